"""Gap-free monthly series of milestones and payments, national and by scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MILESTONES = ["recommended", "sanctioned", "completed"]
MEASURES = [*MILESTONES, "payments", "paid_amount", "success_payments", "success_amount"]


def milestone_events(works: DataFrame, scope: str = "state") -> DataFrame:
    """(scope, day, recommended, sanctioned, completed, ...): one row for each dated milestone.

    A recommendation counts unless in_recommended is false; the others need a date only.
    """
    parts = []
    for m, column in zip(MILESTONES, ("recommended_date", "sanction_date", "completion_date")):
        df = works.where(F.coalesce(F.col("in_recommended"), F.lit(True))) if m == "recommended" else works
        parts.append(df.select(F.col(scope).alias("scope"), F.col(column).cast("date").alias("day"), F.lit(m).alias("kind"), F.lit(None).cast("decimal(18,2)").alias("amount"), F.lit(False).alias("success")))
    return reduce(DataFrame.unionByName, parts).where("day is not null")


def payment_events(rows: DataFrame, scope: str = "state", day: str = "day", amount: str = "amount", success: str = "success") -> DataFrame:
    """The same for payments; repeats count, and an amount that is missing counts as zero."""
    return rows.select(F.col(scope).alias("scope"), F.col(day).cast("date").alias("day"), F.lit("payment").alias("kind"), F.coalesce(F.col(amount).cast("decimal(18,2)"), F.lit(0)).cast("decimal(18,2)").alias("amount"), F.coalesce(F.col(success), F.lit(False)).alias("success")).where("day is not null")


def _measures() -> list:
    paid = F.col("kind") == "payment"
    total = lambda w: F.coalesce(F.sum(F.when(w, F.col("amount"))), F.lit(0)).cast("decimal(28,2)")
    return [
        *[F.count_if(F.col("kind") == m).alias(m) for m in MILESTONES],
        F.count_if(paid).alias("payments"),
        total(paid).alias("paid_amount"),
        F.count_if(paid & F.col("success")).alias("success_payments"),
        total(paid & F.col("success")).alias("success_amount"),
    ]


def monthly(events: DataFrame) -> DataFrame:
    """(scope, is_total, month, measures): every scope's months and the national ones, in one pass by grouping sets.

    Events without a scope count nationally only.
    """
    df = events.withColumn("month", F.trunc("day", "month").cast("date"))
    both = df.groupingSets([["month"], ["scope", "month"]], "scope", "month").agg(F.grouping("scope").cast("boolean").alias("is_total"), *_measures())
    return both.where("is_total or scope is not null")


def densify(series: DataFrame) -> DataFrame:
    """Every month between a scope's first and last, with zeros where nothing happened."""
    scope = ["is_total", "scope"]
    span = series.groupBy(*scope).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select(*scope, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    s, m = series.alias("s"), months.alias("m")
    same = F.col("m.scope").eqNullSafe(F.col("s.scope")) & (F.col("m.is_total") == F.col("s.is_total")) & (F.col("m.month") == F.col("s.month"))
    return m.join(s, same, "left").select("m.is_total", "m.scope", "m.month", *[F.coalesce(F.col(f"s.{c}"), F.lit(0)).cast(series.schema[c].dataType).alias(c) for c in MEASURES])


def trend(events: DataFrame, scope: str | None = None) -> DataFrame:
    """The dense national series, or that of one scope, with the month as YYYY-MM."""
    series = monthly(events if scope is None else events.where(F.col("scope") == scope))
    series = series.where("is_total" if scope is None else "not is_total")
    return densify(series).select(F.date_format("month", "yyyy-MM").alias("period"), *MEASURES)


def series_totals(series: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sums over all months."""
    return series.groupBy(*by).agg(*[F.sum(c).alias(c) for c in MEASURES])
