"""Profiles of numeric columns and of peer groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import fold_text
from quillspan.operators.ranks import percentiles


def numeric_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: counts, moments (population deviation), percentiles, Tukey's fences and what lies beyond them.

    Percentiles are exact, by ``ranks.percentiles``; then the statistics, and the counts beyond the fences.
    """
    points = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    stats = []
    for c in columns:
        v = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.count(F.lit(1)).alias("total"), F.count(v).alias("n"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"),
                F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
            ).alias(c)
        )
    one = rows.agg(*stats).first()
    found = percentiles(rows, {"all": []}, {"all": {c: (F.col(c), points) for c in columns}})
    quantiles = {r.measure: r.p for r in found.collect()}
    fences = {}
    for c in columns:
        p = quantiles.get(c)
        if p is not None:
            spread = p[2] - p[0]
            fences[c] = (p[0] - 1.5 * spread, p[2] + 1.5 * spread)
    beyond = rows.agg(*[F.struct(F.count_if(F.col(c).cast("double") < lo).alias("low"), F.count_if(F.col(c).cast("double") > hi).alias("high")).alias(c) for c, (lo, hi) in fences.items()]).first() if fences else {}
    out = []
    for c in columns:
        s, p = one[c], quantiles.get(c) or [None] * 6
        lo, hi = fences.get(c, (None, None))
        low, high = (beyond[c]["low"], beyond[c]["high"]) if c in fences else (0, 0)
        r = lambda x: None if x is None else round(x, 4)
        out.append((c, s["total"], s["n"], s["zero"], s["negative"], r(s["min"]), r(s["max"]), r(s["mean"]), r(s["sd"]), *map(r, p), r(lo), r(hi), low, high))
    kinds = "column string, total long, n long, zero long, negative long, min double, max double, mean double, sd_pop double, p25 double, median double, p75 double, p90 double, p95 double, p99 double, low_fence double, high_fence double, below long, above long"
    return rows.sparkSession.createDataFrame(out, kinds)


def suitability(profile: DataFrame, least_share: float = 0.5) -> DataFrame:
    """A verdict on each profiled column, by a ladder of tests."""
    share = F.col("n") / F.nullif(F.col("total"), F.lit(0))
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("min") == F.col("max"), "constant").when(share < least_share, "sparse")
    verdict = verdict.when((F.col("below") + F.col("above")) > 0.1 * F.col("n"), "heavy tails").otherwise("suitable")
    return profile.select("column", F.round(F.coalesce(share, F.lit(0.0)), 4).alias("filled"), verdict.alias("verdict"))


def peer_viability(works: DataFrame, columns: list[str], least: int = 20) -> DataFrame:
    """(groups, sizes, works in sufficient groups and in none) of one grouping; works with a null key are ungrouped."""
    total = works.count()
    sizes = works.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.round(F.median("n"), 4).alias("median_size"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0)).alias("covered"),
        (F.lit(total) - F.coalesce(F.sum("n"), F.lit(0))).alias("ungrouped"),
    )


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, total, nulls, distinct, min, max) as text, in one pass."""
    stats = [F.struct(F.count(F.lit(1)).alias("total"), F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("distinct_values"), F.min(F.col(c).cast("string")).alias("min"), F.max(F.col(c).cast("string")).alias("max")).alias(c) for c in columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return rows.agg(*stats).select(F.explode(pairs).alias("x")).select("x.column", "x.s.*")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Exact frequencies; a null counts as '(missing)'."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(missing)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def dependency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, values): values of ``a`` with several of ``b``, which a functional dependency would not allow."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.array_join(F.array_sort(F.collect_set(b)), "|").alias("values"), F.countDistinct(b).alias("n")).where("n > 1")


def spelling_variants(rows: DataFrame, column: str) -> DataFrame:
    """(folded, spellings, variants): spellings that fold to the same text."""
    spelt = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("folded", fold_text(F.col(column)))
    return spelt.groupBy("folded").agg(F.array_join(F.array_sort(F.collect_list(column)), "|").alias("spellings"), F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows")).where("variants > 1")
