"""Payments: aggregates by work, histograms, status totals, payments after completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Payments-per-work classes: upper bounds and names.
CLASSES = [(1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (None, "21+")]


def flag_repeats(rows: DataFrame, signature: list[str], order: list[str], name: str = "duplicate_record") -> DataFrame:
    """Mark the second and later rows of each content signature, in the order given."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*signature).orderBy(*order)) > 1)


def _total(value: Column, when: Column | None = None) -> Column:
    """A sum that is zero, not null, over no rows."""
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("decimal(28,2)")


def payments_by_work(rows: DataFrame, key: str = "work_id", amount: str = "amount", day: str = "day", vendor: str = "vendor", status: str = "status", repeat: str = "duplicate_record", success: str = "Payment Success", in_progress: str = "Payment In-Progress") -> DataFrame:
    """One row for each work: 17 measures over its payments, repeats included and excluded.

    Payments are first added up by work and vendor, then by work, where each vendor is a row: distinct vendors need no copy of
    the rows, and a work with many payments is spread over its vendors.
    """
    a, r = F.col(amount).cast(MONEY), F.coalesce(F.col(repeat), F.lit(False))
    some = {
        "total_disbursed_all_rows": _total(a),
        "success_amount": _total(a, F.col(status) == success),
        "in_progress_amount": _total(a, F.col(status) == in_progress),
        "exact_duplicate_amount": _total(a, r),
        "deduplicated_disbursed_amount": _total(a, ~r),
        "payment_count_all_rows": F.count(F.lit(1)),
        "deduplicated_payment_count": F.count_if(~r),
        "duplicate_record_count": F.count_if(r),
        "amount_missing_count": F.count_if(F.col(amount).isNull()),
        "date_missing_count": F.count_if(F.col(day).isNull()),
        "negative_amount_count": F.count_if(a < 0),
    }
    parts = rows.groupBy(F.col(key), F.col(vendor).alias("_vendor")).agg(*[v.alias(k) for k, v in some.items()], F.min(day).alias("first_expenditure_date"), F.max(day).alias("last_expenditure_date"))
    add = lambda k: F.sum(k).cast("decimal(28,2)" if k.endswith(("amount", "all_rows")) and not k.startswith("payment") else "long").alias(k)
    out = parts.groupBy(key).agg(*[add(k) for k in some], F.min("first_expenditure_date").alias("first_expenditure_date"), F.max("last_expenditure_date").alias("last_expenditure_date"), F.count("_vendor").alias("vendor_count"))
    share = F.bround(F.col("duplicate_record_count").cast(MONEY) / F.col("payment_count_all_rows").cast(MONEY), 4)
    return out.withColumn("total_disbursed", F.col("total_disbursed_all_rows")).withColumn("payment_count", F.col("payment_count_all_rows")).withColumn("duplicate_ratio", share.cast("decimal(8,4)"))


def payment_classes(by_work: DataFrame, count: str = "payment_count_all_rows") -> DataFrame:
    """Works by how many payments they have."""
    label = None
    for top, name in CLASSES[:-1]:
        label = (F.when if label is None else label.when)(F.col(count) <= top, name)
    return by_work.groupBy(label.otherwise(CLASSES[-1][1]).alias("payments")).agg(F.count(F.lit(1)).alias("works"), F.sum(count).alias("payment_rows"))


def busiest_work(by_work: DataFrame, key: str = "work_id", count: str = "payment_count_all_rows") -> DataFrame:
    """The work with most payments; of several the smallest key."""
    return by_work.orderBy(F.desc(count), key).limit(1).select(key, count)


def status_totals(rows: DataFrame, status: str = "status", amount: str = "amount") -> DataFrame:
    """Rows and sum for each status; a missing one is '(missing)'."""
    return rows.groupBy(F.coalesce(F.col(status), F.lit("(missing)")).alias("payment_status")).agg(F.count(F.lit(1)).alias("payments"), _total(F.col(amount).cast(MONEY)).alias("amount"))


def late_payments(works: DataFrame, rows: DataFrame, key: str = "work_id", completion: str = "completion_date", day: str = "day", amount: str = "amount", grace: int = 30) -> DataFrame:
    """Payments more than ``grace`` days after completion, by work: their number, sum and longest delay."""
    done = works.where(F.col(completion).isNotNull()).select(key, completion)
    delay = F.datediff(F.col(day), F.col(completion))
    late = rows.select(key, day, amount).join(done, key).where(delay > grace)
    return late.groupBy(key).agg(F.count(F.lit(1)).alias("post_completion_count"), _total(F.col(amount).cast(MONEY)).alias("post_completion_amount"), F.max(delay).alias("max_days_after_completion"))
