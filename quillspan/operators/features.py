"""Features of a work: ratios, delays, payment behaviour, status, text, and peer groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import clean_description, token_count
from quillspan.operators.ranks import percentiles
from quillspan.session import scratch

SNAPSHOT = "2026-09-25"
MIN_PEERS = 20
#: Peer groupings: name and columns.
PEERS = {"work_category": ["work_category"], "state": ["state"], "state_work_category": ["state", "work_category"]}
PEER_MEASURES = {"sanction_amount": "sanction_amount", "disbursed_amount": "total_disbursed_all_rows", "payment_count": "payment_count_all_rows"}


def safe_ratio(a: Column, b: Column, places: int = 6) -> Column:
    """a / b, halves to even; null if either is null or b is zero."""
    return F.bround(a.cast("decimal(18,2)") / F.nullif(b.cast("decimal(18,2)"), F.lit(0)), places).cast(f"decimal(24,{places})")


def day_diff(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def work_status(status: Column) -> Column:
    """'completed', 'partial', 'sanctioned', or null without a status; 'incomplete' never reads as complete."""
    low = F.lower(F.nullif(status, F.lit("")))
    full, part = low.contains("complet"), low.contains("partial")
    return F.when(low.contains("incomplete"), "sanctioned").when(full & part, "partial").when(full, "completed").when(low.isNotNull(), "sanctioned")


def status_crosstab(works: DataFrame, paid: DataFrame, key: str = "work_id") -> DataFrame:
    """(status, works, also_completed, also_paid): ``works`` has work_status, in_sanctioned and in_completed; ``paid`` the keys with payments."""
    label = F.when(~F.coalesce(F.col("in_sanctioned"), F.lit(False)), "(no sanctioned record)").otherwise(F.coalesce(F.nullif("work_status", F.lit("")), F.lit("(status missing)")))
    rows = works.join(paid.select(key, F.lit(True).alias("_paid")), key, "left")
    return rows.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("works"), F.count_if("in_completed").alias("also_completed"), F.count_if("_paid").alias("also_paid"))


@dataclass(frozen=True)
class Feature:
    """A registered feature: the expression, its group, and when it may be used ('monitoring', 'retrospective', 'context')."""

    name: str
    make: object
    group: str
    timing: str = "monitoring"


def _c(name: str) -> Column:
    return F.col(name)


def registry(snapshot: str = SNAPSHOT) -> list[Feature]:
    """All features that need one row only; peer features are added by ``peer_features``."""
    at = F.lit(snapshot).cast("date")
    passed = lambda group, *names, timing="monitoring": [Feature(n, _c(n), group, timing) for n in names]
    kind = work_status(_c("work_status"))
    text = clean_description(_c("work_description"))
    span = day_diff(_c("last_expenditure_date"), _c("first_expenditure_date"))
    count = _c("payment_count_all_rows")
    return [
        *passed("context", "work_id", "state", "constituency", "mp_name", "ida", "work_category", "id_mp_code", "id_financial_year", timing="context"),
        *passed("context", "work_status", "in_recommended", "in_sanctioned"),
        *passed("context", "in_completed", timing="retrospective"),
        *passed("financial", "recommended_amount", "sanction_amount"),
        Feature("recommendation_to_sanction_amount_ratio", safe_ratio(_c("sanction_amount"), _c("recommended_amount")), "financial"),
        *passed("financial", "total_disbursed_all_rows", "success_amount", "in_progress_amount", "exact_duplicate_amount", "deduplicated_disbursed_amount"),
        Feature("success_utilization_ratio", safe_ratio(_c("success_amount"), _c("sanction_amount")), "financial"),
        Feature("gross_utilization_ratio", safe_ratio(_c("total_disbursed_all_rows"), _c("sanction_amount")), "financial"),
        Feature("deduplicated_utilization_ratio", safe_ratio(_c("deduplicated_disbursed_amount"), _c("sanction_amount")), "financial"),
        Feature("remaining_sanction_amount", _c("sanction_amount") - _c("deduplicated_disbursed_amount"), "financial"),
        Feature("in_progress_ratio", safe_ratio(_c("in_progress_amount"), _c("total_disbursed_all_rows")), "financial"),
        Feature("duplicate_amount_ratio", safe_ratio(_c("exact_duplicate_amount"), _c("total_disbursed_all_rows")), "financial"),
        Feature("recommendation_to_sanction_days", day_diff(_c("sanction_date"), _c("recommended_date")), "time"),
        Feature("sanction_to_first_payment_days", day_diff(_c("first_expenditure_date"), _c("sanction_date")), "time"),
        Feature("sanction_to_last_payment_days", day_diff(_c("last_expenditure_date"), _c("sanction_date")), "time"),
        Feature("sanction_to_completion_days", day_diff(_c("completion_date"), _c("sanction_date")), "time", "retrospective"),
        Feature("days_since_sanction", day_diff(at, _c("sanction_date")), "time"),
        Feature("days_since_last_payment", day_diff(at, _c("last_expenditure_date")), "time"),
        *passed("transaction", "payment_count_all_rows", "deduplicated_payment_count", "vendor_count", "duplicate_record_count", "duplicate_ratio"),
        Feature("payment_span_days", span, "transaction"),
        Feature("single_payment_work", F.coalesce(count == 1, F.lit(False)), "transaction"),
        Feature("average_payment_interval_days", F.when(count > 1, safe_ratio(span, count - 1)), "transaction"),
        Feature("is_completed", F.coalesce(kind == "completed", F.lit(False)), "completion", "retrospective"),
        Feature("is_partially_completed", F.coalesce(kind == "partial", F.lit(False)), "completion"),
        Feature("is_sanctioned_only", F.coalesce((kind == "sanctioned") & _c("in_sanctioned"), F.lit(False)), "completion"),
        *passed("completion", "completion_date", "completed_amount_disbursed", timing="retrospective"),
        Feature("cleaned_work_description", text, "text", "context"),
        Feature("description_length_chars", F.char_length(text), "text", "context"),
        Feature("description_token_count", token_count(text), "text", "context"),
    ]


def work_features(master: DataFrame, payments: DataFrame, snapshot: str = SNAPSHOT, retrospective: bool = True) -> DataFrame:
    """A row of features for each work, payments joined where there are any. ``retrospective``: also what is known only after completion."""
    df = master.join(payments, "work_id", "left")
    return df.select(*[f.make.alias(f.name) for f in registry(snapshot) if retrospective or f.timing != "retrospective"])


def peer_statistics(works: DataFrame, peers: dict[str, list[str]]) -> DataFrame:
    """(level, key columns, measure, n, p): medians of the peer measures and, as 'rows', the size of each group without a null key."""
    measures = {m: (F.col(c), (0.5,)) for m, c in PEER_MEASURES.items()} | {"rows": (F.lit(0.0), (0.5,))}
    return percentiles(works, peers, dict.fromkeys(peers, measures))


def _groups(stats: DataFrame, columns: list[str], name: str, least: int) -> DataFrame:
    """One level of ``peer_statistics`` as a row for each group."""
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    enough = of("rows", F.col("n")) >= least
    medians = [F.when(enough, of(m, F.round(F.get("p", F.lit(0)), 6))).alias(f"peer_median_{m}_by_{name}") for m in PEER_MEASURES]
    return stats.where(F.col("level") == name).groupBy(*columns).agg(of("rows", F.col("n")).alias(f"peer_count_by_{name}"), enough.alias(f"peer_group_sufficient_by_{name}"), *medians)


def peer_groups(works: DataFrame, columns: list[str], name: str, least: int = MIN_PEERS) -> DataFrame:
    """One row for each group without a null key: size, whether it suffices, and medians if so."""
    return _groups(peer_statistics(works, {name: columns}), columns, name, least)


def peer_features(works: DataFrame, peers: dict[str, list[str]] | None = None, least: int = MIN_PEERS) -> DataFrame:
    """Add the peer columns of each grouping; a null key is in no sufficient group.

    The rows are written once; all groupings are computed from them together, and their tables, a row for each group, are
    joined back. AQE broadcasts those if they are small and splits hot groups if not.
    """
    peers = peers or PEERS
    works = scratch(works, "features")
    stats = scratch(peer_statistics(works, peers), "peers")
    for name, columns in peers.items():
        works = works.join(_groups(stats, columns, name, least), columns, "left")
        works = works.withColumn(f"peer_group_sufficient_by_{name}", F.coalesce(F.col(f"peer_group_sufficient_by_{name}"), F.lit(False)))
    return works
