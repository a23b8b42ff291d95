"""Reads for a service: filters, sorts with nulls last, pages, lookups and hydration of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import scratch


class BadRequest(ValueError):
    """A sort or page that can't be."""


class NotFound(KeyError):
    """No row has the key."""


class Unavailable(RuntimeError):
    """A table that a request needs isn't there."""


def rows_of(page: DataFrame) -> list[dict]:
    """The rows of a page or of a small aggregate."""
    return [r.asDict(recursive=True) for r in page.collect()]


def where_in(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Rows that have one of the values in each column, in any case; empty lists don't filter."""
    for column, values in filters.items():
        if values:
            df = df.where(F.lower(F.trim(F.col(column).cast("string"))).isin([v.strip().lower() for v in values]))
    return df


def where_between(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within the limits; a null is within none."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df.where(F.col(column) <= high) if high is not None else df


def parse_sort(text: str, allowed: list[str], most: int = 3) -> list[tuple[str, bool]]:
    """(field, descending) of '-score,state'; three fields at most, each once."""
    keys = [(part.strip().lstrip("-"), part.strip().startswith("-")) for part in text.split(",") if part.strip()]
    names = [k for k, _ in keys]
    if not keys or len(keys) > most or len(set(names)) != len(names) or any(n not in allowed for n in names):
        raise BadRequest(f"sort must name one to {most} of: {', '.join(allowed)}")
    return keys


def sort_rows(df: DataFrame, keys: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Sorted by keys, nulls last either way, texts in any case, ties by ``tie`` ascending."""
    kinds = dict(df.dtypes)
    order = []
    for name, down in keys:
        c = F.lower(name) if kinds[name] == "string" else F.col(name)
        order.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return df.orderBy(*order, tie)


def page(df: DataFrame, number: int = 1, size: int = 25, most: int = 200) -> DataFrame:
    """One page of sorted rows, from 1; beyond the end it is empty."""
    if number < 1 or not 1 <= size <= most:
        raise BadRequest(f"pages count from 1 and hold 1 to {most} rows")
    return df.offset((number - 1) * size).limit(size)


def clamped_page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """Like ``page``, but a page beyond the end is the last one."""
    last = max(1, -(-df.count() // size))
    return page(df.orderBy(*order), min(max(1, number), last), size)


def lookup(df: DataFrame, key: str, value) -> dict:
    """The row of a key."""
    row = df.where(F.col(key) == value).limit(1).collect()
    if not row:
        raise NotFound(value)
    return row[0].asDict(recursive=True)


#: Groups of the detail view, with the columns of each.
DETAIL = {
    "identity": "state constituency mp_name ida work_category work_status id_mp_code id_financial_year".split(),
    "flags": "in_recommended in_sanctioned in_completed is_completed is_partially_completed is_sanctioned_only".split(),
    "amounts": "recommended_amount sanction_amount total_disbursed_all_rows success_amount in_progress_amount exact_duplicate_amount deduplicated_disbursed_amount remaining_sanction_amount completed_amount_disbursed".split(),
    "utilization": "success_utilization_ratio gross_utilization_ratio deduplicated_utilization_ratio in_progress_ratio".split(),
    "payments": "payment_count_all_rows deduplicated_payment_count vendor_count duplicate_record_count duplicate_ratio duplicate_amount_ratio single_payment_work payment_span_days average_payment_interval_days".split(),
    "timeline": "completion_date recommendation_to_sanction_days sanction_to_first_payment_days sanction_to_last_payment_days sanction_to_completion_days days_since_sanction days_since_last_payment".split(),
}
PEER_LEVELS = ("work_category", "state", "state_work_category")


def detail_rows(features: DataFrame, master: DataFrame | None = None, payments: DataFrame | None = None, scored: DataFrame | None = None, key: str = "work_id") -> DataFrame:
    """A row for each work with its details in groups, from up to four tables; what a table lacks is null.

    review_status: 'scored', 'not_scored', or 'unavailable' without a table of scores. A filter on the key reaches each scan.
    """
    have = set(features.columns)
    pick = lambda columns: [F.col(f"f.{c}").alias(c) if c in have else F.lit(None).alias(c) for c in columns]
    df = features.alias("f")
    said = [F.lit(None).cast("string").alias("work"), *[F.lit(None).cast("date").alias(c) for c in ("recommended_date", "sanction_date")]]
    if master is not None:
        some = {c: F.col(c).cast(t) if c in master.columns else F.lit(None).cast(t) for c, t in (("work", "string"), ("recommended_date", "date"), ("sanction_date", "date"))}
        own = master.select(F.col(key).alias("_m"), *[v.alias(f"m_{c}") for c, v in some.items()])
        df = df.join(own, F.col(f"f.{key}") == F.col("_m"), "left")
        said = [F.col(f"m_{c}").alias(c) for c in some]
    paid = [F.lit(None).cast("date").alias(c) for c in ("first_payment_date", "last_payment_date")]
    if payments is not None:
        own = payments.select(F.col(key).alias("_p"), F.col("first_expenditure_date").alias("p_first"), F.col("last_expenditure_date").alias("p_last"))
        df = df.join(own, F.col(f"f.{key}") == F.col("_p"), "left")
        paid = [F.col("p_first").alias("first_payment_date"), F.col("p_last").alias("last_payment_date")]
    status, review = F.lit("unavailable"), F.lit(None).cast("struct<score:double,label:string,signals:int,explanation:string>")
    if scored is not None:
        own = scored.select(F.col(key).alias("_s"), F.struct(F.col("review_priority_score").cast("double").alias("score"), F.col("review_priority_label").alias("label"), F.col("signal_count").alias("signals"), F.col("explanation_text").alias("explanation")).alias("s_review"))
        df = df.join(own, F.col(f"f.{key}") == F.col("_s"), "left")
        status, review = F.when(F.col("_s").isNotNull(), "scored").otherwise("not_scored"), F.col("s_review")
    groups = {g: F.struct(*pick(columns)) for g, columns in DETAIL.items()}
    groups["identity"] = F.struct(said[0], *pick(["cleaned_work_description"]), *pick(DETAIL["identity"]))
    groups["timeline"] = F.struct(*said[1:], *paid, *pick(DETAIL["timeline"]))
    if any(c.startswith("peer_count_by_") for c in have):
        names = {"peer_count": "peer_count_by_", "sufficient": "peer_group_sufficient_by_", "median_sanction_amount": "peer_median_sanction_amount_by_", "median_disbursed_amount": "peer_median_disbursed_amount_by_", "median_payment_count": "peer_median_payment_count_by_"}
        groups["peers"] = F.struct(*[F.struct(*[F.col(f"f.{p}{level}").alias(n) for n, p in names.items()]).alias(level) for level in PEER_LEVELS])
    return df.select(F.col(f"f.{key}").alias(key), *[v.alias(g) for g, v in groups.items()], status.alias("review_status"), review.alias("review"))


def work_detail(value, features: DataFrame, master: DataFrame | None = None, payments: DataFrame | None = None, scored: DataFrame | None = None, key: str = "work_id") -> dict:
    """The details of one work, nested."""
    one = lambda df: None if df is None else df.where(F.col(key) == value)
    return lookup(detail_rows(one(features), one(master), one(payments), one(scored), key), key, value)


def demo_tables(tables: dict[str, DataFrame], master: str, paid: str, seed: str, n: int, key: str = "work_id") -> dict[str, DataFrame]:
    """Each table's rows of the ``n`` sampled works: those that are in the tables ``master`` and ``paid``, by ``seeded_sample``. The sample's keys are written once."""
    both = tables[master].select(key).where(F.col(key).isNotNull()).distinct().join(tables[paid].select(key), key, "left_semi")
    ids = scratch(seeded_sample(both, key, seed, n), "demo")
    return {name: df.join(ids, key, "left_semi") for name, df in tables.items()}


def where_pairs(pairs: DataFrame, priority: str | None = None, batch: bool | None = False, least: float | None = None, text: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Pairs by priority, by whether they are links of a batch (by default none), score, and a text in ``fields``."""
    if priority:
        pairs = pairs.where(F.lower("review_priority").contains(priority.lower()))
    if batch is not None:
        pairs = pairs.where(F.col("is_batch") == F.lit(batch))
    pairs = where_between(pairs, "score", least)
    return pairs.where(reduce(lambda a, b: a | b, [F.lower(f).contains(text.lower()) for f in fields])) if text else pairs


#: Orders of pairs: by score, largest amount or date gap, where no gap counts as 9999 days.
PAIR_ORDERS = {
    "score_desc": lambda: [F.desc("score")],
    "score_asc": lambda: [F.asc("score")],
    "amount_desc": lambda: [F.greatest("amount_a", "amount_b").desc_nulls_last()],
    "gap_asc": lambda: [F.coalesce(F.col("date_gap_days"), F.lit(9999)).asc()],
}


def sort_pairs(pairs: DataFrame, order: str = "score_desc") -> DataFrame:
    """Pairs in one of PAIR_ORDERS; ties by both ids."""
    if order not in PAIR_ORDERS:
        raise BadRequest(f"order must be one of: {', '.join(PAIR_ORDERS)}")
    return pairs.orderBy(*PAIR_ORDERS[order](), "id_a", "id_b")


def hydrate(pairs: DataFrame, works: DataFrame, columns: list[str], key: str = "work_id") -> DataFrame:
    """Pairs with columns of both works, suffixed _a and _b."""
    for end in ("a", "b"):
        own = works.select(F.col(key).alias(f"id_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(own, f"id_{end}", "left")
    return pairs


def fill_absent(rows: DataFrame, features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with those of ``columns`` that it lacks taken from ``features``."""
    lost = [c for c in columns if c not in rows.columns]
    return rows.join(features.select(key, *lost), key, "left") if lost else rows


def dashboard(works: DataFrame, amount: str = "sanction_amount", paid: str = "disbursed") -> DataFrame:
    """One row of totals over all works."""
    money = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)")
    return works.agg(F.count(F.lit(1)).alias("works"), money(amount).alias("sanctioned_total"), money(paid).alias("disbursed_total"), F.count_if("is_completed").alias("completed"))


def counts_by(works: DataFrame, column: str) -> DataFrame:
    """(value, works), the most frequent first, then by value."""
    return works.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("works")).orderBy(F.desc("works"), "value")


def top_groups(works: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The n most frequent values."""
    return counts_by(works, column).limit(n)


def snapshot_date(works: DataFrame, day: str = "sanction_date", since: str = "days_since_sanction") -> DataFrame:
    """The most frequent of day + since; of several the earliest."""
    found = works.select(F.date_add(day, F.col(since).cast("int")).alias("snapshot")).where("snapshot is not null")
    return found.groupBy("snapshot").agg(F.count(F.lit(1)).alias("works")).orderBy(F.desc("works"), "snapshot").limit(1)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The n rows of the smallest SHA-256 of seed and key: the same rows on any cluster."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)
