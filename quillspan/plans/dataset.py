"""The whole build: six raw sources to master, payments, aggregates and audit tables, then features and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.operators import anomaly, features, merge, payments, rowquality
from quillspan.plans.contracts import SOURCES, Source, require_columns
from quillspan.session import scratch

STAGES = {"recommended": "r", "sanctioned": "s", "completed": "c"}


def classified(raw: DataFrame, source: Source) -> DataFrame:
    """Evaluated rows of a source, written once. A hidden total among the valid rows becomes a summary row."""
    rows = scratch(rowquality.evaluate(require_columns(raw, ["source_row", *source.columns], source.name), source), source.name)
    counted = rows.where("category <> 'summary'").select("source_row", source.amount, "category")
    totals = rowquality.hidden_total(counted, source.amount, F.col("category") == "valid").where("is_total").select("source_row", F.lit(True).alias("_total"))
    rows = rows.join(totals, "source_row", "left")
    hit = F.col("_total").isNotNull()
    return rows.withColumn("reason", F.when(hit, "aggregate_total").otherwise(F.col("reason"))).withColumn("category", F.when(hit, "summary").otherwise(F.col("category"))).drop("_total")


def content(source: Source) -> Column:
    """What a row says, serial number and place apart: equal for exact repeats. A bad cell counts by its raw text."""
    parts = []
    for c, kind in source.columns.items():
        if c == source.key:
            parts.append(F.coalesce(F.col("key__p.key"), F.concat(F.lit("!"), F.col(f"{c}__raw"))))
        elif kind in ("date", "amount"):
            parts.append(F.coalesce(F.col(c).cast("string"), F.when(F.col(f"{c}__p.status") == "invalid", F.concat(F.lit("!"), F.col(f"{c}__raw"))), F.lit("")))
        else:
            parts.append(F.coalesce(F.col(c), F.lit("")))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _audit(rows: dict[str, DataFrame], category: str) -> DataFrame:
    parts = []
    for name, df in rows.items():
        source = SOURCES[name]
        error = F.col("key__p.error") if source.key else F.lit(None).cast("string")
        cell = lambda c: F.substring(f"{c}__raw", 1, 50) if category == "summary" else F.col(f"{c}__raw")
        values = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(cell(c), F.lit(""))) for c in source.columns])
        parts.append(df.where(F.col("category") == category).select(F.lit(name).alias("source"), "source_row", "reason", error.alias("error"), values.alias("row_values")))
    return reduce(DataFrame.unionByName, parts)


def build(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Outputs by name from raw tables of all-text columns with ``source_row``.

    ``raw``: recommended, sanctioned, completed and expenditure; allocation and calamity if there are any.
    """
    rows = {name: scratch(classified(df, SOURCES[name]), name) for name, df in raw.items()}
    out = {"summary_rows": _audit(rows, "summary")}
    keyed = {n: df for n, df in rows.items() if SOURCES[n].key}
    out["malformed_ids"], out["unkeyed_recommendations"] = _audit(keyed, "malformed"), _audit(keyed, "unkeyed")
    kept, repeats = {}, []
    for name in STAGES:
        source = SOURCES[name]
        exact = {c: k in ("date", "amount") for c, k in source.columns.items()}
        valid = rows[name].where("category = 'valid'").select(F.col("key__p.key").alias("work_id"), "source_row", *source.columns)
        first, found = rowquality.resolve_repeats(valid, "work_id", "source_row", exact)
        kept[name] = first.join(valid.groupBy("work_id").agg(F.count(F.lit(1)).alias("row_count")), "work_id")
        repeats.append(found.select(F.lit(name).alias("source"), *found.columns))
    out["work_id_duplicates"] = reduce(DataFrame.unionByName, repeats)
    paid = rows["expenditure"].where("category = 'valid'").withColumn("_content", content(SOURCES["expenditure"]))
    paid = payments.flag_repeats(paid, ["_content"], ["source_row"])
    columns = [c for c in SOURCES["expenditure"].columns if c != "work_id"]
    out["expenditure_transactions"] = scratch(paid.select(F.col("key__p.key").alias("work_id"), *columns, "source_row", "duplicate_record"), "transactions")
    out["expenditure_by_work"] = scratch(payments.payments_by_work(out["expenditure_transactions"], amount="fund_disbursed_amount", day="expenditure_date", vendor="vendor_name", status="payment_status"), "by_work")
    out["works_master"] = scratch(merge.merge_stages(*[kept[n] for n in STAGES]), "master")
    dated = kept["recommended"].where("sanction_date is not null")
    flags = merge.presence({tag: kept[n] for n, tag in STAGES.items()} | {"e": out["expenditure_by_work"], "d": dated})
    out["presence"] = scratch(flags, "presence")
    out["containment"], out["join_unmatched_ids"] = merge.containment_checks(out["presence"]), merge.unmatched_ids(out["presence"])
    out["conflicts"] = merge.conflict_counts(out["works_master"])
    spent = out["expenditure_by_work"].select("work_id", "first_expenditure_date", "total_disbursed")
    out["checks"] = merge.cross_checks(out["works_master"].join(spent, "work_id", "left"))
    for name, output in (("allocation", "mp_allocated_limits"), ("calamity", "calamity_consents")):
        if name in rows:
            df = rows[name].where("category = 'valid'").withColumn("_content", content(SOURCES[name]))
            out[output] = payments.flag_repeats(df, ["_content"], ["source_row"]).select(*SOURCES[name].columns, "source_row", "duplicate_record")
    return out


def score(outputs: dict[str, DataFrame], snapshot: str = features.SNAPSHOT) -> DataFrame:
    """Features and review priority of every work of a build."""
    rows = features.work_features(outputs["works_master"], outputs["expenditure_by_work"].drop("total_disbursed", "payment_count"), snapshot)
    return anomaly.score(anomaly.prepare(features.peer_features(rows)))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with source_row from 1, for a source that has no row numbers of its own."""
    return df.withColumn("source_row", F.row_number().over(W.orderBy(order)))
