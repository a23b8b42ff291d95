"""Command line: python -m quillspan.cli build|features|anomalies|duplicates|inspect|serve."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import anomaly, compliance, duplicates, features, payments, serve
from quillspan.plans import dataset
from quillspan.plans.contracts import SOURCES, bind_columns
from quillspan.session import local_session
from quillspan.sources import reports, tables, xlsx


def raw_sources(spark: SparkSession, folder: str, limit: int | None = None) -> dict[str, DataFrame]:
    """The sources that a folder has, as <name>.xlsx, <name>.csv or <name>.parquet; a CSV or Parquet source brings source_row."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda path: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = {}
    for name, source in SOURCES.items():
        aliases = {c: source.aliases.get(c, []) for c in source.columns}
        base = f"{folder.rstrip('/')}/{name}"
        if there(f"{base}.xlsx"):
            df = xlsx.read_workbooks(spark, f"{base}.xlsx", aliases, source.required)
        elif there(f"{base}.csv"):
            df = bind_columns(tables.read_csv(spark, f"{base}.csv"), aliases, source.required).withColumn("source_row", F.col("source_row").cast("int"))
        elif there(f"{base}.parquet"):
            df = bind_columns(spark.read.parquet(f"{base}.parquet"), aliases, source.required)
        else:
            continue
        out[name] = tables.limit_rows(df, limit) if limit else df
    return out


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def build(spark: SparkSession, args) -> dict:
    """All outputs of a build as CSV and Parquet, demo tables, the quality report and the dictionary; fails if a source changes meanwhile."""
    marks = lambda: sorted(map(tuple, xlsx.fingerprints(spark, f"{args.raw.rstrip('/')}/*.xlsx").collect())) if args.workbooks else []
    before = marks()
    outputs = dataset.build(raw_sources(spark, args.raw, args.limit_rows))
    profiles = {}
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{args.out}/parquet/{name}")
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        profiles[name] = tables.write_csv(flat, f"{args.out}/csv/{name}")
    own = {n: outputs[n] for n in ("works_master", "expenditure_by_work", "expenditure_transactions")}
    for name, df in serve.demo_tables(own, "works_master", "expenditure_by_work", args.demo_seed, args.demo_size).items():
        tables.write_csv(df, f"{args.out}/demo/{name}")
    _write(spark, f"{args.out}/quality.md", reports.quality_report(outputs))
    _write(spark, f"{args.out}/dictionary.md", reports.data_dictionary(outputs))
    _write(spark, f"{args.out}/profile.json", json.dumps(profiles, indent=1, default=str))
    if marks() != before:
        raise RuntimeError("a source changed while it was read")
    return {name: p["rows"] for name, p in profiles.items()}


def _built(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{out}/parquet/{n}") for n in ("works_master", "expenditure_by_work", "expenditure_transactions")}


def make_features(spark: SparkSession, args) -> dict:
    """Features and peers of every work, and their profile."""
    own = _built(spark, args.out)
    rows = features.work_features(own["works_master"], own["expenditure_by_work"].drop("total_disbursed", "payment_count"), args.snapshot)
    features.peer_features(rows).write.mode("overwrite").parquet(f"{args.out}/parquet/features")
    rows = spark.read.parquet(f"{args.out}/parquet/features")
    _write(spark, f"{args.out}/features.md", reports.profiling_report(rows, ["sanction_amount", "success_utilization_ratio", "days_since_sanction", "payment_count_all_rows"]))
    return {"features": rows.count()}


def make_anomalies(spark: SparkSession, args) -> dict:
    """Review scores of every work, compliance masks, and the report on the scores."""
    rows = spark.read.parquet(f"{args.out}/parquet/features")
    anomaly.score(anomaly.prepare(rows)).write.mode("overwrite").parquet(f"{args.out}/parquet/scored")
    scored = spark.read.parquet(f"{args.out}/parquet/scored")
    _write(spark, f"{args.out}/scores.md", reports.engine_report(scored))
    own = _built(spark, args.out)
    late = payments.late_payments(own["works_master"], own["expenditure_transactions"], day="expenditure_date", amount="fund_disbursed_amount").select("work_id", F.col("post_completion_count").alias("late_payments"))
    compliance.rule_mask(compliance.rule_inputs(own["works_master"], own["expenditure_by_work"], late), args.snapshot).write.mode("overwrite").parquet(f"{args.out}/parquet/masked")
    return {"scored": scored.count()}


def make_duplicates(spark: SparkSession, args) -> dict:
    """Pairs worth review and the clusters of the high ones."""
    own = _built(spark, args.out)["works_master"]
    works = duplicates.prepare(own.select(F.col("work_id").alias("id"), "state", "constituency", F.col("work_category").alias("category"), F.col("work_description").alias("description"), F.coalesce("sanction_amount", "recommended_amount").alias("amount"), F.coalesce("sanction_date", "recommended_date").alias("day")))
    works.write.mode("overwrite").parquet(f"{args.out}/parquet/described")
    works = spark.read.parquet(f"{args.out}/parquet/described")
    found = duplicates.explained(duplicates.retained_pairs(duplicates.score_pairs(duplicates.candidate_pairs(works), works)))
    found.write.mode("overwrite").parquet(f"{args.out}/parquet/pairs")
    pairs = spark.read.parquet(f"{args.out}/parquet/pairs")
    duplicates.high_clusters(pairs).write.mode("overwrite").parquet(f"{args.out}/parquet/clusters")
    return duplicates.duplicate_summary(pairs).first().asDict()


def inspect(spark: SparkSession, args) -> dict:
    """The first rows of every sheet of the workbooks in a folder."""
    rows = xlsx.inspect_workbooks(spark, f"{args.raw.rstrip('/')}/*.xlsx", args.rows).collect()
    for r in rows:
        print(os.path.basename(r.file), r.sheet, r.source_row, r.cells, sep="\t")
    return {"rows": len(rows)}


def run_server(spark: SparkSession, args) -> dict:
    """Answer requests until interrupted."""
    from quillspan.serving import api

    own = {"features": "features", "master": "works_master", "payments": "expenditure_by_work", "scored": "scored", "pairs": "pairs", "masked": "masked"}
    fs = spark._jvm.org.apache.hadoop.fs.Path(args.out).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {k: spark.read.parquet(f"{args.out}/parquet/{n}") for k, n in own.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{args.out}/parquet/{n}"))}
    api.server(api.Reads(found), args.port).serve_forever()
    return {}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run a command; prints its counts as JSON."""
    parser = argparse.ArgumentParser(prog="quillspan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = lambda name, run: commands.add_parser(name, help=run.__doc__.splitlines()[0])
    b = one("build", build)
    b.add_argument("--raw", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--limit-rows", type=int)
    b.add_argument("--demo-size", type=int, default=500)
    b.add_argument("--demo-seed", default="demo")
    b.add_argument("--workbooks", action="store_true", help="compare the workbooks' fingerprints before and after")
    for name, run in (("features", make_features), ("anomalies", make_anomalies), ("duplicates", make_duplicates)):
        p = one(name, run)
        p.add_argument("--out", required=True)
        p.add_argument("--snapshot", default=features.SNAPSHOT)
    i = one("inspect", inspect)
    i.add_argument("--raw", required=True)
    i.add_argument("--rows", type=int, default=8)
    s = one("serve", run_server)
    s.add_argument("--out", required=True)
    s.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    run = {"build": build, "features": make_features, "anomalies": make_anomalies, "duplicates": make_duplicates, "inspect": inspect, "serve": run_server}[args.command]
    out = run(spark or local_session("*"), args)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
