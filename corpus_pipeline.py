"""A corpus pipeline: each stage takes documents and returns the documents that it keeps, as it leaves them.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents, whatever further ones come in.

A row is judged as a row: ids may be null or repeat, and no stage joins its decisions back by them. Null and empty texts are
clean; an empty table stays one; very long texts are read in stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontam, nearcopies, substring, toxicity
from quillspan.session import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text the classifier, fitted on labels that aren't held out, calls toxic. Rows of equal texts share their fate."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: sets of five-word shingles at 0.8 or more.

    SimHash only discards candidates; each link is verified by the Jaccard similarity of the sets before groups are formed. The
    row of the smallest id stays; null ids come last, and of several rows of that id a hash of the row decides, so of equal
    rows one is left. A document without words is no copy of another: it is kept. Only rows that go are joined to the texts.
    """
    missing = F.col("doc_id").isNull()
    row = F.struct(missing.alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*COLUMNS).alias("hash"))
    own = docs.select(*COLUMNS, row.alias("row"))
    groups = scratch(nearcopies.near_copy_groups(own.select("row", "text"), key="row", shingle=5), "groups")
    kept = own.join(groups.where("row > component_id").select("row").distinct(), "row", "left_anti")
    again = groups.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    if again.limit(1).count():
        again = scratch(again, "again")
        kept = kept.join(again, "row", "left_anti").unionByName(kept.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a row with a smaller id has; a row that loses all its words goes.

    Rows of one id don't cut each other; a row without an id keeps all and cuts nothing.
    """
    kept = substring.remove_repeats(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds an item of the benchmark."""
    return decontam.without_items(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: a row for each row."""
    return bpe.encode_decode(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", toxic_stage),
    ("simhash near-dedup", near_copy_stage),
    ("substring dedup", passage_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding and decoding", token_stage),
]

#: SQL has no trees, XXH64 or BPE: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
