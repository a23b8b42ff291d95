"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.session import scratch

#: A ranking of n rows uses this many times sqrt(n) sort groups: both a group and the list of groups stay near sqrt(n).
GROUPS = 4


def shuffle_key(seed: int, key: str) -> Column:
    """A seeded pseudo-random number of 60 bits for each key, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Rank from 0 within ``group`` by (bucket, order): the rows of earlier buckets, plus the rank inside the bucket.

    Only counts of a bucket are gathered by group, so a group with any share of the rows is still dealt out.
    """
    df = df.withColumn("__qs_bucket", bucket)
    keys = [*group, "__qs_bucket"]
    before = W.partitionBy(*group).orderBy("__qs_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__qs_n"))
    starts = counts.select(*keys, F.coalesce(F.sum("__qs_n").over(before), F.lit(0)).alias("__qs_start"))
    inside = df.withColumn("__qs_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    starts = starts.select(*[F.col(k).alias(f"__qs_r{i}") for i, k in enumerate(keys)], "__qs_start")
    same = [F.col(k).eqNullSafe(F.col(f"__qs_r{i}")) for i, k in enumerate(keys)]
    joined = inside.join(starts, same)
    return joined.withColumn(name, F.col("__qs_start") + F.col("__qs_i")).drop("__qs_start", "__qs_i", "__qs_bucket", *[f"__qs_r{i}" for i in range(len(keys))])


def interleave(docs: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", seed: int = 7, groups: int = GROUPS) -> DataFrame:
    """Give each row a shard and a slot; all columns of ``docs`` stay.

    Rows are put in seeded random order within their stratum; the row of rank r among n has the fractional
    rank (r + u) / n, u being its shuffle number as a fraction of one, which spreads the rows of many small strata. All rows are
    sorted by it (ties: stratum, shuffle number, key, a hash of the row) and cut into ``shards`` runs whose sizes differ by
    one at most, so each shard holds each stratum in proportion.

    Null strata are a stratum of their own. Rows with a null or repeated key keep a place of their own, in the order of a hash
    of all their columns; equal rows are interchangeable. Texts are never compared, however long. An empty table gives an
    empty result. Columns of ``docs`` named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    total = docs.count()
    buckets = 1 + groups * math.isqrt(total)
    top = 1 << 60
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    # A null key is no number: such rows are dealt by their hash.
    once = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("-"), row.cast("string")))
    df = docs.withColumns({"__qs_row": row, "__qs_key": once})
    df = df.withColumn("__qs_h", shuffle_key(seed, "__qs_key"))
    df = _ranked(df, [stratum], (F.col("__qs_h") / F.lit(top) * F.lit(buckets)).cast("int"), ["__qs_h", "__qs_key", "__qs_row"], "__qs_rank")
    sizes = docs.groupBy(stratum).agg(F.count(F.lit(1)).alias("__qs_n")).withColumnRenamed(stratum, "__qs_s")
    df = df.join(sizes, F.col(stratum).eqNullSafe(F.col("__qs_s"))).withColumn("__qs_f", (F.col("__qs_rank") + F.col("__qs_h") / F.lit(top)) / F.col("__qs_n"))
    df = scratch(df.drop("__qs_s", "__qs_n", "__qs_rank"), "shards")
    df = df.withColumn("__qs_all", F.lit(0))
    df = _ranked(df, ["__qs_all"], (F.col("__qs_f") * F.lit(buckets)).cast("int"), ["__qs_f", F.col(stratum).asc_nulls_first(), "__qs_h", "__qs_key", "__qs_row"], "__qs_pos")
    df = df.withColumn("shard", F.expr(f"cast((__qs_pos * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return df.withColumn("slot", F.col("__qs_pos") - first).drop("__qs_h", "__qs_f", "__qs_pos", "__qs_all", "__qs_key", "__qs_row")


def op9(spark, sf_dir: str) -> DataFrame:
    """The query: documents into 40 shards by the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return interleave(slim, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
