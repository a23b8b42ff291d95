"""Text tables: CSV in two encodings, contracts on load, sinks with a profile, and reloads when files change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.rowquality import first_rows
from quillspan.plans.contracts import require_columns, require_unique

_CONTROLS = "".join(chr(i) for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore"))
_SIGNS = "".join(bytes([ord(c)]).decode("cp1252") for c in _CONTROLS)


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV with a header, all columns text, in the first encoding that leaves no replacement character; no types are guessed.

    Spark allows no other charset than ISO-8859-1 for Western text unless spark.sql.legacy.javaCharsets is set; the signs
    that cp1252 has between 0x80 and 0x9F are then mapped here.
    """
    for i, encoding in enumerate(encodings):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
        if encoding == "ISO-8859-1":
            return df.select(*[F.translate(F.col(f"`{c}`"), _CONTROLS, _SIGNS).alias(c) for c in df.columns])
        if i == len(encodings) - 1 or not df.columns:
            break
        broken = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda x: x.contains("�"))
        if not any("�" in c for c in df.columns) and not df.where(broken).limit(1).count():
            break
    return df


def load_keyed(spark: SparkSession, path: str, key: str, required: list[str] = ()) -> DataFrame:
    """A CSV whose key must be unique."""
    return require_unique(require_columns(read_csv(spark, path), [key, *required], path), key, path)


def load_first_wins(spark: SparkSession, path: str, key: str, order: str) -> tuple[DataFrame, int]:
    """(the first row of each key, how many rows were ignored)."""
    rows = read_csv(spark, path)
    kept = first_rows(rows, key, order)
    return kept, rows.count() - kept.count()


def write_csv(df: DataFrame, path: str) -> dict:
    """Write as CSV - ISO dates, plain decimals, 1 and 0, empty for null - and return rows and nulls by column."""
    text = [F.when(F.col(c), "1").otherwise(F.when(F.col(c).isNotNull(), "0")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    df.select(*text).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    return {"rows": row.pop("_rows"), "missing": row}


class Reloading:
    """A table that is read again when its files change; a read that fails leaves the last good one."""

    def __init__(self, spark: SparkSession, path: str, read):
        self.spark, self.path, self.read = spark, path, read
        self.signature, self.table, self.error = None, None, None

    def get(self) -> DataFrame:
        listing = self.spark.read.format("binaryFile").load(self.path).select("path", "modificationTime", "length")
        now = sorted(map(tuple, listing.collect()))
        if now != self.signature:
            try:
                table = self.read(self.spark, self.path).cache()
                table.count()
            except Exception as e:  # noqa: BLE001
                if self.table is None:
                    raise
                self.error = e
            else:
                if self.table is not None:
                    self.table.unpersist()
                self.table, self.error = table, None
            self.signature = now
        return self.table


def limit_rows(df: DataFrame, n: int, order: str = "source_row") -> DataFrame:
    """The first n rows in source order."""
    return df.orderBy(order).limit(n)
