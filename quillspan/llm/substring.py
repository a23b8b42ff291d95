"""Removal of long passages that an earlier document has, by difference-cover anchors.

A difference cover D modulo P has, for any two places, a shift below P that moves both into D. So if two documents
share a window of WINDOW words, both have an anchor - a hash of ANCHOR = WINDOW - P + 1 words that starts at a place in
D - at the same distance from the window's start. Anchors are hashed at |D| of P places only; where an anchor is shared,
the windows around it are hashed too, and the first document of each window is found among those.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.memory import BATCH_BYTES, bounded_batches, parts, releasing
from quillspan.llm.words import spread
from quillspan.session import drop_scratch, scratch

WINDOW = 50
#: A perfect difference set; every number modulo 31 is the difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1


def sequence_key(whole: bytes) -> bytes:
    """Equal for equal word sequences: 128 bits."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(whole)


def anchor_places(n_words: int) -> np.ndarray:
    """Where anchors start in a text of so many words; none in a text without a window."""
    if n_words < WINDOW:
        return np.zeros(0, np.int64)
    found = (np.arange(0, n_words, PERIOD)[:, None] + np.array(COVER)).ravel()
    return found[found + ANCHOR <= n_words]


def _hashes(whole: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the words from each place on: enough to find anchors, which only tell where to look."""
    from xxhash import xxh64_intdigest

    spans = zip(starts[places].tolist(), ends[places + width - 1].tolist())
    return np.fromiter((xxh64_intdigest(whole[a:b]) for a, b in spans), np.uint64, len(places)).view(np.int64)


def _keys(whole: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """128 bits for the words from each place on, as two longs: equal ones are taken for equal words."""
    from xxhash import xxh3_128_digest

    spans = zip(starts[places].tolist(), ends[places + width - 1].tolist())
    return np.frombuffer(b"".join([xxh3_128_digest(whole[a:b]) for a, b in spans]), ">i8").astype(np.int64).reshape(-1, 2)


def _batched(rows, schema: pa.Schema, most: int = 400) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` rows, or fewer whose arrays reach BATCH_BYTES: a long text's windows are some 20 bytes a word."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(x.nbytes for x in row if isinstance(x, np.ndarray))
        if len(held) == most or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seq, anchors) of each text with a window."""

    def rows():
        for batch in parts(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                whole, starts, ends = spread(text)
                if len(ends) >= WINDOW and key is not None:
                    yield key, sequence_key(whole), np.unique(_hashes(whole, starts, ends, anchor_places(len(ends)), ANCHOR))

    return _batched(rows(), pa.schema([("key", pa.int64()), ("seq", pa.binary()), ("anchors", pa.list_(pa.int64()))]))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seq, starts, one, two) of the windows that hold a shared anchor aligned with their start; one and two are their keys."""

    def rows():
        for batch in parts(batches):
            for key, text, shared in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "shared"))):
                whole, starts, ends = spread(text)
                places = anchor_places(len(ends))
                if not len(places):
                    continue
                hit = places[np.isin(_hashes(whole, starts, ends, places, ANCHOR), np.array(shared, np.int64))]
                last = len(ends) - WINDOW + 1
                edge = np.zeros(last + 1, np.int64)
                np.add.at(edge, np.minimum(np.maximum(hit - PERIOD + 1, 0), last), 1)
                np.add.at(edge, np.minimum(hit + 1, last), -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if len(at):
                    found = _keys(whole, starts, ends, at, WINDOW)
                    yield key, sequence_key(whole), at.astype(np.int32), found[:, 0], found[:, 1]

    return _batched(rows(), pa.schema([("key", pa.int64()), ("seq", pa.binary()), ("starts", pa.list_(pa.int32())), ("one", pa.list_(pa.int64())), ("two", pa.list_(pa.int64()))]))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no table refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, found): for each key with something to remove, an array of (seq, whole, starts).

    seq names the word sequence that it holds for. whole: an earlier document has all the same words. starts: the
    windows whose word sequence also starts in a document with a smaller key, by their first word's place.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = scratch(slim.mapInArrow(releasing(_anchors), "key long, seq binary, anchors array<long>"), "anchors")
    # Copies: the first of each word sequence stands for all of them from here on.
    first = rows.groupBy("seq").agg(F.min("key").alias("low"))
    first = scratch(first, "first")
    copies = rows.select("key", "seq").join(first, "seq").where("key > low").select("key", "seq")
    copies = scratch(copies, "copies")
    each = rows.select("key", F.explode("anchors").alias("h"))
    # Counts are written before they are joined: AQE splits a hot key only between two exchanges of a join's own.
    twice = scratch(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    free_shuffles(spark)
    shared = each.join(twice, "h", "left_semi")
    shared = shared.groupBy("key").agg(F.collect_set("h").alias("shared")).join(first.select(F.col("low").alias("key")).distinct(), "key", "left_semi")
    shared = scratch(shared, "shared")
    drop_scratch(rows)
    free_shuffles(spark)
    windows = scratch(slim.join(shared, "key").mapInArrow(releasing(_windows), "key long, seq binary, starts array<int>, one array<long>, two array<long>"), "windows")
    drop_scratch(shared)
    free_shuffles(spark)
    each = windows.select("key", "seq", F.explode(F.arrays_zip("one", "two", "starts")).alias("w")).select("key", "seq", F.col("w.one").alias("h"), F.col("w.two").alias("g"), F.col("w.starts").alias("s"))
    owner = each.groupBy("h", "g").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("h", "g", "low")
    owner = scratch(owner, "owner")
    free_shuffles(spark)
    later = each.join(owner, ["h", "g"]).where("key > low").groupBy("key", "seq").agg(F.array_sort(F.collect_set("s")).alias("starts"))
    later = later.select("key", "seq", F.lit(False).alias("whole"), "starts")
    copies = copies.select("key", "seq", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))
    found = later.unionByName(copies).groupBy("key").agg(F.collect_list(F.struct("seq", "whole", "starts")).alias("found"))
    found = scratch(found, "repeats")
    drop_scratch(windows)
    free_shuffles(spark)
    return found


def covered(n_words: int, starts: list[int], width: int = WINDOW) -> np.ndarray:
    """Which words the windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.array(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text replaced by what stays of it, with n_words, n_removed and kept_sha256 added.

    A word is a run of anything but ASCII white space. Each word that lies in a window of WINDOW consecutive words is
    removed if the window's word sequence also starts in a row with a smaller key; windows are judged on the input. Equal 128-bit hashes are taken for equal words; a wrong one among 1e15 windows has a chance of about 1e-9.
    A text that loses words becomes its other words joined by one space, any other text stays as it is. kept_sha256 is
    that of the kept words joined by one space. Null texts have no words and stay null. Rows with a null key keep all
    and own nothing; rows of the same key don't remove each other's words. The key is cast to long for comparisons.
    Columns of ``docs`` named n_words, n_removed or kept_sha256 are replaced.

    Shuffles: anchors (a fifth of the words, 16 bytes each) twice, the windows around shared anchors twice, and the
    texts twice, each time against a narrow table. The session's Arrow batches are bounded from then on. A passage that any share of the documents has is first counted
    map-side; the joins against those counts are sort-merge joins, whose hot keys AQE splits.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    found = repeated_windows(docs, key, text).withColumnRenamed("key", "__qs_key").withColumnRenamed("found", "__qs_found")
    joined = docs.join(found, docs[key].cast("long") == F.col("__qs_key"), "left").drop("__qs_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, counts, removed, shas = [], [], [], []
            for body, marks in zip(batch.column(text).to_pylist(), batch.column("__qs_found").to_pylist()):
                whole, starts, ends = spread(body)
                gone = 0
                if marks:
                    own = [m for m in marks if m["seq"] == sequence_key(whole)]
                    if any(m["whole"] for m in own):
                        gone, body, whole = len(ends), "", b""
                    elif own:
                        out = covered(len(ends), [s for m in own for s in m["starts"]])
                        gone = int(out.sum())
                        left = np.flatnonzero(np.diff(np.concatenate([[1], out, [1]]).astype(np.int8)))  # of runs that stay: first word, one past the last
                        whole = b" ".join([whole[starts[a] : ends[b - 1]] for a, b in zip(left[::2].tolist(), left[1::2].tolist())])
                        body = whole.decode()
                texts.append(body)
                counts.append(len(ends))
                removed.append(gone)
                shas.append(hashlib.sha256(whole).hexdigest())
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], [*names, "n_words", "n_removed", "kept_sha256"])

    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(releasing(cut), f"{kinds}, n_words long, n_removed long, kept_sha256 string")


def op6(spark, sf_dir: str) -> DataFrame:
    """The query: what is removed from each document, and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
