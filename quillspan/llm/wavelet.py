"""Token ids in wavelet matrices, one for each shard of documents.

A wavelet matrix keeps a sequence as one bit-plane for each bit of an id, highest first; before each further plane the
sequence is parted, stably, by the bit just written. Rank and select on the planes then give any token, the count of a
token in a range, and the place of its k-th occurrence, without unpacking the sequence.

File format: Parquet, one shard in a part file, which is a row: part and seq (shards in order are sorted by them), before
(ids in the earlier shards of the same part), n_docs, n_tokens, n_null (documents without a key, which come last), doc_ids
(int64, little-endian), ends (int64: tokens up to each document's end), zeros (of each plane), planes (bits, first bit
highest), ranks (uint32 for each plane: ones before each block of BLOCK bits). Spark's writer commits it, so a task that is
run again leaves one copy, in any store that Spark can write.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.llm.bpe import encoder, slices, vocabulary
from quillspan.llm.memory import releasing
from quillspan.session import shared_dir

BLOCK = 512
#: A shard is closed when it has so many ids; a document is never parted.
SHARD_IDS = 8 << 20
#: Text of a key range, about, and how many ranges there are at most; each is a sorted stream of documents, cut into shards on its way.
#: The driver holds RANGE_SAMPLE keys for each range to choose them.
RANGE_BYTES, MAX_RANGES, RANGE_SAMPLE = 16 << 20, 20_000, 30
#: Encoding for shards keeps more pieces and takes larger slices than elsewhere: it has its workers to itself.
KEPT_PIECES, SLICE_BYTES = 1_000_000, 12 << 20
#: Stands for a null key.
AFTER = 1 << 63
FILE = "part int, seq int, before long, n_docs long, n_tokens long, n_null long, doc_ids binary, ends binary, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Access, rank, count and select over a sequence of non-negative integers."""

    def __init__(self, length: int, zeros: list[int], planes: list[bytes], ranks: list[bytes] | None = None):
        self.length, self.zeros = length, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks] if ranks is not None else [_block_ranks(p) for p in self.planes]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        rest, zeros, planes = ids, [], []
        for b in range(bits - 1, -1, -1):
            if b == 7:
                rest = rest.astype(np.uint8)  # the bits above are written
            one = (rest & rest.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one).tobytes())
            low = np.compress(~one, rest)
            zeros.append(len(low))
            rest = np.concatenate([low, np.compress(one, rest)])
        return cls(len(ids), zeros, planes)

    def ids(self) -> np.ndarray:
        """The whole sequence: the partings are undone from the lowest plane up."""
        kind, out = np.uint8, np.zeros(self.length, np.uint8)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            if b == 8:
                kind = np.uint16 if len(self.planes) <= 16 else np.uint32
                out = out.astype(kind)
            one = np.unpackbits(plane, count=self.length).view(bool)
            up = np.empty_like(out)
            up[np.flatnonzero(~one)] = out[:z]
            up[np.flatnonzero(one)] = out[z:] | kind(1 << b)
            out = up
        return out

    def _rank1(self, level: int, i: int) -> int:
        """Ones in a plane before place i."""
        block, plane = i // BLOCK, self.planes[level]
        at = block * BLOCK // 8
        whole = int(np.bitwise_count(plane[at : i // 8]).sum())
        left = int(plane[i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(self.ranks[level][block]) + whole + left.bit_count()

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> (7 - i % 8) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id stands in [lo, hi)."""
        lo, hi = self._range(value, lo, self.length if hi is None else hi)
        return hi - lo

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of an id, from 0."""
        lo, hi = self._range(value, 0, self.length)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            z = self.zeros[level]
            i = self._select(level, i - z, 1) if i >= z else self._select(level, i, 0)
        return i

    def _select(self, level: int, k: int, bit: int) -> int:
        """The place of the k-th one or zero of a plane: the block by its rank, then the bits of that block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])


def _block_ranks(plane: np.ndarray) -> np.ndarray:
    step = BLOCK // 8
    ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % step))).reshape(-1, step).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


@dataclass
class Shard:
    """One row of a file, opened: tokens, counts and places from the planes, without unpacking them."""

    matrix: WaveletMatrix
    doc_ids: list[int | None]
    ends: list[int]

    @classmethod
    def open(cls, row: dict) -> Shard:
        keys = np.frombuffer(row["doc_ids"], "<i8").tolist()
        keys[len(keys) - row["n_null"] :] = [None] * row["n_null"]
        return cls(WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]), keys, np.frombuffer(row["ends"], "<i8").tolist())

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th document starts and ends."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def tokens(self, i: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """The ids of the i-th document from its lo-th to before its hi-th."""
        start, end = self.span(i)
        return [self.matrix.access(k) for k in range(start + lo, end if hi is None else min(end, start + hi))]

    def count(self, value: int, i: int | None = None) -> int:
        """How often an id stands in the shard, or in its i-th document."""
        return self.matrix.count(value) if i is None else self.matrix.count(value, *self.span(i))

    def places(self, value: int) -> Iterator[tuple[int | None, int]]:
        """(document's key, place in it) of each occurrence of an id, in order."""
        for k in range(self.matrix.count(value)):
            at = self.matrix.select(value, k)
            i = bisect_right(self.ends, at)
            yield self.doc_ids[i], at - self.span(i)[0]


def range_cuts(keyed: DataFrame, n: int, seed: int = 11) -> list[tuple[int, int]]:
    """(key, salt) pairs that cut rows of those columns into ``n`` ranges of like numbers of rows; nulls are after all keys."""
    rows = keyed.count() if n > 1 else 0
    if not rows:
        return []
    most = n * RANGE_SAMPLE
    some = keyed.sample(min(1.0, most / rows), seed).limit(2 * most).collect()
    seen = sorted((AFTER if r.key is None else r.key, r.salt) for r in some)
    return sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS, ranges: int | None = None) -> None:
    """Encode every text, append ``end``, and write the ids of all in ascending key order as wavelet matrices.

    Null texts count as empty: just the end id. Rows with a null key come after all others; rows of the same key stand
    side by side, in the order of a hash of their texts, so equal rows are next to each other. An empty table writes no
    shard. A very long text is one document of one shard, which is as large as it needs. Only the two named columns are
    read. ``tokenizer``: as for ``encode_decode``.

    Texts are encoded where they are read; only ids are shuffled, into ranges of (key, hash), so that a key with any share of
    the rows is dealt over several. A task holds one open shard.
    """
    spark = docs.sparkSession
    slim = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(docs[text]).alias("salt"), docs[text].alias("text"))
    volume = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    n = ranges or min(MAX_RANGES, max(1, volume // RANGE_BYTES, min(volume // (1 << 18), 2 * spark.sparkContext.defaultParallelism)))
    cuts = range_cuts(slim.select("key", "salt"), n)
    own = encoder(tokenizer)
    bits = max(1, len(own.lengths).bit_length(), int(end).bit_length())
    kind = own.kind

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, KEPT_PIECES)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, ends = own.flat(pc.fill_null(part.column("text"), ""), end)
                offsets = np.concatenate([[0], ends * kind.itemsize])
                packed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                keys = zip(part.column("key").to_pylist(), part.column("salt").to_pylist())
                at = [bisect_right(cuts, (AFTER if k is None else k, s)) for k, s in keys]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part.column("key"), part.column("salt"), packed], ["part", "key", "salt", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = seq = before = 0
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, size
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(sizes), dtype="<i8")
            own = pa.concat_arrays(keys)
            m = WaveletMatrix.build(ids, bits)
            row = {"part": part, "seq": seq, "before": before, "n_docs": len(own), "n_tokens": len(ids), "n_null": own.null_count, "doc_ids": pc.fill_null(own, 0).to_numpy().astype("<i8").tobytes(), "ends": ends.tobytes(), "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks]}
            seq, before, size = seq + 1, before + len(ids), 0
            for x in (keys, held, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            parts = batch.column("part").to_numpy()
            offsets = np.frombuffer(batch.column("ids").buffers()[1], np.int32)[batch.column("ids").offset :][: batch.num_rows + 1]
            data, w = np.frombuffer(batch.column("ids").buffers()[2] or b"", np.uint8), kind.itemsize
            lo = 0
            while lo < batch.num_rows:
                if parts[lo] != part or size >= shard_ids:
                    if size:
                        yield close()
                    if parts[lo] != part:
                        part, seq, before = int(parts[lo]), 0, 0
                # As many rows as the shard takes: the one that fills it is the last.
                hi = int(np.searchsorted(parts, part, side="right"))
                hi = min(hi, int(np.searchsorted(offsets, offsets[lo] + (shard_ids - size) * w)))
                hi = max(hi, lo + 1)
                keys.append(batch.column("key").slice(lo, hi - lo))
                sizes.append(np.diff(offsets[lo : hi + 1]) // w)
                held.append(data[offsets[lo] : offsets[hi]].view(kind).copy())
                size += len(held[-1])
                lo = hi
        if size:
            yield close()

    binary = pa.list_(pa.binary())
    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_null", pa.int64()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("zeros", pa.list_(pa.int64())), ("planes", binary), ("ranks", binary)])
    ids = slim.mapInArrow(releasing(encode), "part int, key long, salt long, ids binary")
    dealt = ids.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.col("key").asc_nulls_last(), "salt").drop("salt")
    dealt.mapInArrow(releasing(build), FILE).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def _started(spark: SparkSession, path: str) -> DataFrame:
    """The shards, with the ids before each of them as ``base``: at most MAX_RANGES rows are gathered and broadcast."""
    shards = spark.read.schema(FILE).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return shards.join(F.broadcast(starts), "part").withColumn("base", F.col("first") + F.col("before")).drop("first")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document from the shards' files; start counts all ids before it, ids are little-endian 32-bit."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], []).ids()
                ends = np.concatenate([[0], np.frombuffer(row["ends"], "<i8")])
                keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.arange(row["n_docs"]) >= row["n_docs"] - row["n_null"])
                step = max(1, row["n_docs"] * (1 << 20) // max(1, row["n_tokens"]))
                for k in range(0, row["n_docs"], step):
                    e = ends[k : k + step + 1]
                    out = ids[e[0] : e[-1]].astype("<u4")
                    offsets = pa.py_buffer((4 * (e - e[0])).astype(np.int64))
                    packed = pa.Array.from_buffers(pa.large_binary(), len(e) - 1, [None, offsets, pa.py_buffer(out)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([keys.slice(k, step), pa.array(row["base"] + e[:-1]), pa.array(np.diff(e)), packed], ["doc_id", "start", "n_tokens", "ids"])

    shards = _started(spark, path).select("base", "n_docs", "n_tokens", "n_null", "doc_ids", "ends", "zeros", "planes")
    return shards.mapInArrow(releasing(unpack), "doc_id long, start long, n_tokens long, ids binary")


def count_ids(spark: SparkSession, path: str, values: list[int]) -> DataFrame:
    """(id, n): how often each of a stated list of ids stands in all shards, by rank alone."""
    values = sorted(set(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.open({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([shard.count(v) for v in values], pa.int64())], ["id", "n"])

    shards = spark.read.schema(FILE).parquet(path).select("n_tokens", "n_null", "doc_ids", "ends", "zeros", "planes", "ranks")
    return shards.mapInArrow(releasing(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def find_id(spark: SparkSession, path: str, value: int) -> DataFrame:
    """(doc_id, at, place): each occurrence of an id - its document, its place there, and its place among all ids - by select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.open({c: batch.column(c)[i].as_py() for c in batch.schema.names})
                base, n = batch.column("base")[i].as_py(), shard.count(value)
                for k in range(0, n, 10_000):
                    at = [shard.matrix.select(value, j) for j in range(k, min(n, k + 10_000))]
                    docs = [bisect_right(shard.ends, x) for x in at]
                    yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[d] for d in docs], pa.int64()), pa.array([x - shard.span(d)[0] for x, d in zip(at, docs)], pa.int64()), pa.array([base + x for x in at], pa.int64())], ["doc_id", "at", "place"])

    shards = _started(spark, path).select("base", "n_tokens", "n_null", "doc_ids", "ends", "zeros", "planes", "ranks")
    return shards.mapInArrow(releasing(run), "doc_id long, at long, place long")


def op5(spark, sf_dir: str) -> DataFrame:
    """The query: documents to files, and each document's digest from the files."""
    path = f"{shared_dir(spark).rstrip('/')}/quillspan/shards-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(), 2)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
