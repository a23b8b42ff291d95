"""Near-duplicate groups by SimHash, with pivot distance tables.

For each distinct fingerprint the Hamming distances to a set of reference fingerprints (pivots) are computed once and kept
beside it. By the triangle inequality two fingerprints are at least as far apart as any of their coordinates differ, so
a pair whose largest coordinate difference exceeds the radius is discarded unseen; the survivors are verified by their
differing bits. Pivots alone leave over half of the pairs for each coordinate, so fingerprints first meet in buckets: of b
blocks of bits, ``radius`` differing bits leave b - radius blocks equal, and each such choice of equal blocks is a bucket. In
a bucket they stand in order of their first coordinate, and only those within the radius there are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.memory import parts, releasing
from quillspan.llm.words import stretches
from quillspan.operators.components import connected_components
from quillspan.session import scratch

PIVOTS = 16
#: Buckets of more fingerprints are split into tiles, every two of which meet in a task.
TILE = 8192
#: Runs up to this length are searched together.
SHORT_RUN = 48
#: Fingerprints that a bucket should hold by chance, at most; finer blocks are chosen for larger inputs.
BY_CHANCE = 16


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 value of each shingle in order, repeats included; none for a text without words. A long text is read in stretches."""
    from xxhash import xxh64_intdigest

    out, tail = [], b""
    for raw in stretches(text):
        words = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
        if tail:
            words[:0] = tail.split()
        if len(words) < shingle:
            tail = b" ".join(words)
            continue
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        out.append(np.array([xxh64_intdigest(whole[a:b], seed) for a, b in spans], "<u8"))
        tail = b" ".join(words[len(words) - shingle + 1 :])
    if out or not tail:
        return np.concatenate(out) if out else np.zeros(0, "<u8")
    return np.array([xxh64_intdigest(tail, seed)], "<u8")


def fold_hashes(found: np.ndarray, step: int = 1 << 17) -> int:
    """Bit i is set if over half of the values have it."""
    n = len(found)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, step):
        part = found[i : i + step]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash: bit i is set if over half of the shingles' XXH64 values, repeats included, have it."""
    return fold_hashes(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int, seed: int) -> DataFrame:
    """(key, fp), one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(releasing(run), f"key {kind}, fp long")


def block_masks(blocks: int, equal: int) -> list[int]:
    """For each choice of ``equal`` among ``blocks`` blocks of the 64 bits, their mask as a signed long."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(one, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks with which a bucket holds BY_CHANCE of n fingerprints at most."""
    for blocks in range(radius + 1, 2 * radius + 5):
        if n / 2 ** (64 * (blocks - radius) / blocks) <= BY_CHANCE:
            break
    return blocks


def pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints, the same in every run, as signed longs."""
    return np.random.default_rng(20).integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64).tolist()


def with_pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` with the distances of fp to all pivots, each in a byte of ``near`` or ``far``."""
    packed = lambda some: reduce(Column.bitwiseOR, [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i) for i, p in enumerate(some)])
    known = pivots()
    return fps.withColumns({"near": packed(known[:8]), "far": packed(known[8:])})


def pivot_table(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each pivot, from the packed columns."""
    return np.concatenate([near.astype("<i8").view(np.int8).reshape(-1, 8), far.astype("<i8").view(np.int8).reshape(-1, 8)], axis=1).T.copy()


def link_bucket(fps: np.ndarray, table: np.ndarray, radius: int, also=None) -> list[tuple[int, int]]:
    """A star (member, root) for each group of linked fingerprints; the search goes on from each find among those not yet found.

    They stand in order of their first coordinate, so those that may be near are a run of what is left. ``also`` (places, place)
    tells which of the places within ``radius`` of the place link; all do without it.
    """
    left, stars = np.arange(len(fps)), []
    while len(left):
        root, left = int(left[0]), left[1:]
        todo = [root]
        while todo and len(left):
            i = todo.pop()
            first = table[0][left]
            near = left[np.searchsorted(first, table[0][i] - radius) : np.searchsorted(first, table[0][i] + radius, side="right")]
            for row in table[1:]:
                near = near[np.abs(row[near] - row[i]) <= radius]
                if not len(near):
                    break
            if len(near):
                near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
            if len(near) and also:
                near = near[also(near, i)]
            if len(near):
                stars += [(int(j), root) for j in near]
                todo += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return stars


def _linked_runs(fps: np.ndarray, table: np.ndarray, start: np.ndarray, length: np.ndarray, radius: int) -> np.ndarray:
    """Numbers of the runs that hold a linked pair; pairs at each distance in a run are tested together."""
    run = np.repeat(np.arange(len(start)), length)
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(start.tolist(), length.tolist())]) if len(start) else np.zeros(0, np.int64)
    has = np.zeros(len(start), bool)
    for step in range(1, int(length.max(initial=0))):
        keep = run[:-step] == run[step:] if step < len(run) else np.zeros(0, bool)
        i = np.flatnonzero(keep)
        i = i[~has[run[i]]]
        if not len(i):
            break
        j = i + step
        for row in table:
            close = np.abs(row[at[i]] - row[at[j]]) <= radius
            i, j = i[close], j[close]
        close = np.bitwise_count(fps[at[i]] ^ fps[at[j]]) <= radius
        has[run[i[close]]] = True
    return np.flatnonzero(has)


def _bucket_links(radius: int):
    """Rows sorted by bucket and first coordinate: the stars of each bucket."""

    def search(keys: np.ndarray, fps: np.ndarray, table: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.append(start, len(keys)))
        short = np.flatnonzero((length > 1) & (length <= SHORT_RUN))
        runs = short[_linked_runs(fps, table, start[short], length[short], radius)]
        out = []
        for r in [*runs.tolist(), *np.flatnonzero(length > SHORT_RUN).tolist()]:
            own = slice(start[r], start[r] + length[r])
            out += [(fps[own][a], fps[own][b]) for a, b in link_bucket(fps[own], table[:, own], radius)]
        return np.array(out, np.uint64).reshape(-1, 2).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, table = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((PIVOTS, 0), np.int8)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("bucket").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            table = np.concatenate([table, pivot_table(batch.column("near").to_numpy(), batch.column("far").to_numpy())], axis=1)
            if len(keys) < 50_000 or keys[0] == keys[-1]:
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            links = search(keys[:last], fps[:last], table[:, :last])
            keys, fps, table = keys[last:], fps[last:], table[:, last:].copy()
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
        if len(keys):
            links = search(keys, fps, table)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, radius: int, count: int, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that are within ``radius`` bits, directly or by others.

    ``fps``: distinct fp values with their pivot tables, ``count`` of them. Links of a bucket form stars, so there are fewer than members.
    """
    columns = ["fp", "near", "far"]
    masks = block_masks(blocks := blocks_for(count, radius), blocks - radius)
    slots = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    rows = fps.select(F.explode(slots).alias("bucket"), *columns)
    if count > tile:  # else no bucket can be larger
        hot = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
        hot = scratch(hot.select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "hot")
        if hot.limit(1).count():
            split = rows.join(hot, "bucket").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
            split = split.select("bucket", *columns, "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
            split = split.select(F.xxhash64("bucket", F.least("t", "u"), F.greatest("t", "u")).alias("bucket"), *columns)
            rows = rows.join(hot, "bucket", "left_anti").select("bucket", *columns).unionByName(split)
    first = F.col("near").bitwiseAND(F.lit(255))
    return rows.repartition("bucket").sortWithinPartitions("bucket", first).mapInArrow(_bucket_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id), one row for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fingerprints link at ``radius`` differing bits
    or fewer; component_id is the smallest key reachable over links, a row's own included. Texts without words,
    nulls included, have fingerprint zero and link like any other; a text shorter than ``shingle`` words is one
    shingle; a very long text is read in stretches. Repeated keys and equal rows get a row each. A null key gets the component
    of its fingerprint. An empty table gives an empty result. Other columns aren't read.

    Rows meet by distinct fingerprint, so copies are never paired; only the last join has a row for each document, and
    its hot fingerprints are split by AQE.
    """
    rows = scratch(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    distinct = scratch(with_pivot_table(rows.groupBy("fp").agg(F.min("key").alias("low"))), "distinct")
    links = fingerprint_links(distinct.select("fp", "near", "far"), radius, distinct.count())
    groups = connected_components(links)
    groups = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "low")
    groups = scratch(groups, "groups")
    least = scratch(groups.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    ids = groups.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(F.col("key").alias(key), hexadecimal("fp").alias("fingerprint"), "component_id")


def hexadecimal(column: str) -> Column:
    """16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1(spark, sf_dir: str) -> DataFrame:
    """The query: every document's fingerprint and group."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
