"""Groups of documents whose shingle sets have a Jaccard similarity of 0.8 or more, by SimHash with pivot distance tables.

Of two such sets one of the first fifth (and one more) of each one's shingles is in both, in any order of all shingles (prefix filter),
so sets meet in buckets of those. The order puts shingles that are frequent in a sample last: it changes what meets by chance, not
what is found. In a bucket sets stand in order of their fingerprint's distance to a first pivot; pivot distances, the
fingerprint's own bits at a wide radius, the sizes and a wide fingerprint of three more words discard. What is left forms
families, as stars. A family's sets meet in one task (a large family's in tiles, every two of which meet), where exact
counts of common shingles tell which are at 0.8: pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.memory import bounded_batches, parts, releasing
from quillspan.llm.simhash import TILE, fold_hashes, link_bucket, pivot_table, shingle_hashes, with_pivot_table
from quillspan.operators.components import connected_components
from quillspan.session import drop_scratch, scratch

#: Differing bits up to which a pair is verified. Fingerprints of sets at 0.8 differ by about ten bits, of unrelated ones by 32.
RADIUS = 24
#: The same for the 192 bits of the wide fingerprint: about 29 at 0.8, 96 of unrelated sets.
WIDE_RADIUS = 64
#: Odd factors that make other hashes of a hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Runs up to this length are searched together.
SHORT_RUN = 48
#: Runs up to this length give their pairs as they are, three for a set at most; longer ones give stars.
PAIR_RUN = 4
#: Rows whose shingles are counted, about, and the share of them from which on a shingle is frequent.
SAMPLE, FREQUENT = 4000, 0.002
#: Shingles of a family's tile; a larger family is split.
TILE_SHINGLES = 1 << 19
#: Postings that are counted in a step.
PLACES = 1 << 18
#: Candidates of a set in a bucket that are verified first; what they join needs no other link.
FIRST = 1
SET_COLUMNS = ["key", "sig", "fp", "n", "head"]
WIDE_COLUMNS = ["w0", "w1", "w2"]


def prefix_length(n: int) -> int:
    """Of n sorted shingles, how many hold one of any set at 0.8 or more: all but those that may differ, and one."""
    return n - (4 * n + 4) // 5 + 1


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """Three more SimHash words of the same shingles."""
    return [fold_hashes(x ^ (x >> np.uint64(32))) for x in (((found ^ (found >> np.uint64(29))) * np.uint64(m)).astype("<u8") for m in MIX)]


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _sets(shingle: int, seed: int, frequent: np.ndarray | None = None):
    """For each text with words: its set's hash, its fingerprint, its size and the first of its hashed shingles.

    They are in order of their hashes; with ``frequent`` (sorted hashes), those come last, and the wide fingerprint is given too.
    """
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows, sigs, fps, sizes, heads, wide = [], [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                found = shingle_hashes(text, shingle, seed)
                if not len(found):
                    continue
                own = np.unique(found)
                rows.append(i)
                sigs.append(xxh64_intdigest(own.tobytes(), seed))
                fps.append(fold_hashes(own))  # of the set, as that is what is compared
                sizes.append(len(own))
                head = own
                if frequent is not None:
                    wide.append(wide_fingerprint(own))
                    last = _in_sorted(own, frequent)
                    head = np.concatenate([own[~last], own[last]])
                heads.append(head[: prefix_length(len(own))].view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            head = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            keys = part.column("key").take(pa.array(rows, pa.int32()))
            columns, names = [keys, long(sigs), long(fps), pa.array(sizes, pa.int32()), head], SET_COLUMNS
            if frequent is not None:
                words = np.array(wide, np.uint64).reshape(-1, 3)
                columns, names = [*columns, *(long(words[:, k].copy()) for k in range(3))], [*names, *WIDE_COLUMNS]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _whole_sets(shingle: int, seed: int):
    """For each text with words: its set's hash and all its hashed shingles."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = [np.unique(x) for x in (shingle_hashes(t, shingle, seed) for t in part.column("text").to_pylist()) if len(x)]
            sigs = np.array([xxh64_intdigest(x.tobytes(), seed) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["sig", "hashes"])

    return run


def frequent_shingles(plain: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Sorted hashes of the shingles that a share FREQUENT of a sample's rows have. Any list gives the same groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_sets(shingle, seed)(batches):
            yield pa.RecordBatch.from_arrays([batch.column("hashes").flatten()], ["h"])

    some = plain.where(F.pmod(F.xxhash64("key"), F.lit(max(1, plain.count() // SAMPLE))) == 0).limit(2 * SAMPLE)
    counts = some.mapInArrow(releasing(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= max(2, int(SAMPLE * FREQUENT))).select("h").toArrow().column("h")
    return np.sort(found.to_numpy().view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: those of buckets of two or more, with the bucket's size."""

    def search(keys: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.repeat(np.diff(np.append(start, len(keys))), np.diff(np.append(start, len(keys))))
        more = size > 1
        return pa.RecordBatch.from_arrays([pa.array(keys[more]), pa.array(sigs[more]), pa.array(size[more])], ["bucket", "sig", "size"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("bucket").to_numpy(), batch.column("sig").to_numpy()))
        n += batch.num_rows
        if n < 50_000 or not batch.num_rows or held[0][0][0] == held[-1][0][-1]:
            continue
        keys, sigs = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        yield search(keys[:last], sigs[:last])
        held, n = [(keys[last:].copy(), sigs[last:].copy())], len(keys) - last
    if n:
        yield search(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))


def _family_links(t: dict[str, np.ndarray], radius: int) -> pa.RecordBatch:
    """Links (a, b) that join all sets of a bucket that may be at 0.8, directly or by others: stars, but for short runs."""
    fps, sig, n = t["fp"].view(np.uint64), t["sig"], t["n"]
    table = pivot_table(t["near"], t["far"])

    def alike(i, j):
        ok = (5 * n[i] >= 4 * n[j]) & (5 * n[j] >= 4 * n[i])
        apart = sum(np.bitwise_count((t[w][i] ^ t[w][j]).view(np.uint64)).astype(np.int16) for w in WIDE_COLUMNS)
        return ok & (apart <= WIDE_RADIUS)

    keys, out = t["bucket"], []
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(start, len(keys)))
    at = np.flatnonzero(np.repeat((length > 1) & (length <= PAIR_RUN), length))
    for step in range(1, PAIR_RUN):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        i = at
        for row in table:
            i = i[np.abs(row[i] - row[i + step]) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]
        i = i[alike(i, i + step)]
        out.append(np.stack([sig[i], sig[i + step]], axis=1))
    for r in np.flatnonzero(length > PAIR_RUN).tolist():
        first = int(start[r])
        own = slice(first, first + int(length[r]))
        stars = link_bucket(fps[own], table[:, own], radius, lambda near, i: alike(near + first, np.full(len(near), i + first)))
        if stars:
            out.append(sig[own][np.array(stars)])
    both = np.concatenate(out)
    both = np.unique(np.sort(both, axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _common(posted: np.ndarray, first: np.ndarray, many: np.ndarray, sets: int) -> np.ndarray:
    """How often each of the sets stands in postings that begin at ``first`` and are ``many`` long; PLACES of them are looked at in a step, or one posting."""
    total, ends, a = np.zeros(sets, np.int64), np.cumsum(many), 0
    while a < len(many):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + PLACES, side="right")))
        places = np.arange(int(ends[b - 1]) - before)
        places += np.repeat(first[a:b] - (ends[a:b] - many[a:b] - before), many[a:b])
        total += np.bincount(posted[places], minlength=sets)
        a = b
    return total


def exact_stars(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A star (member, root) for each group of sets that 0.8 joins: common shingles are counted over an index of the sets."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    del flat  # each of these is as long as all sets together
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    posted = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    del order, new
    left, stars = np.arange(len(sets)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        todo = [root]
        while todo and len(left):
            i = todo.pop()
            own = number[ends[i] - sizes[i] : ends[i]]
            own = own[times[own] > 1]
            common = _common(posted, first[own], times[own], len(sets))
            ok = 9 * common[left] >= 4 * (sizes[left] + sizes[i])
            near, left = left[ok].tolist(), left[~ok]
            stars += [(j, root) for j in near]
            todo += near
    return stars


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, sig, hashes) sorted by family: the stars (a, b) of each."""
    now, sigs, sets, out = None, [], [], []

    def done() -> None:
        if len(sets) > 1:
            out.extend((sigs[i], sigs[j]) for i, j in exact_stars(sets))

    def links() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        hashes = batch.column("hashes")
        for i, (family, sig) in enumerate(zip(batch.column("family").to_pylist(), batch.column("sig").to_pylist())):
            if family != now:
                done()
                now, sigs, sets = family, [], []
            sigs.append(sig)
            sets.append(hashes[i].values.to_numpy().copy())
        if len(out) > 50_000:
            yield links()
            out.clear()
    done()
    yield links()


def _close_pairs(t: dict[str, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places) of pairs in the same bucket that may be at 0.8, the later ones all different in each step.

    A pair that shares the shingle before the bucket's as well is left to that bucket; one of the same group is no candidate. Wide
    fingerprints are compared where the rows have them.
    """

    def close(i, j):
        ok = np.bitwise_count((t["fp"][i] ^ t["fp"][j]).view(np.uint64)) <= radius
        ok &= (5 * t["n"][i] >= 4 * t["n"][j]) & (5 * t["n"][j] >= 4 * t["n"][i])
        ok &= (t["prev"][i] != t["prev"][j]) & (t["group"][i] != t["group"][j])
        if "w0" in t:
            apart = sum(np.bitwise_count((t[w][i] ^ t[w][j]).view(np.uint64)).astype(np.int16) for w in WIDE_COLUMNS)
            ok &= apart <= WIDE_RADIUS
        return ok

    keys = t["bucket"]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(start, len(keys)))
    at = np.flatnonzero(np.repeat((length > 1) & (length <= SHORT_RUN), length))
    for step in range(1, SHORT_RUN):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        i = at[close(at, at + step)]
        yield i, i + step
    for r in np.flatnonzero(length > SHORT_RUN).tolist():
        end = start[r] + length[r]
        for i in range(start[r], end - 1):
            j = np.arange(i + 1, end)
            j = j[close(i, j)]
            if len(j):
                yield np.full(len(j), i), j


def _stars(t: dict[str, np.ndarray], radius: int) -> pa.RecordBatch:
    """Of each row that has candidates in its bucket: the row, and FIRST of those before it, as rows with ``other``."""
    taken, some = np.zeros(len(t["sig"]), np.int8), np.zeros(len(t["sig"]), bool)
    edges = []
    for i, j in _close_pairs(t, radius):
        some[i] = some[j] = True
        ok = taken[j] < FIRST
        taken[j[ok]] += 1
        edges.append((i[ok], j[ok]))
    i, j = (np.concatenate([e[k] for e in edges]) if edges else np.zeros(0, np.int64) for k in (0, 1))
    own = np.flatnonzero(some)
    rows = np.concatenate([j, own])
    other = np.concatenate([t["sig"][i], np.zeros(len(own), np.int64)])
    none = np.arange(len(rows)) >= len(j)
    return pa.RecordBatch.from_arrays([pa.array(t["bucket"][rows]), pa.array(t["sig"][rows]), pa.array(other, mask=none), pa.array(t["prev"][rows]), pa.array(t["fp"][rows]), pa.array(t["n"][rows], pa.int32())], ["bucket", "sig", "other", "prev", "fp", "n"])


def _all_pairs(t: dict[str, np.ndarray], radius: int) -> pa.RecordBatch:
    """The candidates of a bucket between different groups, smaller set hash first."""
    found = [(t["sig"][i], t["sig"][j]) for i, j in _close_pairs(t, radius)]
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _by_bucket(search, radius: int, names: list[str]):
    """Rows sorted by bucket, searched in runs of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append({c: batch.column(c).to_numpy() for c in names})
            size += batch.num_rows
            ends = held[-1]["bucket"]
            if size < 50_000 or not len(ends) or held[0]["bucket"][0] == ends[-1]:
                continue
            t = {c: np.concatenate([h[c] for h in held]) for c in names}
            last = int(np.flatnonzero(t["bucket"] != t["bucket"][-1])[-1]) + 1  # the last bucket may go on
            yield search({c: v[:last] for c, v in t.items()}, radius)
            held = [{c: v[last:].copy() for c, v in t.items()}]
            size -= last
        if size:
            yield search({c: np.concatenate([h[c] for h in held]) for c in names}, radius)

    return run


def _searched(rows: DataFrame, search, radius: int, shape: str) -> DataFrame:
    # In order of the set, the same neighbours are taken in many buckets of a group.
    return rows.repartition("bucket").sortWithinPartitions("bucket", "sig").mapInArrow(releasing(_by_bucket(search, radius, rows.columns)), shape)


def bucket_rows(nodes: DataFrame, count: int, tile: int = TILE) -> DataFrame:
    """(bucket, prev, sig, fp, n): a row for each of the smallest shingles of each set. ``nodes``: (sig, fp, n, head), ``count`` rows, sig distinct.

    A bucket over ``tile`` rows is split into tiles, every two of which meet in a bucket of their own.
    """
    before = F.concat(F.array("sig"), F.slice("head", 1, F.size("head") - 1))
    rows = nodes.select(F.inline(F.arrays_zip(F.col("head").alias("bucket"), before.alias("prev"))), "sig", "fp", "n")
    if count > tile:  # else no bucket can be larger
        # Counts of coarse groups are small tables; only buckets of groups over a tile are counted one by one.
        total = nodes.agg(F.sum(F.size("head")).alias("n")).first()["n"]
        group = F.pmod("bucket", F.lit(max(1, total // 1024)))
        warm = rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile).select("g")
        warm = scratch(warm, "warm")
        hot = rows.select("bucket", group.alias("g")).join(warm, "g", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
        hot = scratch(hot.select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "hot")
        if hot.limit(1).count():
            split = rows.join(hot, "bucket").withColumn("t", F.pmod(F.xxhash64("sig"), F.col("tiles")).cast("int"))
            split = split.select("bucket", "prev", "sig", "fp", "n", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
            split = split.select(F.xxhash64("bucket", F.least("t", "u"), F.greatest("t", "u")).alias("bucket"), "prev", "sig", "fp", "n")
            rows = rows.join(hot, "bucket", "left_anti").select("bucket", "prev", "sig", "fp", "n").unionByName(split)
    return rows.select("bucket", "prev", "sig", "fp", "n")


def candidates(nodes: DataFrame, radius: int, count: int, tile: int = TILE) -> DataFrame:
    """(a, b): all distinct pairs of set hashes that may be at 0.8."""
    rows = bucket_rows(nodes, count, tile).withColumn("group", F.col("sig"))
    return _searched(rows, _all_pairs, radius, "a long, b long").distinct()


def tiled(rows: DataFrame, bucket: str, tiles, member: str) -> DataFrame:
    """``rows`` whose ``bucket`` is split into as many ``tiles``, every two of which meet in a bucket of their own."""
    columns = [c for c in rows.columns if c != bucket]
    split = rows.withColumn("tiles", tiles)
    few = split.where("tiles <= 1").select(bucket, *columns)
    split = split.where("tiles > 1").withColumn("t", F.pmod(F.xxhash64(member), F.col("tiles")))
    split = split.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return few.unionByName(split.select(F.xxhash64(bucket, F.least("t", "u"), F.greatest("t", "u")).alias(bucket), *columns))


def families(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(node, component): sets that meet in a bucket and that nothing discards, joined. ``nodes``: (sig, fp, n, head, w0, w1, w2), sig distinct."""
    met = nodes.select(F.explode("head").alias("bucket"), "sig").repartition("bucket").sortWithinPartitions("bucket")
    met = scratch(met.mapInArrow(releasing(_shared), "bucket long, sig long, size long"), "met")
    fps = scratch(with_pivot_table(nodes.select("sig", "fp", "n", *WIDE_COLUMNS)), "pivots")
    rows = tiled(met.join(fps, "sig"), "bucket", F.ceil(F.col("size") / tile), "sig").drop("size")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("near").bitwiseAND(F.lit(255)), "sig")
    links = rows.mapInArrow(releasing(_by_bucket(_family_links, radius, rows.columns)), "a long, b long")
    links = scratch(links.distinct(), "links")
    drop_scratch(met)
    return connected_components(links)


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = RADIUS, seed: int = 42) -> DataFrame:
    """(key, component_id), one row for each row of ``docs`` that has words; component_id is the smallest key reachable over links.

    Words as in ``simhash_groups``. Two texts link if the Jaccard similarity of their sets of ``shingle`` words is 0.8 or more
    (a shorter text is one shingle) and their fingerprints differ in ``radius`` and WIDE_RADIUS bits at most; 64-bit hashes stand for shingles.
    Texts of equal sets are one node, so copies are never paired. Links are stars, of buckets and of families, so a group of
    any size gives a few for each member, whether its members are near copies or only nearly so.

    Null and empty texts have no row; repeated keys and equal rows have a row each; the key may be of any type that has an
    order, and must not be null. Very long texts are read in stretches. An empty table gives none; other columns aren't read.
    The session's Arrow batches are bounded from then on.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    frequent = frequent_shingles(plain, shingle, seed)
    rows = scratch(plain.mapInArrow(releasing(_sets(shingle, seed, frequent)), f"key {kind}, sig long, fp long, n int, head array<long>, w0 long, w1 long, w2 long"), "sets")
    nodes = rows.groupBy("sig").agg(F.min("key").alias("low"), *(F.first(c).alias(c) for c in [*SET_COLUMNS[2:], *WIDE_COLUMNS]))
    nodes, keys = scratch(nodes, "nodes"), scratch(rows.select("key", "sig"), "keys")
    drop_scratch(rows)
    lows = scratch(nodes.select("sig", "low", "n"), "lows")
    joined = scratch(families(nodes, radius).withColumnsRenamed({"node": "sig", "component": "family"}), "families")
    drop_scratch(nodes)
    # Whole sets are made again for what has a family.
    total = scratch(joined.join(lows, "sig").groupBy("family").agg(F.sum("n").alias("total")), "total")
    some = scratch(joined.join(lows, "sig").select(F.col("low").alias("key")).distinct(), "some")
    sets = plain.join(some, "key", "left_semi").mapInArrow(releasing(_whole_sets(shingle, seed)), "sig long, hashes array<long>").dropDuplicates(["sig"])
    members = tiled(joined.join(total, "family"), "family", F.ceil(F.col("total") / TILE_SHINGLES), "sig").drop("total")
    meet = members.join(sets, "sig").repartition("family").sortWithinPartitions("family", "sig")
    links = meet.select("family", "sig", "hashes").mapInArrow(releasing(_exact_links), "a long, b long")
    groups = connected_components(links)
    groups = lows.join(groups, lows["sig"] == groups["node"], "left").select("sig", F.coalesce("component", "sig").alias("root"), "low")
    groups = scratch(groups, "groups")
    least = scratch(groups.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    ids = groups.join(least, "root").select("sig", "component_id")
    return keys.join(ids, "sig").select(F.col("key").alias(key), "component_id")
