import random

import numpy as np

import corpus_pipeline
from quillspan.llm import nearcopies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    out = [None, "", " \n", "one", "One", "a b c d", "a b c d e"]
    for _ in range(150):
        base = [word() for _ in range(r.randint(4, 220))]
        out.append(" ".join(base))
        for _ in range(r.randint(1, 4)):
            w = base[:]
            for _ in range(r.randint(1, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def test_groups_are_those_of_exact_similarity(spark):
    rows = list(enumerate(texts()))
    sets = {i: shingles(t) for i, t in rows}
    fps = {i: simhash.fingerprint(t, 5) for i, t in rows}
    low = {i: i for i in sets if sets[i]}
    links, far = [], 0
    for a in low:
        for b in low:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                links.append((a, b))
                far += (fps[a] ^ fps[b]).bit_count() > 6
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(low[a], low[b])
            changed |= low[a] != low[b]
            low[a] = low[b] = least
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearcopies.near_copy_groups(docs)
    assert {x.doc_id: x.component_id for x in got.collect()} == low
    assert far > 20  # links that six bits don't give
    assert nearcopies.near_copy_groups(docs.limit(0)).count() == 0


def test_hot_buckets_lose_no_pair(spark):
    rows = [(k, int(x), 10, [7, 9]) for k, x in enumerate([0, 1, 3, 7, 15, 31, 63, -1] * 3)]
    nodes = spark.createDataFrame(rows, "sig long, fp long, n int, head array<long>")
    whole = {tuple(x) for x in nearcopies.candidates(nodes, 6, len(rows)).collect()}
    assert whole == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[1] ^ b[1]) % (1 << 64)).bit_count() <= 6}
    assert {tuple(x) for x in nearcopies.candidates(nodes, 6, len(rows), tile=5).collect()} == whole


def test_stage_wants_similarity_not_bits(spark):
    r = random.Random(9)
    while True:
        w = [f"w{r.randrange(10**6)}" for _ in range(80)]
        a, b = " ".join(w), " ".join([*w[:78], "x", "y"])
        if (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > 6:
            break
    while True:
        w = [f"w{r.randrange(10**6)}" for _ in range(100)]
        c, d = " ".join(w), " ".join([*w[:84], *(f"v{i}" for i in range(16))])
        if (simhash.fingerprint(c, 5) ^ simhash.fingerprint(d, 5)).bit_count() <= 6:
            break
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate([a, b, c, d])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_copy_stage(spark, docs, "").collect()} == {0, 2, 3}


def test_a_group_is_not_expanded_into_all_pairs(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join([*base[:k], f"v{i}", *base[k + 1 :]]) for i in range(600) for k in [r.randrange(60)]]
    counts = []
    for n in (300, 600):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "key long, text string").repartition(3)
        nodes = docs.mapInArrow(nearcopies._sets(5, 42), "key long, sig long, fp long, n int, head array<long>").drop("key").distinct().cache()
        rows = nearcopies.bucket_rows(nodes, n).withColumn("group", nearcopies.F.col("sig"))
        found = nearcopies._searched(rows, nearcopies._stars, nearcopies.RADIUS, "bucket long, sig long, other long, prev long, fp long, n int")
        counts.append((found.count(), nearcopies.candidates(nodes, nearcopies.RADIUS, n).count()))
    (few, all_), (more, pairs) = counts
    assert more < 2.5 * few and pairs > 3.5 * all_ and more < pairs / 8
    assert {x.component_id for x in nearcopies.near_copy_groups(docs, key="key").collect()} == {0}


def test_a_family_just_below_gives_no_pairs(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    counts = []
    for n in (150, 300):  # three places differ: most pairs are below 0.8, and all in one family
        rows = []
        for i in range(n):
            gone = set(r.sample(range(100), 3))
            rows.append((i, " ".join(f"v{i}" if k in gone else w for k, w in enumerate(base))))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        kind = "key long, sig long, fp long, n int, head array<long>, w0 long, w1 long, w2 long"
        nodes = docs.withColumnRenamed("doc_id", "key").mapInArrow(nearcopies._sets(5, 42, np.zeros(0, np.uint64)), kind).cache()
        family = nearcopies.families(nodes, nearcopies.RADIUS)
        assert family.select("component").distinct().count() == 1 and family.count() == n
        counts.append(nearcopies.candidates(nodes.select("sig", "fp", "n", "head"), nearcopies.RADIUS, n).count())
        assert sorted(x.component_id for x in nearcopies.near_copy_groups(docs).collect()) == brute(rows)
    assert counts[1] > 3.5 * counts[0]


def brute(rows):
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for _ in rows:
        before = dict(low)
        for a in sets:
            for b in sets:
                if a < b and low[a] != low[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                    low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    return sorted(low.values())


def test_tiles_and_the_order_of_shingles_lose_no_link(spark, monkeypatch):
    rows = list(enumerate(texts()[:200]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, nearcopies.near_copy_groups(docs).collect()))
    monkeypatch.setattr(nearcopies, "TILE_SHINGLES", 300)
    monkeypatch.setattr(nearcopies, "SAMPLE", 40)  # with it, nearly every repeated shingle is frequent
    assert sorted(map(tuple, nearcopies.near_copy_groups(docs).collect())) == whole


def test_exact_step_needs_few_bytes_a_shingle():
    import tracemalloc

    r = np.random.default_rng(1)
    new = lambda: r.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64)
    base = new()
    for changed in (0.02, 1.0):  # near copies, and sets that only chance joined
        sets = [np.unique(np.where(r.random(400) < changed, new(), base)) for _ in range(1000)]
        tracemalloc.start()
        stars = nearcopies.exact_stars(sets)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(stars) == (999 if changed < 1 else 0)
        assert most < 42 * sum(map(len, sets))  # a tile's shingles and indexes in one worker


def test_stars_are_the_same_in_small_steps(monkeypatch):
    r = random.Random(6)
    base = [r.randrange(1 << 60) for _ in range(60)]
    sets = [np.unique(np.array([r.randrange(90) if r.random() < 0.1 else x for x in base], np.uint64)) for _ in range(40)]
    whole = nearcopies.exact_stars(sets)
    monkeypatch.setattr(nearcopies, "PLACES", 7)
    assert whole and nearcopies.exact_stars(sets) == whole


def test_arrow_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from quillspan.llm import memory

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
        assert nearcopies.near_copy_groups(docs).count() == 2
        long = spark.range(3000, numPartitions=1).selectExpr("repeat(cast(id as string), 3000) as text")  # 33 MB in one task
        most = max(r.n for r in long.mapInArrow(sizes, "n long").collect())
        assert most < 1.5 * memory.BATCH_BYTES
        spark.conf.set(name, "1000")  # a smaller limit stays
        memory.bounded_batches(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
