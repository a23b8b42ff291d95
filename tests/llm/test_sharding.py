import hashlib
import random
from collections import Counter, defaultdict

from quillspan.llm import sharding


def brute(rows, shards, seed=7):
    by = defaultdict(list)
    for k, s in rows:
        by[s].append((int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16), k))
    order = []
    for s, own in by.items():
        for r, (h, k) in enumerate(sorted(own)):
            order.append(((r + h / (1 << 60)) / len(own), s is not None, s or "", h, k))
    order.sort()
    n, out, last = len(order), {}, Counter()
    for i, (*_, k) in enumerate(order):
        shard = i * shards // n
        out[k] = (shard, last[shard])
        last[shard] += 1
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(k, r.choice(["hot"] * 12 + ["a", "b", "c", "", None])) for k in range(0, 6000, 3)]
    docs = spark.createDataFrame([(k, s, "x", 9) for k, s in rows], "doc_id long, source string, _n string, shard int").repartition(7)
    for groups in (1, 4):
        got = {x.doc_id: (x.shard, x.slot) for x in sharding.interleave(docs, 40, groups=groups).collect()}
        assert got == brute(rows, 40)
    sizes = Counter(s for s, _ in got.values())
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    hot = Counter(got[k][0] for k, s in rows if s == "hot")
    assert max(hot.values()) - min(hot.values()) <= 5  # each shard has the mixture


def test_edges(spark):
    kinds = "doc_id long, source string, size string"
    assert sharding.interleave(spark.createDataFrame([], kinds), 40).count() == 0
    odd = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "y"), (None, None, None)], kinds)
    got = sharding.interleave(odd, 40).collect()
    assert len(got) == 4 and len({(x.shard, x.slot) for x in got}) == 4
    many = spark.createDataFrame([(None if k % 3 else 7, f"s{k}", "x" * 1000) for k in range(400)], kinds)  # strata of one row, hot keys
    runs = [sorted((x.source, x.shard, x.slot) for x in sharding.interleave(many.repartition(n), 40).collect()) for n in (2, 5)]
    assert runs[0] == runs[1] and Counter(s for _, s, _ in runs[0]) == Counter(dict.fromkeys(range(40), 10))
