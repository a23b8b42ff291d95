import random
import re

import numpy as np
import xxhash

from quillspan.llm import simhash


def plain(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, radius=4):
    ids = list(fps)
    comp = {i: i for i in ids}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeÉ") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(60)]
    out = [None, "", " \n\t", "one", "One  TWO", "one two x", "a b c d", *base, *base[:20]]
    for _ in range(120):
        w = r.choice(base).split()
        w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return out


def test_fingerprint():
    for t in texts():
        assert simhash.fingerprint(t) == plain(t)


def test_long_texts_are_read_in_stretches():
    r = random.Random(6)
    w = ["".join(r.choice("abcD") for _ in range(r.randint(1, 9))) for _ in range(500_000)]
    text = "\n ".join(w)
    assert len(text) > 3 << 20
    low = [x.lower() for x in w]
    want = np.array([xxhash.xxh64(" ".join(low[i : i + 4]).encode(), seed=42).intdigest() for i in range(len(w) - 3)], "<u8")
    assert np.array_equal(simhash.shingle_hashes(text), want)
    most = 2 * np.unpackbits(want.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) > len(want)
    assert simhash.fingerprint(text) == int(np.packbits(most, bitorder="little").view("<u8")[0])
    assert len(simhash.shingle_hashes("x" * 5_000_000)) == 1 and len(simhash.shingle_hashes(" " * 5_000_000)) == 0


def test_pivot_tables(spark):
    fps = [0, -1, 5, 1 << 62, -(1 << 63)]
    rows = sorted(map(tuple, simhash.with_pivot_table(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()))
    table = simhash.pivot_table(np.array([x[1] for x in rows]), np.array([x[2] for x in rows]))
    assert table.T.tolist() == [[((f ^ p) % (1 << 64)).bit_count() for p in simhash.pivots()] for f in sorted(fps)]


def test_groups(spark):
    rows = [(3 * i, t, "k") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    fps = {i: plain(t) for i, t, _ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute(fps)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_links_lose_none(spark):
    r = random.Random(1)
    fps = {0}
    for _ in range(40):  # chains and clouds around random centres
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
    want = brute({f: f for f in fps})
    for tile in (8, simhash.TILE):
        df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
        links = simhash.fingerprint_links(simhash.with_pivot_table(df), 4, len(fps), tile=tile).collect()
        own = {f: f for f in fps}
        find = lambda x: x if own[x] == x else find(own[x])  # noqa: E731, B023
        for a, b in links:
            a, b = a % (1 << 64), b % (1 << 64)
            assert a != b
            a, b = find(a), find(b)
            own[max(a, b)] = min(a, b)
        assert {f: find(f) for f in fps} == want


def test_every_scheme_covers():
    for n in (10, 10**6, 10**9, 10**11):
        for radius in (1, 3, 4):
            b = simhash.blocks_for(n, radius)
            masks = [m % (1 << 64) for m in simhash.block_masks(b, b - radius)]
            r = random.Random(n)
            for _ in range(100):
                d = sum(1 << i for i in r.sample(range(64), radius))
                assert any(not m & d for m in masks)
