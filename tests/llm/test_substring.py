import hashlib
import random
import re

from quillspan.llm import substring


def brute(rows):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    low = {}
    for k, w in words:
        for i in range(len(w) - 49):
            if k is not None:
                g = tuple(w[i : i + 50])
                low[g] = min(k, low.get(g, k))
    out = []
    for k, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if k is not None and low[tuple(w[i : i + 50])] < k:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    pool = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 120, 300)]
    rows = [(0, None), (1, ""), (2, " \n"), (None, " ".join(pool[3])), (None, " ".join(pool[3]))]
    for k in range(3, 90):
        parts = [[word() for _ in range(r.randint(0, 60))]]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randrange(0, 30)
            parts += [p[a:] if r.random() < 0.5 else p, [word() for _ in range(r.randint(0, 40))]]
        rows.append((r.randrange(1, 80), r.choice([" ", "\n", " \t"]).join(x for p in parts for x in p)))
    rows += [(200, rows[20][1]), (201, rows[20][1]), (5, rows[21][1]), (5, rows[21][1]), (300, "a " * 200), (301, "a " * 90)]
    book = [word() for _ in range(30_000)]
    rows += [(400, " ".join(book)), (401, " ".join(book[100:20_000] + ["cut"] + book[20_000:]))]
    docs = spark.createDataFrame([(k, t, "z", "w") for k, t in rows], "doc_id long, text string, key string, n_words string").repartition(5)
    got = substring.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "key", "n_words", "n_removed", "kept_sha256"]
    got = got.collect()
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got], key=str) == brute(rows)
    assert all(x.n_removed or (x.doc_id, x.text) in rows for x in got)
    assert substring.remove_repeats(docs.limit(0)).count() == 0
