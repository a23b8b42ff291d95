import math
import random
import zlib

import numpy as np

from quillspan.llm import toxicity as tox


def test_isotonic():
    r = np.random.default_rng(2)
    for _ in range(50):
        s, y = np.round(r.random(60), 1), (r.random(60) < 0.4).astype(float)
        x, v = tox.isotonic(s, y)
        assert (np.diff(v) >= 0).all() and (np.diff(x) > 0).all()
        fit = np.interp(s, x, v)
        assert abs(fit.sum() - y.sum()) < 1e-9
        # no monotone step function does better
        for cut in np.unique(s):
            low, high = y[s <= cut], y[s > cut]
            if len(low) and len(high) and low.mean() <= high.mean():
                assert ((fit - y) ** 2).sum() <= ((low - low.mean()) ** 2).sum() + ((high - high.mean()) ** 2).sum() + 1e-9


def test_trees_learn_an_interaction():
    r = np.random.default_rng(5)
    x = r.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3) | (x[:, 2] > 0.9)).astype(float)
    m = tox.fit_trees(x[:1500], y[:1500])
    assert (((m.raw(x[1500:]) > 0) == (y[1500:] == 1)).mean()) > 0.96
    assert np.isfinite(tox.fit_trees(x[:0], y[:0]).raw(x)).all()


def plain_fit(x, y, rounds, depth, rate, bins, least, l2):
    """The same trees by trying every split of every node on its own rows."""
    edges = [sorted({*np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist(), 0.0}) for c in x.T]
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = math.log(mean / (1 - mean))
    raw, trees = [base] * len(y), []

    def grow(rows, level, p):
        g, h = [y[i] - p[i] for i in rows], [p[i] * (1 - p[i]) for i in rows]
        if level == depth:
            return rate * sum(g) / (sum(h) + l2)
        best, split = 1e-9, None
        for f in range(x.shape[1]):
            top, at = -2.0, None
            for cut in edges[f]:
                left = [k for k, i in enumerate(rows) if x[i, f] <= cut]
                right = [k for k, i in enumerate(rows) if x[i, f] > cut]
                if len(left) < least or len(right) < least:
                    continue
                G, H = sum(g[k] for k in left), sum(h[k] for k in left)
                A, B = sum(g[k] for k in right), sum(h[k] for k in right)
                gain = G * G / (H + l2) + A * A / (B + l2) - (G + A) ** 2 / (H + B + l2)
                if gain > top + 1e-12:
                    top, at = gain, cut
            if at is not None and top > best + 1e-9:
                best, split = top, (f, at)
        if split is None:
            return (0, math.inf, grow(rows, level + 1, p), 0.0)
        f, cut = split
        return (f, cut, grow([i for i in rows if x[i, f] <= cut], level + 1, p), grow([i for i in rows if x[i, f] > cut], level + 1, p))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        tree = grow(list(range(len(y))), 0, p)
        trees.append(tree)
        raw = [r + walk(tree, x[i]) for i, r in enumerate(raw)]
    return base, trees


def walk(node, row):
    """One row down one tree, a node at a time."""
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def test_trees_are_those_of_an_exhaustive_search():
    r = np.random.default_rng(9)
    x = np.round(r.random((160, 3)), 2)
    y = ((x[:, 0] > 0.6) ^ (r.random(160) < 0.1)).astype(float)
    own = dict(rounds=4, depth=2, rate=0.3, bins=8, least=8, l2=1.0)
    fast, (base, trees) = tox.fit_trees(x, y, **own), plain_fit(x, y, **own)
    want = [base + sum(walk(t, row) for t in trees) for row in x]
    assert np.allclose(fast.raw(x), want, atol=1e-9)


def test_scores_are_those_of_a_walk(spark):
    rows, known, _ = corpus()
    model = tox.fit(spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(known, "doc_id long, toxic int"))
    m, heads = model.trees, tox.lexicon_heads(model.learned)

    def scalar(text):
        row = tox.text_features(text, model.learned, heads)
        raw = m.base
        for feature, cut, leaves in m.trees:
            k = node = 0
            for level in range(m.depth):
                k = (1 << level) - 1 + node
                node = 2 * node + int(row[feature[k]] > cut[k])
            raw += leaves[node]
        xs, ys = model.knots.tolist(), model.values.tolist()
        i = sum(x <= raw for x in xs)
        fit = ys[0] if i == 0 else ys[-1] if i == len(xs) else ys[i - 1] + (ys[i] - ys[i - 1]) * (raw - xs[i - 1]) / (xs[i] - xs[i - 1])
        return min(1.0, max(0.0, 0.998 * fit + 0.002 / (1 + math.exp(-raw))))

    some = rows[:200]
    got = tox.score_toxicity(spark.createDataFrame(some, "doc_id long, text string, score int"), model).collect()
    assert all(abs(x.score - scalar(t)) < 1e-9 for x, (_, t, _) in zip(sorted(got, key=lambda x: x.doc_id), some))


def test_a_fit_can_be_repeated(spark):
    rows, known, _ = corpus()
    rows = rows[:400]
    rows += [(k, t, 2) for k, t, _ in rows[50:90]] + [(k, "other text", 2) for k, _, _ in rows[90:95]]  # equal and repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    one, two = (tox.fit(docs.repartition(n), labels.repartition(n)) for n in (3, 7))
    texts = [t for _, t, _ in rows[:60]]
    x = np.array([tox.text_features(t, one.learned, tox.lexicon_heads(one.learned)) for t in texts])
    assert one.learned == two.learned and np.array_equal(one.score(x), two.score(x)) and np.array_equal(one.knots, two.knots)


def test_stretches_are_read_as_one():
    text = " ".join(["You are an idiot, m0ron! WHAT a nice day $hit"] * 40_000)
    f = dict(zip(tox.FEATURES, tox.text_features(text)))
    g = dict(zip(tox.FEATURES, tox.text_features(text[: 46 * 100 - 1])))
    assert all(abs(f[k] - g[k]) < 0.02 * max(1, abs(g[k])) for k in f if k not in ("log_known", "log_words"))
    assert f["disguised_known"] > 0 and f["you"] > 0


def test_features():
    f = dict(zip(tox.FEATURES, tox.text_features("You are an IDIOT! tra5h i d i o t, so 1d1ot m0ron", frozenset({"so*", "are", "trash*"}), frozenset({"so", "are", "tras"}))))
    assert f["fixed"] > 0 and f["near_you"] > 0 and f["learned"] > 0 and f["disguised_known"] > 0 and f["shouted"] > 0 and f["exclaim"] > 0
    assert all(map(tox.is_disguised, ["1diot", "$hit", "st*pid", "m0r0n!", "idi0t*"])) and not any(map(tox.is_disguised, ["2nd", "a1", "x*y", "b2b"]))
    assert dict(zip(tox.FEATURES, tox.text_features("what do you want, 1diot")))["disguised_known"] > 0
    assert tox.text_features(None) == tox.text_features("") == tox.text_features(" ?! ") == [0.0] * len(tox.FEATURES)


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [(0, None, 1), (1, "", 1), (2, "x" * 100_000, 1)], [(0, 0), (1, 0)]
    for k in range(3, 1200):
        w = [word() for _ in range(r.randint(5, 150))]
        bad = r.random() < 0.2
        if bad:
            for _ in range(r.randint(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(["moron", "zzork" + word(), "zzork" + word()]))
        docs.append((k, " ".join(w), 1))
        if r.random() < 0.8:
            labels.append((k, int(bad)))
    return docs, [*labels, (5, None), (None, 1), labels[7]], {k: int("moron" in t or "zzork" in t) for k, t, _ in docs if t}


def test_held_out_accuracy(spark):
    rows, known, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    assert any(w.startswith("zzor") for w in model.learned)
    got = tox.score_toxicity(docs, model).withColumn("h", tox.held_out("doc_id")).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    assert all(x.h == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    out = [(x.predicted, truth.get(x.doc_id, 0)) for x in got if x.h]
    assert sum(a == b for a, b in out) / len(out) > 0.97
    # labels of held-out rows don't matter
    flipped = spark.createDataFrame([(k, t if k is None or t is None or zlib.crc32(str(k).encode()) % 3 != 1 else 1 - t) for k, t in known], "doc_id long, toxic int")
    again = tox.score_toxicity(docs, tox.fit(docs, flipped)).collect()
    assert {x.doc_id: x.score for x in again} == {x.doc_id: x.score for x in got}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(x.score, 6) for x in tox.score_toxicity(docs, tox.fit(docs, none)).collect()] == [0.5, 0.5]
    assert tox.score_toxicity(docs.limit(0), tox.fit(docs.limit(0), none)).count() == 0
