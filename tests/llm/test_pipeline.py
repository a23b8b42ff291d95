import random
import re

import corpus_pipeline
from quillspan.llm import bpe, decontam, simhash, substring, toxicity

COLUMNS = corpus_pipeline.COLUMNS


def make(spark, tmp):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    texts = [None, "", " \n", "", "one"]
    for k in range(260):
        w = [word() for _ in range(r.randint(5, 160))]
        if k % 9 == 0:
            w[3:3] = ["moron", "idiot", "zzork" + word()]
        if k % 17 == 1:
            w[4:4] = passage.split()
        if k % 23 == 2:
            w[2:2] = r.choice(items)[1].split()
        texts.append(" ".join(w))
    texts += texts[5:25] + [t + " end" for t in texts[40:60]]
    docs = [(i, t, "en", "s%d" % (i % 3), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp}/documents.parquet")
    labels = [(i, 1, int("moron" in (t or ""))) for i, t in enumerate(texts) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return docs, items


def near_copies(rows):
    """One row of each component of texts at a Jaccard similarity of 0.8, by all pairs."""
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    best = {}
    for i, x in enumerate(rows):
        if sets[i]:
            own = (x[0] is None, x[0] or 0)
            if top(i) not in best or own < best[top(i)][0]:
                best[top(i)] = (own, i)
    stay = {i for _, i in best.values()}
    return [x for i, x in enumerate(rows) if not sets[i] or i in stay]


def cut(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = []
    for i, t, *rest in rows:
        w = words[i]
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        if not gone:
            out.append((i, t, *rest))
        elif len(gone) < len(w):
            text = " ".join(x for j, x in enumerate(w) if j not in gone)
            out.append((i, text, *rest[:2], len(text)))
    return out


def clean(rows, items):
    def holds(text):
        words = decontam.tokens(text)
        return any(decontam.myers(p, words) <= int(len(p) * decontam.RATE) for p in (decontam.tokens(b) for _, b in items))

    return [x for x in rows if not holds(x[1])]


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = make(spark, tmp_path)
    frame, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs
    model = toxicity.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import numpy as np

    score = lambda t: model.score(np.array([toxicity.text_features(t, model.learned, toxicity.lexicon_heads(model.learned))]))[0]
    brute = [lambda x: [d for d in x if score(d[1]) < toxicity.THRESHOLD], near_copies, cut, lambda x: clean(x, items)]
    sizes = [len(rows)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == COLUMNS
        rows = plain(rows)
        assert sorted(map(tuple, out.collect())) == sorted(rows), name
        path = str(tmp_path / name)
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        sizes.append(len(rows))
    assert all(a > b for a, b in zip(sizes, [*sizes[1:3], sizes[4]]))
    assert {i for i, t, *_ in docs if not (t or "").split()} <= {x[0] for x in rows}  # clean, if empty
    own = bpe.encoder(bpe.vocabulary())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: len(own.encode([t or ""])[0]) for i, t, *_ in rows}


def stage(spark, tmp, name, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame([(1, "some benchmark item of quite a few words here")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp}/{name[:5]}")
    return sorted(map(tuple, dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{tmp}/{name[:5]}"), str(tmp)).collect()), key=str)


def rest(t):
    return (t, "en", "s", len(t or ""))


def test_null_and_repeated_ids(spark, tmp_path):
    bad, good = "before some benchmark item of quite a few words here after", "nothing of that kind is in this one"
    rows = [(None, *rest(bad)), (9, *rest(bad)), (9, *rest(good)), (None, *rest(None)), (3, *rest(""))]
    assert stage(spark, tmp_path, "benchmark decontamination", rows) == sorted(rows[2:], key=str)
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, *rest(one)), (1, *rest(one)), (5, *rest(one)), (5, *rest(two)), (None, *rest(one)), (None, *rest(three)), (None, *rest(three)), (7, *rest(" ")), (7, *rest(" ")), (None, *rest(None))]
    assert stage(spark, tmp_path, "simhash near-dedup", rows) == sorted([rows[0], rows[3], rows[5], *rows[7:]], key=str)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, *rest(long)), (2, *rest(long)), (None, *rest(long)), (4, *rest(long + " tail"))]
    assert stage(spark, tmp_path, "substring dedup", rows) == sorted([*rows[:3], (4, "tail", "en", "s", 4)], key=str)
    assert len(stage(spark, tmp_path, "toxicity", rows)) == 4 == len(stage(spark, tmp_path, "bpe encoding and decoding", rows))


def test_empty_tables_long_texts_and_further_columns(spark, tmp_path):
    wide = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, n_words int, predicted int, component_id long"
    more = ("r", "k", 1, 1, 1)
    long = "ab cd " * 300_000
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, tmp_path, name, [], wide) == []
        got = stage(spark, tmp_path, name, [(1, *rest(long), *more), (2, *rest("x y"), *more)], wide)
        if name.startswith("bpe"):
            assert [(x[0], x[1]) for x in got] == [(1, 600_001), (2, 2)]
        else:
            assert got == [(1, *rest(long)), (2, *rest("x y"))]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "benchmark decontamination", "bpe encoding and decoding"]
    assert substring.WINDOW == 50
