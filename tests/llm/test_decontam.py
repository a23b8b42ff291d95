import random

from quillspan.llm import decontam


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(4)
    for _ in range(600):
        a = [r.choice("abc") for _ in range(r.randint(1, 90))]
        b = [r.choice("abc") for _ in range(r.randint(0, 40))]
        assert decontam.myers(a, b) == distance(a, b)


def test_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: r.choice(["the", "of", "Äh", "to", "x1", *("w%d" % r.randrange(60) for _ in range(4))])
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "ha " * 12)]
    rows = [(1, None), (2, ""), (3, "ha " * 300), (None, items[7][1])]
    for k in range(10, 160):
        w = [word() for _ in range(r.randint(0, 60))]
        if r.random() < 0.7:
            part = (r.choice(items)[1] or "").split()
            for _ in range(r.randint(0, 8)):
                if part:
                    i = r.randrange(len(part))
                    part[i : i + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 2))]
            at = r.randint(0, len(w))
            w[at:at] = part
        rows.append((k, "".join(x.upper() + r.choice([" ", ", ", ".\n"]) for x in w)))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, t in rows:
        for i, b in items:
            p = decontam.tokens(b)
            if p and (d := distance(p, decontam.tokens(t))) <= int(len(p) * decontam.RATE):
                want.append((k, i, d))
    for size in (decontam.BLOCK_BYTES, 500):
        got = decontam.contamination(docs, bench, block_bytes=size)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len(want) > 30 and any(len(decontam.tokens(dict(items)[i])) < 4 for _, i, _ in want)
    held = {(k, t) for k, t in rows if any((k, i, d) in want for i, _ in items for d in range(9))}
    for size in (decontam.BLOCK_BYTES, 500):
        left = decontam.without_items(docs, bench, block_bytes=size)
        assert left.columns == docs.columns
        assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted((x for x in rows if x not in held), key=str)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).count() == 0


def test_long_texts_are_read_in_stretches():
    m = decontam.Matcher([(7, "one two three four five six seven eight nine ten"), (8, "solo")], decontam.RATE)
    for lead in (1 << 20, (1 << 20) - 20, (1 << 20) - 47, (1 << 20) - 5):
        text = "x" * (lead - 1) + " One, two three four FIVE six eight nine ten. " + "y " * 700_000 + "solo"
        assert sorted(m.find(text)) == [(7, 1), (8, 0)]
    assert m.find("z " * 900_000) == []
