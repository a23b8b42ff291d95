import math
import random

import duckdb
import pytest

from quillspan.llm import license as licenses

MIT = "Released under the MIT License."


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")


def brute(text, least=licenses.MIN_DICE, templates=licenses.TEMPLATES):
    """Every window that starts anywhere, by the definition."""
    grams, best = licenses.bigrams(licenses.normalise(text or "")), []
    known = [(n, licenses.bigrams(licenses.normalise(t))) for n, t in templates]
    for _, have in known:
        own = set(have)
        longest = math.floor(round(len(own) * (2 - least) / least, 9)) + len(have) - len(own)
        top = 0.0
        for a in range(len(grams)):
            for b in range(a + 1, min(len(grams), a + longest) + 1):
                inside = [g for g in grams[a:b] if g in own]
                top = max(top, 2 * len(set(inside)) / (len(set(inside)) + (b - a - len(inside)) + len(own)))
        best.append(top)
    out = []
    for i, (name, have) in enumerate(known):
        rivals = [u for u, (other, body) in enumerate(known) if other != name and licenses.best_window(have, body) >= least]
        if best[i] >= least and all(best[u] <= best[i] for u in rivals):
            out.append((name, best[i]))
    return len(out), ",".join(sorted({n for n, _ in out})), round(max((d for _, d in out), default=0.0), 6)


def test_bands_are_exact():
    for n in range(1, 300):
        sizes = [m for m in range(1, 700) if 2 * 5 * min(m, n) >= 4 * (m + n)]
        assert licenses.band(n, 0.8) == (sizes[0], sizes[-1])
    assert licenses.band(4, 0.8) == (3, 6)


def test_found(spark):
    wrapped = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies\n# of the Software, and to permit persons to whom the Software is furnished to do\n# so, subject to the following conditions:\nimport os"
    texts = {
        None: "", "": "", " \n ": "", "one": "", MIT: "MIT", "It is released under the MIT License.": "MIT", f"x\n{MIT.upper()}\n{MIT}\nLicensed under CC BY 4.0": "CC-BY-4.0,MIT",
        "released under the license " * 9: "", "Licensed under the Apache License, Version 2.0!": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", wrapped: "MIT",
        "# Copyright 2020 Foo. Released under the MIT License. See the file for details of it.": "MIT",
        "a " * 3000 + "Licensed under the\nApache License,\nVersion 2.0 " + "b " * 3000: "Apache-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 3. Elsewhere: This work is licensed under the GNU Lesser General Public License, version 3.": "GPL-3.0,LGPL-3.0",
    }
    for name, body in licenses.TEMPLATES:
        texts[f"start {body} end"] = name
    rows = list(texts)
    got = {x.doc_id: x.licenses for x in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {t: got[i] for i, t in enumerate(rows)} == texts


def test_edges(spark):
    docs = spark.createDataFrame([(3, MIT, 1), (3, MIT, 1), (None, "no", 2), (None, None, 3)], "doc_id long, text string, best_dice int")
    assert sorted(map(str, licenses.scan_licenses(docs).collect())) == sorted(["Row(doc_id=3, n_templates=2, licenses='MIT', best_dice=1.0)"] * 2 + ["Row(doc_id=None, n_templates=0, licenses='', best_dice=0.0)"] * 2)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert [x.licenses for x in licenses.scan_licenses(docs, templates=()).collect()] == [""] * 4
    long = "word " * 400_000 + MIT + " Released under the MIT License." * 2000
    (x,) = licenses.scan_licenses(frame(spark, [long])).collect()
    assert (x.licenses, x.best_dice) == ("MIT", 1.0)


@pytest.fixture(scope="module")
def changed():
    """Templates with words put in, left out and changed, between other words."""
    r = random.Random(3)
    texts = []
    for k in range(90):
        w = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 1 + len(w) // 8)):
            i = r.randrange(len(w))
            kind = r.randrange(4)
            if kind == 0:
                w[i] = "zz%d" % r.randrange(3)
            elif kind == 1:
                w[i:i] = ["yy"]
            elif kind == 2 and len(w) > 2:
                del w[i]
            else:
                w[i:i] = w[i : i + 2]
        around = lambda: [r.choice("the of under work license a b c".split()) for _ in range(r.randint(0, 8))]
        sep = r.choice([" ", "\n", "\n# "])
        texts.append(sep.join(around() + w + around()))
    return [*texts, None, "", "x"]


def test_against_brute_force(spark, changed):
    got = {x.doc_id: (x.n_templates, x.licenses, x.best_dice) for x in licenses.scan_licenses(frame(spark, changed)).collect()}
    want = {i: brute(t) for i, t in enumerate(changed)}
    assert got == want
    assert sum(bool(w[0]) for w in want.values()) > 40 and sum(0.8 <= w[2] < 0.83 for w in want.values()) > 1


def test_sql(changed, spark, tmp_path):
    docs = frame(spark, changed)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(licenses.OP3_SQL).fetchall())
    assert sorted(map(tuple, licenses.scan_licenses(docs).collect())) == want
