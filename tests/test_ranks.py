import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import ranks


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(12)
    value = lambda: r.choice([None, 0.0, float("nan"), r.gauss(0, 1e6), float(r.randint(-3, 3)), 7.25, r.random() * 1e-9, -(10.0 ** r.randint(0, 15))])
    data = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice(["x", "y", None]), value(), r.randint(0, 30)) for i in range(4000)]
    return data, spark.createDataFrame(data, "id long, g string, h string, v double, n int").repartition(5)


def test_percentiles(rows):
    data, df = rows
    points = (0.0, 0.05, 0.5, 0.9, 0.99, 1.0)
    found = ranks.percentiles(df, {"all": [], "g": ["g"], "both": ["g", "h"]}, {k: {"v": (F.col("v"), points), "n": (F.when(F.col("n") > 5, F.col("n")), (0.25, 0.75))} for k in ("all", "g", "both")})
    got = {(x.level, x.g, x.h, x.measure): (x.n, x.p) for x in found.collect()}
    want = {}
    for _, g, h, v, n in data:
        for key in (("all", None, None), ("g", g, None), ("both", g, h)):
            if key[0] == "g" and g is None or key[0] == "both" and None in (g, h):
                continue
            if v is not None and v == v:
                want.setdefault((*key, "v"), []).append(v)
            if n > 5:
                want.setdefault((*key, "n"), []).append(n)
    assert set(got) == set(want)
    for key, values in want.items():
        n, p = got[key]
        assert n == len(values)
        assert np.allclose(p, np.quantile(values, points if key[3] == "v" else (0.25, 0.75)), rtol=1e-12, atol=1e-12)
    assert ranks.percentiles(df.limit(0), {"all": []}, {"all": {"v": (F.col("v"), points)}}).count() == 0


def test_bands_rise_with_the_value(spark):
    v = sorted({0.0, *(s * m * 10.0**e for s in (-1, 1) for e in range(-12, 18) for m in (1, 1.1, 3, 9.99))})
    got = [x.b for x in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").select("i", ranks.band(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_numbers_and_neighbours(rows):
    data, df = rows
    order = [F.desc("n"), "id"]
    got = [(x.id, x.number) for x in ranks.numbered(df, order, ranges=7).collect()]
    want = {i: k + 1 for k, (i, *_) in enumerate(sorted(data, key=lambda x: (-x[4], x[0])))}
    assert dict(got) == want and len(got) == len(data)
    named = df.where("g is not null")
    for n in (2, 9):
        pairs = sorted(map(tuple, ranks.neighbours(named, ["g"], "id", ranges=n).collect()))
        want = []
        for g in ("a", "b", "hot"):
            ids = [i for i, x, *_ in data if x == g]
            want += [(g, a, b) for a, b in zip(ids, ids[1:])]
        assert pairs == sorted(want)


def test_sql_agrees(rows, spark):
    data, df = rows
    con = duckdb.connect()
    con.execute("CREATE TABLE t (v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for *_, v, _ in data if v is not None and v == v])
    want = con.execute("SELECT quantile_cont(v, [0.1, 0.5, 0.95]) FROM t").fetchone()[0]
    (x,) = ranks.percentiles(df, {"all": []}, {"all": {"v": (F.col("v"), (0.1, 0.5, 0.95))}}).collect()
    assert np.allclose(x.p, want, rtol=1e-12)
