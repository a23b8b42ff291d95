"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspan.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
        return str(v)
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return str(v)[:10]
    return repr(round(float(v), 6)) if isinstance(v, (int, float, decimal.Decimal)) or hasattr(v, "dtype") else str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_operators(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(here):
        if name not in ("quillspan", "corpus_pipeline.py", ".git"):
            os.symlink(f"{here}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "quillspan")
    for name in os.listdir(f"{here}/quillspan"):
        if name != "llm":
            os.symlink(f"{here}/quillspan/{name}", tmp_path / "quillspan" / name)
    code = "import __spark_entry__ as e; assert 'payments_by_work' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
