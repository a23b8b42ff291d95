import json
import threading
import urllib.error
import urllib.request
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_dataset import KEY, tables

from quillspan import cli
from quillspan.operators import rowquality, serve
from quillspan.plans.contracts import SOURCES
from quillspan.serving import api


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A build from raw tables, by the commands."""
    folder = tmp_path_factory.mktemp("built")
    for name, df in tables(spark).items():
        df.write.parquet(f"{folder}/raw/{name}.parquet")
    out = f"{folder}/out"
    counts = cli.main(["build", "--raw", f"{folder}/raw", "--out", out, "--demo-size", "1"], spark)
    assert counts["works_master"] == 4 and counts["expenditure_transactions"] == 4
    assert cli.main(["features", "--out", out], spark) == {"features": 4}
    assert cli.main(["anomalies", "--out", out], spark) == {"scored": 4}
    assert cli.main(["duplicates", "--out", out], spark)["batch"] == 0
    return out


@pytest.fixture(scope="module")
def reads(spark, built):
    names = {"features": "features", "master": "works_master", "payments": "expenditure_by_work", "scored": "scored", "pairs": "pairs", "masked": "masked"}
    return api.Reads({k: spark.read.parquet(f"{built}/parquet/{n}") for k, n in names.items()})


def test_files(spark, built):
    quality = spark.read.text(f"{built}/quality.md", wholetext=True).first()[0]
    assert "recommended_with_sanction_date_not_in_sanctioned" in quality and "bad_financial_year" in quality
    words = spark.read.text(f"{built}/dictionary.md", wholetext=True).first()[0]
    assert "## works_master" in words and "| days_since_sanction | time | monitoring |" in words
    assert "Signals by severity" in spark.read.text(f"{built}/scores.md", wholetext=True).first()[0]
    assert "Suitability" in spark.read.text(f"{built}/features.md", wholetext=True).first()[0]
    demo = spark.read.option("header", True).csv(f"{built}/demo/works_master").collect()
    assert [r.work_id for r in demo] == [KEY % 1]  # the only work of the master with payments
    assert {r.work_id for r in spark.read.option("header", True).csv(f"{built}/demo/expenditure_transactions").collect()} == {KEY % 1}
    assert json.loads(spark.read.text(f"{built}/profile.json", wholetext=True).first()[0])["works_master"]["rows"] == 4


def test_answers(reads):
    get = lambda url: api.answer(reads, f"/api/v1/{url}")
    status, body = get("summary")
    assert status == 200 and body["works"] == 4 and sum(x["works"] for x in body["by_state"]) == 4
    assert get("states")[1] == get("states")[1] != []
    status, body = get("anomalies?page_size=3&sort=-review_priority_score,state&state=KARNATAKA")
    assert status == 200 and (len(body["items"]), body["total"], body["pages"]) == (3, 4, 2)
    for url in ("anomalies?page=0", "anomalies?sort=nope", "anomalies?page=x", "anomalies?min_score=9&max_score=1", "anomalies?odd=1", "duplicates?order=nope"):
        assert get(url)[0] == 422, url
    key = KEY % 1
    assert get(f"anomalies/{key}")[1]["work_id"] == key
    status, work = get(f"works/{key}")
    assert status == 200 and work["identity"]["work"].startswith("MP/MP62") and work["review_status"] == "scored" and work["review"]["label"]
    assert work["timeline"]["first_payment_date"] == date(2024, 6, 1) and work["payments"]["vendor_count"] == 1 and "state" in work["peers"]
    assert get("works/none")[0] == get("anomalies/none")[0] == get("nothing")[0] == 404
    assert get("trends")[0] == 503  # no events were given
    assert get("duplicates")[0] == 200 and get("duplicates/summary")[1]["clusters"] == 0
    assert get("compliance")[1]["works"] == 4 and len(get("compliance/queue?rule=COMP-02")[1]["items"]) >= 1
    bare = api.Reads({"features": reads.tables["features"]})
    assert api.answer(bare, f"/api/v1/works/{key}")[1]["review_status"] == "unavailable" and api.answer(bare, "/api/v1/anomalies")[0] == 503


def test_http(reads):
    server = api.server(reads, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}/api/v1"
    try:
        with urllib.request.urlopen(f"{at}/summary") as r:
            assert json.load(r)["works"] == 4
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{at}/works/none")
        assert e.value.code == 404
    finally:
        server.shutdown()


def test_numbers_are_days(spark):
    source = SOURCES["completed"]
    cells = [(2, "45000", ["completion_date"]), (3, "45000", []), (4, "45000.75", ["completion_date"]), (5, "0", ["completion_date"]), (6, "08-Jul-2024", [])]
    rows = spark.createDataFrame(cells, "source_row int, completion_date string, numeric array<string>")
    for c in source.columns:
        if c != "completion_date":
            rows = rows.withColumn(c, F.lit("MP/MP1/2024-2025/1 - x" if c == source.key else "5" if c == source.amount else "Goa"))
    got = {r.source_row: (r.completion_date, r.completion_date__p.status, r.completion_date__p.notes) for r in rowquality.evaluate(rows, source).collect()}
    day = date(2023, 3, 15)
    assert got == {2: (day, "ok", ["excel_serial"]), 3: (None, "invalid", ["unrecognised_format"]), 4: (day, "ok", ["excel_serial"]), 5: (None, "invalid", ["number_not_a_date"]), 6: (date(2024, 7, 8), "ok", [])}


def test_lookup_of_a_work_without_other_tables(spark):
    works = spark.createDataFrame([("a/1", "Goa")], "work_id string, state string")
    assert serve.work_detail("a/1", works)["identity"]["state"] == "Goa"
    with pytest.raises(serve.NotFound):
        serve.work_detail("b", works)
