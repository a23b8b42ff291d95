import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspan.functions import parse, similarity, text


def run(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


AMOUNTS = [
    ("448127", "448127", "ok", []), ("1,50,000", "150000", "ok", ["thousands_separator"]), ("₹ 5,00,000.50", "500000.5", "ok", ["currency_symbol", "thousands_separator"]),
    ("(1,000)", "-1000", "ok", ["accounting_negative", "thousands_separator"]), ("1,234,567.5", "1234567.5", "ok", ["thousands_separator"]), ("Rs. 12", "12", "ok", ["currency_symbol"]),
    ("INR 7.125", "7.125", "ok", ["currency_symbol", "more_than_2_decimals"]), ("-5", "-5", "ok", []), ("1e3", "1000", "ok", []), (".5", "0.5", "ok", []), ("5.", "5", "ok", []),
    (None, None, "missing", []), ("", None, "missing", []), (" ​ ", None, "missing", []), ("N/A", None, "missing", ["placeholder"]), ("-", None, "missing", ["placeholder"]),
    ("abc", None, "invalid", ["unparseable"]), ("1,00", None, "invalid", ["unparseable"]), ("12,34", None, "invalid", ["unparseable"]), ("1e15", None, "invalid", ["magnitude_out_of_range"]),
    ("999999999999999", "999999999999999", "ok", []), ("1e999", None, "invalid", ["magnitude_out_of_range"]), ("0.0000000000001", None, "invalid", ["excessive_precision"]), ("٣", None, "invalid", ["unparseable"]),
]


def test_amounts(spark):
    got = run(spark, parse.parse_amount, [a[0] for a in AMOUNTS])
    for (raw, value, status, notes), r in zip(AMOUNTS, got):
        assert (r.value, r.status, r.notes) == (None if value is None else Decimal(value), status, notes), raw


DATES = [
    ("08-Jul-2024", "2024-07-08", "ok", []), ("8 July 2024", "2024-07-08", "ok", ["alt_format"]), ("08-SEPT-2024", "2024-09-08", "ok", ["alt_format"]), ("2024-07-08", "2024-07-08", "ok", ["alt_format"]),
    ("2024-7-8T10:30:00Z", "2024-07-08", "ok", ["alt_format"]), ("8/7/2024", "2024-07-08", "ok", ["alt_format", "numeric_day_first_assumed"]), ("8.7.2024", "2024-07-08", "ok", ["alt_format", "numeric_day_first_assumed"]),
    ("July 8, 2024", "2024-07-08", "ok", ["alt_format"]), ("31-Feb-2024", None, "invalid", ["impossible_calendar_date"]), ("29-Feb-2024", "2024-02-29", "ok", []), ("8-Foo-2024", None, "invalid", ["unknown_month_name"]),
    ("8/7-2024", None, "invalid", ["unrecognised_format"]), ("45000", None, "invalid", ["unrecognised_format"]), (None, None, "missing", []), ("  ", None, "missing", []), ("nil", None, "missing", ["placeholder"]),
    ("0000-01-01", None, "invalid", ["impossible_calendar_date"]), ("13/13/2024", None, "invalid", ["impossible_calendar_date"]),
]


def test_dates(spark):
    got = run(spark, parse.parse_date, [x[0] for x in DATES])
    for (raw, value, status, notes), r in zip(DATES, got):
        assert (r.value, r.status, r.notes) == (value and dt.date.fromisoformat(value), status, notes), raw
    serial = run(spark, parse.serial_date, [45000.7, 0.0, None, 2958466.0], "double")
    assert [(r.value, r.status) for r in serial] == [(dt.date(2023, 3, 15), "ok"), (None, "invalid"), (None, "missing"), (None, "invalid")]
    assert run(spark, parse.lenient_date, ["2024-01-05", "5-JAN-2024", "05/01/2024", "2024/1/5", "nan", "x", None]) == [dt.date(2024, 1, 5)] * 4 + [None] * 3


KEYS = [
    ("MP/MP620/2024-2025/133166 - Road", "MP/MP620/2024-2025/133166", None, []), ("mp/mp620/2024-2025/1", "MP/MP620/2024-2025/1", None, ["case_normalized"]), (" MP / MP 620/2024–2025/7:x/y", "MP/MP620/2024-2025/7", None, ["whitespace_normalized"]),
    ("MP/MP620/2024-2026/1", "MP/MP620/2024-2026/1", None, ["financial_year_not_consecutive"]), (None, None, "empty", []), ("  ", None, "empty", []), ("N/A", None, "placeholder", []), ("MP/MP620/1", None, "wrong_segment_count", []),
    ("12/MP620/2024-2025/1", None, "bad_prefix", []), ("MP/620/2024-2025/1", None, "bad_mp_code", []), ("MP/MP620/24-25/1", None, "bad_financial_year", []), ("MP/MP620/2024-2025/x", None, "bad_serial", []),
    ("MP/MP620/2024-2025/1234567890123", None, "bad_serial", []), ("MP/MP620/2024-2025/12abc", None, "serial_not_terminated", []), ("ＭＰ/MP620/2024-2025/5", "MP/MP620/2024-2025/5", None, []),
]


def test_keys(spark):
    got = run(spark, parse.parse_key, [k[0] for k in KEYS])
    for (raw, key, error, warnings), r in zip(KEYS, got):
        assert (r.key, r.error, r.warnings) == (key, error, warnings), raw
    assert got[0].remainder == "Road" and got[2].remainder == "x/y"
    assert run(spark, lambda c: parse.parse_key(c, bare=True), [KEYS[0][0]])[0].warnings == ["trailing_text_after_id"]
    assert run(spark, parse.is_unkeyed, ["NA", "na-Construction", "NATIONAL", "NAC/1", None]) == [True, True, False, False, False]
    keys = [r.key for r in got if r.key]
    assert run(spark, parse.is_canonical_key, keys) == [True] * len(keys)
    assert [r.key for r in run(spark, parse.parse_key, keys)] == keys


def test_parsers_are_total(spark):
    r = random.Random(7)
    junk = ["".join(r.choice("0123456789,.-/()₹ RsINRabcXYZ\t​–é漢") for _ in range(r.randint(0, 14))) for _ in range(1500)]
    for make in (parse.parse_amount, parse.parse_date):
        for x in run(spark, make, junk):
            assert x.status in ("ok", "missing", "invalid") and (x.value is not None) == (x.status == "ok")
    for x in run(spark, parse.parse_key, junk):
        assert (x.key is None) == (x.error is not None)


def test_text(spark):
    odd = ["  a  b​ ", "N/A", "", None, "—", "Ok"]
    assert run(spark, text.normalize_text, odd) == ["a b", None, None, None, None, "Ok"]
    assert run(spark, text.missing_kind, odd) == [None, "placeholder", "empty", "empty", "placeholder", None]
    assert run(spark, text.fold_text, ["Tamil-Nadu_ (S)", None, "ÉTÉ 1"]) == ["tamil nadu s", "", "été 1"]
    assert run(spark, text.fold_person_name, ["Shri Dr. A. Kumar", "Smt", "Drew X", None]) == ["a kumar", "", "drew x", ""]
    assert run(spark, text.has_suspect_encoding, ["Ã©", "â€", "�", "é"]) == [True, True, True, False]
    assert run(spark, text.financial_year, [dt.date(2024, 3, 31), dt.date(2024, 4, 1), None], "date") == ["2023-2024", "2024-2025", None]
    assert run(spark, text.decimal_text, [Decimal("497185.00"), Decimal("1234.50"), Decimal("-0.00")], "decimal(18,2)") == ["497185", "1234.5", "0"]
    assert run(spark, text.to_flag, ["1", "Yes", "f", "x", None]) == [True, True, False, None, None]
    assert run(spark, text.to_float, ["1.5", "nan", "inf", "x", None]) == [1.5, None, None, None, None]
    assert run(spark, text.to_int, ["2.5", "3.5", ""]) == [2, 4, None]
    assert run(spark, text.to_iso_date, ["2024-02-30", "2024-02-29 10:00", "29/02/2024"]) == [None, dt.date(2024, 2, 29), None]
    df = spark.createDataFrame([("A b", "a-B"), ("x", None), (None, ""), ("-5", "5")], "a string, b string")
    assert [tuple(r) for r in df.select(text.values_equal(F.col("a"), F.col("b")), text.values_equal(F.col("a"), F.col("b"), True)).collect()] == [(True, False), (False, False), (True, True), (True, False)]


def test_similarity(spark):
    assert run(spark, similarity.trigrams, ["abcd", "ab", "", None, "AB  C"]) == [["abc", "bcd"], ["ab"], [], [], ["ab ", "b c"]]
    assert run(spark, similarity.normalize_description, ["Road, No. 5!", None]) == ["road no 5", ""]
    assert run(spark, lambda c: similarity.core_tokens(similarity.normalize_description(c)), ["Construction of Rampur road 12 x Rampur", ""]) == [["rampur"], []]
    assert run(spark, lambda c: similarity.numerals(similarity.normalize_description(c)), ["ward 05 and 7a"]) == [["05"]]
    assert run(spark, similarity.plain_number, ["007", "000", "07a"]) == ["7", "0", "7a"]

    def conflict(a, b):
        n = similarity.normalize_description
        df = spark.createDataFrame([(a, b)], "a string, b string").select(n(F.col("a")).alias("a"), n(F.col("b")).alias("b"))
        c = similarity.numeric_conflict(*[similarity.contextual_numerals(F.col(x)) for x in "ab"], *[similarity.numerals(F.col(x)) for x in "ab"])
        return df.select(c).first()[0]

    assert conflict("road in ward 5", "road in ward 6") and not conflict("road in ward 05", "road in ward 5")
    assert conflict("x 1 y 2", "x 1 y 3") and not conflict("x 1", "x") and not conflict("x 12345 y 7", "x 12346 y 7") and conflict("x 12345", "x 12346")
    df = spark.createDataFrame([("MP/A1/2024-2025/5", "MP/A1/2024-2025/6", True), ("MP/A1/2024-2025/5", "MP/A2/2024-2025/6", False), ("x", None, False)], "a string, b string, w boolean")
    assert all(r[0] == r[1] for r in df.select(similarity.is_consecutive(F.col("a"), F.col("b")), "w").collect())


@pytest.mark.parametrize("a,b,want", [([], ["x"], 0.0), (["x"], ["x"], 1.0), (["x", "y"], ["y"], 2 / 3)])
def test_dice(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(similarity.dice(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_parsers_compute_each_part_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(parse.parse_amount(F.col("t")).alias("a"), parse.parse_date(F.col("t")).alias("d"), parse.parse_key(F.col("t")).alias("k"))
    assert plan._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 8  # of which each stood in dozens of places
    cells = [("12,345.50", True), ("Rs. 5", True), ("(7)", True), ("1e3", True), ("INR 4", True), ("1-URGENT", False), ("MP/MP1/2024-2025/3", False), ("12/3", False), (None, False), ("", False), ("x", False), ("1 2", False)]
    rows = spark.createDataFrame(cells, "t string, ok boolean").select("ok", parse.is_amount(F.col("t")).alias("a"), F.coalesce(parse.parse_amount(F.col("t"))["status"] == "ok", F.lit(False)).alias("b")).collect()
    assert all(r.ok == r.a == r.b for r in rows)
