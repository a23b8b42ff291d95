import json
from decimal import Decimal

from quillspan.plans import dataset
from quillspan.plans.contracts import SOURCES
from quillspan.sources import reports

PLACE = {"work_category": "Roads", "state": "Karnataka", "ida": "Mysuru", "mp_name": "Shri A Kumar", "constituency": "Mysuru", "work_description": "Bore well at Rampur"}
KEY = "MP/MP62/2024-2025/%d"


def raw(spark, name, rows):
    columns = list(SOURCES[name].columns)
    data = [(i, *[r.get(c) for c in columns]) for i, r in enumerate(rows, 2)]
    return spark.createDataFrame(data, ", ".join(["source_row int", *[f"{c} string" for c in columns]]))


def tables(spark):
    w = lambda n, **x: PLACE | {"work": f"{KEY % n} - Bore well"} | x
    recommended = [
        w(1, recommended_date="01-Apr-2024", recommended_amount="5,00,000", sanction_date="10-May-2024"), w(2, recommended_date="02-Apr-2024", recommended_amount="3,00,000"),
        w(2, recommended_date="02-Apr-2024", recommended_amount="3,00,000"), w(2, recommended_date="03-Apr-2024", recommended_amount="1"), {}, w(3) | {"work": "NA-Bore well"}, w(4) | {"work": "MP/MP62/24/1"},
        {"state": "Grand Total", "recommended_amount": "8,00,001"},
    ]
    sanctioned = [
        w(1, state="KARNATAKA", mp_name="B Rao", recommended_date="01-Apr-2024", sanction_date="10-May-2024", sanction_amount="4,50,000", work_status="Work Completed"),
        w(5, sanction_date="01-Jun-2024", sanction_amount="2,00,000", work_status="Sanctioned"), w(6, sanction_date="01-Mar-2024", sanction_amount="100", work_status="Sanctioned"),
        w(99, sanction_amount="6,50,100"),  # the sum of the others: a total that reads as a work
    ]
    completed = [w(1, completion_date="01-Dec-2024", completed_amount_disbursed="4,60,000")]
    p = lambda n, **x: PLACE | {"work_id": KEY % n, "work": "Bore well", "vendor_name": "12345", "payment_status": "Payment Success"} | x
    one = p(1, expenditure_date="01-Jun-2024", fund_disbursed_amount="2,00,000")
    paid = [one, one, p(1, expenditure_date="01-Feb-2025", fund_disbursed_amount="x"), p(7, expenditure_date="bad", fund_disbursed_amount="-5"), p(1) | {"work_id": "junk"}]
    return {n: raw(spark, n, r) for n, r in zip(("recommended", "sanctioned", "completed", "expenditure"), (recommended, sanctioned, completed, paid))} | {"allocation": raw(spark, "allocation", [{"state": "Goa", "mp_name": "A", "constituency": "c", "allocated_amount": "5"}] * 2)}


def test_build(spark):
    out = dataset.build(tables(spark))
    assert {(r.source, r.source_row, r.reason) for r in out["summary_rows"].collect()} == {("recommended", 9, "grand_total_label"), ("sanctioned", 5, "aggregate_total")}
    assert {(r.source, r.source_row) for r in out["unkeyed_recommendations"].collect()} == {("recommended", 7)}
    assert {(r.source, r.source_row, r.error) for r in out["malformed_ids"].collect()} == {("recommended", 8, "bad_financial_year"), ("expenditure", 6, "wrong_segment_count")}
    assert {(r.work_id, r.source_row, r.relation, r.differing_fields) for r in out["work_id_duplicates"].collect()} == {(KEY % 2, 4, "identical", ""), (KEY % 2, 5, "conflicting", "recommended_date;recommended_amount")}
    master = {r.work_id: r for r in out["works_master"].collect()}
    assert set(master) == {KEY % n for n in (1, 2, 5, 6)}
    m = master[KEY % 1]
    assert (m.state, m.mp_name, m.sanction_amount, m.conflict_fields, m.format_only_fields) == ("KARNATAKA", "B Rao", Decimal(450000), "mp_name", "state")
    assert (m.id_mp_code, m.id_financial_year, m.in_completed, master[KEY % 2].recommended_row_count, master[KEY % 2].sanctioned_row_count) == ("MP62", "2024-2025", True, 3, 0)
    by = {r.work_id: r for r in out["expenditure_by_work"].collect()}
    assert (by[KEY % 1].total_disbursed, by[KEY % 1].duplicate_record_count, by[KEY % 1].amount_missing_count, by[KEY % 1].duplicate_ratio) == (400000, 1, 1, Decimal("0.3333"))
    assert (by[KEY % 7].date_missing_count, by[KEY % 7].negative_amount_count) == (1, 1)
    checks = {r.check: (r.evaluated, r.hits) for r in out["checks"].collect()}
    assert checks["completed_amount_exceeds_sanction"] == (1, 1) and checks["expenditure_total_exceeds_sanction"] == (1, 0) and checks["id_fy_differs_from_sanction_fy"] == (3, 1)
    assert ("expenditure_not_in_master", KEY % 7) in {tuple(r) for r in out["join_unmatched_ids"].collect()}
    assert [r.duplicate_record for r in out["mp_allocated_limits"].orderBy("source_row").collect()] == [False, True]
    scored = dataset.score(out).collect()
    assert len(scored) == 4 and all(r.review_priority_label for r in scored)
    text = reports.markdown(out["containment"], "Containment")
    assert text.startswith("## Containment") and "sanctioned_not_in_recommended" in text
    assert json.loads(reports.summary({"checks": out["checks"]}))["checks"]
