import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspan.operators import anomaly, compliance, duplicates, features, merge, payments, rowquality, serve, trends
from quillspan.operators.components import connected_components
from quillspan.plans.contracts import SOURCES, ContractError, bind_columns, require_columns, require_unique

D = dt.date


def sanctioned(spark, rows):
    source = SOURCES["sanctioned"]
    names = ["source_row", *source.columns]
    data = [(i, *[r.get(c) for c in source.columns]) for i, r in enumerate(rows, 2)]
    return rowquality.evaluate(spark.createDataFrame(data, ", ".join(["source_row int", *[f"{c} string" for c in names[1:]]])), source)


GOOD = {"work_category": "Roads", "state": "Goa", "ida": "X", "mp_name": "A", "constituency": "C", "work_description": "d", "work": "MP/MP1/2024-2025/7 - d", "sanction_date": "01-Jan-2024", "sanction_amount": "1,00,000", "work_status": "Sanctioned"}


def test_row_categories(spark):
    rows = [
        GOOD, {}, {"state": "Grand Total", "sanction_amount": "5"}, {"state": "Total", "sanction_amount": "5"}, GOOD | {"state": "1200"}, GOOD | {"sanction_date": "1,20,000"},
        {"sanction_amount": "77"}, GOOD | {"work": "NA-Construction"}, GOOD | {"work": "broken"}, GOOD | {"work_description": "total station purchase"}, {"state": "N/A"},
    ]
    got = {r.source_row: (r.category, r.reason) for r in sanctioned(spark, rows).collect()}
    assert got == {2: ("valid", None), 4: ("summary", "grand_total_label"), 5: ("summary", "total_label"), 6: ("summary", "footer_row"), 7: ("summary", "footer_row"), 8: ("summary", "summary_amount_only"), 9: ("unkeyed", None), 10: ("malformed", None), 11: ("valid", None), 12: ("malformed", None)}
    one = sanctioned(spark, [GOOD]).first()
    assert (one.sanction_amount, one.sanction_date, one.key__p.key) == (Decimal(100000), D(2024, 1, 1), "MP/MP1/2024-2025/7")
    assert rowquality.key_profile(sanctioned(spark, rows)).where("kind = 'category' and value = 'valid'").first().n == 2


@pytest.mark.parametrize("amounts,total", [([1, 2, 3], 3), ([1, 2], None), ([1, 1, 2, 4], 4), ([2, 2, 4, 4], None), ([-1, 1, 0], None), ([], None), ([None, 5, 5], None)])
def test_hidden_total(spark, amounts, total):
    df = spark.createDataFrame([(None if a is None else Decimal(a),) for a in amounts], "a decimal(18,2)")
    assert [r.a for r in rowquality.hidden_total(df, "a").where("is_total").collect()] == ([] if total is None else [Decimal(total)])


def test_repeats(spark):
    df = spark.createDataFrame([("k", 3, "A b", "1"), ("k", 1, "a-B", "1"), ("k", 2, "x", "2"), ("m", 4, None, None)], "key string, source_row int, t string, amount string")
    kept, found = rowquality.resolve_repeats(df, "key", "source_row", {"t": False, "amount": True})
    assert {(r.key, r.source_row) for r in kept.collect()} == {("k", 1), ("m", 4)}
    assert {tuple(r) for r in found.collect()} == {("k", 2, 1, "conflicting", "t;amount"), ("k", 3, 1, "identical", "")}


def pay(spark, rows):
    return spark.createDataFrame(rows, "work_id string, amount decimal(18,2), day date, vendor string, status string, duplicate_record boolean")


def test_payments(spark):
    rows = [("a", Decimal(10), D(2024, 1, 1), "v", "Payment Success", False), ("a", Decimal(10), D(2024, 1, 1), "v", "Payment Success", True), ("a", None, None, None, None, False), ("a", Decimal(-3), D(2024, 2, 1), "w", "Payment In-Progress", None), ("b", None, None, None, "x", False)]
    got = {r.work_id: r for r in payments.payments_by_work(pay(spark, rows)).collect()}
    a, b = got["a"], got["b"]
    assert (a.total_disbursed, a.success_amount, a.in_progress_amount, a.exact_duplicate_amount, a.deduplicated_disbursed_amount) == (17, 20, -3, 10, 7)
    assert (a.payment_count, a.duplicate_record_count, a.duplicate_ratio, a.vendor_count, a.negative_amount_count, a.amount_missing_count) == (4, 1, Decimal("0.25"), 2, 1, 1)
    assert a.exact_duplicate_amount + a.deduplicated_disbursed_amount == a.total_disbursed
    assert (b.total_disbursed, b.first_expenditure_date) == (0, None)
    works = spark.createDataFrame([("a", D(2024, 1, 1)), ("b", None)], "work_id string, completion_date date")
    late = payments.late_payments(works, pay(spark, [("a", Decimal(1), D(2024, 1, 31), "v", "s", False), ("a", Decimal(2), D(2024, 2, 1), "v", "s", False)])).collect()
    assert [(r.post_completion_count, r.post_completion_amount, r.max_days_after_completion) for r in late] == [(1, 2, 31)]


def test_presence(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "work_id string")
    flags = merge.presence({"r": ids("a", "b", "b"), "s": ids("b", "c"), "c": ids("c"), "e": ids("c", "z", None)})
    assert {tuple(r) for r in flags.collect()} == {("a", True, False, False, False), ("b", True, True, False, False), ("c", False, True, True, True), ("z", False, False, False, True)}
    checks = {r.issue: (r.from_count, r.unmatched) for r in merge.containment_checks(flags).collect()}
    assert checks["sanctioned_not_in_recommended"] == (2, 1) and checks["expenditure_not_in_master"] == (2, 1)
    assert ("expenditure_not_in_master", "z") in {tuple(r) for r in merge.unmatched_ids(flags).collect()}


def test_ratios_and_status(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(3)), (Decimal(1), Decimal(0)), (None, Decimal(1)), (Decimal("0.01"), Decimal(80000))], "a decimal(18,2), b decimal(18,2)")
    assert [r[0] for r in df.select(features.safe_ratio(F.col("a"), F.col("b"))).collect()] == [Decimal("0.333333"), None, None, Decimal("0E-6")]
    df = spark.createDataFrame([("Work Completed",), ("Partially Completed",), ("Incomplete",), ("Sanctioned",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(features.work_status(F.col("s"))).collect()] == ["completed", "partial", "sanctioned", "sanctioned", None, None]
    names = [f.name for f in features.registry()]
    assert len(names) == len(set(names)) and {f.timing for f in features.registry()} == {"monitoring", "retrospective", "context"}


@pytest.mark.parametrize("n,enough", [(19, False), (20, True)])
def test_peer_minimum(spark, n, enough):
    df = spark.createDataFrame([("s", "c", Decimal(i), Decimal(i), i) for i in range(n)] + [(None, "c", Decimal(1), Decimal(1), 1)], "state string, work_category string, sanction_amount decimal(18,2), total_disbursed_all_rows decimal(18,2), payment_count_all_rows int")
    r = features.peer_features(df, {"state": ["state"]}).where("state = 's'").first()
    assert (r.peer_group_sufficient_by_state, r.peer_count_by_state, r.peer_median_sanction_amount_by_state) == (enough, n, 9.5 if enough else None)
    assert features.peer_features(df, {"state": ["state"]}).where("state is null").first().peer_group_sufficient_by_state is False


RULE = dict(recommended_date=D(2024, 1, 1), sanction_date=D(2024, 1, 10), completion_date=None, last_payment_date=None, sanction_amount=Decimal(300000), disbursed=Decimal(300000), is_completed=False, late_payments=0)
CASES = [
    ({"sanction_date": D(2024, 2, 15)}, 0, False), ({"sanction_date": D(2024, 2, 16)}, 0, True), ({"sanction_amount": Decimal(249999)}, 1, True), ({"sanction_amount": Decimal(250000)}, 1, False), ({"sanction_amount": None}, 1, True),
    ({"is_completed": True, "completion_date": D(2025, 1, 9)}, 2, False), ({"is_completed": True, "completion_date": D(2025, 1, 10)}, 2, True), ({"is_completed": True, "disbursed": None}, 3, True), ({"is_completed": True, "disbursed": Decimal(1)}, 3, False),
    ({"disbursed": None, "sanction_date": D(2026, 6, 27)}, 4, False), ({"disbursed": None, "sanction_date": D(2026, 6, 26)}, 4, True), ({"disbursed": Decimal(0), "sanction_date": D(2026, 3, 29)}, 4, True), ({"disbursed": Decimal(0), "sanction_date": D(2026, 3, 28)}, 4, False),
    ({"disbursed": Decimal(0), "sanction_date": D(2026, 3, 28)}, 5, True), ({"disbursed": Decimal(0), "sanction_date": D(2026, 3, 29)}, 5, False),
    ({"disbursed": Decimal(239999), "last_payment_date": D(2026, 3, 28)}, 6, True), ({"disbursed": Decimal(240000), "last_payment_date": D(2026, 3, 28)}, 6, False), ({"disbursed": Decimal(1), "last_payment_date": D(2026, 3, 29)}, 6, False), ({"late_payments": 1}, 7, True), ({}, 7, False),
]


def test_rules(spark):
    kinds = "i int, recommended_date date, sanction_date date, completion_date date, last_payment_date date, sanction_amount decimal(18,2), disbursed decimal(18,2), is_completed boolean, late_payments int"
    df = spark.createDataFrame([(i, *(RULE | c).values()) for i, (c, _, _) in enumerate(CASES)], kinds)
    masked = compliance.rule_mask(df)
    got = {r.i: r.rule_mask for r in masked.collect()}
    for i, (case, bit, want) in enumerate(CASES):
        assert bool(got[i] >> bit & 1) == want, (case, compliance.RULES[bit])
    ids = masked.select("rule_mask", compliance.mask_to_rules(F.col("rule_mask")).alias("r"))
    assert all(r[0] == r[1] for r in ids.select("rule_mask", compliance.rules_to_mask(F.col("r"))).collect())
    s = compliance.compliance_summary(masked).first()
    assert s.flagged + s.unflagged == s.works == len(CASES)
    assert compliance.queue(masked.withColumn("state", F.lit("Goa")), rule="nonsense").count() == 0
    assert masked.where("rule_mask <> 0").select(compliance.explain(F.col("rule_mask"))).first()[0]


def test_labels_and_bounds(spark):
    rows = spark.createDataFrame([(i, "s", "c", float(i), 1.0) for i in range(40)], "work_id int, state string, work_category string, days_since_sanction double, x double")
    names = "days_since_last_payment sanction_to_first_payment_days sanction_to_last_payment_days payment_span_days success_utilization_ratio deduplicated_utilization_ratio payment_count_all_rows deduplicated_payment_count vendor_count duplicate_record_count duplicate_ratio duplicate_amount_ratio in_progress_amount in_progress_ratio sanction_amount total_disbursed_all_rows".split()
    for n in names:
        rows = rows.withColumn(n, F.lit(None).cast("double"))
    rows = rows.withColumn("success_utilization_ratio", F.lit(0.01) * F.col("work_id"))
    scored = anomaly.score(anomaly.prepare(features.peer_features(rows)))
    got = {r.work_id: r for r in scored.collect()}
    assert all(0 <= r.review_priority_score <= 100 for r in got.values())
    assert got[39].sev_age_utilization == 0 and all(got[i].review_priority_label == "Normal Monitoring" for i in range(20))
    again = anomaly.score(anomaly.prepare(features.peer_features(rows.orderBy(F.desc("work_id"))))).collect()
    assert {r.work_id: r.review_priority_score for r in again} == {i: r.review_priority_score for i, r in got.items()}


def test_trend_is_dense(spark):
    ev = spark.createDataFrame([("a", D(2024, 1, 31), "recommended", None, False), ("a", D(2024, 4, 1), "payment", Decimal(5), True), (None, D(2023, 12, 1), "completed", None, False)], "scope string, day date, kind string, amount decimal(18,2), success boolean")
    got = [tuple(r)[:5] for r in trends.trend(ev).orderBy("period").collect()]
    assert [g[0] for g in got] == ["2023-12", "2024-01", "2024-02", "2024-03", "2024-04"]
    assert got[0][3] == 1 and got[2][1:5] == (0, 0, 0, 0)
    assert [r.period for r in trends.trend(ev, "a").orderBy("period").collect()] == ["2024-01", "2024-02", "2024-03", "2024-04"]
    works = spark.createDataFrame([("s", D(2024, 1, 1), None, None, False), ("s", D(2024, 1, 1), None, None, None)], "state string, recommended_date date, sanction_date date, completion_date date, in_recommended boolean")
    assert trends.milestone_events(works).count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (60, 60), (None, 3), (51, 50)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50, 52: 50}
    assert connected_components(edges.limit(0)).count() == 0


def described(spark, rows):
    return duplicates.prepare(spark.createDataFrame([(i, "s", c, "k", t, Decimal(a), d) for i, (c, t, a, d) in enumerate(rows)], "id long, state string, constituency string, category string, description string, amount decimal(18,2), day date"))


def test_duplicates(spark):
    w = described(spark, [("c", "Paving near Rampur temple ward 5", 100, D(2024, 1, 1)), ("c", "Paving near Rampur temple, ward 5", 104, D(2024, 2, 1)), ("c", "Paving near Rampur temple ward 6", 100, D(2024, 1, 1)), ("e", "unrelated bridge", 5, D(2024, 1, 1))])
    pairs = duplicates.candidate_pairs(w)
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}
    got = {(r.id_a, r.id_b): r for r in duplicates.score_pairs(pairs, w).collect()}
    assert got[0, 1].is_high and got[0, 1].review_priority == "High-Confidence Potential Duplicate"
    assert got[0, 2].numeric_conflict and not got[0, 2].is_high and got[0, 2].score == got[0, 2].score
    c = duplicates.clusters(duplicates.score_pairs(pairs, w).where("is_high")).collect()
    assert [(r.cluster_id, r.work_count, r.work_ids) for r in c] == [("CLUST-00001", 2, "0;1")]


def test_large_templates_chain(spark):
    w = described(spark, [("c", "Rampur bore well", 100, None)] * 9)
    assert {tuple(r) for r in duplicates.candidate_pairs(w).collect()} == {(i, i + 1) for i in range(8)}
    w = described(spark, [("c", "Rampur bore well", 100, None)] * 8)
    assert duplicates.candidate_pairs(w).count() == 28


def test_serving(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "A", None), (3, None, 2.0), (4, "a", 9.0)], "work_id int, state string, score double")
    order = lambda text: [r.work_id for r in serve.sort_rows(df, serve.parse_sort(text, ["state", "score"]), "work_id").collect()]
    assert order("-score") == [4, 1, 3, 2] and order("state,-score") == [4, 2, 1, 3] and order("-state") == [1, 2, 4, 3]
    for bad in ("", "nope", "score,score", "a,b,c,d"):
        with pytest.raises(serve.BadRequest):
            serve.parse_sort(bad, ["state", "score"])
    rows = df.orderBy("work_id")
    assert [r.work_id for r in serve.page(rows, 2, 3).collect()] == [4] and serve.page(rows, 9, 3).count() == 0
    assert [r.work_id for r in serve.clamped_page(df, 9, 3, ["work_id"]).collect()] == [4]
    assert serve.where_between(df, "score", 1).count() == 3 and serve.where_in(df, {"state": ["A"], "score": []}).count() == 2
    assert serve.lookup(df, "work_id", 2)["state"] == "A"
    with pytest.raises(serve.NotFound):
        serve.lookup(df, "work_id", 99)


def test_contracts(spark):
    df = spark.createDataFrame([("1", "x"), ("1", "y")], "Work_ID string, extra string")
    with pytest.raises(ContractError):
        require_columns(df, ["state"])
    with pytest.raises(ContractError):
        require_unique(df, "Work_ID")
    out = bind_columns(df, {"work_id": [], "amount": ["paid"]}, ["work_id"])
    assert out.columns == ["work_id", "amount", "extra"] and out.first().amount is None
    with pytest.raises(ContractError):
        bind_columns(df, {"state": []}, ["state"])


def test_single_pairs_need_no_rounds(spark):
    from quillspan.operators.components import connected_components

    pairs = spark.createDataFrame([(1, 2), (4, 3)], "a long, b long")
    assert {tuple(x) for x in connected_components(pairs, max_rounds=1).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    chain = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 4)], "a long, b long")
    assert {tuple(x) for x in connected_components(chain).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}
