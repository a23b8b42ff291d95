"""Queries over rows made from the supplied tables, for operators whose inputs those tables don't have: raw cells, numerals, dates of several milestones, segmented keys.

Each cell is a rule of the order's key, so the SQL states the outcome by arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import parse
from quillspan.functions import similarity as S
from quillspan.functions import text as T
from quillspan.operators import anomaly, compliance, duplicates, features, payments, rowquality, serve, trends
from quillspan.plans import dataset
from quillspan.plans.catalogue import AS_OF, FEAT, PAY, SCORED, WORKS, by_work, feature_rows, paid_rows, query, scored, table, works
from quillspan.plans.contracts import SOURCES

SANCTIONED = SOURCES["sanctioned"]


def raw_rows(spark, d: str) -> DataFrame:
    """Orders as the text cells of a raw source, with blank rows, totals, placeholders and cells that can't be read."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    key = F.concat(F.lit("MP/MP"), F.col("o_custkey"), F.lit("/"), year, F.lit("-"), year + 1, F.lit("/"), k, F.lit(" - Road"))
    cells = {
        "work_category": F.col("o_orderpriority"),
        "state": F.when(k % 23 == 0, "Grand Total").otherwise("Goa"),
        "ida": F.when(k % 5 == 0, F.lit("  The   Office ")).when(k % 9 == 0, "-").otherwise("Office"),
        "mp_name": F.lit("Shri A"),
        "constituency": F.when(k % 37 == 0, "Ã©tat").otherwise("North"),
        "work_description": F.lit("a road"),
        "work": F.when(k % 17 == 0, "NA - road").when(k % 19 == 0, "MP/MP1/24/5").otherwise(key),
        "recommended_date": F.lit(None).cast("string"),
        "sanction_date": F.when(k % 31 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy")),
        "sanction_amount": F.when(k % 13 == 0, "abc").when(k % 11 == 0, "N/A").when(k % 7 == 0, F.concat(F.lit("Rs. "), money)).when(k % 3 == 0, F.concat(F.lit("-"), money)).otherwise(money),
        "work_status": F.lit("Sanctioned"),
    }
    blank = k % 29 == 0
    return table(spark, d, "orders").select(k.cast("int").alias("source_row"), *[F.when(~blank, v).alias(c) for c, v in cells.items()])


def evaluated(spark, d: str) -> DataFrame:
    return rowquality.evaluate(raw_rows(spark, d), SANCTIONED)


#: k: the order's key; the amount and day as they are read, null where they can't be.
RAW = """raw AS (
  SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, o_orderdate::DATE AS d0, o_orderkey % 31 = 0 AS bad_day, o_orderkey % 13 = 0 AS bad, o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0 AS na,
         CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 0 THEN -o_totalprice::DECIMAL(18,2) ELSE o_totalprice::DECIMAL(18,2) END AS amount
  FROM orders WHERE o_orderkey % 29 <> 0
)"""


@query(f"""WITH {RAW} SELECT k AS source_row, CASE WHEN k % 23 = 0 THEN 'summary' WHEN k % 17 = 0 THEN 'unkeyed' WHEN k % 19 = 0 THEN 'malformed' ELSE 'valid' END AS category, CASE WHEN k % 23 = 0 THEN 'grand_total_label' END AS reason,
CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN 'MP/MP' || c || '/' || y || '-' || (y + 1) || '/' || k END AS key, CASE WHEN k % 17 = 0 THEN 'wrong_segment_count' WHEN k % 19 = 0 THEN 'bad_financial_year' END AS error FROM raw""")
def row_categories(spark, d):
    return evaluated(spark, d).select("source_row", "category", "reason", F.col("key__p.key").alias("key"), F.col("key__p.error").alias("error"))


_EARLY, _LATE = "1996-01-01", "2001-01-01"


@query(f"""WITH {RAW} SELECT 'sanction_amount' AS "column", count(*) AS total, 0::BIGINT AS empty, count(*) FILTER (na) AS placeholder, count(*) FILTER (bad) AS invalid, 0::BIGINT AS cleaned, 0::BIGINT AS suspect, count(*) FILTER (amount < 0) AS negative, sum(amount)::DECIMAL(38,6) AS sum, min(amount)::DECIMAL(27,12) AS least, max(amount)::DECIMAL(27,12) AS most, NULL::DATE AS first_day, NULL::DATE AS last_day, NULL::BIGINT AS too_early, NULL::BIGINT AS too_late FROM raw
UNION ALL SELECT 'sanction_date', count(*), 0, 0, count(*) FILTER (bad_day), 0, 0, NULL, NULL, NULL, NULL, min(d0) FILTER (NOT bad_day), max(d0) FILTER (NOT bad_day), count(*) FILTER (NOT bad_day AND d0 < DATE '{_EARLY}'), count(*) FILTER (NOT bad_day AND d0 > DATE '{_LATE}') FROM raw
UNION ALL SELECT 'ida', count(*), 0, count(*) FILTER (k % 5 <> 0 AND k % 9 = 0), 0, count(*) FILTER (k % 5 = 0), 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM raw
UNION ALL SELECT 'constituency', count(*), 0, 0, 0, 0, count(*) FILTER (k % 37 = 0), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM raw
UNION ALL SELECT 'recommended_date', count(*), count(*), 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0 FROM raw""")
def source_profile(spark, d):
    found = rowquality.source_profile(evaluated(spark, d), SANCTIONED, _EARLY, _LATE)
    return found.where(F.col("column").isin("sanction_amount", "sanction_date", "ida", "constituency", "recommended_date")).drop("kind", "zero", "first_value")


@query(f"WITH {RAW} SELECT 'sanction_amount' AS \"column\", 'currency_symbol' AS note, count(*) FILTER (NOT bad AND NOT na AND k % 7 = 0) AS n FROM raw UNION ALL SELECT 'sanction_amount', 'invalid:unparseable', count(*) FILTER (bad) FROM raw UNION ALL SELECT 'sanction_date', 'invalid:unrecognised_format', count(*) FILTER (bad_day) FROM raw")
def note_frequencies(spark, d):
    return rowquality.note_frequencies(evaluated(spark, d), SANCTIONED)


@query(f"""WITH {RAW}, ok AS (SELECT * FROM raw WHERE k % 17 <> 0 AND k % 19 <> 0), c AS (SELECT CASE WHEN k % 23 = 0 THEN 'summary' WHEN k % 17 = 0 THEN 'unkeyed' WHEN k % 19 = 0 THEN 'malformed' ELSE 'valid' END AS v FROM raw)
SELECT 'category' AS kind, v AS value, count(*) AS n FROM c GROUP BY v UNION ALL SELECT 'prefix', 'MP', count(*) FROM ok UNION ALL SELECT 'code', 'MP' || c, count(*) FROM ok GROUP BY c
UNION ALL SELECT 'financial_year', y || '-' || (y + 1), count(*) FROM ok GROUP BY y UNION ALL SELECT 'error', CASE WHEN k % 17 = 0 THEN 'wrong_segment_count' ELSE 'bad_financial_year' END, count(*) FROM raw WHERE k % 17 = 0 OR k % 19 = 0 GROUP BY 2""")
def key_profile(spark, d):
    return rowquality.key_profile(evaluated(spark, d))


@query("""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS source_row, l_returnflag AS a, l_linestatus AS b FROM lineitem),
k AS (SELECT *, first_value(struct_pack(a := a, b := b)) OVER w AS f, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY key ORDER BY source_row))
SELECT count(DISTINCT key) AS repeated_keys, count(*) AS extra_rows, count(*) FILTER (a = f.a AND b = f.b) AS identical, count(*) FILTER (a <> f.a OR b <> f.b) AS conflicting FROM k WHERE n > 1""")
def repeat_statistics(spark, d):
    from quillspan.plans.catalogue import duplicate_key_resolution

    return rowquality.repeat_statistics(duplicate_key_resolution(spark, d), "key")


@query("SELECT 'orders' AS source, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'customers', count(DISTINCT c_custkey) FROM customer")
def distinct_keys(spark, d):
    return rowquality.distinct_keys({"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("k0")), "customers": table(spark, d, "customer").select(F.col("c_custkey").alias("k0"))}, "k0")


@query(f"WITH {WORKS} SELECT CASE o_orderstatus WHEN 'O' THEN '(no sanctioned record)' ELSE work_status END AS status, count(*) AS works, count(*) FILTER (o_orderstatus = 'F') AS also_completed, count(*) FILTER (work_id IN (SELECT l_orderkey FROM lineitem)) AS also_paid FROM works GROUP BY 1")
def status_crosstab(spark, d):
    w = works(spark, d).withColumn("in_sanctioned", F.col("work_status") != "Sanctioned")
    return features.status_crosstab(w, by_work(spark, d))


@query(f"WITH {SCORED} SELECT signal_count::INT AS signals, count(*) AS works FROM labelled GROUP BY 1")
def signals_per_work(spark, d):
    return anomaly.signals_per_work(scored(spark, d))


@query(f"WITH {SCORED} SELECT state AS value, count(*) AS candidates FROM labelled WHERE review_priority_score >= 25 GROUP BY 1")
def candidates_by_state(spark, d):
    return anomaly.candidates_by(scored(spark, d), "state")


@query(f"WITH {PAY}, {WORKS}, {FEAT} SELECT work_id, state, sanction_amount, vendor_count, sanction_date AS sanction_date, first_expenditure_date AS first_payment_date, last_expenditure_date AS last_payment_date, success_utilization_ratio, 'unavailable' AS review_status FROM feat")
def work_details(spark, d):
    rows = features.work_features(works(spark, d), by_work(spark, d), AS_OF)
    out = serve.detail_rows(rows, works(spark, d), by_work(spark, d))
    return out.select("work_id", "identity.state", "amounts.sanction_amount", "payments.vendor_count", "timeline.sanction_date", "timeline.first_payment_date", "timeline.last_payment_date", "utilization.success_utilization_ratio", "review_status")


@query(f"WITH {PAY}, ids AS (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY sha256('demo|' || o_orderkey::VARCHAR), o_orderkey LIMIT 300) SELECT work_id, payment_count_all_rows, success_amount FROM by_work WHERE work_id IN (SELECT o_orderkey FROM ids)")
def demo_payments(spark, d):
    own = {"master": works(spark, d).select("work_id", "state"), "paid": by_work(spark, d)}
    return serve.demo_tables(own, "master", "paid", "demo", 300)["paid"].select("work_id", "payment_count_all_rows", "success_amount")


def _numbered_text(k) -> F.Column:
    """A description with a ward, a pole and a house, as rules of a number."""
    return F.concat(F.lit("CC road Ward No. 0"), k % 7, F.lit(", pole #"), k % 5, F.lit("; house no: "), k % 3, F.lit("a"))


@query("""SELECT o_orderkey, (o_orderkey % 7)::VARCHAR AS ward, (o_orderkey % 5)::VARCHAR AS pole, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE (o_orderkey % 3) || 'a' END AS house, o_orderkey % 7 <> o_custkey % 7 OR o_orderkey % 5 <> o_custkey % 5 OR o_orderkey % 3 <> o_custkey % 3 AS conflict,
CASE o_orderkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '0' WHEN 2 THEN '7b' ELSE '100' END AS plain FROM orders""")
def numeric_contexts(spark, d):
    a, b = (S.normalize_description(_numbered_text(F.col(c))) for c in ("o_orderkey", "o_custkey"))
    ctx = S.contextual_numerals(a)
    raw = F.when(F.col("o_orderkey") % 4 == 0, "0012").when(F.col("o_orderkey") % 4 == 1, "000").when(F.col("o_orderkey") % 4 == 2, " 07B ").otherwise("100")
    one = lambda c: F.array_join(ctx[c], ",").alias(c)
    conflict = S.numeric_conflict(ctx, S.contextual_numerals(b), S.numerals(a), S.numerals(b))
    return table(spark, d, "orders").select("o_orderkey", one("ward"), one("pole"), one("house"), conflict.alias("conflict"), S.plain_number(raw).alias("plain"))


@query("SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 <> 0 AS consecutive FROM orders")
def consecutive_keys(spark, d):
    k = F.col("o_orderkey")
    serial = k + F.when(k % 4 == 0, 1).when(k % 4 == 1, -1).when(k % 4 == 2, 2).otherwise(0)
    a = F.concat(F.lit("MP/MP1/2024-2025/"), k)
    b = F.concat(F.when(k % 3 == 0, "MP/MP2").otherwise("MP/MP1"), F.lit("/2024-2025/"), serial)
    return table(spark, d, "orders").select("o_orderkey", S.is_consecutive(a, b).alias("consecutive"))


def twin_works(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Two described works for each order, with segmented keys, and the pairs of them."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d0"))
    key = lambda serial: F.concat(F.lit("MP/MP1/2024-2025/"), serial)
    name = F.concat(F.lit("Alpha"), F.col("k"), F.lit(" Beta"), F.col("k"), F.lit(" gamma"), F.col("k"), F.lit("x delta"), F.col("k"), F.lit("y"))
    place = [F.lit("Goa").alias("state"), F.when(F.col("k") % 2 == 0, F.lit("north")).otherwise(F.lit("")).alias("constituency"), F.lit("roads").alias("category")]
    one = o.select(key(2 * F.col("k")).alias("id"), *place, name.alias("description"), F.lit(1000).cast("decimal(18,2)").alias("amount"), F.col("d0").alias("day"))
    other = F.when(F.col("k") % 3 == 0, 1000).when(F.col("k") % 3 == 1, 960).otherwise(700).cast("decimal(18,2)")
    two = o.select(key(2 * F.col("k") + 1).alias("id"), *place, name.alias("description"), other.alias("amount"), F.date_add("d0", (F.col("k") % 120).cast("int")).alias("day"))
    pairs = o.select(key(2 * F.col("k")).alias("id_a"), key(2 * F.col("k") + 1).alias("id_b"))
    return duplicates.described(one.unionByName(two)), pairs


#: 45 for equal texts, 15 for four common tokens, 5 for the category, 3 for consecutive serials; then the place, the amounts and the days.
TWINS = """twins AS (
  SELECT 'MP/MP1/2024-2025/' || (2 * o_orderkey) AS id_a, 'MP/MP1/2024-2025/' || (2 * o_orderkey + 1) AS id_b, o_orderkey AS k, o_orderkey % 120 AS gap, o_orderkey % 3 < 2 AS near,
         least(100, 68 + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END + CASE o_orderkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 12 ELSE 0 END + CASE WHEN o_orderkey % 120 = 0 THEN 15 WHEN o_orderkey % 120 <= 30 THEN 10 WHEN o_orderkey % 120 <= 90 THEN 5 ELSE 0 END)::DOUBLE AS score
  FROM orders
), judged AS (SELECT *, score >= 80 AND near AND gap <= 90 AS is_high FROM twins)"""


@query(f"WITH {TWINS} SELECT id_a, id_b, score, is_high, gap::INT AS date_gap_days, CASE WHEN is_high THEN 'High-Confidence Potential Duplicate' ELSE 'Medium-Confidence Potential Duplicate' END AS review_priority FROM judged")
def high_pairs(spark, d):
    w, pairs = twin_works(spark, d)
    return duplicates.score_pairs(pairs, w).select("id_a", "id_b", "score", "is_high", "date_gap_days", "review_priority")


@query(f"WITH {TWINS} SELECT 2::BIGINT AS work_count, false AS is_batch_scheme, least(id_a, id_b) || ';' || greatest(id_a, id_b) AS work_ids FROM judged WHERE is_high")
def high_clusters(spark, d):
    w, pairs = twin_works(spark, d)
    return duplicates.high_clusters(duplicates.score_pairs(pairs, w)).drop("cluster_id")


@query(f"WITH {TWINS} SELECT count(*) AS ordinary, count(*) FILTER (is_high) AS high, count(*) FILTER (NOT is_high) AS medium, 0::BIGINT AS batch, (2 * count(*))::BIGINT AS affected_works FROM judged WHERE is_high OR score >= 75")
def high_summary(spark, d):
    w, pairs = twin_works(spark, d)
    return duplicates.duplicate_summary(duplicates.retained_pairs(duplicates.score_pairs(pairs, w)))


@query(f"WITH {WORKS} SELECT work_id, work_id % 90 > 45 AS late, CASE WHEN work_id % 90 > 45 THEN 'COMP-01' END AS rule FROM works")
def late_sanctions(spark, d):
    """The rule on the days from recommendation to sanction."""
    w = works(spark, d).withColumn("recommended_date", F.date_sub("sanction_date", (F.col("work_id") % 90).cast("int")))
    none = by_work(spark, d).limit(0)
    late = payments.late_payments(w, paid_rows(spark, d).limit(0)).select("work_id", F.col("post_completion_count").alias("late_payments"))
    mask = compliance.rule_mask(compliance.rule_inputs(w, none, late), AS_OF)
    hit = F.col("rule_mask").bitwiseAND(F.lit(1)) != 0
    return mask.select("work_id", hit.alias("late"), F.when(hit, F.element_at(compliance.mask_to_rules(F.col("rule_mask")), 1)).alias("rule"))


@query(f"""WITH {WORKS}, m AS (SELECT date_trunc('month', sanction_date - 40)::DATE AS month, count(*) FILTER (work_id % 3 <> 0) AS n FROM works GROUP BY 1), cal AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m WHERE n > 0)
SELECT strftime(month, '%Y-%m') AS period, coalesce(n, 0)::BIGINT AS recommended FROM cal LEFT JOIN m USING (month)""")
def recommended_trend(spark, d):
    """A recommendation counts unless its flag says no; a missing flag does."""
    k = F.col("work_id")
    w = works(spark, d).withColumns({"recommended_date": F.date_sub("sanction_date", 40), "in_recommended": F.when(k % 3 == 0, F.lit(False)).when(k % 3 == 1, F.lit(True))}).withColumn("sanction_date", F.lit(None).cast("date"))
    return trends.trend(trends.milestone_events(w)).select("period", "recommended")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'A B' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'Ã©tat' ELSE 'x' END AS cell, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'placeholder' WHEN 2 THEN 'empty' END AS missing, o_orderkey % 5 = 3 AS suspect,
CASE WHEN o_totalprice::DECIMAL(18,2) = 0 THEN '0' ELSE regexp_replace(regexp_replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS amount FROM orders""")
def clean_cells(spark, d):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "​ A \t B ").when(k == 1, " N/A ").when(k == 2, " \n ").when(k == 3, "Ã©tat").otherwise("x")
    suspect = F.coalesce(T.has_suspect_encoding(raw), F.lit(False))
    return table(spark, d, "orders").select("o_orderkey", T.normalize_text(raw).alias("cell"), T.missing_kind(raw).alias("missing"), suspect.alias("suspect"), T.decimal_text(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE END AS serial, CASE WHEN o_orderkey % 4 = 0 THEN 'number_not_a_date' ELSE 'excel_serial' END AS note, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS lenient, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS iso,
o_orderkey % 3 <> 0 AS canonical FROM orders""")
def number_dates(spark, d):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    number = F.when(k % 4 == 0, -1.0).otherwise(F.datediff(day, F.lit("1899-12-30")).cast("double") + 0.25)
    p = parse.serial_date(number)
    text = F.when(k % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 5 == 1, F.date_format(day, "d-MMM-yyyy")).when(k % 5 == 2, F.date_format(day, "dd/MM/yyyy")).when(k % 5 == 3, F.date_format(day, "yyyy/MM/dd")).otherwise("13.1.2020")
    iso = T.to_iso_date(F.when(k % 2 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:00"))).otherwise(F.date_format(day, "dd-MM-yyyy")))
    key = F.concat(F.when(k % 3 == 0, "mp").otherwise("MP"), F.lit("/MP62/2024-2025/"), k)
    return table(spark, d, "orders").select("o_orderkey", p["value"].alias("serial"), F.array_join(p["notes"], ",").alias("note"), parse.lenient_date(text).alias("lenient"), iso.alias("iso"), parse.is_canonical_key(key).alias("canonical"))


@query(f"WITH {PAY}, {WORKS}, {FEAT} SELECT state, count(*) AS works, round(median(sanction_amount::DOUBLE), 6) AS median_amount FROM feat GROUP BY 1")
def state_medians(spark, d):
    rows = feature_rows(spark, d)
    return rows.groupBy("state").agg(F.max("peer_count_by_state").alias("works"), F.max("peer_median_sanction_amount_by_state").alias("median_amount"))


def raw_sources(spark, d: str) -> dict[str, DataFrame]:
    """Orders and line items as the text cells of four raw sources: the whole build's input."""
    o = table(spark, d, "orders")
    year, day = F.year("o_orderdate"), lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "dd-MMM-yyyy")
    key = F.concat(F.lit("MP/MP"), F.col("o_custkey"), F.lit("/"), year, F.lit("-"), year + 1, F.lit("/"), F.col("o_orderkey"))
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    place = {"work_category": F.col("o_orderpriority"), "state": F.lit("Goa"), "ida": F.lit("Office"), "mp_name": F.lit("Shri A"), "constituency": F.lit("North"), "work_description": F.lit("a road"), "work": F.concat(key, F.lit(" - Road"))}
    row = F.col("o_orderkey").cast("int").alias("source_row")
    make = lambda rows, **own: rows.select(row, *[v.alias(c) for c, v in (place | own).items()])
    items = table(spark, d, "lineitem").join(o.select("o_orderkey", key.alias("work_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    cells = {"state": F.lit("Goa"), "ida": F.lit("Office"), "mp_name": F.lit("Shri A"), "constituency": F.lit("North"), "work": F.lit("a road"), "vendor_name": F.concat(F.lit("V "), F.col("l_suppkey")), "payment_status": F.when(F.col("l_returnflag") == "R", "Payment Success").otherwise("Payment In-Progress"), "work_id": F.col("work_id"), "expenditure_date": F.date_format("l_shipdate", "dd-MMM-yyyy"), "fund_disbursed_amount": F.col("l_extendedprice").cast("decimal(18,2)").cast("string")}
    paid = items.select((F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey") % 1_000_000_000).cast("int").alias("source_row"), *[v.alias(c) for c, v in cells.items()])
    return {
        "recommended": make(o, recommended_date=day(-30), recommended_amount=money, sanction_date=day(0)),
        "sanctioned": make(o.where("o_orderstatus <> 'O'"), recommended_date=day(-30), sanction_date=day(1), sanction_amount=money, work_status=F.lit("Sanctioned")),
        "completed": make(o.where("o_orderstatus = 'F'"), completion_date=day(60), completed_amount_disbursed=money),
        "expenditure": paid,
    }


@query("""SELECT 'MP/MP' || o_custkey || '/' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || '/' || o_orderkey AS work_id, o_totalprice::DECIMAL(18,2)::DOUBLE AS recommended_amount, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS sanction_amount,
(o_orderdate::DATE + CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END)::DATE AS sanction_date, CASE WHEN o_orderstatus = 'F' THEN (o_orderdate::DATE + 60)::DATE END AS completion_date, o_orderstatus <> 'O' AS in_sanctioned, o_orderstatus = 'F' AS in_completed,
CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'sanction_date' END AS conflict_fields FROM orders""")
def built_master(spark, d):
    """The whole build, of which the master is returned."""
    out = dataset.build(raw_sources(spark, d))
    return out["works_master"].select("work_id", *[F.col(c).cast("double").alias(c) for c in ("recommended_amount", "sanction_amount")], "sanction_date", "completion_date", "in_sanctioned", "in_completed", "conflict_fields")
