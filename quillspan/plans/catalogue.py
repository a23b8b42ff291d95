"""The operators bound to the supplied tables: orders are works, line items payments, parts descriptions.

Each query has the SQL that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import parse
from quillspan.functions import similarity as S
from quillspan.functions import text as T
from quillspan.operators import anomaly, compliance, duplicates, features, merge, payments, profile, rowquality, serve, trends
from quillspan.session import scratch
from quillspan.streaming import daily

AS_OF = "2001-12-31"
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
PAID = {"success": "R", "in_progress": "A"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def paid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as payments, with repeats of (order, line) flagged."""
    rows = payments.flag_repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER)
    return rows.select(F.col("l_orderkey").alias("work_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.col("l_suppkey").alias("vendor"), F.col("l_returnflag").alias("status"), "duplicate_record")


def by_work(spark: SparkSession, d: str) -> DataFrame:
    return payments.payments_by_work(paid_rows(spark, d), **PAID)


def works(spark: SparkSession, d: str) -> DataFrame:
    """Orders as works, with their place."""
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyer = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")
    o = table(spark, d, "orders").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "Work Completed").when(F.col("o_orderstatus") == "P", "Partially complete").otherwise("Sanctioned")
    none = lambda t: F.lit(None).cast(t)
    return o.select(
        F.col("o_orderkey").alias("work_id"), F.col("r_name").alias("state"), F.col("n_name").alias("constituency"), F.col("c_name").alias("mp_name"), none("string").alias("ida"),
        F.col("o_orderpriority").alias("work_category"), status.alias("work_status"), none("string").alias("id_mp_code"), none("string").alias("id_financial_year"),
        F.concat_ws(" ", "o_orderpriority", "c_name").alias("work_description"), none("date").alias("recommended_date"), none("decimal(18,2)").alias("recommended_amount"),
        F.col("o_orderdate").cast("date").alias("sanction_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("sanction_amount"), none("date").alias("completion_date"),
        none("decimal(18,2)").alias("completed_amount_disbursed"), F.lit(True).alias("in_recommended"), F.lit(True).alias("in_sanctioned"), (F.col("o_orderstatus") == "F").alias("in_completed"),
    )


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return features.peer_features(features.work_features(works(spark, d), by_work(spark, d), AS_OF))


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Works with what the compliance rules need; a completed work ends with its last payment."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last"))
    w = works(spark, d).join(last, F.col("work_id") == F.col("l_orderkey"), "left")
    w = w.withColumn("completion_date", F.when(F.col("in_completed"), F.col("last"))).drop("last", "l_orderkey")
    late = payments.late_payments(w.withColumn("completion_date", F.when(F.col("in_completed"), F.col("sanction_date"))), paid_rows(spark, d)).select("work_id", F.col("post_completion_count").alias("late_payments"))
    return compliance.rule_mask(compliance.rule_inputs(w, by_work(spark, d), late), AS_OF)


_SERVED: dict[tuple[str, str], DataFrame] = {}


def served(spark: SparkSession, d: str) -> DataFrame:
    """Works with their payments, written once in a session: what a service reads its pages from."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _SERVED:
        _SERVED[at] = scratch(works(spark, d).join(by_work(spark, d), "work_id", "left"), "served")
    return _SERVED[at]


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as described works; the brand is the constituency."""
    p = table(spark, d, "part")
    return duplicates.prepare(p.select(F.col("p_partkey").alias("id"), F.lit("all").alias("state"), F.col("p_brand").alias("constituency"), F.col("p_type").alias("category"), F.col("p_name").alias("description"), F.col("p_retailprice").cast("decimal(18,2)").alias("amount"), F.lit(None).cast("date").alias("day")))


PAY = f"""pay AS (
  SELECT l_orderkey AS work_id, l_shipdate::DATE AS day, l_extendedprice::DECIMAL(18,2) AS amount, l_suppkey AS vendor, l_returnflag AS status,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ORDER)}) > 1 AS dup
  FROM lineitem
), by_work AS (
  SELECT work_id, sum(amount)::DECIMAL(28,2) AS total_disbursed_all_rows,
         coalesce(sum(amount) FILTER (status = 'R'), 0)::DECIMAL(28,2) AS success_amount,
         coalesce(sum(amount) FILTER (status = 'A'), 0)::DECIMAL(28,2) AS in_progress_amount,
         coalesce(sum(amount) FILTER (dup), 0)::DECIMAL(28,2) AS exact_duplicate_amount,
         coalesce(sum(amount) FILTER (NOT dup), 0)::DECIMAL(28,2) AS deduplicated_disbursed_amount,
         count(*) AS payment_count_all_rows, count(*) FILTER (NOT dup) AS deduplicated_payment_count, count(*) FILTER (dup) AS duplicate_record_count,
         min(day) AS first_expenditure_date, max(day) AS last_expenditure_date, count(DISTINCT vendor) AS vendor_count,
         count(*) FILTER (amount IS NULL) AS amount_missing_count, count(*) FILTER (day IS NULL) AS date_missing_count, count(*) FILTER (amount < 0) AS negative_amount_count
  FROM pay GROUP BY work_id
)"""
WORKS = """works AS (
  SELECT o_orderkey AS work_id, r_name AS state, n_name AS constituency, o_orderpriority AS work_category, o_orderstatus, o_orderdate::DATE AS sanction_date, o_totalprice::DECIMAL(18,2) AS sanction_amount,
         CASE o_orderstatus WHEN 'F' THEN 'Work Completed' WHEN 'P' THEN 'Partially complete' ELSE 'Sanctioned' END AS work_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
RATIO = "round_even({a}::DOUBLE / nullif({b}, 0)::DOUBLE, {n})::DECIMAL(24,{n})"


def ratio(a: str, b: str, n: int = 6) -> str:
    return RATIO.format(a=a, b=b, n=n)


FEAT = f"""feat AS (
  SELECT w.*, b.* EXCLUDE (work_id), {ratio('success_amount', 'sanction_amount')} AS success_utilization_ratio, {ratio('total_disbursed_all_rows', 'sanction_amount')} AS gross_utilization_ratio,
         {ratio('deduplicated_disbursed_amount', 'sanction_amount')} AS deduplicated_utilization_ratio, sanction_amount - deduplicated_disbursed_amount AS remaining_sanction_amount,
         {ratio('in_progress_amount', 'total_disbursed_all_rows')} AS in_progress_ratio, {ratio('exact_duplicate_amount', 'total_disbursed_all_rows')} AS duplicate_amount_ratio,
         {ratio('duplicate_record_count', 'payment_count_all_rows', 4)}::DECIMAL(8,4) AS duplicate_ratio,
         date_diff('day', sanction_date, first_expenditure_date) AS sanction_to_first_payment_days, date_diff('day', sanction_date, last_expenditure_date) AS sanction_to_last_payment_days,
         date_diff('day', sanction_date, DATE '{AS_OF}') AS days_since_sanction, date_diff('day', last_expenditure_date, DATE '{AS_OF}') AS days_since_last_payment,
         date_diff('day', first_expenditure_date, last_expenditure_date) AS payment_span_days
  FROM works w LEFT JOIN by_work b USING (work_id)
)"""


@query(f"WITH {PAY} SELECT *, total_disbursed_all_rows AS total_disbursed, payment_count_all_rows AS payment_count, {ratio('duplicate_record_count', 'payment_count_all_rows', 4)}::DECIMAL(8,4) AS duplicate_ratio FROM by_work")
def payments_by_work(spark, d):
    return by_work(spark, d)


@query(f"""WITH {PAY} SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS payments,
count(*) AS works, sum(n)::BIGINT AS payment_rows FROM (SELECT payment_count_all_rows AS n FROM by_work) GROUP BY 1""")
def payment_histogram(spark, d):
    return payments.payment_classes(by_work(spark, d))


@query(f"WITH {PAY} SELECT work_id, payment_count_all_rows FROM by_work ORDER BY payment_count_all_rows DESC, work_id LIMIT 1")
def busiest_work(spark, d):
    return payments.busiest_work(by_work(spark, d))


@query(f"WITH {PAY} SELECT coalesce(status, '(missing)') AS payment_status, count(*) AS payments, sum(amount)::DECIMAL(28,2) AS amount FROM pay GROUP BY 1")
def payment_status_totals(spark, d):
    return payments.status_totals(paid_rows(spark, d))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(ORDER)}) > 1 AS duplicate_record FROM lineitem")
def duplicate_payment_flags(spark, d):
    return payments.flag_repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "duplicate_record")


def _numbered(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rows.withColumn("source_row", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", *ORDER)))


@query(f"""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(ORDER)}) AS source_row, l_returnflag AS a, l_linestatus AS b FROM lineitem),
k AS (SELECT *, first_value(struct_pack(s := source_row, a := a, b := b)) OVER w AS f, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY key ORDER BY source_row))
SELECT key, source_row, f.s AS kept_source_row, CASE WHEN a <> f.a OR b <> f.b THEN 'conflicting' ELSE 'identical' END AS relation,
concat_ws(';', CASE WHEN a <> f.a THEN 'l_returnflag' END, CASE WHEN b <> f.b THEN 'l_linestatus' END) AS differing_fields FROM k WHERE n > 1""")
def duplicate_key_resolution(spark, d):
    return rowquality.resolve_repeats(_numbered(spark, d), "key", "source_row", {"l_returnflag": False, "l_linestatus": False})[1]


@query(f"""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(ORDER)}) AS source_row, l_partkey FROM lineitem)
SELECT key, source_row, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_row) AS n FROM r) WHERE n = 1""")
def first_rows(spark, d):
    return rowquality.first_rows(_numbered(spark, d), "key", "source_row").select("key", "source_row", "l_partkey")


_FEATURES = "success_utilization_ratio gross_utilization_ratio deduplicated_utilization_ratio remaining_sanction_amount in_progress_ratio duplicate_amount_ratio sanction_to_first_payment_days sanction_to_last_payment_days days_since_sanction days_since_last_payment payment_span_days".split()


@query(f"""WITH {PAY}, {WORKS}, {FEAT} SELECT work_id, {', '.join(_FEATURES)}, coalesce(payment_count_all_rows = 1, false) AS single_payment_work,
CASE WHEN payment_count_all_rows > 1 THEN {ratio('payment_span_days', '(payment_count_all_rows - 1)')} END AS average_payment_interval_days FROM feat""")
def work_features(spark, d):
    df = features.work_features(works(spark, d), by_work(spark, d), AS_OF)
    return df.select("work_id", *_FEATURES, "single_payment_work", "average_payment_interval_days")


@query(f"WITH {WORKS} SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'sanctioned' END AS kind, count(*) AS works, min(work_status) AS example, (count(*) FILTER (work_id IN (SELECT l_orderkey FROM lineitem)))::BIGINT AS also_paid FROM works GROUP BY 1")
def status_classification(spark, d):
    paid = by_work(spark, d).select("work_id", F.lit(True).alias("paid"))
    rows = works(spark, d).join(paid, "work_id", "left")
    return rows.groupBy(features.work_status(F.col("work_status")).alias("kind")).agg(F.count(F.lit(1)).alias("works"), F.min("work_status").alias("example"), F.count_if("paid").alias("also_paid"))


def _flags(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), "o_orderstatus", "o_orderpriority")
    return merge.presence({"r": o, "s": o.where("o_orderstatus <> 'O'"), "c": o.where("o_orderstatus = 'F'"), "e": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work_id")), "d": o.where("o_orderpriority = '1-URGENT'")})


FLAGS = """flags AS (SELECT o_orderkey AS work_id, true AS has_r, o_orderstatus <> 'O' AS has_s, o_orderstatus = 'F' AS has_c, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_e, o_orderpriority = '1-URGENT' AS has_d FROM orders
UNION ALL SELECT DISTINCT l_orderkey, false, false, false, true, false FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), m AS (SELECT *, has_r OR has_s OR has_c AS has_m FROM flags)"""


@query(f"WITH {FLAGS} SELECT has_r, has_s, has_c, has_e, count(*) AS works FROM m GROUP BY ALL")
def presence_patterns(spark, d):
    return merge.presence_patterns(_flags(spark, d))


@query(f"WITH {FLAGS} " + " UNION ALL ".join(f"SELECT '{n}' AS issue, count(*) FILTER (has_{a}) AS from_count, count(*) FILTER (has_{a} AND has_{b}) AS matched, count(*) FILTER (has_{a} AND NOT has_{b}) AS unmatched FROM m" for a, b, n, _ in merge.CONTAINMENT))
def containment_checks(spark, d):
    return merge.containment_checks(_flags(spark, d))


@query(f"WITH {FLAGS} " + " UNION ALL ".join(f"SELECT '{n}' AS issue, work_id FROM m WHERE has_{a} AND NOT has_{b}" for a, b, n, listed in merge.CONTAINMENT if listed))
def unmatched_ids(spark, d):
    return merge.unmatched_ids(_flags(spark, d))


def _merged(spark, d):
    w = works(spark, d).withColumn("source_row", F.lit(1)).withColumn("row_count", F.lit(1)).withColumn("work", F.col("work_category"))
    san = w.where("work_status <> 'Sanctioned'").withColumn("state", F.initcap("state")).withColumn("sanction_date", F.date_add("sanction_date", 1))
    com = w.where("work_status = 'Work Completed'").withColumn("work_category", F.col("work_status"))
    return merge.merge_stages(w, san, com)


@query(f"""WITH {WORKS}, s AS (SELECT count(*) FILTER (o_orderstatus <> 'O') AS sc, count(*) FILTER (o_orderstatus = 'F') AS f FROM works)
SELECT 'state' AS field, 0::BIGINT AS conflicts, sc AS format_only FROM s UNION ALL SELECT 'sanction_date', sc, 0 FROM s UNION ALL SELECT 'work_category', f, 0 FROM s""")
def merge_conflicts(spark, d):
    return merge.conflict_counts(_merged(spark, d))


@query(f"""WITH {WORKS} SELECT work_id, CASE WHEN o_orderstatus = 'O' THEN state ELSE array_to_string(list_transform(string_split(state, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS state,
CASE WHEN o_orderstatus = 'O' THEN sanction_date ELSE (sanction_date + 1)::DATE END AS sanction_date, true AS in_recommended, o_orderstatus <> 'O' AS in_sanctioned, o_orderstatus = 'F' AS in_completed,
CASE o_orderstatus WHEN 'O' THEN '' WHEN 'P' THEN 'sanction_date' ELSE 'work_category;sanction_date' END AS conflict_fields FROM works""")
def merge_master(spark, d):
    return _merged(spark, d).select("work_id", "state", "sanction_date", "in_recommended", "in_sanctioned", "in_completed", "conflict_fields")


@query(f"""WITH {PAY}, {WORKS}, t AS (SELECT work_id, sanction_date < DATE '1990-01-01' AS x, first_expenditure_date < sanction_date AS a, total_disbursed_all_rows > sanction_amount AS b FROM works LEFT JOIN by_work USING (work_id)),
u AS (SELECT 'expenditure_before_sanction' AS "check", work_id, a AS hit FROM t UNION ALL SELECT 'expenditure_total_exceeds_sanction', work_id, b FROM t)
SELECT "check", count(hit) AS evaluated, count(*) FILTER (hit) AS hits, array_to_string(list_sort(list(work_id) FILTER (hit))[1:5], ',') AS sample FROM u GROUP BY 1""")
def cross_checks(spark, d):
    paid = by_work(spark, d).select("work_id", "first_expenditure_date", "total_disbursed")
    rows = works(spark, d).join(paid, "work_id", "left")
    return merge.cross_checks(rows).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


@query("SELECT 'o_orderstatus' AS \"column\", count(*) AS total, count(*) - count(o_orderstatus) AS nulls, count(DISTINCT o_orderstatus) AS distinct_values, min(o_orderstatus) AS min, max(o_orderstatus) AS max FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders")
def column_profile(spark, d):
    return profile.column_profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER (coalesce(trim({c}), '') = '') AS empty, count(*) FILTER (lower(trim({c})) IN ('n/a','na','nil','null','none','nan','#n/a','-','--','not available')) AS placeholder, count(*) FILTER (coalesce(trim({c}), '') <> '' AND lower(trim({c})) NOT IN ('n/a','na','nil','null','none','nan','#n/a','-','--','not available')) AS present FROM documents" for c in ("lang", "source")))
def missingness(spark, d):
    return rowquality.missingness(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_frequencies(spark, d):
    return profile.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS \"values\", count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def dependency_violations(spark, d):
    return profile.dependency(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("""WITH s AS (SELECT v, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS folded, count(*) AS n FROM (SELECT n_name AS v FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT p_brand FROM part) GROUP BY 1, 2)
SELECT folded, string_agg(v, '|' ORDER BY v) AS spellings, count(*) AS variants, sum(n)::BIGINT AS rows FROM s GROUP BY 1 HAVING count(*) > 1""")
def spelling_variants(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("v"))
    return profile.spelling_variants(n.unionByName(n.select(F.lower("v").alias("v"))).unionByName(table(spark, d, "part").select(F.col("p_brand").alias("v"))), "v")


@query("""WITH f AS (SELECT DISTINCT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM nation), g AS (SELECT DISTINCT trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM region)
SELECT (SELECT count(*) FROM f WHERE n NOT IN (SELECT n FROM g)) AS only_left, (SELECT count(*) FROM f WHERE n IN (SELECT n FROM g)) AS "both", (SELECT count(*) FROM g WHERE n NOT IN (SELECT n FROM f)) AS only_right""")
def set_overlap(spark, d):
    return merge.name_overlap(table(spark, d, "nation"), table(spark, d, "region"), "n_name", "r_name")


@query("""WITH t AS (SELECT DISTINCT c_nationkey::VARCHAR AS value, 'customer' AS source FROM customer UNION ALL SELECT DISTINCT s_nationkey::VARCHAR, 'supplier' FROM supplier UNION ALL SELECT DISTINCT n_nationkey::VARCHAR, 'nation' FROM nation)
SELECT value, string_agg(source, ',' ORDER BY source) AS sources FROM t GROUP BY 1 HAVING count(*) < 3""")
def states_missing_somewhere(spark, d):
    of = lambda name, c: (table(spark, d, name).select(F.col(c).cast("string").alias("v")), "v")
    return merge.not_everywhere({"customer": of("customer", "c_nationkey"), "supplier": of("supplier", "s_nationkey"), "nation": of("nation", "n_nationkey")})


@query("""WITH n AS (SELECT c_nationkey::VARCHAR AS label, sum(c_acctbal::DECIMAL(18,2))::DECIMAL(28,2) AS amount FROM customer GROUP BY 1), u AS (SELECT * FROM n UNION ALL SELECT 'all', sum(amount) FROM n)
SELECT label, amount, amount * 2 = (SELECT sum(amount) FROM u) AS is_total FROM u""")
def footer_total_row(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("label")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(28,2)").alias("amount"))
    total = n.agg(F.lit("all").alias("label"), F.sum("amount").cast("decimal(28,2)").alias("amount"))
    return rowquality.hidden_total(n.unionByName(total), "amount")


PEER = """peer AS (
  SELECT state, work_category, count(*) AS peer_count_by_state_work_category, count(*) >= 20 AS peer_group_sufficient_by_state_work_category,
  CASE WHEN count(*) >= 20 THEN round(median(sanction_amount::DOUBLE), 6) END AS peer_median_sanction_amount_by_state_work_category,
  CASE WHEN count(*) >= 20 THEN round(median(total_disbursed_all_rows::DOUBLE), 6) END AS peer_median_disbursed_amount_by_state_work_category,
  CASE WHEN count(*) >= 20 THEN round(median(payment_count_all_rows::DOUBLE), 6) END AS peer_median_payment_count_by_state_work_category
  FROM feat GROUP BY 1, 2
)"""


@query(f"WITH {PAY}, {WORKS}, {FEAT}, {PEER} SELECT * FROM peer")
def peer_medians(spark, d):
    rows = features.work_features(works(spark, d), by_work(spark, d), AS_OF)
    return features.peer_groups(rows, ["state", "work_category"], "state_work_category")


@query(f"""WITH {WORKS}, s AS (SELECT count(*) AS n FROM works GROUP BY constituency, work_category)
SELECT count(*) AS groups, round(median(n), 4) AS median_size, min(n) AS min_size, max(n) AS max_size, coalesce(sum(n) FILTER (n >= 20), 0)::BIGINT AS covered, ((SELECT count(*) FROM works) - sum(n))::BIGINT AS ungrouped FROM s""")
def peer_viability(spark, d):
    return profile.peer_viability(works(spark, d), ["constituency", "work_category"])


_PROFILED = ["o_totalprice"]


@query("""WITH q AS (SELECT o_totalprice AS v FROM orders), s AS (SELECT count(*) AS total, count(v) AS n, count(*) FILTER (v = 0) AS zero, count(*) FILTER (v < 0) AS negative, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS sd,
quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM q)
SELECT 'o_totalprice' AS "column", total, n, zero, negative, round(mn, 4) AS min, round(mx, 4) AS max, round(mean, 4) AS mean, round(sd, 4) AS sd_pop, round(p25, 4) AS p25, round(p50, 4) AS median, round(p75, 4) AS p75, round(p90, 4) AS p90, round(p95, 4) AS p95, round(p99, 4) AS p99,
round(p25 - 1.5 * (p75 - p25), 4) AS low_fence, round(p75 + 1.5 * (p75 - p25), 4) AS high_fence, (SELECT count(*) FROM q WHERE v < p25 - 1.5 * (p75 - p25)) AS below, (SELECT count(*) FROM q WHERE v > p75 + 1.5 * (p75 - p25)) AS above FROM s""")
def numeric_profile(spark, d):
    return profile.numeric_profile(table(spark, d, "orders"), _PROFILED)


@query("SELECT 'o_totalprice' AS \"column\", round(count(o_totalprice) / count(*), 4) AS filled, 'suitable' AS verdict FROM orders")
def feature_suitability(spark, d):
    return profile.suitability(profile.numeric_profile(table(spark, d, "orders"), _PROFILED))


def _q(value: str, points: tuple[float, ...], where: str = "true") -> str:
    ok = f"({value}) IS NOT NULL AND ({where})"
    each = ", ".join(f"round(quantile_cont(({value})::DOUBLE, {p}) FILTER ({ok}), 6)" for p in points)
    return f"CASE WHEN count(*) FILTER ({ok}) >= 20 THEN [{each}] END"


_LEVEL_SQL = ", ".join(
    f"{k} AS (SELECT {', '.join(c)}, count(*) AS n, round(median(sanction_amount::DOUBLE), 6) AS ms, round(median(total_disbursed_all_rows::DOUBLE), 6) AS md, {_q('deduplicated_payment_count', anomaly.UPPER)} AS tp, {_q('vendor_count', anomaly.UPPER)} AS tv FROM feat GROUP BY ALL)"
    for k, c in (("l1", ["state", "work_category"]), ("l2", ["state"]), ("l3", ["work_category"]))
)
_PICK = "CASE WHEN l1.n >= 20 THEN {0} WHEN l2.n >= 20 THEN {1} WHEN l3.n >= 20 THEN {2} END"
_over = lambda v, t: f"coalesce(len(list_filter({t}, lambda x: {v} > x)) * (({v}) IS NOT NULL)::INT, 0)"
_under = lambda v, t: f"coalesce(len(list_filter({t}, lambda x: {v} < x)) * (({v}) IS NOT NULL)::INT, 0)"
PREP = f"""{PAY}, {WORKS}, {FEAT}, {_LEVEL_SQL}, prep AS (
  SELECT f.*, greatest(success_utilization_ratio, deduplicated_utilization_ratio)::DOUBLE AS eff_util, coalesce(payment_count_all_rows > 0, false) AS paid, coalesce(greatest(success_utilization_ratio, deduplicated_utilization_ratio)::DOUBLE < 0.95, false) AS open,
         round(sanction_amount::DOUBLE / nullif({_PICK.format('l1.ms', 'l2.ms', 'l3.ms')}, 0), 6) AS peer_sanction, round(total_disbursed_all_rows::DOUBLE / nullif({_PICK.format('l1.md', 'l2.md', 'l3.md')}, 0), 6) AS peer_disbursed,
         coalesce(CASE WHEN l1.n >= 20 THEN l1.tp END, CASE WHEN l2.n >= 20 THEN l2.tp END, CASE WHEN l3.n >= 20 THEN l3.tp END) AS tp,
         coalesce(CASE WHEN l1.n >= 20 THEN l1.tv END, CASE WHEN l2.n >= 20 THEN l2.tv END, CASE WHEN l3.n >= 20 THEN l3.tv END) AS tv
  FROM feat f JOIN l1 USING (state, work_category) JOIN l2 ON f.state = l2.state JOIN l3 ON f.work_category = l3.work_category
), thr AS (
  SELECT {_q('days_since_sanction', anomaly.MIDDLE)} AS t_age, {_q('eff_util', anomaly.LOWER)} AS u, {_q('days_since_last_payment', anomaly.UPPER, 'paid AND open')} AS t_inactivity,
         {_q('sanction_to_first_payment_days', anomaly.UPPER, 'sanction_to_first_payment_days >= 0')} AS t_first, {_q('sanction_to_last_payment_days', anomaly.UPPER, 'sanction_to_last_payment_days >= 0')} AS t_last,
         {_q('payment_span_days', anomaly.UPPER, 'payment_count_all_rows >= 2 AND payment_span_days >= 0')} AS t_span, {_q('duplicate_ratio', anomaly.MIDDLE, 'duplicate_record_count >= 1')} AS t_dup_ratio,
         {_q('duplicate_amount_ratio', anomaly.MIDDLE, 'duplicate_record_count >= 1')} AS t_dup_amount, {_q('duplicate_record_count', anomaly.MIDDLE, 'duplicate_record_count >= 1')} AS t_dup_count,
         median(days_since_last_payment) FILTER (paid) AS t_stale, {_q('peer_sanction', anomaly.UPPER)} AS t_peer_sanction, {_q('peer_disbursed', anomaly.UPPER)} AS t_peer_disbursed FROM prep
), t AS (SELECT * EXCLUDE (u), CASE WHEN u IS NOT NULL THEN [least(u[1], 0.90), least(u[2], 0.60), least(u[3], 0.30)] END AS t_util FROM thr)"""
_IDLE = f"CASE WHEN paid AND open THEN {_over('days_since_last_payment', 't_inactivity')} ELSE 0 END"
_DUP = f"greatest(1, {_over('duplicate_ratio::DOUBLE', 't_dup_ratio')}, {_over('duplicate_amount_ratio::DOUBLE', 't_dup_amount')}, {_over('duplicate_record_count', 't_dup_count')})"
SCORED = f"""{PREP}, lev AS (
  SELECT prep.*, {_over('days_since_sanction', 't_age')} AS age, {_under('eff_util', 't_util')} AS low, {_IDLE} AS idle, t.* FROM prep, t
), sev AS (
  SELECT work_id, state, work_category, CASE WHEN age = 0 OR (low = 0 AND idle = 0) THEN 0 ELSE least(3, greatest(low, idle) + (low > 0 AND idle > 0)::INT, age) END AS sev_age_utilization,
         CASE WHEN coalesce(duplicate_record_count, 0) < 1 THEN 0 WHEN duplicate_record_count = 1 THEN least({_DUP}, 2) ELSE {_DUP} END AS sev_duplicate_activity,
         CASE WHEN deduplicated_payment_count >= 3 THEN {_over('deduplicated_payment_count', 'tp')} ELSE 0 END AS sev_payment_count,
         greatest({_over('sanction_to_first_payment_days', 't_first')}, {_over('sanction_to_last_payment_days', 't_last')}, CASE WHEN payment_count_all_rows >= 2 THEN {_over('payment_span_days', 't_span')} ELSE 0 END, idle) AS sev_payment_timing,
         CASE WHEN vendor_count >= 3 THEN {_over('vendor_count', 'tv')} ELSE 0 END AS sev_vendor_count,
         greatest(CASE WHEN peer_sanction >= 2 THEN {_over('peer_sanction', 't_peer_sanction')} ELSE 0 END, CASE WHEN peer_disbursed >= 2 THEN {_over('peer_disbursed', 't_peer_disbursed')} ELSE 0 END) AS sev_peer_financial,
         CASE WHEN in_progress_amount > 0 AND days_since_last_payment > t_stale THEN {_over('in_progress_ratio::DOUBLE', '[0.50, 0.75, 0.95]')} ELSE 0 END AS sev_in_progress
  FROM lev
), scored AS (
  SELECT *, round_even(({' + '.join(f'sev_{n} * {w}' for n, w in anomaly.WEIGHTS.items())}) / 3.0::DOUBLE, 2)::DECIMAL(8,2) AS review_priority_score, ({' + '.join(f'(sev_{n} > 0)::INT' for n in anomaly.WEIGHTS)}) AS signal_count FROM sev
), labelled AS (SELECT *, CASE WHEN review_priority_score >= 75 THEN 'High Review Priority' WHEN review_priority_score >= 50 THEN 'Medium Review Priority' WHEN review_priority_score >= 25 THEN 'Low Review Priority' ELSE 'Normal Monitoring' END AS review_priority_label FROM scored)"""


def scored(spark, d):
    return anomaly.score(anomaly.prepare(feature_rows(spark, d)))


_THRESHOLDS = ["t_age", "t_util", "t_inactivity", "t_first", "t_last", "t_span", "t_dup_ratio", "t_dup_amount", "t_dup_count", "t_peer_sanction", "t_peer_disbursed"]


@query(f"WITH {PREP} " + " UNION ALL ".join(f"SELECT '{n}' AS threshold, round({n}[1], 5) AS mild, round({n}[2], 5) AS moderate, round({n}[3], 5) AS strong FROM t" for n in _THRESHOLDS))
def global_thresholds(spark, d):
    row = anomaly.global_thresholds(anomaly.prepare(feature_rows(spark, d)))
    each = F.array(*[F.struct(F.lit(n).alias("threshold"), F.col(n).alias("t")) for n in _THRESHOLDS])
    return row.select(F.explode(each).alias("x")).select("x.threshold", *[F.round(F.get("x.t", F.lit(i)), 5).alias(n) for i, n in enumerate(("mild", "moderate", "strong"))])


@query(f"WITH {PAY}, {WORKS}, {FEAT}, {_LEVEL_SQL} SELECT state, work_category, round(tp[1], 5) AS p90, round(tp[2], 5) AS p95, round(tp[3], 5) AS p99 FROM l1 WHERE n >= 20 AND tp IS NOT NULL")
def peer_thresholds(spark, d):
    t = anomaly.peer_thresholds(anomaly.prepare(feature_rows(spark, d)), "dedup_count", "state_work_category")
    return t.select("state", "work_category", *[F.round(F.get("t", F.lit(i)), 5).alias(n) for i, n in enumerate(("p90", "p95", "p99"))])


@query(f"WITH {SCORED} SELECT work_id, {', '.join(f'sev_{n}::INT AS sev_{n}' for n in anomaly.WEIGHTS)}, review_priority_score, signal_count::INT AS signal_count, review_priority_label FROM labelled")
def anomaly_scores(spark, d):
    return scored(spark, d).select("work_id", *[f"sev_{n}" for n in anomaly.WEIGHTS], "review_priority_score", "signal_count", "review_priority_label")


@query(f"WITH {SCORED} SELECT least(floor(review_priority_score / 10), 9)::INT AS band, count(*) AS works FROM labelled GROUP BY 1")
def score_bands(spark, d):
    return anomaly.score_bands(scored(spark, d))


@query(f"WITH {SCORED} SELECT review_priority_label, count(*) AS works, round(avg(review_priority_score::DOUBLE), 4) AS mean_score FROM labelled GROUP BY 1")
def label_counts(spark, d):
    return anomaly.label_counts(scored(spark, d))


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS signal, count(*) FILTER (sev_{n} = 1) AS mild, count(*) FILTER (sev_{n} = 2) AS moderate, count(*) FILTER (sev_{n} = 3) AS strong FROM sev" for n in anomaly.WEIGHTS))
def signal_activation(spark, d):
    return anomaly.signal_activation(scored(spark, d))


@query(f"WITH {SCORED} SELECT work_id, review_priority_score, signal_count::INT AS signal_count FROM labelled ORDER BY review_priority_score DESC, signal_count DESC, work_id LIMIT 20")
def top20(spark, d):
    return anomaly.top_candidates(scored(spark, d)).select("work_id", "review_priority_score", "signal_count")


def _top(k: int) -> str:
    ranked = ", ".join(f"struct_pack(p := -sev_{n} * {w}, i := {i}, n := '{n}')" for i, (n, w) in enumerate(anomaly.WEIGHTS.items()))
    return f"coalesce(list_sort(list_filter([{ranked}], lambda x: x.p < 0))[{k}].n, '')"


@query(f"WITH {SCORED} SELECT work_id, {_top(1)} AS top_signal_1, {_top(2)} AS top_signal_2, {_top(3)} AS top_signal_3 FROM labelled")
def top_signals(spark, d):
    return scored(spark, d).select("work_id", "top_signal_1", "top_signal_2", "top_signal_3")


@query(f"WITH {SCORED} SELECT work_id, review_priority_score FROM labelled WHERE review_priority_score >= 25")
def review_candidates(spark, d):
    return anomaly.candidates(scored(spark, d)).select("work_id", "review_priority_score")


_SINCE = f"date_diff('day', sanction_date, DATE '{AS_OF}')"
MASK = f"""{PAY}, {WORKS}, late AS (
  SELECT w.work_id, count(*) AS n, sum(amount)::DECIMAL(28,2) AS a, max(date_diff('day', sanction_date, day)) AS x FROM works w JOIN pay USING (work_id) WHERE o_orderstatus = 'F' AND date_diff('day', sanction_date, day) > 30 GROUP BY 1
), inp AS (
  SELECT w.*, coalesce(b.success_amount, 0) AS paid, b.last_expenditure_date AS last, coalesce(late.n, 0) AS late, o_orderstatus = 'F' AS done FROM works w LEFT JOIN by_work b USING (work_id) LEFT JOIN late USING (work_id)
), mask AS (
  SELECT *, (CASE WHEN coalesce(sanction_amount, 0) < 250000 THEN 2 ELSE 0 END + CASE WHEN date_diff('day', sanction_date, CASE WHEN done THEN coalesce(last, DATE '{AS_OF}') ELSE DATE '{AS_OF}' END) > 365 THEN 4 ELSE 0 END
    + CASE WHEN done AND paid <= 0 THEN 8 ELSE 0 END + CASE WHEN NOT done AND paid <= 0 AND {_SINCE} > 90 AND {_SINCE} <= 180 THEN 16 ELSE 0 END + CASE WHEN NOT done AND paid <= 0 AND {_SINCE} > 180 THEN 32 ELSE 0 END
    + CASE WHEN NOT done AND paid > 0 AND paid::DOUBLE / nullif(sanction_amount, 0)::DOUBLE < 0.8 AND date_diff('day', last, DATE '{AS_OF}') > 180 THEN 64 ELSE 0 END + CASE WHEN late >= 1 THEN 128 ELSE 0 END)::INT AS rule_mask FROM inp
)"""
_RULE_SQL = ", ".join(f"CASE WHEN rule_mask & {1 << i} <> 0 THEN '{r}' END" for i, r in enumerate(compliance.RULES))


@query(f"WITH {MASK} SELECT work_id, rule_mask, concat_ws(',', {_RULE_SQL}) AS rules FROM mask")
def compliance_mask(spark, d):
    return rule_rows(spark, d).select("work_id", "rule_mask", F.array_join(compliance.mask_to_rules(F.col("rule_mask")), ",").alias("rules"))


@query(f"WITH {MASK} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (rule_mask & {1 << i} <> 0) AS works, round(count(*) FILTER (rule_mask & {1 << i} <> 0) * 100.0::DOUBLE / count(*), 2) AS share FROM mask" for i, r in enumerate(compliance.RULES)))
def rule_breakdown(spark, d):
    return compliance.rule_breakdown(rule_rows(spark, d))


@query(f"""WITH {MASK} SELECT count(*) AS works, count(*) FILTER (rule_mask <> 0) AS flagged, count(*) FILTER (rule_mask = 0) AS unflagged, sum(bit_count(rule_mask))::BIGINT AS triggers,
count(*) FILTER (rule_mask & 15 <> 0) AS policy_works, count(*) FILTER (rule_mask & 8 <> 0) AS reconciliation_works, count(*) FILTER (rule_mask & 240 <> 0) AS execution_works,
round(sum(sanction_amount)::DOUBLE / 1e7, 2) AS outlay, round(coalesce(sum(sanction_amount) FILTER (rule_mask <> 0), 0)::DOUBLE / 1e7, 2) AS flagged_outlay FROM mask""")
def compliance_summary(spark, d):
    return compliance.compliance_summary(rule_rows(spark, d))


@query(f"WITH {MASK} SELECT bit_count(rule_mask)::INT AS rules_fired, count(*) AS works FROM mask GROUP BY 1")
def trigger_density(spark, d):
    return compliance.trigger_density(rule_rows(spark, d))


@query(f"WITH {MASK} SELECT work_id, n AS post_completion_count, a AS post_completion_amount, x::INT AS max_days_after_completion FROM late")
def post_completion_payments(spark, d):
    done = works(spark, d).withColumn("completion_date", F.when(F.col("in_completed"), F.col("sanction_date")))
    return payments.late_payments(done, paid_rows(spark, d))


@query(f"WITH {MASK} SELECT work_id, rule_mask FROM mask WHERE rule_mask & 64 <> 0 AND lower(state) = 'asia' AND contains(lower(constituency), 'i') ORDER BY sanction_amount DESC, work_id LIMIT 20")
def queue_page(spark, d):
    rows = compliance.queue(rule_rows(spark, d), rule="RISK-02", state="Asia", search="I", fields=("constituency",))
    return serve.clamped_page(rows, 1, 20, [F.desc("sanction_amount"), "work_id"]).select("work_id", "rule_mask")


def _events(spark, d):
    w = works(spark, d)
    paid = paid_rows(spark, d).join(w.select("work_id", "state"), "work_id", "left").withColumn("success", F.col("status") == "R")
    return trends.milestone_events(w.withColumn("completion_date", F.when(F.col("in_completed"), F.date_add("sanction_date", 60)))).unionByName(trends.payment_events(paid))


EVENTS = f"""{PAY}, {WORKS}, ev AS (
  SELECT state, sanction_date AS day, 's' AS kind, 0::DECIMAL(18,2) AS amount, false AS ok FROM works UNION ALL
  SELECT state, (sanction_date + 60)::DATE, 'c', 0, false FROM works WHERE o_orderstatus = 'F' UNION ALL
  SELECT state, day, 'p', amount, status = 'R' FROM pay LEFT JOIN works USING (work_id)
)"""
_MONTHLY = "0::BIGINT AS recommended, count(*) FILTER (kind = 's') AS sanctioned, count(*) FILTER (kind = 'c') AS completed, count(*) FILTER (kind = 'p') AS payments, coalesce(sum(amount) FILTER (kind = 'p'), 0)::DECIMAL(28,2) AS paid_amount, count(*) FILTER (kind = 'p' AND ok) AS success_payments, coalesce(sum(amount) FILTER (kind = 'p' AND ok), 0)::DECIMAL(28,2) AS success_amount"
_DENSE = ", ".join(f"coalesce({m}, 0) AS {m}" for m in trends.MEASURES)


@query(f"""WITH {EVENTS}, m AS (SELECT date_trunc('month', day)::DATE AS month, {_MONTHLY} FROM ev GROUP BY 1), cal AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m)
SELECT strftime(month, '%Y-%m') AS period, {_DENSE} FROM cal LEFT JOIN m USING (month)""")
def monthly_trend(spark, d):
    return trends.trend(_events(spark, d))


@query(f"""WITH {EVENTS}, m AS (SELECT state, date_trunc('month', day)::DATE AS month, {_MONTHLY} FROM ev WHERE state IS NOT NULL GROUP BY 1, 2), cal AS (SELECT state, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY 1)
SELECT cal.state AS scope, strftime(cal.month, '%Y-%m') AS period, {_DENSE} FROM cal LEFT JOIN m ON cal.state = m.state AND cal.month = m.month""")
def monthly_trend_by_state(spark, d):
    dense = trends.densify(trends.monthly(_events(spark, d)).where("not is_total"))
    return dense.select("scope", F.date_format("month", "yyyy-MM").alias("period"), *trends.MEASURES)


@query(f"WITH {EVENTS}, m AS (SELECT {_MONTHLY} FROM ev) SELECT * FROM m")
def trend_totals(spark, d):
    total = trends.series_totals(trends.trend(_events(spark, d)))
    return total.select(*[F.col(c).cast("decimal(28,2)" if c.endswith("amount") else "long").alias(c) for c in trends.MEASURES])


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", S.normalize_description(F.col("text")).alias("normalized"))


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"
_LOW = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
PARTS = f"""works AS (SELECT p_partkey AS id, p_brand AS constituency, p_type AS category, p_retailprice::DECIMAL(18,2)::DOUBLE AS amount, p_name AS description, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part),
prep AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_STOP}))) AS core, {_TRI.format(_LOW.format('description'))} AS tri FROM works),
tok AS (SELECT id, constituency, norm, unnest(core) AS token FROM prep)"""


@query(f"WITH {PARTS} SELECT token, count(*) AS works FROM tok GROUP BY 1")
def token_frequencies(spark, d):
    return duplicates.token_frequencies(parts(spark, d))


@query(f"WITH {PARTS} SELECT norm, count(*) AS works, count(DISTINCT constituency) AS constituencies FROM prep WHERE norm <> '' GROUP BY 1")
def exact_template_groups(spark, d):
    return duplicates.description_frequencies(parts(spark, d))


PAIRS = f"""{PARTS}, nm AS (SELECT *, count(*) OVER (PARTITION BY constituency, norm) AS n FROM prep WHERE length(norm) > 3),
loc AS (SELECT tok.id, tok.constituency, token, count(*) OVER (PARTITION BY tok.constituency, token) AS n FROM tok LEFT JOIN nm ON tok.id = nm.id WHERE coalesce(nm.n, 0) <= 8),
nat AS (SELECT *, count(*) OVER (PARTITION BY norm) AS n FROM prep WHERE length(norm) > 8), rare AS (SELECT *, count(*) OVER (PARTITION BY token) AS n FROM tok),
cand AS (
  SELECT a.id AS id_a, b.id AS id_b FROM nm a JOIN nm b ON a.constituency = b.constituency AND a.norm = b.norm AND a.id < b.id WHERE a.n BETWEEN 2 AND 8
  UNION SELECT id, nx FROM (SELECT id, n, lead(id) OVER (PARTITION BY constituency, norm ORDER BY id) AS nx FROM nm) WHERE n > 8 AND nx IS NOT NULL
  UNION SELECT a.id, b.id FROM loc a JOIN loc b ON a.constituency = b.constituency AND a.token = b.token AND a.id < b.id WHERE a.n BETWEEN 2 AND 25
  UNION SELECT id, nx FROM (SELECT id, n, lead(id) OVER (PARTITION BY constituency, token ORDER BY id) AS nx FROM loc) WHERE n > 25 AND nx IS NOT NULL
  UNION SELECT a.id, b.id FROM nat a JOIN nat b ON a.norm = b.norm AND a.id < b.id AND a.constituency <> b.constituency WHERE a.n BETWEEN 2 AND 15
  UNION SELECT a.id, b.id FROM rare a JOIN rare b ON a.token = b.token AND a.id < b.id AND a.constituency <> b.constituency WHERE a.n BETWEEN 2 AND 6 AND length(a.token) >= 5
)"""


@query(f"WITH {PAIRS} SELECT id_a, id_b FROM cand")
def duplicate_candidates(spark, d):
    return duplicates.candidate_pairs(parts(spark, d))


@query(f"WITH {PAIRS} SELECT id_a, id_b, round(coalesce(2.0::DOUBLE * len(list_intersect(a.tri, b.tri)) / nullif(len(a.tri) + len(b.tri), 0), 0), 6) AS dice, round(coalesce(len(list_intersect(a.core, b.core))::DOUBLE / nullif(len(a.core) + len(b.core) - len(list_intersect(a.core, b.core)), 0), 0), 6) AS jaccard FROM cand JOIN prep a ON a.id = id_a JOIN prep b ON b.id = id_b")
def trigram_similarity(spark, d):
    """Of every candidate pair: trigrams by Dice, core tokens by Jaccard."""
    p = duplicates.scratch(parts(spark, d), "parts")
    a, b = (p.select(F.col("id").alias(f"id_{e}"), F.col("tri").alias(f"tri_{e}"), F.col("core").alias(f"core_{e}")) for e in "ab")
    pairs = duplicates.candidate_pairs(p).join(a, "id_a").join(b, "id_b")
    return pairs.select("id_a", "id_b", F.round(S.dice(F.col("tri_a"), F.col("tri_b")), 6).alias("dice"), F.round(S.jaccard(F.col("core_a"), F.col("core_b")), 6).alias("jaccard"))


# Names of parts have no numerals, so the numeric rules can't fire here; they are tested on rows of their own.
SCORES = f"""{PAIRS}, fr AS (SELECT *, count(*) OVER (PARTITION BY norm) AS national, count(*) OVER (PARTITION BY constituency, norm) AS loc_n FROM prep),
sim AS (SELECT id_a, id_b, a.norm = b.norm AND a.norm <> '' AS exact, CASE WHEN a.norm = b.norm AND a.norm <> '' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.tri, b.tri)) / (len(a.tri) + len(b.tri)) END AS similarity,
  len(list_intersect(a.core, b.core)) AS shared, len(a.core) + len(b.core) - 2 * len(list_intersect(a.core, b.core)) AS apart, len(a.core) > 0 AND len(b.core) > 0 AS named,
  abs(a.amount - b.amount) / greatest(a.amount, b.amount) AS diff, a.constituency = b.constituency AS same_place, a.category = b.category AS same_kind, a.national AS national, a.loc_n AS loc_n
  FROM cand JOIN fr a ON a.id = id_a JOIN fr b ON b.id = id_b),
pts AS (SELECT *, greatest(0, least(100, round(CASE WHEN exact THEN 45.0::DOUBLE WHEN similarity >= 0.85 THEN 35.0 + (similarity - 0.85::DOUBLE) / 0.15::DOUBLE * 5.0::DOUBLE ELSE 20.0 + (similarity - 0.65::DOUBLE) / 0.20::DOUBLE * 14.0::DOUBLE END
  + least(15, shared * 4) - CASE WHEN named AND NOT exact AND shared <= 1 AND apart >= 2 THEN 10 ELSE 0 END + CASE WHEN diff = 0 THEN 20 WHEN diff <= 0.05 THEN 12 WHEN diff <= 0.15 THEN 5 ELSE 0 END
  + CASE WHEN same_place THEN 5 ELSE 0 END + CASE WHEN same_kind THEN 5 ELSE 0 END, 1))) AS score, loc_n >= 20 OR national >= 40 AS is_batch FROM sim WHERE similarity >= 0.65),
prio AS (SELECT *, CASE WHEN is_batch THEN 'Batch Scheme Representative Link' WHEN score >= 60 THEN 'Medium-Confidence Potential Duplicate' WHEN score >= 40 THEN 'Low-Confidence Similar Work' END AS review_priority FROM pts)"""


def pairs(spark, d):
    p = duplicates.scratch(parts(spark, d), "parts")
    return duplicates.score_pairs(duplicates.candidate_pairs(p), p)


@query(f"WITH {SCORES} SELECT id_a, id_b, round(similarity, 6) AS similarity, score, is_batch, review_priority, shared::INT AS shared FROM prio WHERE review_priority IS NOT NULL")
def duplicate_pairs(spark, d):
    return pairs(spark, d).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"), "score", "is_batch", "review_priority", F.size("shared_tokens").alias("shared"))


@query(f"WITH {SCORES} SELECT id_a, id_b, score, CASE WHEN is_batch THEN review_priority ELSE 'Medium-Confidence Potential Duplicate' END AS review_priority FROM prio WHERE is_batch OR score >= 75")
def retained_pairs(spark, d):
    return duplicates.retained_pairs(pairs(spark, d)).select("id_a", "id_b", "score", "review_priority")


@query(f"""WITH {SCORES}, k AS (SELECT id_a, id_b, is_batch FROM prio WHERE is_batch OR score >= 75)
SELECT count(*) FILTER (NOT is_batch) AS ordinary, 0::BIGINT AS high, count(*) FILTER (NOT is_batch) AS medium, count(*) FILTER (is_batch) AS batch, (SELECT count(DISTINCT x) FROM (SELECT id_a AS x FROM k UNION ALL SELECT id_b FROM k)) AS affected_works FROM k""")
def duplicate_summary(spark, d):
    return duplicates.duplicate_summary(duplicates.retained_pairs(pairs(spark, d)))


@query(f"""WITH RECURSIVE {SCORES}, e AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM prio WHERE score >= 75 UNION SELECT id_b, id_a FROM prio WHERE score >= 75), reach(node, root) AS (
  SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON reach.node = e.a
), comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1), g AS (SELECT c, count(*) AS work_count, string_agg(node::VARCHAR, ';' ORDER BY node) AS work_ids FROM comp GROUP BY 1)
SELECT 'CLUST-' || lpad((row_number() OVER (ORDER BY work_count DESC, c))::VARCHAR, 5, '0') AS cluster_id, work_count, work_count > 15 AS is_batch_scheme, work_ids FROM g""")
def duplicate_clusters(spark, d):
    return duplicates.clusters(pairs(spark, d).where("score >= 75"))


@query(f"WITH {WORKS} SELECT work_id, state, sanction_amount FROM works WHERE lower(state) IN ('asia', 'europe') AND work_category = '1-URGENT' AND sanction_amount >= 100000")
def filtered_page(spark, d):
    rows = serve.where_in(works(spark, d), {"state": ["ASIA", "europe"], "work_category": ["1-urgent"]})
    return serve.where_between(rows, "sanction_amount", 100_000).select("work_id", "state", "sanction_amount")


@query(f"WITH {PAY}, {WORKS} SELECT work_id, state, duplicate_record_count FROM works LEFT JOIN by_work USING (work_id) ORDER BY duplicate_record_count DESC NULLS LAST, lower(state) ASC NULLS LAST, work_id LIMIT 25 OFFSET 25")
def multi_sort_page(spark, d):
    rows = served(spark, d)
    keys = serve.parse_sort("-duplicate_record_count,state", ["duplicate_record_count", "state"])
    return serve.page(serve.sort_rows(rows, keys, "work_id"), 2, 25).select("work_id", "state", "duplicate_record_count")


@query(f"WITH {SCORES} SELECT id_a, id_b, score, a.p_name AS description_a, b.p_name AS description_b FROM prio JOIN part a ON a.p_partkey = id_a JOIN part b ON b.p_partkey = id_b WHERE review_priority IS NOT NULL AND NOT is_batch AND score >= 60 ORDER BY score DESC, id_a, id_b LIMIT 50")
def pair_page(spark, d):
    found = serve.sort_pairs(serve.where_pairs(pairs(spark, d), least=60)).limit(50).select("id_a", "id_b", "score")
    return serve.hydrate(found, table(spark, d, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("description")), ["description"])


@query(f"WITH {PAY}, {WORKS} SELECT count(*) AS works, sum(sanction_amount)::DECIMAL(28,2) AS sanctioned_total, sum(success_amount)::DECIMAL(28,2) AS disbursed_total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM works LEFT JOIN by_work USING (work_id)")
def dashboard(spark, d):
    rows = works(spark, d).join(by_work(spark, d), "work_id", "left").withColumn("is_completed", F.col("in_completed"))
    return serve.dashboard(rows, paid="success_amount")


@query(f"WITH {WORKS} SELECT constituency AS value, count(*) AS works FROM works GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_places(spark, d):
    return serve.top_groups(works(spark, d), "constituency")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('demo|' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def demo_sample(spark, d):
    return serve.seeded_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "demo", 500)


@query(f"SELECT DATE '{AS_OF}' AS snapshot, count(*) AS works FROM orders")
def snapshot_date(spark, d):
    rows = features.work_features(works(spark, d), by_work(spark, d), AS_OF).select("work_id", "days_since_sanction")
    return serve.snapshot_date(rows.join(works(spark, d).select("work_id", "sanction_date"), "work_id"))


@query("SELECT ts::DATE AS day, event_type AS kind, count(*) AS events, sum(round(value, 4)::DECIMAL(18,4))::DECIMAL(28,4) AS total FROM events GROUP BY 1, 2")
def events_daily(spark, d):
    return daily.daily_counts(table(spark, d, "events"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice::DECIMAL(18,2) AS value, 'ok' AS status, 'currency_symbol' AS notes FROM lineitem")
def parse_amounts(spark, d):
    rows = table(spark, d, "lineitem")
    p = parse.parse_amount(F.concat(F.lit("Rs. "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", p["value"].cast("decimal(18,2)").alias("value"), p["status"].alias("status"), F.array_join(p["notes"], ",").alias("notes"))


@query("SELECT o_orderkey, o_orderdate::DATE AS value, 'ok' AS status, CASE WHEN month(o_orderdate) % 2 = 0 THEN '' ELSE 'alt_format,numeric_day_first_assumed' END AS notes, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 1) ELSE (year(o_orderdate) - 1) || '-' || year(o_orderdate) END AS fy FROM orders")
def parse_dates(spark, d):
    rows = table(spark, d, "orders")
    day = F.col("o_orderdate")
    p = parse.parse_date(F.when(F.month(day) % 2 == 0, F.date_format(day, "dd-MMM-yyyy")).otherwise(F.date_format(day, "d/M/yyyy")))
    return rows.select("o_orderkey", p["value"].alias("value"), p["status"].alias("status"), F.array_join(p["notes"], ",").alias("notes"), T.financial_year(F.to_date(day)).alias("fy"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE 'MP/MP' || o_custkey || '/' || year(o_orderdate) || '-' || (year(o_orderdate) + 1) || '/' || o_orderkey END AS key, CASE WHEN o_orderstatus = 'O' THEN 'wrong_segment_count' END AS error, CASE WHEN o_orderstatus = 'P' THEN 'case_normalized' ELSE '' END AS warnings FROM orders""")
def parse_keys(spark, d):
    rows = table(spark, d, "orders")
    year = F.year("o_orderdate")
    key = F.concat_ws("/", F.when(F.col("o_orderstatus") == "P", "mp").otherwise("MP"), F.concat(F.lit("MP"), F.col("o_custkey")), F.concat_ws("-", year, year + 1), F.concat(F.col("o_orderkey"), F.lit(" - of a road")))
    p = parse.parse_key(F.when(F.col("o_orderstatus") == "O", "no key here").otherwise(key))
    return rows.select("o_orderkey", p["key"].alias("key"), p["error"].alias("error"), F.array_join(p["warnings"], ",").alias("warnings"))
