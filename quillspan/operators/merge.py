"""Several sources merged into a row for each key, with conflicts, containment and cross-field checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import financial_year, fold_person_name, values_equal

DESCRIPTIVE = ["work_category", "work", "state", "ida", "mp_name", "constituency", "work_description"]
#: Which directed pairs of sources are compared: (from, to, name of the issue, whether ids are listed). Source 'd' is
#: the recommended works that have a sanction date.
CONTAINMENT = [
    ("s", "r", "sanctioned_not_in_recommended", True),
    ("c", "s", "completed_not_in_sanctioned", True),
    ("e", "s", "expenditure_not_in_sanctioned", True),
    ("e", "m", "expenditure_not_in_master", True),
    ("c", "e", "completed_without_expenditure", True),
    ("r", "s", "recommended_not_in_sanctioned", False),
    ("s", "c", "sanctioned_not_completed", False),
    ("s", "e", "sanctioned_without_expenditure", False),
    ("d", "s", "recommended_with_sanction_date_not_in_sanctioned", True),
]


def presence(sources: dict[str, DataFrame], key: str = "work_id") -> DataFrame:
    """(key, has_<name> ...): the union of all keys, with the sources that have each. One shuffle by key."""
    tagged = [df.select(F.col(key), F.lit(name).alias("_tag")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged).where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.col("_tag") == n).alias(f"has_{n}") for n in sources])


def presence_patterns(flags: DataFrame) -> DataFrame:
    """How many keys each combination of sources has."""
    return flags.groupBy(*[c for c in flags.columns if c.startswith("has_") and c != "has_d"]).agg(F.count(F.lit(1)).alias("works"))


def containment_checks(flags: DataFrame, pairs=tuple(CONTAINMENT)) -> DataFrame:
    """(issue, from_count, matched, unmatched) for directed pairs; 'm' is any source but 'e'. Pairs of sources that aren't there are left out."""
    pairs = [p for p in pairs if all(f"has_{x}" in flags.columns or x == "m" for x in p[:2])]
    members = [c for c in flags.columns if c.startswith("has_") and c != "has_e"]
    flags = flags.withColumn("has_m", reduce(lambda a, b: a | b, [F.col(c) for c in members]))
    one = flags.agg(*[F.struct(F.count_if(F.col(f"has_{a}")).alias("n"), F.count_if(F.col(f"has_{a}") & F.col(f"has_{b}")).alias("k")).alias(name) for a, b, name, _ in pairs])
    each = F.array(*[F.struct(F.lit(name).alias("issue"), F.col(name).alias("x")) for _, _, name, _ in pairs])
    return one.select(F.explode(each).alias("y")).select("y.issue", F.col("y.x.n").alias("from_count"), F.col("y.x.k").alias("matched"), (F.col("y.x.n") - F.col("y.x.k")).alias("unmatched"))


def unmatched_ids(flags: DataFrame, key: str = "work_id", pairs=tuple(CONTAINMENT)) -> DataFrame:
    """(issue, key) for every key that a listed pair lacks."""
    pairs = [p for p in pairs if all(f"has_{x}" in flags.columns or x == "m" for x in p[:2])]
    members = [c for c in flags.columns if c.startswith("has_") and c != "has_e"]
    flags = flags.withColumn("has_m", reduce(lambda a, b: a | b, [F.col(c) for c in members]))
    issues = F.array_compact(F.array(*[F.when(F.col(f"has_{a}") & ~F.col(f"has_{b}"), F.lit(name)) for a, b, name, listed in pairs if listed]))
    return flags.select(F.explode(issues).alias("issue"), key)


def _pick(field: str, order: list[str], exact: bool) -> tuple[Column, Column, Column]:
    """(chosen value, whether another source disagrees, whether another differs in form only)."""
    values = [F.nullif(F.col(f"{s}.{field}").cast("string"), F.lit("")) for s in order]
    chosen = F.coalesce(*values)
    others = lambda test: reduce(lambda a, b: a | b, [F.coalesce(v.isNotNull() & test(v), F.lit(False)) for v in values])
    differs = others(lambda v: ~values_equal(chosen, v, exact))
    return chosen, differs, others(lambda v: v != chosen) & ~differs


def merge_stages(recommended: DataFrame, sanctioned: DataFrame, completed: DataFrame, key: str = "work_id") -> DataFrame:
    """A row for each key of three de-duplicated stages: preferred values, presence flags and conflicts.

    Descriptive fields prefer the sanctioned row, then the recommended, then the completed. conflict_fields lists
    fields in which another source disagrees; format_only those that differ in case, spacing or punctuation only.
    """
    stages = {"recommended": recommended, "sanctioned": sanctioned, "completed": completed}
    packed = [df.select(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias(name)) for name, df in stages.items()]
    df = packed[0].join(packed[1], key, "full_outer").join(packed[2], key, "full_outer")
    order = ["sanctioned", "recommended", "completed"]
    picks = {f: _pick(f, order, False) for f in DESCRIPTIVE}
    picks["recommended_date"] = _pick("recommended_date", ["recommended", "sanctioned"], True)
    picks["sanction_date"] = _pick("sanction_date", ["sanctioned", "recommended"], True)
    listed = lambda i: F.array_join(F.array_compact(F.array(*[F.when(p[i], F.lit(f)) for f, p in picks.items()])), ";")
    parts = F.split(key, "/")
    return df.select(
        key,
        F.get(parts, F.lit(1)).alias("id_mp_code"),
        F.get(parts, F.lit(2)).alias("id_financial_year"),
        *[picks[f][0].alias(f) for f in DESCRIPTIVE],
        picks["recommended_date"][0].cast("date").alias("recommended_date"),
        F.col("recommended.recommended_amount").alias("recommended_amount"),
        picks["sanction_date"][0].cast("date").alias("sanction_date"),
        F.col("sanctioned.sanction_amount").alias("sanction_amount"),
        F.col("sanctioned.work_status").alias("work_status"),
        F.col("completed.completion_date").alias("completion_date"),
        F.col("completed.completed_amount_disbursed").alias("completed_amount_disbursed"),
        *[F.col(s).isNotNull().alias(f"in_{s}") for s in stages],
        *[F.col(f"{s}.source_row").alias(f"{s}_source_row") for s in stages],
        *[F.coalesce(F.col(f"{s}.row_count"), F.lit(0)).alias(f"{s}_row_count") for s in stages],
        listed(1).alias("conflict_fields"),
        listed(2).alias("format_only_fields"),
    )


def conflict_counts(master: DataFrame) -> DataFrame:
    """(field, conflicts, format_only) over a merged table."""
    each = lambda c, kind: F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda f: F.struct(f.alias("field"), F.lit(kind).alias("kind")))
    rows = master.select(F.explode(F.concat(each("conflict_fields", "c"), each("format_only_fields", "f"))).alias("x"))
    return rows.groupBy("x.field").agg(F.count_if(F.col("x.kind") == "c").alias("conflicts"), F.count_if(F.col("x.kind") == "f").alias("format_only"))


def cross_checks(rows: DataFrame, key: str = "work_id", samples: int = 5) -> DataFrame:
    """(check, evaluated, hits, sample): date-order and amount checks, each over the rows that have its inputs.

    ``rows``: recommended_date, sanction_date, completion_date, first_expenditure_date, recommended_amount,
    sanction_amount, completed_amount_disbursed, total_disbursed, id_financial_year. sample: the smallest keys hit.
    """
    c = F.col
    rd, sd, cd, fd = c("recommended_date"), c("sanction_date"), c("completion_date"), c("first_expenditure_date")
    ra, sa, ca, td = c("recommended_amount"), c("sanction_amount"), c("completed_amount_disbursed"), c("total_disbursed")
    tests = {
        "sanction_before_recommendation": sd < rd,
        "completion_before_sanction": cd < sd,
        "completion_before_recommendation": cd < rd,
        "expenditure_before_recommendation": fd < rd,
        "expenditure_before_sanction": fd < sd,
        "completed_amount_exceeds_sanction": ca > sa,
        "expenditure_total_exceeds_sanction": td > sa,
        "sanction_amount_differs_from_recommended": sa != ra,
        "sanction_amount_exceeds_recommended": sa > ra,
        "id_fy_differs_from_sanction_fy": financial_year(sd) != c("id_financial_year"),
    }
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("check"), t.alias("hit")) for n, t in tests.items()])).alias("x")).where("x.hit is not null")
    counts = each.groupBy("x.check").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("x.hit").alias("hits"))
    rank = F.row_number().over(W.partitionBy("check").orderBy(key))
    top = each.where("x.hit").select("x.check", key).withColumn("_n", rank).where(F.col("_n") <= samples)
    top = top.groupBy("check").agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return counts.join(top, "check", "left")


def name_overlap(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(only_left, both, only_right): distinct person names of two tables, compared without honorifics."""
    l, r = (df.select(fold_person_name(F.col(c)).alias("n")).where("n <> ''").withColumn(s, F.lit(True)).distinct() for df, c, s in ((left, a, "l"), (right, b, "r")))  # noqa: E741
    return l.join(r, "n", "full_outer").agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("l").isNull()).alias("only_right"))


def not_everywhere(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(value, sources): values that some table lacks, with the tables that have them."""
    tagged = [df.select(F.col(c).alias("value"), F.lit(n).alias("source")).where("value is not null").distinct() for n, (df, c) in tables.items()]
    found = reduce(DataFrame.unionByName, tagged).groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") < len(tables)).drop("n")
