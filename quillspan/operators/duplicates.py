"""Potential duplicates: blocking, scoring of candidate pairs, the high-confidence gate, and clusters.

Columns of a works table: id, state, constituency, category, description, amount, day. Text columns are trimmed by
``prepare``; id orders the works and gives ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import similarity as S
from quillspan.operators.components import connected_components
from quillspan.operators.ranks import neighbours, numbered
from quillspan.session import scratch

# Group sizes, lengths and points of the rules.
TEMPLATE_PAIRS, TOKEN_PAIRS, NATIONAL_PAIRS, RARE = 8, 25, 15, (2, 6)
MIN_SIMILARITY, HIGH_SIMILARITY = 0.65, 0.85
BATCH_LOCAL, BATCH_NATIONAL, BATCH_CLUSTER = 20, 40, 15
KEEP_SCORE = 75.0


def described(works: DataFrame) -> DataFrame:
    """Trimmed texts and the normalised description: all that scoring needs where pairs are given, as it makes the rest from these."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    df = works.select("id", *[text(c).alias(c) for c in ("state", "constituency", "category")], "description", "amount", "day")
    return df.withColumn("norm", S.normalize_description(F.col("description")))


def prepare(works: DataFrame) -> DataFrame:
    """Add what blocking and scoring need: the normalised description, core tokens, numerals and trigrams."""
    return described(works).withColumns({"core": S.core_tokens(F.col("norm")), "nums": S.numerals(F.col("norm")), "tri": S.trigrams(F.col("description"))})


def _pairs(rows: DataFrame, key: list[str], most: int, least: int = 2, carry: list[str] = ()) -> DataFrame:
    """All pairs a < b inside groups of ``least`` to ``most`` rows; larger groups make none here."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).drop("n")
    some = rows.join(sizes, key)
    a, b = (some.select(*key, F.col("id").alias(f"id_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in carry]) for e in "ab")
    return a.join(b, key).where("id_a < id_b").drop(*key)


def _chains(rows: DataFrame, key: list[str], over: int) -> DataFrame:
    """Neighbours by id inside groups of more than ``over`` rows: as many pairs as rows. A group of any size is dealt over the ranges of ids."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over).drop("n")
    return neighbours(rows.join(sizes, key), key, "id").drop(*key)


def candidate_pairs(works: DataFrame) -> DataFrame:
    """(id_a, id_b), distinct, id_a < id_b, from five passes over ``prepare``'s rows.

    In a constituency: equal descriptions (all pairs up to TEMPLATE_PAIRS, else neighbours), and a common core token
    (all pairs up to TOKEN_PAIRS, else neighbours) without the works of large templates. Across constituencies: equal
    descriptions up to NATIONAL_PAIRS, and tokens that few works have.
    """
    place = ["state", "constituency"]
    rows = works.select("id", *place, "norm", "core")
    named = rows.where(F.char_length("norm") > 3).select("id", *place, "norm")
    large = named.groupBy(*place, "norm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TEMPLATE_PAIRS).drop("n")
    tokens = rows.select("id", *place, "norm", F.explode("core").alias("token"))
    local = tokens.join(large, [*place, "norm"], "left_anti").select("id", *place, "token")
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(*RARE) & (F.char_length("token") >= 5)).select("token")
    apart = F.col("constituency_a") != F.col("constituency_b")
    wide = rows.where(F.char_length("norm") > 8).select("id", "constituency", "norm")
    rare = tokens.select("id", "constituency", "token").join(freq, "token")
    passes = [
        _pairs(named, [*place, "norm"], TEMPLATE_PAIRS),
        _chains(named, [*place, "norm"], TEMPLATE_PAIRS),
        _pairs(local, [*place, "token"], TOKEN_PAIRS),
        _chains(local, [*place, "token"], TOKEN_PAIRS),
        _pairs(wide, ["norm"], NATIONAL_PAIRS, carry=["constituency"]).where(apart).select("id_a", "id_b"),
        _pairs(rare, ["token"], RARE[1], carry=["constituency"]).where(apart).select("id_a", "id_b"),
    ]
    return reduce(DataFrame.unionByName, passes).distinct()


def score_pairs(pairs: DataFrame, works: DataFrame) -> DataFrame:
    """Points, priority and reasons of each pair that reaches MIN_SIMILARITY and a priority.

    ``works``: rows of ``prepare`` or of ``described``; of the latter, arrays are made for the pairs alone. Pairs meet the texts by
    id; similarity is computed and filtered before anything else is. Rows with their counts are written once.
    """
    national = works.groupBy("norm").agg(F.count(F.lit(1)).alias("national"))
    local = works.groupBy("constituency", "norm").agg(F.count(F.lit(1)).alias("local"))
    full = works.join(national, "norm", "left").join(local, ["constituency", "norm"], "left")
    arrays = {"core": (S.core_tokens, "norm"), "nums": (S.numerals, "norm"), "tri": (S.trigrams, "description")}
    columns = [*(c for c in full.columns if c != "id")]
    full = scratch(full, "counted")
    a, b = (full.select(F.col("id").alias(f"id_{e}"), *[F.col(c).alias(f"{c}_{e}") for c in columns]) for e in "ab")
    df = pairs.join(a, "id_a").join(b, "id_b")
    same = (F.col("norm_a") == F.col("norm_b")) & (F.col("norm_a") != "")
    made = lambda name, end: F.col(f"{name}_{end}") if name in columns else arrays[name][0](F.col(f"{arrays[name][1]}_{end}"))
    df = df.withColumn("exact", same).withColumn("similarity", F.when(same, 1.0).otherwise(S.dice(made("tri", "a"), made("tri", "b"))))
    df = df.where(F.col("similarity") >= MIN_SIMILARITY)
    sim, c = F.col("similarity"), F.col
    alike = F.col("norm_a") == F.col("norm_b")
    for name in ("core", "nums"):
        if name not in columns:  # equal descriptions have equal tokens
            df = df.withColumn(f"{name}_a", made(name, "a"))
            df = df.withColumn(f"{name}_b", F.when(alike, F.col(f"{name}_a")).otherwise(made(name, "b")))
    shared = F.array_intersect("core_a", "core_b")
    df = df.withColumns({
        "shared_tokens": F.array_sort(shared),
        "numeric_conflict": F.when(alike, False).otherwise(S.numeric_conflict(S.contextual_numerals(c("norm_a")), S.contextual_numerals(c("norm_b")), c("nums_a"), c("nums_b"))),
        "name_conflict": S.name_divergence(c("core_a"), c("core_b")) & ~c("exact"),
        "amount_a": F.when(c("amount_a") > 0, c("amount_a").cast("double")),
        "amount_b": F.when(c("amount_b") > 0, c("amount_b").cast("double")),
        "date_gap_days": F.abs(F.datediff("day_a", "day_b")),
        "consecutive": S.is_consecutive(c("id_a").cast("string"), c("id_b").cast("string")),
    })
    df = df.withColumn("amount_difference", F.abs(c("amount_a") - c("amount_b")) / F.greatest("amount_a", "amount_b"))
    gap, diff = c("date_gap_days"), c("amount_difference")
    points = (
        F.when(c("exact"), 45.0).when(sim >= HIGH_SIMILARITY, 35.0 + (sim - 0.85) / 0.15 * 5.0).otherwise(20.0 + (sim - 0.65) / 0.20 * 14.0)
        + F.least(F.lit(15.0), F.size("shared_tokens") * 4.0)
        - F.when(c("numeric_conflict"), 30.0).otherwise(0.0)
        - F.when(c("name_conflict"), 10.0).otherwise(0.0)
        + F.when(diff == 0, 20.0).when(diff <= 0.05, 12.0).when(diff <= 0.15, 5.0).otherwise(0.0)
        + F.when(gap == 0, 15.0).when(gap <= 30, 10.0).when(gap <= 90, 5.0).otherwise(0.0)
        + F.when((c("constituency_a") != "") & (c("constituency_a") == c("constituency_b")), 5.0).otherwise(0.0)
        + F.when((c("category_a") != "") & (c("category_a") == c("category_b")), 5.0).otherwise(0.0)
        + F.when(c("consecutive"), 3.0).otherwise(0.0)
    )
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(points, 1))))
    high = (c("score") >= 80) & (sim >= HIGH_SIMILARITY) & F.coalesce(diff <= 0.05, F.lit(False)) & F.coalesce(gap <= 90, F.lit(False)) & ~c("numeric_conflict")
    df = df.withColumn("is_high", high).withColumn("is_batch", (c("local_a") >= BATCH_LOCAL) | (c("national_a") >= BATCH_NATIONAL))
    priority = F.when(c("is_batch"), "Batch Scheme Representative Link").when(c("is_high"), "High-Confidence Potential Duplicate")
    priority = priority.when((c("score") >= 60) & ~c("numeric_conflict"), "Medium-Confidence Potential Duplicate").when(c("score") >= 40, "Low-Confidence Similar Work")
    df = df.withColumn("review_priority", priority).where("review_priority is not null")
    reasons = F.array_compact(F.array(
        F.when(c("exact"), F.lit("same normalised description")).when(sim >= HIGH_SIMILARITY, F.format_string("text similarity %.2f, high", sim)).otherwise(F.format_string("text similarity %.2f, moderate", sim)),
        F.when(F.size("shared_tokens") > 0, F.format_string("%d common locality or entity tokens", F.size("shared_tokens"))),
        F.when(c("numeric_conflict"), F.lit("numbers differ: other places")),
        F.when(c("name_conflict"), F.lit("other names")),
        F.when(diff == 0, F.lit("same amount")).when(diff <= 0.15, F.format_string("amounts differ by %.1f%%", diff * 100)),
        F.when(gap == 0, F.lit("same date")).when(gap <= 90, F.format_string("dates %d days apart", gap)),
        F.when((c("constituency_a") != "") & (c("constituency_a") == c("constituency_b")), F.lit("same constituency")),
        F.when((c("category_a") != "") & (c("category_a") == c("category_b")), F.lit("same category")),
        F.when(c("consecutive"), F.lit("consecutive serials")),
    ))
    keep = ["id_a", "id_b", "similarity", "score", "amount_a", "amount_b", "amount_difference", "date_gap_days", "shared_tokens", "numeric_conflict", "name_conflict", "consecutive", "is_high", "is_batch", "review_priority"]
    return df.withColumn("reasons", reasons).select(*keep, F.col("local_a").alias("batch_frequency"), "reasons")


#: Fixed value: what every explanation ends with.
DISCLAIMER = "This indicates potential duplicate entry or overlapping scope that may warrant verification and does not establish wrongdoing."


def explained(scored: DataFrame) -> DataFrame:
    """``scored`` pairs with explanation_text: the reasons in a sentence, and the disclaimer."""
    return scored.withColumn("explanation_text", F.concat(F.lit("Review recommended because "), F.lower(F.array_join("reasons", "; ")), F.lit(f". {DISCLAIMER}")))


def high_clusters(pairs: DataFrame) -> DataFrame:
    """``clusters`` of what high-confidence pairs, not of a batch, connect."""
    return clusters(pairs.where("is_high and not is_batch"))


def retained_pairs(scored: DataFrame) -> DataFrame:
    """Pairs worth review: links of a batch, high confidence, or a score of KEEP_SCORE; the last are written as medium."""
    kept = scored.where(F.col("is_batch") | F.col("is_high") | (F.col("score") >= KEEP_SCORE))
    return kept.withColumn("review_priority", F.when(F.col("is_batch") | F.col("is_high"), F.col("review_priority")).otherwise("Medium-Confidence Potential Duplicate"))


def clusters(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(cluster_id, work_count, is_batch_scheme, work_ids): connected components, the largest first, then by smallest member.

    A component of more than BATCH_CLUSTER is a batch. Clusters are put in order by ranges of it; a row holds its members, as
    that is what it is for.
    """
    members = scratch(connected_components(pairs, a, b), "members")
    groups = members.groupBy("component").agg(F.count(F.lit(1)).alias("work_count"), F.array_sort(F.collect_list("node")).alias("ids"))
    groups = numbered(groups, [F.desc("work_count"), "component"])
    return groups.select(F.format_string("CLUST-%05d", F.col("number")).alias("cluster_id"), "work_count", (F.col("work_count") > BATCH_CLUSTER).alias("is_batch_scheme"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ";").alias("work_ids"))


def duplicate_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs by priority, links of batches, and the works concerned."""
    ends = pairs.select("is_batch", "is_high", F.posexplode(F.array("id_a", "id_b")).alias("end", "w"))
    once = ends.groupBy("w").agg(*[F.count_if((F.col("end") == 0) & ok).alias(name) for name, ok in (("high", F.col("is_high") & ~F.col("is_batch")), ("medium", ~F.col("is_high") & ~F.col("is_batch")), ("batch", F.col("is_batch")))])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return once.agg(total(F.col("high") + F.col("medium")).alias("ordinary"), *[total(c).alias(c) for c in ("high", "medium", "batch")], F.count(F.lit(1)).alias("affected_works"))


def description_frequencies(works: DataFrame) -> DataFrame:
    """(norm, works, constituencies) of ``prepare``'s rows."""
    return works.where("norm <> ''").groupBy("norm").agg(F.count(F.lit(1)).alias("works"), F.countDistinct("constituency").alias("constituencies"))


def token_frequencies(works: DataFrame) -> DataFrame:
    """(token, works) over core tokens."""
    return works.select(F.explode("core").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("works"))
