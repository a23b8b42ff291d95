"""Review priority: thresholds from percentiles, severities of seven signals, score, label and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.ranks import percentiles
from quillspan.session import scratch

# Floors, ceilings, percentiles, shares and weights of the scoring rules.
FULL = 0.95
CEILINGS = (0.90, 0.60, 0.30)
UPPER, MIDDLE, LOWER = (0.90, 0.95, 0.99), (0.50, 0.75, 0.90), (0.20, 0.10, 0.05)
MIN_SAMPLE, MIN_COUNT, MIN_MULTIPLE = 20, 3, 2.0
SHARES = (0.50, 0.75, 0.95)
WEIGHTS = {"age_utilization": 25, "duplicate_activity": 20, "payment_count": 15, "payment_timing": 15, "vendor_count": 10, "peer_financial": 10, "in_progress": 5}
LABELS = [(75, "High Review Priority"), (50, "Medium Review Priority"), (25, "Low Review Priority")]
LEVELS = {"state_work_category": ["state", "work_category"], "state": ["state"], "work_category": ["work_category"]}


def prepare(features: DataFrame) -> DataFrame:
    """Doubles for all measures; effective utilisation and counts; ratios to the first peer level that suffices."""
    measures = "days_since_sanction days_since_last_payment sanction_to_first_payment_days sanction_to_last_payment_days payment_span_days success_utilization_ratio deduplicated_utilization_ratio payment_count_all_rows deduplicated_payment_count vendor_count duplicate_record_count duplicate_ratio duplicate_amount_ratio in_progress_amount in_progress_ratio sanction_amount total_disbursed_all_rows".split()
    df = features.withColumns({m: F.col(m).cast("double") for m in measures})
    df = df.withColumns({"eff_util": F.greatest("success_utilization_ratio", "deduplicated_utilization_ratio"), "dedup_count": F.coalesce("deduplicated_payment_count", "payment_count_all_rows")})
    level = lambda pick: _first(pick)
    ratio = lambda value, m: level(lambda k: F.round(F.col(value) / F.nullif(F.col(f"peer_median_{m}_by_{k}").cast("double"), F.lit(0.0)), 6))
    return df.withColumns({
        "peer_level": F.coalesce(level(F.lit), F.lit("none")),
        "peer_group_size": level(lambda k: F.col(f"peer_count_by_{k}")),
        "sanction_to_peer_median": ratio("sanction_amount", "sanction_amount"),
        "disbursed_to_peer_median": ratio("total_disbursed_all_rows", "disbursed_amount"),
        "payment_count_to_peer_median": ratio("payment_count_all_rows", "payment_count"),
        "paid": F.coalesce(F.col("payment_count_all_rows") > 0, F.lit(False)),
        "open": F.coalesce(F.greatest("success_utilization_ratio", "deduplicated_utilization_ratio") < FULL, F.lit(False)),
    })


def _first(pick) -> Column:
    """The pick of the first peer level that suffices, null included."""
    out = None
    for k in LEVELS:
        out = (F.when if out is None else out.when)(F.col(f"peer_group_sufficient_by_{k}"), pick(k))
    return out


def _measures() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """What the global thresholds are percentiles of."""
    c, dup = F.col, F.coalesce(F.col("duplicate_record_count") >= 1, F.lit(False))
    some = lambda ok, name: F.when(ok, c(name))
    return {
        "t_age": (c("days_since_sanction"), MIDDLE),
        "t_util": (c("eff_util"), LOWER),
        "t_inactivity": (some(c("paid") & c("open"), "days_since_last_payment"), UPPER),
        "t_first": (some(c("sanction_to_first_payment_days") >= 0, "sanction_to_first_payment_days"), UPPER),
        "t_last": (some(c("sanction_to_last_payment_days") >= 0, "sanction_to_last_payment_days"), UPPER),
        "t_span": (some((c("payment_count_all_rows") >= 2) & (c("payment_span_days") >= 0), "payment_span_days"), UPPER),
        "t_dup_ratio": (some(dup, "duplicate_ratio"), MIDDLE),
        "t_dup_amount": (some(dup, "duplicate_amount_ratio"), MIDDLE),
        "t_dup_count": (some(dup, "duplicate_record_count"), MIDDLE),
        "t_stale": (some(c("paid"), "days_since_last_payment"), (0.5,)),
        "t_peer_sanction": (c("sanction_to_peer_median"), UPPER),
        "t_peer_disbursed": (c("disbursed_to_peer_median"), UPPER),
    }


#: Measures that are held against thresholds of the work's own peers.
PEER_METRICS = ("dedup_count", "vendor_count")


def thresholds(works: DataFrame, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """(level, key columns, measure, n, p) of ``prepare``'s rows: the global measures at level 'all', PEER_METRICS at each peer level that suffices."""
    levels = LEVELS if levels is None else levels
    own = {k: {m: (F.when(F.col(f"peer_group_sufficient_by_{k}"), F.col(m)), UPPER) for m in PEER_METRICS} for k in levels}
    return percentiles(works, {"all": [], **levels}, {"all": _measures(), **own})


def _rounded() -> Column:
    """The percentiles, to six places; null from under MIN_SAMPLE values."""
    return F.when(F.col("n") >= MIN_SAMPLE, F.transform("p", lambda x: F.round(x, 6)))


def global_thresholds(works: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of threshold arrays; ``found``: ``thresholds`` of the works, if there already."""
    found = thresholds(works, {}) if found is None else found
    one = {m: F.max(F.when(F.col("measure") == m, F.col("p") if m == "t_stale" else _rounded())) for m in _measures()}
    capped = F.when(F.col("t_util").isNotNull(), F.array(*[F.least(F.get("t_util", F.lit(i)), F.lit(cap)) for i, cap in enumerate(CEILINGS)]))
    return found.where("level = 'all'").agg(*[v.alias(m) for m, v in one.items()]).withColumns({"t_util": capped, "t_stale": F.get("t_stale", F.lit(0))})


def peer_thresholds(works: DataFrame, metric: str, level: str, found: DataFrame | None = None) -> DataFrame:
    """Upper percentiles of a metric in each sufficient group of a level; groups with too few values have none."""
    found = thresholds(works, {level: LEVELS[level]}) if found is None else found
    return found.where((F.col("level") == level) & (F.col("measure") == metric)).select(*LEVELS[level], _rounded().alias("t")).where("t is not null")


def _above(value: Column, thresholds: Column) -> Column:
    """How many thresholds a value exceeds; 0 without either."""
    return F.coalesce(F.size(F.filter(thresholds, lambda t: value > t)) * (value.isNotNull() & thresholds.isNotNull()).cast("int"), F.lit(0))


def _below(value: Column, thresholds: Column) -> Column:
    return F.coalesce(F.size(F.filter(thresholds, lambda t: value < t)) * (value.isNotNull() & thresholds.isNotNull()).cast("int"), F.lit(0))


def score(works: DataFrame) -> DataFrame:
    """Severities, score, label, signal count, top three signals and an explanation for each of ``prepare``'s rows.

    The one row of global thresholds is fetched by an action and put in as literals: 35 numbers, whatever the input.
    Group thresholds are joined by level, and the first level that has any counts. The rows are written once, and all
    thresholds come from one pass over them.
    """
    works = scratch(works, "prepared")
    found = scratch(thresholds(works), "thresholds")
    row = global_thresholds(works, found).first()
    t = {n: F.lit(None).cast("array<double>") if row[n] is None else F.array(*[F.lit(x) for x in row[n]]) for n in row.asDict() if n != "t_stale"}
    stale = F.lit(row["t_stale"]).cast("double")
    for metric in PEER_METRICS:
        for level, columns in LEVELS.items():
            works = works.join(peer_thresholds(works, metric, level, found).withColumnRenamed("t", f"_{metric}_{level}"), columns, "left")
        usable = [F.when(F.col(f"peer_group_sufficient_by_{k}"), F.col(f"_{metric}_{k}")) for k in LEVELS]
        works = works.withColumn(f"t_{metric}", F.coalesce(*usable)).drop(*[f"_{metric}_{k}" for k in LEVELS])
    c, zero = F.col, F.lit(0)
    quiet = c("paid") & c("open")
    since = c("days_since_last_payment")
    age, low = _above(c("days_since_sanction"), t["t_age"]), _below(c("eff_util"), t["t_util"])
    idle = F.when(quiet, _above(since, t["t_inactivity"])).otherwise(zero)
    span = F.when(c("payment_count_all_rows") >= 2, _above(c("payment_span_days"), t["t_span"])).otherwise(zero)
    dups = F.coalesce(c("duplicate_record_count"), F.lit(0.0))
    dup = F.greatest(F.lit(1), _above(c("duplicate_ratio"), t["t_dup_ratio"]), _above(c("duplicate_amount_ratio"), t["t_dup_amount"]), _above(dups, t["t_dup_count"]))
    many = lambda m: F.when(c(m) >= MIN_COUNT, _above(c(m), c(f"t_{m}"))).otherwise(zero)
    peer = lambda m, n: F.when(c(m) >= MIN_MULTIPLE, _above(c(m), t[n])).otherwise(zero)
    late = (c("in_progress_amount") > 0) & (since > stale)
    severities = {
        "age_utilization": F.when((age == 0) | ((low == 0) & (idle == 0)), zero).otherwise(F.least(F.lit(3), F.greatest(low, idle) + ((low > 0) & (idle > 0)).cast("int"), age)),
        "duplicate_activity": F.when(dups < 1, zero).when(dups == 1, F.least(dup, F.lit(2))).otherwise(dup),
        "payment_count": many("dedup_count"),
        "payment_timing": F.greatest(_above(c("sanction_to_first_payment_days"), t["t_first"]), _above(c("sanction_to_last_payment_days"), t["t_last"]), span, idle),
        "vendor_count": many("vendor_count"),
        "peer_financial": F.greatest(peer("sanction_to_peer_median", "t_peer_sanction"), peer("disbursed_to_peer_median", "t_peer_disbursed")),
        "in_progress": F.when(late, _above(c("in_progress_ratio"), F.array(*[F.lit(x) for x in SHARES]))).otherwise(zero),
    }
    out = works.withColumns({f"sev_{n}": s.cast("int") for n, s in severities.items()})
    thirds = sum((F.col(f"sev_{n}") * w for n, w in WEIGHTS.items()), F.lit(0))
    out = out.withColumn("review_priority_score", F.bround(thirds.cast("decimal(18,6)") / F.lit(3).cast("decimal(18,2)"), 2).cast("decimal(8,2)"))
    label = None
    for floor, name in LABELS:
        label = (F.when if label is None else label.when)(F.col("review_priority_score") >= floor, name)
    active = F.array(*[F.struct((-F.col(f"sev_{n}") * w).alias("points"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, w) in enumerate(WEIGHTS.items())])
    top = F.transform(F.slice(F.array_sort(F.filter(active, lambda x: x.points < 0)), 1, 3), lambda x: x["name"])
    out = out.withColumns({"review_priority_label": label.otherwise("Normal Monitoring"), "signal_count": F.size(F.filter(active, lambda x: x.points < 0)), "_top": top})
    out = out.withColumns({f"top_signal_{i + 1}": F.coalesce(F.get("_top", F.lit(i)), F.lit("")) for i in range(3)})
    reasons = F.array_join(F.transform("_top", lambda n: F.replace(n, F.lit("_"), F.lit(" "))), "; ")
    return out.withColumn("explanation_text", F.when(F.size("_top") == 0, "No review signal is active.").otherwise(F.concat(F.lit("Active review signals: "), reasons, F.lit(". A signal asks for a look and finds nothing by itself.")))).drop("_top")


def score_bands(scored: DataFrame) -> DataFrame:
    """Works by tens of the score; the last band holds 90 to 100."""
    band = F.least(F.floor(F.col("review_priority_score") / 10), F.lit(9)).cast("int")
    return scored.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("works"))


def label_counts(scored: DataFrame) -> DataFrame:
    """Works and mean score by label, the highest mean first."""
    return scored.groupBy("review_priority_label").agg(F.count(F.lit(1)).alias("works"), F.round(F.avg("review_priority_score"), 4).cast("double").alias("mean_score")).orderBy(F.desc("mean_score"), "review_priority_label")


def signal_activation(scored: DataFrame) -> DataFrame:
    """(signal, mild, moderate, strong): how many works each signal has at each severity."""
    each = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"sev_{n}").alias("s")) for n in WEIGHTS])
    return scored.select(F.explode(each).alias("x")).groupBy("x.signal").agg(*[F.count_if(F.col("x.s") == i).alias(n) for i, n in ((1, "mild"), (2, "moderate"), (3, "strong"))])


def signals_per_work(scored: DataFrame) -> DataFrame:
    """(signals, works): works by how many signals are active."""
    return scored.groupBy(F.col("signal_count").alias("signals")).agg(F.count(F.lit(1)).alias("works"))


def candidates_by(scored: DataFrame, column: str) -> DataFrame:
    """(value, candidates): review candidates by state or category, the most first."""
    return candidates(scored).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("candidates")).orderBy(F.desc("candidates"), "value")


def top_candidates(scored: DataFrame, n: int = 20, key: str = "work_id") -> DataFrame:
    """The n works of the highest score, then of most signals, then of the smallest key."""
    return scored.orderBy(F.desc("review_priority_score"), F.desc("signal_count"), key).limit(n)


def candidates(scored: DataFrame, labels: list[str] | None = None, least_signals: int | None = None, least_score: float | None = 25) -> DataFrame:
    """Review candidates by the first criterion given: labels, then signal count, then score; else all."""
    if labels:
        return scored.where(F.col("review_priority_label").isin(labels))
    if least_signals is not None:
        return scored.where(F.col("signal_count") >= least_signals)
    return scored.where(F.col("review_priority_score") >= least_score) if least_score is not None else scored
