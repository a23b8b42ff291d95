"""Row-level quality: blank rows, totals rows, keys, and the split of a source into its outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.parse import is_amount, is_unkeyed, parse_amount, parse_date, parse_key, serial_date
from quillspan.functions.text import collapse, decimal_text, has_suspect_encoding, missing_kind, normalize_text, values_equal
from quillspan.plans.contracts import Source

GRAND_TOTAL = r"(?i)^\s*grand[\s\-]*total\b"
TOTAL = r"(?i)^\s*(sub[\s\-]?total|total)\b"
MIN_ROWS = 3


def is_blank(columns: list[str]) -> Column:
    """No cell has anything but white space; a placeholder is something."""
    return reduce(lambda a, b: a & b, [F.coalesce(collapse(F.col(c)), F.lit("")) == "" for c in columns])


def evaluate(rows: DataFrame, source: Source) -> DataFrame:
    """Parse every column by kind, then judge totals rows, then the key.

    ``rows``: all-string columns of the source and ``source_row``. Adds, for each text column c, c normalised in place;
    for dates and amounts a parsed struct ``c__p`` and c as its typed value; ``key__p``; ``reason`` (of a totals row)
    and ``category``: 'summary', 'unkeyed', 'malformed' or 'valid'. Blank rows are dropped. If there is a column ``numeric``, a
    list of the cells that are numbers, dates among them are day numbers.
    """
    raw = {c: F.col(c) for c in source.columns}
    rows = rows.where(~is_blank(list(raw)))
    day = lambda c: parse_date(F.col(c))
    if "numeric" in rows.columns:
        day = lambda c: F.when(F.coalesce(F.array_contains("numeric", c), F.lit(False)), serial_date(F.col(c).try_cast("double"))).otherwise(parse_date(F.col(c)))
    parsers = {"date": day, "amount": lambda c: parse_amount(F.col(c))}
    rows = rows.withColumns({f"{c}__raw": raw[c] for c in raw})
    rows = rows.withColumns({f"{c}__p": parsers[k](c) for c, k in source.columns.items() if k in parsers})
    rows = rows.withColumns({c: F.col(f"{c}__p.value") if k in parsers else normalize_text(F.col(c)) for c, k in source.columns.items()})
    rows = rows.withColumn("reason", totals_reason(source))
    if not source.key:
        return rows.withColumn("category", F.when(F.col("reason").isNotNull(), "summary").otherwise("valid"))
    rows = rows.withColumn("key__p", parse_key(F.col(f"{source.key}__raw"), bare=source.bare_key))
    category = F.when(F.col("reason").isNotNull(), "summary").when(F.col("key__p.key").isNotNull(), "valid")
    return rows.withColumn("category", category.when(is_unkeyed(F.col(f"{source.key}__raw")), "unkeyed").otherwise("malformed"))


def totals_reason(source: Source) -> Column:
    """Why a row reads as a totals row, from its own cells; null if it doesn't."""
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    labels = [F.coalesce(F.col(c), F.lit("")) for c in source.labels]
    number = some([is_amount(F.col(c)) for c in source.no_numbers])
    wrong = some([F.when(F.col(f"{c}__p.status") == "invalid", is_amount(F.col(f"{c}__raw"))).otherwise(False) for c, k in source.columns.items() if k == "date"])
    alone = F.col(source.amount).isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNull() for c in source.identity])
    return F.when(some([x.rlike(GRAND_TOTAL) for x in labels]), "grand_total_label").when(some([x.rlike(TOTAL) for x in labels]), "total_label").when(number | wrong, "footer_row").when(alone, "summary_amount_only")


def hidden_total(rows: DataFrame, amount: str, candidates: Column | None = None, name: str = "is_total") -> DataFrame:
    """Mark the one row whose amount is half of the column's sum, that is, the sum of all others.

    Nothing is marked if the sum isn't positive, if there are fewer than MIN_ROWS candidates, or if several rows fit.
    ``candidates``: the rows that may be marked; the sum is over all. Three sums over the table are all that is gathered.
    """
    ok = F.lit(True) if candidates is None else candidates
    value = F.col(amount).cast("decimal(38,12)")
    total, count = rows.agg(F.sum(value), F.count_if(ok)).first()
    if total is None or total <= 0 or count < MIN_ROWS:
        return rows.withColumn(name, F.lit(False))
    fits = ok & F.coalesce(value * 2 == F.lit(total).cast("decimal(38,12)"), F.lit(False))
    return rows.withColumn(name, fits if rows.where(fits).limit(2).count() == 1 else F.lit(False))


def resolve_repeats(rows: DataFrame, key: str, order: str, fields: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """(kept, findings): the first row of each key, and each later row as identical to it or conflicting, with the fields.

    ``fields``: names, and whether they must agree exactly; others are compared after folding.
    """
    w = W.partitionBy(key).orderBy(order)
    first = F.first(F.struct(order, *fields)).over(w)
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_kept", first)
    differ = [F.when(~values_equal(F.col(f"_kept.{f}").cast("string"), F.col(f).cast("string"), exact), F.lit(f)) for f, exact in fields.items()]
    found = ranked.where("_n > 1").select(key, F.col(order).alias("source_row"), F.col(f"_kept.{order}").alias("kept_source_row"), F.array_compact(F.array(*differ)).alias("differing"))
    found = found.select(key, "source_row", "kept_source_row", F.when(F.size("differing") > 0, "conflicting").otherwise("identical").alias("relation"), F.array_join("differing", ";").alias("differing_fields"))
    return ranked.where("_n = 1").drop("_n", "_kept"), found


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; rows without a key go."""
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, total, empty, placeholder, present) of text columns, in one pass."""
    kinds = [F.struct(F.count(F.lit(1)).alias("total"), F.count_if(missing_kind(F.col(c)) == "empty").alias("empty"), F.count_if(missing_kind(F.col(c)) == "placeholder").alias("placeholder")).alias(c) for c in columns]
    one = rows.agg(*kinds)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return one.select(F.explode(pairs).alias("x")).select("x.column", "x.s.total", "x.s.empty", "x.s.placeholder", (F.col("x.s.total") - F.col("x.s.empty") - F.col("x.s.placeholder")).alias("present"))


def key_profile(parsed: DataFrame) -> DataFrame:
    """(kind, value, n) over ``key__p``: errors, warnings, prefixes, codes and years, with the categories."""
    each = F.concat(
        F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value"))),
        F.array(F.struct(F.lit("error").alias("kind"), F.col("key__p.error").alias("value"))),
        F.array(F.struct(F.lit("prefix").alias("kind"), F.col("key__p.prefix").alias("value"))),
        F.array(F.struct(F.lit("financial_year").alias("kind"), F.col("key__p.year").alias("value"))),
        F.array(F.struct(F.lit("code").alias("kind"), F.col("key__p.code").alias("value"))),
        F.transform("key__p.warnings", lambda w: F.struct(F.lit("warning").alias("kind"), w.alias("value"))),
    )
    return parsed.select(F.explode(each).alias("x")).where("x.value is not null").groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def repeat_statistics(found: DataFrame, key: str) -> DataFrame:
    """One row over the findings of ``resolve_repeats``: keys that repeat, rows that are too many, and how many of those are identical or conflicting."""
    by_key = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relation") == "identical").alias("same"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_key.agg(F.count(F.lit(1)).alias("repeated_keys"), total("n").alias("extra_rows"), total("same").alias("identical"), total(F.col("n") - F.col("same")).alias("conflicting"))


def distinct_keys(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(source, n): how many different keys each source has; nulls don't count."""
    tagged = [df.select(F.lit(name).alias("source"), F.col(key).alias("k")).where("k is not null") for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, tagged).groupBy("source", "k").agg(F.lit(1).alias("one"))
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def source_profile(rows: DataFrame, source: Source, first_day: str, last_day: str) -> DataFrame:
    """(column, kind, total, empty, placeholder, invalid, cleaned, suspect, ...): one row for each column of ``evaluate``'s rows, in one pass.

    Of amounts: how many, below zero, zero, sum, least and most. Of dates: how many, the first and last, and those before
    ``first_day`` or after ``last_day``. first_value: that of the first row which has one. What a kind doesn't have is null.
    """
    stats, none = [], F.lit(None)
    for c, kind in source.columns.items():
        raw, value = F.col(f"{c}__raw"), F.col(c)
        parsed = kind in ("date", "amount")
        missing = missing_kind(raw)
        have = value.isNotNull()
        number = value if kind == "amount" else none.cast("decimal(27,12)")
        day = value if kind == "date" else none.cast("date")
        only = lambda name, x, of=kind: x if of == name else none.cast("long")
        stats.append(
            F.struct(
                F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("total"), F.count_if(missing == "empty").alias("empty"), F.count_if(missing == "placeholder").alias("placeholder"),
                (F.count_if(F.col(f"{c}__p.status") == "invalid") if parsed else F.lit(0).cast("long")).alias("invalid"),
                (F.lit(0).cast("long") if parsed else F.count_if(have & (raw != value))).alias("cleaned"),
                (F.lit(0).cast("long") if parsed else F.count_if(F.coalesce(has_suspect_encoding(value), F.lit(False)))).alias("suspect"),
                only("amount", F.count_if(number < 0)).alias("negative"), only("amount", F.count_if(number == 0)).alias("zero"),
                F.sum(number.cast("decimal(27,6)")).cast("decimal(38,6)").alias("sum"), F.min(number).alias("least"), F.max(number).alias("most"),
                F.min(day).alias("first_day"), F.max(day).alias("last_day"), only("date", F.count_if(day < F.lit(first_day).cast("date"))).alias("too_early"), only("date", F.count_if(day > F.lit(last_day).cast("date"))).alias("too_late"),
                F.min_by(decimal_text(value) if kind == "amount" else value.cast("string"), F.when(have, F.col("source_row"))).alias("first_value"),
            ).alias(c)
        )
    one = rows.agg(*stats)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in source.columns])
    return one.select(F.explode(pairs).alias("x")).select("x.column", "x.s.*")


def note_frequencies(rows: DataFrame, source: Source) -> DataFrame:
    """(column, note, n): what the parsers noted; notes on invalid cells start with 'invalid:'."""
    of = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"{c}__p.status").alias("status"), F.col(f"{c}__p.notes").alias("notes"))
    each = rows.select(F.explode(F.array(*[of(c) for c, k in source.columns.items() if k in ("date", "amount")])).alias("x")).where("x.status <> 'missing'")
    said = F.when(F.col("x.status") == "invalid", F.array(F.concat(F.lit("invalid:"), F.array_join("x.notes", ",")))).otherwise(F.col("x.notes"))
    return each.select("x.column", F.explode(said).alias("note")).groupBy("column", "note").agg(F.count(F.lit(1)).alias("n"))
