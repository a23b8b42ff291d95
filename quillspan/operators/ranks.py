"""Exact ranks and percentiles without a task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.session import scratch

#: A value's band is its sign and this many steps for each doubling: a band is far narrower than any spread of values.
STEPS = 64
#: Ranges of a global order: one for about so many rows, and at most so many.
RANGE_ROWS, MAX_RANGES = 1_000_000, 4096


def band(value: Column) -> Column:
    """A whole number that never falls as the value rises; far fewer of them than values."""
    size = F.floor(F.log2(F.abs(value) + 1) * STEPS).cast("int") + 1
    return F.when(value == 0, 0).when(value > 0, size).otherwise(-size)


def percentiles(rows: DataFrame, levels: dict[str, list[str]], measures: dict[str, dict[str, tuple[Column, tuple[float, ...]]]]) -> DataFrame:
    """(level, key columns, measure, n, p): inclusive percentiles, by linear interpolation, of several measures at several groupings.

    ``levels``: the grouping columns of each level ([] for all rows); ``measures``: of each level, the values and points by
    name. Nulls and NaN don't count, nor do rows with a null key at that level; key columns that a level lacks are null.

    Values are counted where they are read. Counts by band tell which bands hold the ranks that are wanted, and only the values of
    those bands are put in order; so no task holds a group's values, however large the group.
    """
    keys = list(dict.fromkeys(c for columns in levels.values() for c in columns))
    kinds = {c: rows.schema[c].dataType for c in keys}
    each, points = [], []
    for level, columns in levels.items():
        ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))
        for name, (value, wanted) in measures[level].items():
            own = [F.col(c) if c in columns else F.lit(None).cast(kinds[c]) for c in keys]
            v = value.cast("double")
            each.append(F.when(ok & v.isNotNull() & ~F.isnan(v), F.struct(F.lit(level).alias("level"), *[x.alias(c) for x, c in zip(own, keys)], F.lit(name).alias("measure"), v.alias("v"))))
            points.append((level, name, list(map(float, wanted))))
    group = ["level", *keys, "measure"]
    long = rows.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")
    counts = scratch(long.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("band", band(F.col("v"))), "values")
    bands = counts.groupBy(*group, "band").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*group)
    before = F.coalesce(F.sum("n").over(by.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bands = bands.withColumns({"total": F.sum("n").over(by), "start": before})
    asked = None
    for level, name, wanted in points:
        hit = (F.col("level") == level) & (F.col("measure") == name)
        value = F.array(*[F.lit(p) for p in wanted])
        asked = F.when(hit, value) if asked is None else asked.when(hit, value)
    # Each point wants the values of two neighbouring ranks, from 0.
    at = F.transform(asked, lambda p, i: F.struct(i.alias("i"), ((F.col("total") - 1) * p).alias("r")))
    ranks = F.flatten(F.transform(at, lambda x: F.array(F.struct(x.i.alias("i"), F.floor(x.r).alias("k"), (1 - (x.r - F.floor(x.r))).alias("w")), F.struct(x.i.alias("i"), F.ceil(x.r).alias("k"), (x.r - F.floor(x.r)).alias("w")))))
    here = F.filter(ranks, lambda x: (x.k >= F.col("start")) & (x.k < F.col("start") + F.col("n")))
    bands = scratch(bands.withColumn("ranks", here).where(F.size("ranks") > 0).select(*group, "band", "total", "start", "ranks"), "bands")
    same = lambda a, b, columns: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])
    found = counts.join(F.broadcast(bands) if len(points) * max(1, bands.count()) < 100_000 else bands, same(counts, bands, [*group, "band"]))
    found = found.select(*[counts[c] for c in group], "v", "n", "total", "start", "ranks", counts["band"])
    inside = W.partitionBy(*group, "band").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    found = found.select(*group, "total", "v", F.explode(F.filter("ranks", lambda x: (x.k >= F.col("start")) & (x.k < F.col("start") + F.col("n")))).alias("x"))
    one = found.groupBy(*group, F.col("x.i").alias("i")).agg(F.max("total").alias("n"), F.sum(F.col("v") * F.col("x.w")).alias("p"))
    return one.groupBy(*group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x.p).alias("p"))


def in_ranges(rows: DataFrame, order: list, name: str = "part", ranges: int | None = None) -> DataFrame:
    """``rows``, written in ``ranges`` ranges of their order, with each one's number, from 0. Spark samples 100 rows for each range."""
    n = ranges or min(MAX_RANGES, max(2, rows.count() // RANGE_ROWS))
    return scratch(rows.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list, name: str = "number", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place in a global order, from 1: a sort in each range, after the rows of the ranges before it."""
    dealt = in_ranges(rows, order, "_qs_part", ranges)
    sizes = dealt.groupBy("_qs_part").agg(F.count(F.lit(1)).alias("_qs_n"))
    before = F.sum("_qs_n").over(W.orderBy("_qs_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_qs_part", F.coalesce(before, F.lit(0)).alias("_qs_start"))  # MAX_RANGES rows at most
    inside = F.row_number().over(W.partitionBy("_qs_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_qs_part").withColumn(name, inside + F.col("_qs_start")).drop("_qs_part", "_qs_start")


def neighbours(rows: DataFrame, key: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """(key, order_a, order_b): each row and the next of its key, by a column whose values don't repeat in a key.

    Neighbours are found in each range of the order, and then between the ranges, so a key with any share of the rows is
    dealt over all of them.
    """
    dealt = in_ranges(rows.select(*key, order), [order], "_qs_part", ranges)
    by = W.partitionBy(*key, "_qs_part")
    pairs = dealt.select(*key, F.col(order).alias("a"), F.lead(order).over(by.orderBy(order)).alias("b"))
    edges = dealt.groupBy(*key, "_qs_part").agg(F.min(order).alias("low"), F.max(order).alias("high"))
    across = edges.select(*key, F.col("high").alias("a"), F.lead("low").over(W.partitionBy(*key).orderBy("_qs_part")).alias("b"))
    return pairs.where("b is not null").unionByName(across.where("b is not null")).select(*key, F.col("a").alias(f"{order}_a"), F.col("b").alias(f"{order}_b"))
