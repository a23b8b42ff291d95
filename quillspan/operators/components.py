"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import drop_scratch, scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges``: two columns of one orderable type; direction, repeats, loops and null ends don't matter
    (loops and null ends are dropped). Each round is two aggregations and two joins; aggregates combine
    map-side and hot hubs are joined by sort-merge joins, which AQE splits. The rounds grow with the
    logarithm of the longest path. Raises RuntimeError if ``max_rounds`` don't suffice.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    star = scratch(pairs.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("m")).distinct(), "edges")
    # Stars already, as single pairs are: nodes that are the lower end of nothing but links of their own, and have one lower end at most.
    ends = star.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("m").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    whole = not ends.where("up + down > 1").limit(1).count()
    before = None
    for _ in range(max_rounds):
        if whole:
            break
        now = star.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
        # The minima are written before they are joined: AQE splits a hub only between two exchanges of a join's own.
        both = star.unionByName(star.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = scratch(both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low")), "least")
        large = scratch(both.join(least, "v").where("m > v and m <> low").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct(), "large")
        low = scratch(large.groupBy("v").agg(F.min("m").alias("low")), "low")
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))).alias("e"))
        after = scratch(small.select("e.v", "e.m").where("v <> m").distinct(), "edges")
        for done in (least, large, low):
            drop_scratch(done)
        drop_scratch(star)
        star = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = star.select(F.col("m").alias("node")).distinct()
    return star.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
