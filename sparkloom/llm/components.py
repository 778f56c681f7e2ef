"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every end of an edge (u, v), the smallest id that is reachable. Ids are long, not null.

    Each round writes its edges to the shared folder: lost executors reread them. The number of rounds grows with the
    logarithm of the largest component. An empty table of edges has no ends and gives no rows.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.materialise(ordered, "edges")
    mark = _mark(now)
    while True:
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its neighbours below move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = below.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = common.materialise(small, "edges")
        common.drop_scratch(now)
        new = _mark(after)
        if new == mark:
            ends = after.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ends.unionByName(after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        now, mark = after, new
