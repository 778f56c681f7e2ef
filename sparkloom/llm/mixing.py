"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source of weight w (parts of a period of Q slots, Q the sum of the weights) gets its j-th block released at
floor(j*Q/w) and due at ceil((j+1)*Q/w). One block runs per slot; the released block with the earliest deadline goes
first, ties by the source's place in the list. As the weights fill the period, every block runs inside its window, so
at any time a source is less than one block ahead of or behind its share. The schedule repeats every Q slots.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER = "(other)"
#: Hash ranges in which the rows of one source are numbered.
BUCKETS = 1024


def schedule(spark: SparkSession, weights: Mapping[str, int]) -> DataFrame:
    """(mix_class, parts, nth, at): the slot of a period in which the nth block of a class runs; Q rows."""
    parts = {k: int(v) for k, v in weights.items() if int(v) > 0}
    q = sum(parts.values())
    ws = F.array(*(F.lit(w) for w in parts.values()))
    names = F.array(*(F.lit(k) for k in parts))
    start = F.struct(F.array(*(F.lit(0) for _ in parts)).alias("done"), F.expr("cast(array() as array<int>)").alias("picks"))

    def step(state, t):
        window = F.transform(
            ws,
            lambda w, i: F.struct(
                F.ceil((F.element_at(state["done"], i + 1) + 1) * F.lit(q) / w).alias("due"), i.cast("int").alias("i"),
                ((F.floor(F.element_at(state["done"], i + 1) * F.lit(q) / w) <= t) & (F.element_at(state["done"], i + 1) < w)).alias("released"),
            ),
        )
        pick = F.array_min(F.filter(window, lambda x: x["released"]))["i"]
        return F.struct(
            F.transform(state["done"], lambda d, i: d + F.when(i == pick, 1).otherwise(0)).alias("done"), F.concat(state["picks"], F.array(pick)).alias("picks")
        )

    one = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), start, step)["picks"].alias("picks"))
    slots = one.select(F.posexplode("picks").alias("at", "i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("at")) - 1
    return slots.select(F.element_at(names, F.col("i") + 1).alias("mix_class"), F.element_at(ws, F.col("i") + 1).alias("parts"), nth.alias("nth"), "at")


def mix(docs: DataFrame, weights: Mapping[str, int], block_rows: int = 32) -> DataFrame:
    """Adds mix_class, block, slot and position (all rows kept; ascending position is the mixed order) to docs.

    docs needs doc_id and source; its other columns pass through, but columns that have one of these four names are
    replaced. Sources that weights does not name, null included, share the class OTHER; if that has no weight itself it
    gets one part. Rows of a class follow a hash of their doc_id, so equal rows take neighbouring places. The last
    block of a class may be short, and a class that has run out leaves its later slots empty: the others keep their
    times. position = slot * block_rows + place in the block, which is unique. An empty table gives no rows.
    """
    if OTHER not in weights:
        weights = {**weights, OTHER: 1}
    q = sum(int(v) for v in weights.values() if int(v) > 0)
    named = [k for k, v in weights.items() if k != OTHER and int(v) > 0]
    rows = docs.drop("mix_class", "block", "slot", "position")
    rows = rows.withColumn("mix_class", F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(OTHER)))
    rows = rows.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_b", F.substring("_h", 1, 3))
    # place in the class: the rows of the ranges before, and the place inside the range
    counts = rows.groupBy("mix_class", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("mix_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("mix_class").alias("_c"), F.col("_b").alias("_cb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ids = F.row_number().over(Window.partitionBy("mix_class", "_b").orderBy("_h", "doc_id"))
    rows = rows.withColumn("_r", ids.cast("long") - 1)
    rows = rows.join(F.broadcast(starts), (F.col("mix_class") == F.col("_c")) & (F.col("_b") == F.col("_cb")))  # classes x 4096 rows at most
    rows = rows.withColumn("_place", F.col("_start") + F.col("_r")).withColumn("block", F.floor(F.col("_place") / block_rows))
    plan = schedule(docs.sparkSession, weights).select(F.col("mix_class").alias("_k"), "parts", F.col("nth").alias("_nth"), "at")
    parts = F.coalesce(*(F.when(F.col("mix_class") == k, F.lit(int(v))) for k, v in weights.items() if int(v) > 0))
    rows = rows.withColumn("_parts", parts).withColumn("_j", (F.col("block") % F.col("_parts")).cast("int"))
    rows = rows.join(F.broadcast(plan), (F.col("mix_class") == F.col("_k")) & (F.col("_j") == F.col("_nth")))  # one period: Q rows
    rows = rows.withColumn("slot", F.floor(F.col("block") / F.col("_parts")) * F.lit(q) + F.col("at"))
    rows = rows.withColumn("position", F.col("slot") * block_rows + F.col("_place") % block_rows)
    return rows.drop("_h", "_b", "_c", "_cb", "_start", "_r", "_place", "_k", "parts", "_nth", "at", "_parts", "_j")


def in_order(mixed: DataFrame) -> DataFrame:
    """Mixed rows dealt out by ranges of position and sorted inside them: files written from it are in mixed order."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
