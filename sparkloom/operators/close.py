"""Pairs of an expected and a read text that are close enough to be the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import text_steps
from .consistency import inside

#: Least ratio of matching blocks (twice their characters by those of both texts).
RATIO = 0.92
#: Lengths from which a text may begin the other one, or be a part of it.
BEGINS, PART = 3, 5


def normal(s: Column) -> Column:
    """Repeated marks as one, without white space, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)^\s+|\s+$", ""), r"([,.\-_;:])\1+", "$1"), r"(?U)\s+", ""))


def _slack(n: Column) -> Column:
    return F.greatest(F.lit(4), F.floor(n / 5).cast("int"))


def close_pairs(expected: DataFrame, read: DataFrame) -> DataFrame:
    """(expected, read, how, ratio): pairs that are equal once normalised, of which the first begins the second (BEGINS characters or more) or is a part of it
    (PART or more), or whose lengths are near and whose matching blocks make a ratio of RATIO or more; how is the first of these that holds, ratio is given for the last alone.

    expected: (expected), read: (read). Texts meet by pieces: a pair of that ratio leaves at most 1 - RATIO of both lengths outside of the blocks, each character of
    which breaks one piece, so with one piece more than these one stands whole in the other text. Only such pairs have their blocks computed, in which no character counts as junk. Null and
    blank texts have no pair; repeated ones count once.
    """
    a = expected.select("expected").distinct().withColumn("a", normal(F.col("expected"))).filter("a <> ''")
    b = read.select("read").distinct().withColumn("b", normal(F.col("read"))).filter("b <> ''")
    n = F.length("a")
    whole = inside(a.select("a").distinct(), b.select("b").distinct())
    how = F.when(F.col("a") == F.col("b"), "equal").when((n >= BEGINS) & F.col("b").startswith(F.col("a")), "begins").when(n >= PART, "part")
    told = whole.withColumn("how", how).filter("how is not null").withColumn("ratio", F.lit(None).cast("double"))
    k = F.floor((1 - RATIO) * (2 * n + _slack(n)) + 1e-9).cast("int") + 1
    pieces = a.select("a").distinct().filter(n >= k).withColumn("k", k).withColumn("size", F.floor(n / F.col("k")).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substring("a", i * F.col("size") + 1, F.when(i < F.col("k") - 1, F.col("size")).otherwise(n)))
    pieces = pieces.select("a", F.explode(F.array_distinct(cut)).alias("piece"))
    met = inside(pieces.select(F.col("piece").alias("a")), b.select("b").distinct()).select(F.col("a").alias("piece"), "b")
    pairs = pieces.join(met, "piece").select("a", "b").distinct().filter(F.abs(n - F.length("b")) <= _slack(n))
    pairs = pairs.join(told.select("a", "b"), ["a", "b"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (0, 1))
            ratios = [2 * sum(i2 - i1 for tag, i1, i2, _, _ in text_steps(s, t) if tag == "equal") / (len(s) + len(t)) for s, t in zip(x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratios, pa.float64())], ["a", "b", "ratio"])

    near = pairs.mapInArrow(run, "a string, b string, ratio double").filter(F.col("ratio") >= RATIO).select("a", "b", F.lit("near").alias("how"), "ratio")
    return told.select("a", "b", "how", "ratio").unionByName(near).join(a, "a").join(b, "b").select("expected", "read", "how", "ratio")
