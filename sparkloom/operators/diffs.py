"""Line differences of pairs of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import compared_lines


def line_diff(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, op, a_line, b_line, a, b, ratio): equal, delete, insert or change of each line, changes pair line by line.

    Null texts have no lines; line numbers start from 0 and are null on the side that has none. ratio is twice the matched
    characters by all of both lines. Rows of equal key and texts count once; a null key is a key.
    """
    given = pairs.select(F.col(key), F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    found = compared_lines(given, key, "_a", "_b")
    matched = 2.0 * F.col("matched") / (F.length("a") + F.length("b"))
    ratio = F.when(F.col("tag") == "equal", 1.0).when(F.col("tag") == "change", F.when(F.length("a") + F.length("b") == 0, 1.0).otherwise(matched)).otherwise(0.0)
    return found.withColumn("ratio", ratio).select(key, F.col("tag").alias("op"), F.col("a_line").cast("int").alias("a_line"), F.col("b_line").cast("int").alias("b_line"), "a", "b", "ratio")
