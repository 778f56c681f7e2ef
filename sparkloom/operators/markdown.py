"""Chinese list markers of lines as Markdown numbers, outside of fenced code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

#: Lines of a text that one task counts together; the counts of its runs of lines are added up before.
RUN = 4096
# Numerals, and the three forms of a marker.
_NUMERAL = "[一二三四五六七八九十百千零]+"
_TOP, _NESTED, _WIDE = rf"^({_NUMERAL})、\s*(.*)$", rf"^[（(]\s*({_NUMERAL})\s*[)）]\s*(.*)$", r"^([０-９])\s*[.、]\s*(.*)$"
#: The greatest number that is taken for a marker.
MOST = 200
INDENT = 3


def marker(line: Column) -> Column:
    """A line with its marker as a Markdown number: top ones and full-width digits keep the indent, nested ones have INDENT blanks at least."""
    rest = F.regexp_replace(line, r"(?U)^\s+", "")
    indent = F.length(line) - F.length(rest)
    part = lambda p, i: F.regexp_extract(rest, "(?dsU)" + p, i)
    numbered = lambda blanks, n, text: F.concat(F.repeat(F.lit(" "), blanks), n.cast("string"), F.lit(". "), text)
    top, nested = L.chinese_int(part(_TOP, 1)), L.chinese_int(part(_NESTED, 1))
    wide = F.translate(part(_WIDE, 1), "０１２３４５６７８９", "0123456789")
    out = F.when(wide != "", numbered(indent, wide, part(_WIDE, 2)))
    return out.when(top.between(1, MOST), numbered(indent, top, part(_TOP, 2))).when(nested.between(1, MOST), numbered(F.greatest(indent, F.lit(INDENT)), nested, part(_NESTED, 2))).otherwise(line)


def converted(lines: DataFrame, key: str, at: str = "at", line: str = "line") -> DataFrame:
    """lines (key, at, line) with the column markdown; at counts from 0 without gaps in each text.

    Lines between fences stay, and so do fences: a line is inside if an odd number of fences stands before it. These are counted in runs
    of RUN lines, so that a text of any length is shared by many tasks. Null lines stay null and are no fences.
    """
    fence = F.coalesce(F.regexp_replace(line, r"(?U)^\s+", "").startswith("```"), F.lit(False))
    given = lines.withColumn("_fence", fence.cast("int")).withColumn("_run", F.floor(F.col(at) / RUN))
    runs = given.groupBy(key, "_run").agg(F.sum("_fence").alias("_n"))
    before = runs.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for RUN lines
    inside = F.coalesce(F.sum("_fence").over(Window.partitionBy(key, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_before")
    out = given.join(before, [key, "_run"]).withColumn("_inside", inside)
    stays = (F.col("_fence") == 1) | (F.col("_inside") % 2 == 1)
    return out.select(*lines.columns, F.when(stays, F.col(line)).otherwise(marker(F.col(line))).alias("markdown"))
