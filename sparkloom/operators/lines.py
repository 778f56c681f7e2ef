"""Ordered lists of lines: eleven operations and their composition.

A list is a set of rows (keys..., pos, line); keys name the list (none: the whole table is one list) and pos orders it.
Operations keep pos as a sort key, not as a dense number. Grouped lists are numbered inside their keys; one list of a whole
table is cut by TakeOrdered and range sorts, so no operation gathers it in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line) of every document."""
    return docs.select(F.col(id_col), F.posexplode(T.split_lines(F.col(text_col))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def trim(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("line", T.strip(F.col("line")))


def drop_empty(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.filter(~T.blank(F.col("line")))


def dedup(rows: DataFrame, keys: Sequence[str] = (), keep: str = "first", case_insensitive: bool = False) -> DataFrame:
    """One row of each distinct line: the first, the last, or the first as 'count<tab>line'."""
    key = F.lower("line") if case_insensitive else F.col("line")
    grouped = rows.groupBy(*keys, key.alias("_key"))
    if keep == "last":
        return grouped.agg(F.max_by("line", "pos").alias("line"), F.max("pos").alias("pos")).select(*keys, "pos", "line")
    n = F.count(F.lit(1)).alias("_n")
    out = grouped.agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos"), n)
    line = F.concat_ws("\t", F.col("_n").cast("string"), "line") if keep == "count" else F.col("line")
    return out.select(*keys, "pos", line.alias("line"))


def sort(rows: DataFrame, keys: Sequence[str] = (), order: str = "asc", natural: bool = False, case_insensitive: bool = False) -> DataFrame:
    """Sorted by code point, without case or naturally; equal keys keep their order in either direction."""
    key = T.natural_key(F.col("line")) if natural else F.lower("line") if case_insensitive else F.col("line")
    return _numbered(rows, keys, [key.desc() if order == "desc" else key.asc(), F.col("pos").asc()])


def _numbered(rows: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """pos anew in this order. A list without keys is sorted by ranges and numbered from the sizes of its partitions."""
    if keys:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    return rows.orderBy(*order).withColumn("pos", F.monotonically_increasing_id())


def reverse(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("pos", -F.col("pos"))


def shuffle(rows: DataFrame, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """An order that only the seed and the positions decide."""
    return rows.withColumn("pos", F.xxhash64(F.lit(seed), "pos"))


def case(rows: DataFrame, keys: Sequence[str] = (), mode: str = "lower") -> DataFrame:
    how = {"lower": F.lower, "upper": F.upper, "title": T.title_case}.get(mode)
    return rows.withColumn("line", how(F.col("line"))) if how else rows


def filter_lines(rows: DataFrame, keys: Sequence[str] = (), pattern: str = "", mode: str = "include", regex: bool = False, case_insensitive: bool = False) -> DataFrame:
    """Rows whose line holds the pattern, or those that do not; an empty pattern keeps all, a bad regex is an error."""
    if not pattern:
        return rows
    if regex:
        re.compile(pattern)
        hit = F.col("line").rlike(("(?i)" if case_insensitive else "") + pattern)
    else:
        hit = F.lower("line").contains(pattern.lower()) if case_insensitive else F.col("line").contains(pattern)
    return rows.filter(~hit if mode == "exclude" else hit)


def _cut(rows: DataFrame, keys: Sequence[str], n: int, order: Column) -> DataFrame:
    if int(n) < 0:
        raise ValueError("n must not be negative")
    if not keys:
        return rows.orderBy(order).limit(int(n))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= int(n)).drop("_n")


def head(rows: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    return _cut(rows, keys, n, F.col("pos").asc())


def tail(rows: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    return _cut(rows, keys, n, F.col("pos").desc())


def wrap(rows: DataFrame, keys: Sequence[str] = (), prefix: str = "", suffix: str = "") -> DataFrame:
    return rows.withColumn("line", F.concat(F.lit(prefix), "line", F.lit(suffix)))


OPS: dict[str, Callable[..., DataFrame]] = {
    "trim": trim, "drop_empty": drop_empty, "dedup": dedup, "sort": sort, "reverse": reverse, "shuffle": shuffle, "case": case, "filter": filter_lines, "head": head, "tail": tail, "wrap": wrap,
}


def pipeline(rows: DataFrame, ops: Sequence[object], keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The rows after a list of {op, parameters}, and the names of the applied ones; unknown operations are skipped."""
    applied = []
    for spec in ops:
        if isinstance(spec, dict) and spec.get("op") in OPS:
            rows = OPS[spec["op"]](rows, keys, **{k: v for k, v in spec.items() if k != "op"})
            applied.append(spec["op"])
    return rows, applied
