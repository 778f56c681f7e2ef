"""Operations on ordered rows that keep a state: packing, merging of markers, levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


def packed(rows: DataFrame, key: str, order: str, size: Column, most_items: int, most_size: int) -> DataFrame:
    """(key, order, batch): rows of a key in order, a new batch when one more would pass most_items or most_size; null and negative sizes are 0.

    Where batches begin depends on all rows before, so rows are dealt out by ranges of key and order, and a range says for each of its first
    most_items rows how it would be left if a batch began there. A walk over these summaries, one for each range of a key, gives
    the row at which the first batch of each range begins, and each range its batches by that.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = rows.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("_n"))
    dealt = scratch.written(named.repartitionByRange("_k", "_o").withColumn("_p", F.spark_partition_id()), "ranges")

    def follow(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the sizes before each place, and where the next batch begins after one that begins at each place."""
        total = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(len(n))
        reach = np.searchsorted(total, total[:-1] + most_size, side="right") - 1  # the row that no longer fits
        return total, np.minimum(np.minimum(np.maximum(reach, at + 1), at + most_items), len(n))

    def summary(part: pa.Table) -> pa.Table:
        n = part.sort_by("_o").column("_n").to_numpy()
        total, after = follow(n)
        # from each place: the last batch that begins in the range, and how many begin; twice as far each time
        last, count = np.where(after == len(n), np.arange(len(n)), after), np.where(after == len(n), 0, 1)
        while (last[last] != last).any():
            count = count + count[last]
            last = last[last]
        few = slice(0, min(len(n), most_items))
        cols = {"_len": [len(n)], "_head": [n[few].tolist()], "_items": [(len(n) - last[few]).tolist()], "_held": [(total[-1] - total[last[few]]).tolist()], "_batches": [count[few].tolist()]}
        return pa.table({"_k": part.column("_k").slice(0, 1), "_p": part.column("_p").slice(0, 1)} | {c: pa.array(v, pa.int64() if c == "_len" else pa.list_(pa.int64())) for c, v in cols.items()})

    def walk(part: pa.Table) -> pa.Table:
        part = part.sort_by("_p")
        items = held = batch = 0
        starts, bases = [], []
        for r in part.select(["_len", "_head", "_items", "_held", "_batches"]).to_pylist():
            at = 0
            while at < len(r["_head"]) and items and held + r["_head"][at] <= most_size and items < most_items:
                held, items, at = held + r["_head"][at], items + 1, at + 1
            starts.append(at)
            bases.append(batch + 1 if items else batch)
            if at < r["_len"]:
                batch = bases[-1] + r["_batches"][at]
                items, held = r["_items"][at], r["_held"][at]
        return pa.table({"_k": part.column("_k"), "_p": part.column("_p"), "_start": pa.array(starts, pa.int64()), "_base": pa.array(bases, pa.int64())})

    def numbered(part: pa.Table, entry: pa.Table) -> pa.Table:
        part = part.sort_by("_o")
        _, after = follow(part.column("_n").to_numpy())
        at, batch = entry.column("_start")[0].as_py(), entry.column("_base")[0].as_py()
        new = np.zeros(len(after) + 1, np.int64)
        while at < len(after):
            new[at] = 1
            at = int(after[at])
        return pa.table({"_k": part.column("_k"), "_o": part.column("_o"), "batch": pa.array(batch - 1 + np.cumsum(new)[:-1], pa.int32())})

    kind = f"_k {kinds[key]}, _p int"
    summaries = dealt.groupBy("_k", "_p").applyInArrow(summary, f"{kind}, _len long, _head array<long>, _items array<long>, _held array<long>, _batches array<long>")
    entries = summaries.groupBy("_k").applyInArrow(walk, f"{kind}, _start long, _base long")
    out = dealt.groupBy("_k", "_p").cogroup(entries.groupBy("_k", "_p")).applyInArrow(numbered, f"_k {kinds[key]}, _o {kinds[order]}, batch int")
    return out.select(F.col("_k").alias(key), F.col("_o").alias(order), "batch")


def merge_markers(paragraphs: Column, marker: str = r"^\s*(?:[-*•·]|\d+[.)、]|[(（]?[一二三四五六七八九十]+[)）、.])\s*$") -> Column:
    """An array of paragraphs in which a list marker alone is joined to the paragraph after it."""

    def add(s: Column, p: Column) -> Column:
        held = F.length(s["held"]) > 0
        text = F.when(held, F.concat_ws(" ", s["held"], p)).otherwise(p)
        return F.when(p.rlike(marker), F.struct(F.when(held, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]).alias("out"), F.trim(p).alias("held"))).otherwise(
            F.struct(F.concat(s["out"], F.array(text)).alias("out"), F.lit("").alias("held"))
        )

    end = lambda s: F.when(F.length(s["held"]) > 0, F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])
    return F.aggregate(paragraphs, F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held")), add, end)


def levels(items: Column, pages: Column) -> Column:
    """An array of (title, level, page) in which a level is at most one deeper than the one before and pages are clamped."""

    def add(out: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(out, F.lit(-1))["level"], F.lit(0))
        level = F.greatest(F.lit(1), F.least(x["level"], before + 1))
        return F.concat(out, F.array(F.struct(x["title"].alias("title"), level.alias("level"), F.greatest(F.lit(1), F.least(x["page"], pages)).alias("page"))))

    return F.aggregate(items, F.array().cast("array<struct<title:string,level:int,page:int>>"), add)


def page_ranges(spec: Column, pages: Column) -> Column:
    """Pages of '1-3,5,7-': an array of arrays, open ends run to the last page, what lies outside is cut off."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda p: p.rlike(r"^\d+$|^\d*-\d*$") & (p != "-"))

    def one(p: Column) -> Column:
        low = F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d*)", 1), F.lit("")).cast("int"), F.lit(1))
        high = F.when(p.contains("-"), F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d*)$", 1), F.lit("")).cast("int"), pages)).otherwise(low)
        a, b = F.greatest(low, F.lit(1)), F.least(high, pages)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return F.filter(F.transform(parts, one), lambda r: F.size(r) > 0)
