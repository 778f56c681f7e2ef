"""Codes of a scan that belong together, edits of held records, cursors, and hints for findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import invoices as I


def zipped(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the codes (batch, pos, code) of scans: (batch, nth, invoice_number, items), and (batch, invoices, lists, unknown, samples).

    The i-th invoice of a batch goes with the i-th list of items; lists beyond the invoices have no invoice_number, invoices beyond the lists no items. samples
    has the first three codes that are neither, 200 characters of each. Null codes are unknown and give '(empty)', as do empty ones.
    """
    number, items = I.qr_fields(F.col("code"))["invoice_number"], I.qr_items(F.col("code"))
    told = codes.withColumn("invoice_number", number).withColumn("items", items)
    sort = F.when(F.col("invoice_number").isNotNull(), "invoice").when(F.col("items").isNotNull(), "list").otherwise("unknown")
    told = told.withColumn("sort", sort).withColumn("nth", F.row_number().over(Window.partitionBy("batch", "sort").orderBy("pos")))
    left, right = told.filter("sort = 'invoice'").select("batch", "nth", "invoice_number"), told.filter("sort = 'list'").select("batch", "nth", "items")
    n = lambda s: F.count_if(F.col("sort") == s)
    sample = F.when((F.col("sort") == "unknown") & (F.col("nth") <= 3), F.struct("nth", F.coalesce(F.nullif(F.left("code", F.lit(200)), F.lit("")), F.lit("(empty)")).alias("s")))
    stats = told.groupBy("batch").agg(n("invoice").alias("invoices"), n("list").alias("lists"), n("unknown").alias("unknown"), F.transform(F.array_sort(F.collect_list(sample)), lambda x: x["s"]).alias("samples"))  # three of a batch
    return left.join(right, ["batch", "nth"], "full"), stats


def attached(held: DataFrame, items: DataFrame) -> DataFrame:
    """held (user, id, added, scanned_at, items) with the items (user, pos, item) of each user put to the latest record.

    The latest has the greatest scanned_at (null is least), of equal ones the one added last. What it has stays in front, what is new follows in order, each
    once. Users without a record get none; users without items keep what they have.
    """
    latest = held.groupBy("user").agg(F.max_by("id", F.struct(F.coalesce(F.col("scanned_at").cast("string"), F.lit("")), "added")).alias("id"))
    more = items.filter("item is not null").groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("_more"))  # the items of one scan
    out = held.join(latest.join(more, "user"), ["user", "id"], "left")
    return out.withColumn("items", F.when(F.col("_more").isNull(), F.col("items")).otherwise(F.array_distinct(F.concat(F.coalesce("items", F.array().cast("array<string>")), "_more")))).select(held.columns)


def updated(rows: DataFrame, changes: DataFrame, editable: Sequence[str] = ("note",), key: str = "id") -> DataFrame:
    """rows with the changes (key, field, value, at) to their editable fields; of several to one field the last (at) counts, others are refused."""
    fields = [f for f in editable if f in rows.columns]
    if not fields:
        return rows
    last = changes.filter(F.col("field").isin(fields)).groupBy(key, "field").agg(F.max_by(F.struct("value"), "at").alias("v"))
    wide = last.groupBy(key).agg(*(F.first(F.when(F.col("field") == f, F.col("v")), ignorenulls=True).alias(f"_{f}") for f in fields))
    out = rows.join(wide, key, "left")
    return out.select(*(F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def results_from(results: DataFrame, cursors: DataFrame, job: str = "job") -> DataFrame:
    """(job, start, total, pos, ...): results (job, pos from 0, ...) from each job's cursor (job, start) on; start is held between 0 and total.

    A job with nothing new, or nothing at all, has one row without pos.
    """
    totals = results.groupBy(job).agg(F.count(F.lit(1)).alias("total"))
    asked = cursors.join(totals, job, "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    asked = asked.select(job, F.greatest(F.lit(0).cast("long"), F.least(F.coalesce("start", F.lit(0)).cast("long"), F.col("total"))).alias("start"), "total")
    rows = results.withColumnRenamed(job, "_j")
    return asked.join(rows, (F.col(job) == F.col("_j")) & (F.col("pos") >= F.col("start")), "left").drop("_j")


def with_hints(findings: DataFrame, hints: Mapping[str, tuple[str, str]]) -> DataFrame:
    """findings with what helps against their category: (tool, hint), empty where there is none."""
    pairs = [x for k, (tool, hint) in hints.items() for x in (F.lit(k), F.struct(F.lit(tool).alias("tool"), F.lit(hint).alias("hint")))]
    found = F.try_element_at(F.create_map(*pairs), F.coalesce("category", F.lit(""))) if pairs else F.lit(None).cast("struct<tool:string,hint:string>")
    return findings.withColumn("_h", found).select(*findings.columns, F.coalesce("_h.tool", F.lit("")).alias("tool"), F.coalesce("_h.hint", F.lit("")).alias("hint"))


def in_json(value: Column, chosen: Column) -> Column:
    """Whether a value is in a JSON list of texts; a list that is null, empty or no list chooses everything."""
    listed = F.from_json(chosen, "array<string>")
    return F.when(F.coalesce(F.size(listed), F.lit(-1)) <= 0, True).otherwise(F.coalesce(F.array_contains(listed, value), F.lit(False)))
