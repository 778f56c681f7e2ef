"""Consistency across documents: entities, duplicates, amounts, outliers, typing errors, overrides and scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as an entity of each kind, and the lengths that it may have.
ENTITIES = {
    "company": (r"([A-Za-z0-9一-鿿·]+?(?:股份有限公司|有限公司|企業社|商號|行號|工作室|事務所|診所|醫院|診療所))", 4, 40),
    "government": (r"([一-鿿]{2,8}?(?:部|處|局|署|委員會|廳|院|公所|縣政府|市政府|衛生所))", 3, 20),
    "school": (r"([一-鿿]{2,15}?(?:大學|學院|高中|高級中學|國中|國民中學|國小|國民小學|附小|附中))", 4, 30),
    "legal_person": (r"((?:財團法人|社團法人)[一-鿿]{2,15})", 6, 30),
    "tax_id": (r"\b(\d{8})\b", 8, 8),
    "case_number": (r"\b([A-Z]{2,5}-?\d{2,4}-?\d{2,8})\b", 0, 99),
    "date": (r"\b(20\d{2}[-/.年]\s*\d{1,2}[-/.月]\s*\d{1,2}|\d{1,3}[年]\s*\d{1,2}[月]\s*\d{1,2}[日])", 0, 99),
}


def entities(docs: DataFrame, kinds: Mapping[str, tuple[str, int, int]] = ENTITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, value, n): entities of each document, white space left out."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(v, r"\s+", "").alias("value")))

    every = F.flatten(F.array(*(found(k, p) for k, (p, _, _) in kinds.items())))
    rows = docs.select(id_col, F.explode(every).alias("e")).select(id_col, "e.kind", "e.value")
    keep = F.lit(False)
    for k, (_, low, high) in kinds.items():
        keep = keep | ((F.col("kind") == k) & F.length("value").between(low, high))
    return rows.filter(keep).groupBy(id_col, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def across(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(kind, value, total, documents) over all documents."""
    return found.groupBy("kind", "value").agg(F.sum("n").alias("total"), F.count_distinct(id_col).alias("documents"))


def duplicates(docs: DataFrame, content: Column, id_col: str = "doc_id") -> DataFrame:
    """(sha, n, first) of the contents that several rows have."""
    return docs.groupBy(F.sha2(content, 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")).filter("n > 1")


def digit_shifts(amounts: DataFrame, doc: str, amount: str, factors: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """(amount, other, factor): amounts of different documents that are a power of ten apart, each pair of values once.

    The multiples are joined to the amounts by equality, so no two amounts are compared that do not match. Of an amount
    only its least and greatest document are needed to tell whether two documents differ.
    """
    values = amounts.groupBy(F.col(amount).alias("amount")).agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"))
    wanted = values.select("amount", "lo", "hi", F.explode(F.array(*map(F.lit, factors))).alias("factor")).withColumn("other", F.col("amount") * F.col("factor"))
    right = values.select(F.col("amount").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = wanted.join(right, "other")
    return pairs.filter((F.col("lo") != F.col("lo2")) | (F.col("hi") != F.col("hi2")) | (F.col("lo") != F.col("hi"))).select("amount", "other", "factor")


def outliers(counts: DataFrame, group: str, value: str, n: str) -> DataFrame:
    """(group, value, n, top): values of a group that are not its most frequent one."""
    top = counts.groupBy(group).agg(F.max_by(F.struct(F.col(n), F.col(value)), F.struct(F.col(n), F.col(value))).alias("_t"))
    return counts.join(top, group).filter(F.col(value) != F.col(f"_t.{value}")).select(group, value, n, F.col(f"_t.{value}").alias("top"))


def typing_errors(values: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(value, name, distance): the nearest known name within most edits and under four tenths of the shorter length.

    A value within most edits of a name has a length within most of it and shares one of most + 1 pieces of the name in
    about its place, so values and names meet on (piece, place) and not each with each.
    """
    n = most + 1

    def cut(s: Column, i: int) -> Column:
        size = F.floor(F.length(s) / n).cast("int")
        return F.substring(s, F.lit(i) * size + 1, size if i < n - 1 else F.length(s) - i * size)

    pieces = F.explode(F.array(*(F.struct(cut(F.col("name"), i).alias("piece"), (F.lit(i) * F.floor(F.length("name") / n)).cast("int").alias("at"), F.length("name").alias("n")) for i in range(n))))
    left = names.select("name", pieces.alias("p")).select("name", "p.*").filter("length(piece) > 0").distinct()
    shapes = left.select(F.length("piece").alias("size"), "at", "n").distinct()
    shapes = shapes.withColumn("_n", F.explode(F.sequence(F.col("n") - most, F.col("n") + most)))
    near = values.select("value", F.length("value").alias("_n")).distinct().join(shapes, "_n")
    cand = near.select("value", "n", "at", F.explode(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.substring("value", F.greatest(F.col("at") + d, F.lit(0)) + 1, F.col("size")))).alias("piece")).distinct()
    pairs = cand.join(left, ["piece", "at", "n"]).select("value", "name").distinct()
    d = F.levenshtein("value", "name")
    good = pairs.withColumn("distance", d).filter(F.col("distance").between(1, most) & (F.col("distance") < 0.4 * F.least(F.length("value"), F.length("name"))) & (F.length("value") >= 4))
    return good.groupBy("value").agg(F.min(F.struct("distance", "name")).alias("b")).select("value", "b.name", "b.distance")


def overridden(findings: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """Findings, those of which the key is overridden with severity info."""
    marks = overrides.select(key).distinct().withColumn("_o", F.lit(True))
    return findings.join(marks, key, "left").withColumn("severity", F.when(F.col("_o"), "info").otherwise(F.col("severity"))).drop("_o")


def scores(findings: DataFrame, case: str) -> DataFrame:
    """(case, fail, warn, info, score): ten points off for a failure, three for a warning, never under zero."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("fail", "warn", "info")}
    out = findings.groupBy(case).agg(*(c.alias(s) for s, c in n.items()))
    return out.withColumn("score", F.greatest(F.lit(0).cast("long"), 100 - 10 * F.col("fail") - 3 * F.col("warn")))


def keyed_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after) of the keys whose values differ, or that only one side has."""
    both = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key, "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def nearest_right(cells: DataFrame, gap: float = 300.0, line: float = 24.0) -> DataFrame:
    """(page, id, other): for each cell (page, id, x, y, width, height) the nearest one that begins to its right within a gap.

    Two cells are on a line if their y differ by less than half the left one's height, which is at most 2 * line. Cells
    meet by equality of page, band of y and column of x, and only with neighbours of these.
    """
    band, column = F.floor(F.col("y") / line), F.floor(F.col("x") / gap)
    right = cells.select("page", F.col("id").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"), band.alias("_band"), column.alias("_column"))
    end = F.col("x") + F.col("width")
    left = cells.withColumn("_end", end).withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
    left = left.withColumn("_column", F.explode(F.sequence(F.floor(F.col("_end") / gap), F.floor(F.col("_end") / gap) + 1)))
    pairs = left.join(right, ["page", "_band", "_column"]).filter((F.col("_x") >= F.col("_end")) & (F.col("_x") - F.col("_end") <= gap) & (2 * F.abs(F.col("y") - F.col("_y")) < F.col("height")))
    return pairs.groupBy("page", "id").agg(F.min(F.struct("_x", "other"))["other"].alias("other"))
