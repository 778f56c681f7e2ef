"""Names that contain one another, and rules over the entities of a case's files, as rows of one schema of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import labels as L
from . import reconcile

#: Longest piece under which names meet.
GRAM = 3


def bare(s: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", "")


def _grams(s: Column, size: Column | int) -> Column:
    """The distinct pieces of so many characters."""
    at = F.sequence(F.lit(1), F.length(s) - size + 1)
    return F.when(F.length(s) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(s, i, F.lit(size) if isinstance(size, int) else size)))).otherwise(F.array().cast("array<string>"))


def inside(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """(a, b): each a of shorter that is a part of a b of longer (columns a and b, texts without white space).

    Every a is filed under that one of its pieces of GRAM characters (of its whole length, if it is shorter) that fewest
    texts of longer have; a piece that all have deals out nothing unless all pieces of an a are such. Equal texts count.
    """
    small = shorter.select("a").filter("a <> ''").distinct().withColumn("size", F.least(F.length("a"), F.lit(GRAM)))
    pieces = small.select("a", "size", F.explode(_grams(F.col("a"), F.col("size"))).alias("g"))
    sizes = F.array(*map(F.lit, range(1, GRAM + 1)))
    whole = longer.select("b").filter("b <> ''").distinct()
    asked = whole.select("b", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("b"), n)))).alias("g"))
    asked = asked.join(pieces.select("g").distinct(), "g", "left_semi")
    counts = asked.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # a piece that no text has settles that its a is in none
    rare = pieces.join(counts, "g", "left").groupBy("a").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).filter("r.n > 0")
    return rare.select("a", F.col("r.g").alias("g")).join(asked, "g").filter(F.col("b").contains(F.col("a"))).select("a", "b")


def contained(values: DataFrame, names: DataFrame) -> DataFrame:
    """(value, name): pairs of a value and a known name of which one contains the other, white space apart; null and blank ones have none."""
    v, n = values.select("value").distinct().withColumn("_v", bare(F.col("value"))), names.select("name").distinct().withColumn("_n", bare(F.col("name")))
    in_names = inside(v.select(F.col("_v").alias("a")), n.select(F.col("_n").alias("b"))).select(F.col("a").alias("_v"), F.col("b").alias("_n"))
    in_values = inside(n.select(F.col("_n").alias("a")), v.select(F.col("_v").alias("b"))).select(F.col("b").alias("_v"), F.col("a").alias("_n"))
    return in_names.unionByName(in_values).distinct().join(v, "_v").join(n, "_n").select("value", "name")


def own_entities(values: DataFrame, entities: DataFrame) -> DataFrame:
    """(value, entity): the first of our own entities (entity, place, name; a row for each name) that a value contains or is contained in."""
    hit = contained(values, entities).join(entities.select("name", "entity", "place").distinct(), "name")
    return hit.groupBy("value").agg(F.min(F.struct("place", "entity"))["entity"].alias("entity"))


def own_typing_errors(values: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """reconcile.typing_errors of the values that neither contain a name nor are contained in one: these are no errors."""
    return reconcile.typing_errors(values.join(contained(values, names), "value", "left_anti"), names, most)


_SCHEMA = ("case", "layer", "severity", "category", "value", "expected", "n", "n_files", "key")


def findings(entities: DataFrame, truth: DataFrame, own: DataFrame) -> DataFrame:
    """(case, layer, severity, category, value, expected, n, n_files, key) of what does not fit together in the files of a case.

    entities: (case, file, kind, value, n) as of reconcile.entities, values without white space. truth: what is known of a case (case,
    main, identifier, counterparty, case_number), a row at most for each; own: our names and numbers (name, tax_id).

    * identity-mismatch, where the main name is known: organisations that neither contain nor are contained in it, the
      counterparty or one of our own; authorities only where no counterparty is known.
    * identity-outlier, where it is not: companies and legal persons besides the most frequent one (of equals a company, then the smaller
      name) that are in at most half as many files, or in one where that is in two or more.
    * tax-id-mismatch, where the number is known (eight digits): any other. tax-id-multiple, where it is not and there are several numbers: those that
      pass the check and are not our own, if there are two or more. tax-id-invalid: numbers that fail it, a warning where
      they occur once or twice in one file.
    * case-num-other, where the case's number is known: any other.

    key is labels.finding_key. Null values are left out; a case without rows in truth is one of which nothing is known.
    """
    seen = entities.filter("value is not null").groupBy("case", "kind", "value").agg(F.sum("n").alias("n"), F.count_distinct("file").alias("n_files"))
    known = truth.select("case", *(F.nullif(bare(F.col(c)), F.lit("")).alias(c) for c in ("main", "identifier", "counterparty", "case_number")))
    rows = seen.join(known, "case", "left")
    names = own.select(F.col("name")).filter(bare(F.col("name")) != "")
    org = rows.filter(F.col("kind").isin("company", "legal_person", "school", "government"))
    ours = contained(org.select("value").distinct(), names).select("value").distinct()
    either = lambda a, b: F.coalesce(a.contains(b) | b.contains(a), F.lit(False))
    value = F.col("value")

    def told(df: DataFrame, layer: str, severity: Column | str, category: str, expected: Column, evidence: str) -> DataFrame:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        key = L.finding_key(F.lit(category), F.create_map(F.lit(evidence), value), value, F.lit(None).cast("int"))
        return df.select("case", F.lit(layer).alias("layer"), severity.alias("severity"), F.lit(category).alias("category"), value.alias("value"), expected.alias("expected"), "n", "n_files", key.alias("key"))

    strangers = org.filter(F.col("main").isNotNull() & ((F.col("kind") != "government") | F.col("counterparty").isNull()) & ~either(value, F.col("main")) & ~either(value, F.col("counterparty")))
    out = told(strangers.join(ours, "value", "left_anti"), "L2", "warn", "identity-mismatch", F.col("main"), "actual")

    candidates = rows.filter(F.col("main").isNull() & F.col("kind").isin("company", "legal_person"))
    first = candidates.groupBy("case").agg(F.min(F.struct((-F.col("n")).alias("m"), "kind", "value", F.col("n_files").alias("f"))).alias("t"))
    others = candidates.join(first, "case").filter((F.col("kind") != F.col("t.kind")) | (value != F.col("t.value")))
    rare = others.filter((F.col("n_files") <= F.floor(F.col("t.f") / 2)) | ((F.col("t.f") >= 2) & (F.col("n_files") == 1)))
    out = out.unionByName(told(rare, "L2", "warn", "identity-outlier", F.col("t.value"), "outlier"))

    ids = rows.filter("kind = 'tax_id'").withColumn("good", C.tw_business(value))
    has = F.coalesce(F.col("identifier").rlike("^[0-9]{8}$"), F.lit(False))
    out = out.unionByName(told(ids.filter(has & (value != F.col("identifier"))), "L1", "warn", "tax-id-mismatch", F.col("identifier"), "actual"))
    numbers = own.select(bare(F.col("tax_id")).alias("value")).distinct()
    foreign = ids.filter(~has & F.col("good")).join(numbers, "value", "left_anti")
    foreign = foreign.groupBy("case").agg(F.count(F.lit(1)).alias("m"), F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("value"), F.sum("n").alias("n")).filter("m >= 2")  # the numbers of one case
    files = entities.filter("kind = 'tax_id'").join(ids.filter(~has & F.col("good")).join(numbers, "value", "left_anti").select("case", "value"), ["case", "value"]).groupBy("case").agg(F.count_distinct("file").alias("n_files"))
    out = out.unionByName(told(foreign.join(files, "case"), "L1", "warn", "tax-id-multiple", F.lit(None).cast("string"), "non_self_tax_ids"))
    steady = (F.col("n_files") >= 2) | (F.col("n") >= 3)
    out = out.unionByName(told(ids.filter(~F.col("good")), "L1", F.when(steady, "info").otherwise("warn"), "tax-id-invalid", F.lit(None).cast("string"), "tax_id"))
    return out.unionByName(told(rows.filter(F.col("case_number").isNotNull() & (F.col("kind") == "case_number") & (value != F.col("case_number"))), "L2", "info", "case-num-other", F.col("case_number"), "actual"))


def counts(found: DataFrame) -> DataFrame:
    """(case, category, severity, n) of findings."""
    return found.groupBy("case", "category", "severity").agg(F.count(F.lit(1)).alias("n"))
