"""A registry of companies: ingest, lookup, search, facets, upserts and enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FIELDS = ("name", "address", "owner", "org_type", "industries")


def renamed(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str] = ("vat", "name")) -> DataFrame:
    """Canonical columns of a file by the first alias that it has, without regard to case; missing ones are null."""
    have = {c.strip().lower(): c for c in df.columns}
    found = {k: next((have[a.lower()] for a in [k, *names] if a.lower() in have), None) for k, names in aliases.items()}
    if missing := [k for k in required if not found.get(k)]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))


# Headers of an industry's code and of its name.
CODE, NAME = "行業代號", "名稱"


def industry_columns(columns: Sequence[str]) -> list[str]:
    """The columns that name industries: each stands right after its code, and both have the same ending, which may be empty."""
    names = [c.strip().lstrip("\ufeff") for c in columns]
    return [columns[i + 1] for i, c in enumerate(names[:-1]) if c.startswith(CODE) and names[i + 1] == NAME + c[len(CODE) :]]


def valid_records(df: DataFrame, industries: Sequence[str] = ()) -> DataFrame:
    """Rows of an eight-digit vat and a name; the distinct industries joined by ' / '."""
    rows = df.withColumn("vat", F.trim("vat")).withColumn("name", F.trim("name")).filter(F.col("vat").rlike("^[0-9]{8}$") & (F.length("name") > 0))
    if not industries:
        return rows
    kept = F.array_distinct(F.filter(F.array(*(F.trim(c) for c in industries)), lambda x: F.coalesce(F.length(x), F.lit(0)) > 0))
    return rows.withColumn("industries", F.array_join(kept, " / "))


def last_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row of each key, the one read last. Whole rows meet in a partial aggregate, so repeats shrink before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), ordinal).alias("_r")).select("_r.*")


def supplement(base: DataFrame, more: DataFrame, key: str = "vat", category: str = "category") -> DataFrame:
    """base with the rows of more that it lacks; of rows in both, only the category is taken over."""
    a, b = base.alias("a"), more.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    old = F.col(f"a.{key}").isNotNull()

    def column(c: str) -> Column:
        if c == category:
            return F.coalesce(f"b.{c}", f"a.{c}")
        return F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))

    return both.select(*(column(c).alias(c) for c in base.columns))


def contains_all(query: str, fields: Sequence[str] = FIELDS) -> Column:
    """Whether every keyword of a query is in one of the fields; spelling variants are one."""
    words = query.replace("臺", "台").lower().split()
    text = lambda f: F.lower(T.variants(F.coalesce(F.col(f).cast("string"), F.lit(""))))
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (text(f).contains(w) for f in fields)) for w in words), F.lit(bool(words)))


def faceted(rows: DataFrame, categories: Sequence[str] = (), org_type: str | None = None, city: str | None = None, industry: str | None = None) -> DataFrame:
    """Rows under the filters that are set."""
    if categories:
        rows = rows.filter(F.col("category").isin(list(categories)))
    if org_type is not None:
        rows = rows.filter(F.col("org_type") == org_type)
    if city is not None:
        rows = rows.filter(T.variants(F.col("address")).startswith(city.replace("臺", "台")))
    if industry is not None:
        rows = rows.filter(F.col("industries").contains(industry))
    return rows


def search(registry: DataFrame, query: str, fields: Sequence[str] = FIELDS, limit: int = 50, **filters) -> DataFrame:
    """The first hits by name, then key: a top-k report."""
    return faceted(registry, **filters).filter(contains_all(query, fields)).orderBy("name", "vat").limit(max(1, min(limit, 500)))


def top_values(rows: DataFrame, column: Column | str, n: int = 8, other: str = "(none)") -> DataFrame:
    """(value, count) of the n most frequent values, exact, ties by value."""
    value = F.coalesce(F.nullif(F.trim(F.col(column) if isinstance(column, str) else column), F.lit("")), F.lit(other))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n)


def facets(rows: DataFrame, columns: Sequence[str], n: int = 8) -> DataFrame:
    """(facet, value, count): top_values of several columns in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("(none)")).alias("value")) for c in columns)))
    counts = rows.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value"))
    return counts.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def city_of(address: Column) -> Column:
    """A city is up to three characters and 縣 or 市, else 其他."""
    found = F.regexp_extract(F.coalesce(address, F.lit("")), r"^\s*(.{1,3}?[縣市])", 1)
    return F.when(found == "", "其他").otherwise(T.variants(found))


def category_counts(registry: DataFrame, order: Sequence[str] = (), none: str = "未分類") -> DataFrame:
    """(category, count, place): fixed categories first in their order, the others by count."""
    counts = registry.groupBy(F.coalesce("category", F.lit(none)).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    fixed = F.array_position(F.array(*map(F.lit, order)), F.col("category")) if order else F.lit(0)
    w = Window.orderBy(F.when(fixed == 0, 1 << 30).otherwise(fixed), F.desc("count"), "category")  # a row for each category
    return counts.withColumn("place", F.row_number().over(w).cast("long"))


def batch_lookup(keys: DataFrame, registry: DataFrame, key: str = "vat") -> DataFrame:
    """Every key with its registry row and a status: ok, not 8 digits, or unknown."""
    good = F.trim(F.col(key))
    asked = keys.withColumn("_k", F.when(good.rlike("^[0-9]{8}$"), good))
    found = asked.join(registry.withColumnRenamed(key, "_rk"), F.col("_k") == F.col("_rk"), "left")
    status = F.when(F.col("_k").isNull(), "not 8 digits").when(F.col("_rk").isNull(), "unknown").otherwise("ok")
    return found.withColumn("status", status).drop("_k", "_rk")


def append_new(held: DataFrame, batch: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame:
    """held and the first row of each key of batch that it lacks, the newest `most` of all (None: all)."""
    fresh = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*").join(held, key, "left_anti")
    both = held.unionByName(fresh.select(held.columns))
    return both.orderBy(F.desc(order), key).limit(most) if most else both


def cascade(rules: Sequence[tuple[str, Sequence[str]]], columns: Sequence[str], default: str | None = None) -> tuple[Column, Column]:
    """(result, source) of rules (result, keywords): columns in turn, for each the first rule of which a keyword occurs."""
    result = source = None
    for c in columns:
        for name, words in rules:
            hit = reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w.lower()) for w in words))
            result = F.when(hit, name) if result is None else result.when(hit, name)
            source = F.when(hit, c) if source is None else source.when(hit, c)
    if result is None:
        return F.lit(default), F.lit(None).cast("string")
    return result.otherwise(F.lit(default)), source


def enrich(rows: DataFrame, registry: DataFrame, key: str, rules: Sequence[tuple[str, Sequence[str]]], by: Sequence[str] = ("industries", "name")) -> DataFrame:
    """rows with the registry's columns of their key and the rule that classifies them; unknown keys keep nulls."""
    found = rows.join(registry.withColumnRenamed("vat", "_vat"), F.col(key) == F.col("_vat"), "left")
    subject, source = cascade(rules, by)
    return found.withColumn("subject", subject).withColumn("subject_source", source).drop("_vat")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of a name: words, and each CJK character and kana for itself; spelling variants are one."""
    return F.array_remove(F.array_distinct(F.split(T.tokenised(F.lower(T.variants(F.coalesce(text, F.lit(""))))), " ")), "")


def token_search(questions: DataFrame, rows: DataFrame, question: str, key: str, name: str) -> DataFrame:
    """(question, key): rows whose name has every token of a question (question, query), as whole tokens.

    The index (token, key) is met under the rarest token of each question alone, so a token that all names share deals
    out nothing; the other tokens are looked up in the row that was found.
    """
    named = rows.select(key, tokens(F.col(name)).alias("_have"))
    index = named.select(key, "_have", F.explode("_have").alias("_token"))
    counts = index.groupBy("_token").agg(F.count(F.lit(1)).alias("_n"))
    asked = questions.select(question, tokens(F.col("query")).alias("_want")).select(question, "_want", F.explode("_want").alias("_token"))
    first = asked.join(counts, "_token", "left").groupBy(question, "_want").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token"))).alias("_first"))
    met = first.select(question, "_want", F.col("_first.token").alias("_token")).join(index, "_token")
    return met.filter(F.size(F.array_except("_want", "_have")) == 0).select(question, key).distinct()
