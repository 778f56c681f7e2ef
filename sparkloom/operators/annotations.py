"""Annotations of documents and glossaries: filters, summaries, groups, lists of tasks; terms that are protected."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSIGNED = "(unsigned)"


def _author() -> Column:
    return F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit(UNSIGNED))


def chosen(annots: DataFrame, kinds: Sequence[str] = (), authors: Sequence[str] = ()) -> DataFrame:
    """Annotations of these kinds and authors (none: all); an empty author goes by UNSIGNED."""
    if kinds:
        annots = annots.filter(F.col("kind").isin(list(kinds)))
    return annots.filter(_author().isin([a or UNSIGNED for a in authors])) if authors else annots


def stripped(annots: DataFrame, kinds: Sequence[str] = (), authors: Sequence[str] = ()) -> DataFrame:
    """What is left once annotations of these kinds or authors go; all go if neither is given."""
    gone = F.lit(not kinds and not authors)
    gone = gone | F.col("kind").isin(list(kinds)) if kinds else gone
    gone = gone | _author().isin([a or UNSIGNED for a in authors]) if authors else gone
    return annots.filter(~F.coalesce(gone, F.lit(False)))


def summary(annots: DataFrame) -> DataFrame:
    """(doc, facet, value, n): counts by kind and author, and under pages the number of pages that have any."""
    facets = F.array(F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value")), F.struct(F.lit("author").alias("facet"), _author().alias("value")))
    counts = annots.select("doc", F.explode(facets).alias("f")).groupBy("doc", "f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
    pages = annots.groupBy("doc").agg(F.count_distinct("page").alias("n")).select("doc", F.lit("pages").alias("facet"), F.lit("").alias("value"), "n")
    return counts.unionByName(pages)


def grouped(annots: DataFrame, by: str, part: int = 1000) -> DataFrame:
    """(doc, key, nth, n, items): notes of a document under each value of by, in order of page and id.

    A long list comes in parts (nth) of about `part` pages, so that no task holds a list that grows without bound.
    """
    key = _author() if by == "author" else F.col(by).cast("string")
    rows = annots.select("doc", key.alias("key"), F.floor(F.col("page") / part).alias("nth"), F.struct("page", "id", "note").alias("i"))
    listed = rows.groupBy("doc", "key", "nth").agg(F.sort_array(F.collect_list("i")).alias("items"))
    return listed.select("doc", "key", "nth", F.size("items").alias("n"), F.transform("items", lambda x: x["note"]).alias("items"))


def tasks(annots: DataFrame) -> DataFrame:
    """(doc, page, id, line): an open task in Markdown for each annotation."""
    return annots.select("doc", "page", "id", F.concat(F.lit("- [ ] p."), F.col("page"), F.lit(" "), _author(), F.lit(": "), F.regexp_replace(F.coalesce("note", F.lit("")), r"\s+", " ")).alias("line"))


def bounded(term: str) -> str:
    """Pattern of a term: with word edges where it begins or ends with an ASCII letter or digit."""
    edge = lambda c: bool(re.match("[A-Za-z0-9]", c))
    return ("(?<![A-Za-z0-9])" if edge(term[0]) else "") + re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII) + ("(?![A-Za-z0-9])" if edge(term[-1]) else "")


def alternation(terms: Sequence[str]) -> str:
    """One pattern of all terms of a glossary, the longest first, without regard to case."""
    return "(?i)(?:" + "|".join(bounded(t) for t in sorted(set(filter(None, terms)), key=lambda t: (-len(t), t))) + ")"


def terms_found(texts: DataFrame, terms: Sequence[str], id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, n): terms of a glossary in each text; overlapping terms count for the longest."""
    hits = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(alternation(terms)), F.lit(0)))
    return texts.select(id_col, hits.alias("term")).select(id_col, F.lower("term").alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


def protected(text: Column, terms: Sequence[str]) -> tuple[Column, Column]:
    """(text with terms as ⟪1⟫, ⟪2⟫ ..., the terms in that order); a text that has such marks itself stays as it is."""
    free = ~text.rlike("⟪\\d+⟫")
    hits = F.when(free, F.regexp_extract_all(text, F.lit(alternation(terms)), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.split(text, alternation(terms), -1)
    numbered = F.array_join(F.transform(between, lambda part, i: F.concat(F.when(i > 0, F.concat(F.lit("⟪"), i.cast("string"), F.lit("⟫"))).otherwise(""), part)), "")
    return F.when(free, numbered).otherwise(text), hits


def restored(text: Column, hits: Column) -> Column:
    """A text with its marks filled again; null unless each mark is there exactly once."""
    found = F.transform(F.regexp_extract_all(text, F.lit("⟪(\\d+)⟫"), F.lit(1)), lambda x: x.cast("int"))
    wanted = F.when(F.size(hits) > 0, F.sequence(F.lit(1), F.size(hits))).otherwise(F.array().cast("array<int>"))
    between = F.split(text, "⟪\\d+⟫", -1)

    def filled(marks: Column) -> Column:
        parts = F.transform(between, lambda part, i: F.concat(F.when(i > 0, F.element_at(hits, F.element_at(marks, i))).otherwise(""), part))
        return F.when(F.array_sort(marks) == wanted, F.array_join(parts, ""))

    # a variable of a lambda is computed once: else every part would look for all marks of the text again
    return F.when(F.size(hits) == 0, text).otherwise(F.element_at(F.transform(F.array(found), filled), 1))
