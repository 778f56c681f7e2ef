"""An index of tokens with their positions: keywords match as phrases of adjacent tokens, CJK text character by character."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Longest run of tokens under which a keyword is looked up.
GRAM = 3

# letters of the Latin blocks whose decomposition begins with a plain letter
_MARKED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0].isascii()}


def tokens(text: Column) -> Column:
    """Tokens in order, repeats included: runs of letters and digits in small letters without marks, and each CJK character and kana."""
    plain = F.translate(F.lower(T.variants(F.coalesce(text, F.lit("")))), "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_extract_all(T.tokenised(plain), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, pos, token) of every token of the fields of rows."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in fields))).alias("x")
    return rows.select(key, each).select(key, "x.field", F.posexplode("x.t").alias("pos", "token"))


def phrases(questions: DataFrame, question: str, query: str = "query") -> DataFrame:
    """(question, nth, want): the tokens of each keyword of a question; keywords are set apart by blanks, and those without a token are left out."""
    words = F.filter(F.transform(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), tokens), lambda t: F.size(t) > 0)
    return questions.select(question, F.posexplode(F.array_distinct(words)).alias("nth", "want"))


def _grams(index: DataFrame, key: str) -> DataFrame:
    """(key, field, pos, gram): the tokens of an index in runs of one, two and three, set apart by blanks."""
    place = Window.partitionBy(key, "field").orderBy("pos")
    ahead = lambda n: F.collect_set("token").over(place.rangeBetween(n, n))
    runs = index.select(key, "field", "pos", "token", ahead(1).alias("a"), ahead(2).alias("b"))
    two = F.transform("a", lambda a: F.concat_ws(" ", "token", a))
    three = F.flatten(F.transform(two, lambda t: F.transform("b", lambda b: F.concat_ws(" ", t, b))))
    return runs.select(key, "field", "pos", F.explode(F.concat(F.array("token"), two, three)).alias("gram"))


def _places(wants: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(want, key): rows that have the tokens of a keyword one after the other in a field."""
    size = F.least(F.size("want"), F.lit(GRAM))
    grams = F.transform(F.sequence(F.lit(1), F.size("want") - size + 1), lambda i: F.array_join(F.slice("want", i, size), " "))
    pieces = wants.select("want", F.posexplode(grams).alias("off", "gram"))
    # postings are far more than the file of their rows says: a broadcast of them would not fit the driver
    filed = _grams(held, key).join(pieces.select("gram").distinct().hint("merge"), "gram", "left_semi")
    counts = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = pieces.join(counts.hint("merge"), "gram", "left").groupBy("want").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "gram")).alias("r")).filter("r.n > 0")
    met = rare.select("want", F.col("r.off").alias("off"), F.col("r.gram").alias("gram")).join(filed.hint("merge"), "gram")
    starts = met.select("want", key, "field", (F.col("pos") - F.col("off")).alias("start"))
    # a phrase of a gram is settled; of a longer one each place must have its token
    longer = F.size("want") > GRAM
    each = starts.filter(longer).select("*", F.posexplode("want").alias("off", "token")).withColumn("pos", F.col("start") + F.col("off")).drop("off")
    found = each.join(held.hint("merge"), [key, "field", "pos", "token"], "left_semi").groupBy("want", key, "field", "start").agg(F.count(F.lit(1)).alias("n"))
    return starts.filter(~longer).select("want", key).unionByName(found.filter(F.col("n") == F.size("want")).select("want", key)).distinct()


def search(questions: DataFrame, index: DataFrame, question: str, key: str, fields: Sequence[str] | None = None) -> DataFrame:
    """(question, key): rows that have every keyword of a question (question, query) as adjacent tokens, each in any one of the fields.

    index: postings() of the rows, which may be a stored table. Keywords that several questions have are looked up once, each under its rarest run of
    GRAM tokens (all of it, if it is shorter). The rows of a question's rarest keyword alone are asked for the others, so a keyword that all
    rows have deals out nothing. Questions without a token find nothing, as do null ones. Rows of one key are one row.
    """
    held = index.filter(F.col("field").isin(*fields)) if fields else index
    asked = phrases(questions.select(question, "query").distinct(), question)
    hits = _places(asked.select("want").distinct(), held, key)
    counts = hits.groupBy("want").agg(F.count(F.lit(1)).alias("n"))
    each = asked.join(counts.hint("merge"), "want", "left").select(question, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "nth", "want").alias("w"))
    lists = each.groupBy(question).agg(F.array_sort(F.collect_list("w")).alias("l"))  # the keywords of one question
    rest = F.transform(F.slice("l", 2, F.size("l")), lambda w: w["want"])
    first = lists.select(question, F.col("l")[0]["want"].alias("want"), rest.alias("rest")).join(hits.hint("merge"), "want")
    several = F.size("rest") > 0
    others = first.filter(several).select(question, key, F.size("rest").alias("needed"), F.explode("rest").alias("want")).join(hits.hint("merge"), ["want", key], "left_semi")
    all_met = others.groupBy(question, key, "needed").agg(F.count(F.lit(1)).alias("n")).filter("n = needed")
    return first.filter(~several).select(question, key).unionByName(all_met.select(question, key))


def counted(found: DataFrame, rows: DataFrame, question: str, key: str, facets: Sequence[str], sample: int = 2000, top: int = 10) -> DataFrame:
    """(question, total, sampled, facet, value, n, place): hits of each question, and the commonest values of facets in a sample of them.

    The sample is the first `sample` hits by key, which is its feature: facets of a question with very many hits cost no more. Null and
    blank values count as "other". Of equal counts the smaller value comes first.
    """
    totals = found.groupBy(question).agg(F.count(F.lit(1)).alias("total"))
    some = found.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy(key))).filter(F.col("_n") <= sample).drop("_n")
    value = lambda f: F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("other"))
    each = some.join(rows.select(key, *dict.fromkeys(facets)).hint("merge"), key).select(question, F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), value(f).alias("value")) for f in facets))).alias("x"))
    counts = each.groupBy(question, "x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(question, "facet").orderBy(F.desc("n"), "value"))
    best = counts.withColumn("place", place).filter(F.col("place") <= top)
    return best.join(totals, question).select(question, "total", F.least("total", F.lit(sample)).alias("sampled"), "facet", "value", "n", "place")
