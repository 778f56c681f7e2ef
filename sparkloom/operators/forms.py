"""Values of forms: options that they tick, by aliases and ranges, and references to other fields of their record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.unicode import folded, nfkc
from .consistency import contained

# What is said in other words on forms, in order.
ALIASES: dict[str, list[str]] = {
    "台幣": ["ntd", "twd", "新台幣", "新臺幣"], "臺幣": ["ntd", "twd", "新台幣", "台幣"], "新台幣": ["ntd", "twd", "台幣"], "美金": ["usd", "美元"], "美元": ["usd", "美金"], "日圓": ["yen", "jpy", "日元"], "日幣": ["yen", "jpy", "日元"],
    "人民幣": ["rmb", "cny"], "歐元": ["eur", "euro"], "港幣": ["hkd"], "電匯": ["t/t", "tt", "wire"], "支票": ["check", "cheque"], "現金": ["cash"], "電子發票": ["電子計算機發票", "電計發票", "e-invoice"],
    "月結三十天": ["30", "三十", "30天", "三十天", "月結30天", "月結30", "net 30", "net 30 days"], "月結四十五天": ["45", "四十五", "45天", "四十五天", "月結45天", "月結45", "net 45", "net 45 days"],
    "月結六十天": ["60", "六十", "60天", "六十天", "月結60天", "月結60", "net 60", "net 60 days"], "月結九十天": ["90", "九十", "90天", "九十天", "月結90天", "月結90", "net 90", "net 90 days"], "預付": ["prepaid", "in advance"],
}


def aliases(spark, words: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(term, place, synonyms) of a table of aliases in code; place is their order."""
    return spark.createDataFrame([(t, i, s) for i, (t, s) in enumerate(words.items())], "term string, place int, synonyms array<string>")


def expanded(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, nth, said): each value with what it is also said as, the value itself first, then by the order of the terms.

    A value that is a term is said as its synonyms; one that is a synonym as the term and its other synonyms. values: (value).
    """
    given = values.select("value").filter(F.trim("value") != "").distinct().withColumn("_k", folded(nfkc(F.col("value")))).withColumn("_l", F.lower(F.trim("value")))
    named = words.withColumn("_k", folded(nfkc(F.col("term"))))
    terms = given.join(named, "_k").select("value", "place", F.posexplode("synonyms").alias("pos", "said"))
    synonyms = words.select("term", "place", "synonyms", F.explode(F.array_distinct(F.transform("synonyms", F.lower))).alias("_l"))
    other = given.join(synonyms, "_l").join(terms.select("value", "place").distinct(), ["value", "place"], "left_anti")
    other = other.select("value", "place", F.posexplode(F.concat(F.array("term"), F.filter("synonyms", lambda s: F.lower(s) != F.col("_l")))).alias("pos", "said"))
    first = given.select("value", F.lit(-1).alias("place"), F.lit(0).alias("pos"), F.col("value").alias("said"))
    every = first.unionByName(terms).unionByName(other)
    return every.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("place", "pos", "said"))).alias("l")).select("value", F.posexplode(F.transform("l", lambda x: x["said"])).alias("nth", "said"))  # the words for one value


def _bounds(t: Column) -> tuple[Column, Column]:
    """(least, greatest) number that an option stands for; null where it names no range."""
    n = F.transform(F.regexp_extract_all(t, F.lit("[0-9]{1,37}"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    a, b = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    under, over = t.rlike("以下|以內|以内|≤"), t.rlike("以上|≥")
    most = F.lit("9" * 38).cast("decimal(38,0)")
    low = F.when(under, F.lit("-1").cast("decimal(38,0)")).when(over, a).when(b.isNotNull(), F.least(a, b))
    high = F.when(under, a).when(over, most).when(b.isNotNull(), F.greatest(a, b))
    return F.when(a.isNotNull(), low), F.when(a.isNotNull(), high)


def _candidates(options: DataFrame, values: DataFrame, words: DataFrame) -> DataFrame:
    """(form, field, value, rank, option, place) of every way in which a value of a field fits an option of its form; rank: the stage, the word, and how it fits."""
    opts = options.select("form", "option", "place", folded(nfkc(F.col("text"))).alias("t")).filter("t <> ''")
    asked = values.select("form", "field", "value").filter("value is not null").distinct()
    said = expanded(asked.select("value"), words).withColumn("c", folded(nfkc(F.col("said")))).filter("c <> ''")
    rank = lambda stage, nth, how: F.struct(F.lit(stage).alias("stage"), nth.alias("nth"), F.lit(how).alias("how")).alias("rank")
    cols = ("form", "field", "value", "option", "place")
    low, high = _bounds(F.col("t"))
    ranges = opts.withColumn("low", low).withColumn("high", high).filter("low is not null")
    numbers = asked.filter(F.trim("value").rlike("^[0-9]{1,37}$")).withColumn("n", F.trim("value").cast("decimal(38,0)"))
    out = numbers.join(ranges, "form").filter(F.col("n").between(F.col("low"), F.col("high"))).select(*cols, rank(0, F.lit(0), 0))
    words_of = asked.join(said, "value").select("form", "field", "value", "nth", "c")
    out = out.unionByName(words_of.join(opts, (words_of.form == opts.form) & (words_of.c == opts.t)).select(words_of.form, "field", "value", "option", "place", rank(1, F.col("nth"), 0)))
    # words and options meet by pieces of the words, all forms at once, and then each in its form
    pairs = contained(said.select(F.col("c").alias("value")), opts.select(F.col("t").alias("name"))).select(F.col("value").alias("c"), F.col("name").alias("t"))
    part = words_of.join(pairs, "c").join(opts, ["form", "t"])
    within = part.filter(F.col("c").contains(F.col("t"))).select(*cols, rank(2, F.col("nth"), 0))
    around = part.filter(F.col("t").contains(F.col("c"))).select(*cols, rank(2, F.col("nth"), 1))
    return out.unionByName(within).unionByName(around)


def best_option(options: DataFrame, values: DataFrame, words: DataFrame) -> DataFrame:
    """(form, field, value, option): the option of its form that a value ticks.

    options: (form, option, place, text), values: (form, field, value), words: (term, place, synonyms). The first of: an option whose range
    holds the number that the value is; one that is the value or a word for it; word by word, one that is a part of it, else one of which it is
    a part; of several the first by place. Texts are compared in NFKC form, in one script, without white space and case. Null and blank
    values, and values that nothing fits, have no row.
    """
    found = _candidates(options, values, words)
    return found.groupBy("form", "field", "value").agg(F.min(F.struct("rank", "place", "option"))["option"].alias("option"))


def all_options(options: DataFrame, values: DataFrame, words: DataFrame) -> DataFrame:
    """(form, field, value, option): every option of its form that is a value or a word for it, a part of it, or contains it; see best_option."""
    return _candidates(options, values, words).filter("rank.stage > 0").select("form", "field", "value", "option").distinct()


# References that name no field, marks around a value, how references begin and end, and the fields that a bare one means.
BARE = ("同上", "同前", "如上", "同上述", "同前述", "同左", "同右", "同上欄", "同左列", "同上所述", "略同上", "ditto", "同", "〃", "″", "”", '"', "，, ")
AROUND = r"[\s（）()［］\[\]｛｝{}「」『』<>《》]"
BEGINS, ENDS = "[同與如]", ("相同", "同", "一致", "者同")
DITTO = {"invoice_address": "address", "factory_address": "address", "payee_address_en": "english_address", "bank_account_name": "company_name", "short_name": "company_name"}


def _clean(value: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")
    marks = AROUND.replace(r"\s", "")
    return F.regexp_replace(F.regexp_replace(bare, f"^{marks}+|{marks}+$", ""), r"(?U)^\s+|\s+$", "")


def _named(value: Column) -> Column:
    """The field that a cleaned value names as 'the same as', null if it names none."""
    body = F.trim(F.substring(value, 2, 1 << 30))
    for end in ENDS:
        body = F.when(F.endswith(body, F.lit(end)) & (F.length(body) > len(end)), F.trim(F.substring(body, F.lit(1), F.length(body) - len(end)))).otherwise(body)
    good = value.rlike(f"^{BEGINS}") & ~value.isin(*BARE) & ~body.isin("上", "前", "左", "右") & (F.length(body) >= 2)
    return F.when(good, body)


def same_as(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """rows (record, key, value) with resolved (the value, or that of the field it refers to) and source (that field's key, null if it is no reference).

    synonyms: (key, label), the labels under which a field is named. A reference is 'same as' with a field's label, or a bare 'ditto' in
    a field for which DITTO has another. It is followed one step: a field whose value is a reference itself, that is blank, missing or
    the same field gives nothing, and then the value stays as it is. A record has a key once (of repeated ones the smallest value counts). Null values stay.
    """
    index = synonyms.select(F.col("key").alias("_target"), L.label(F.col("label")).alias("_label")).filter("_label <> ''").groupBy("_label").agg(F.min("_target").alias("_target"))
    given = rows.withColumn("_c", _clean(F.col("value"))).withColumn("_n", _named(F.col("_c")))
    given = given.withColumn("_label", L.label(F.col("_n"))).join(index, "_label", "left")
    refers = (F.col("_c") != "") & (F.length("_c") <= 20) & (F.col("_c").isin(*BARE) | F.col("_target").isNotNull())
    ditto = F.create_map(*(F.lit(x) for kv in DITTO.items() for x in kv))
    bare = F.col("_c").isin(*BARE)
    goal = F.when(F.col("_n").isNotNull(), F.when(F.col("_target") != F.col("key"), F.col("_target"))).when(bare, F.try_element_at(ditto, F.col("key")))
    given = given.withColumn("_goal", goal).withColumn("_ref", F.coalesce(refers, F.lit(False)))
    held = given.filter(~F.col("_ref") & (F.trim("value") != "")).groupBy("record", F.col("key").alias("_goal")).agg(F.min(F.trim("value")).alias("_got"))
    out = given.join(held, ["record", "_goal"], "left").withColumn("source", F.when(F.col("_got").isNotNull(), F.col("_goal")))
    return out.select(*rows.columns, F.coalesce("_got", "value").alias("resolved"), "source")
