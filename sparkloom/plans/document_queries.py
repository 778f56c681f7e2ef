"""Queries over annotations, glossaries, labels, page lists, replies and findings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import labels as L
from ..functions import text as T
from ..operators import annotations as N
from ..operators import summaries as Y
from .tables import table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_ANNOTS = "a AS (SELECT user_id % 10 AS doc, event_id AS id, event_id % 37 AS page, event_type AS kind, CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 = 1 THEN NULL ELSE 'u' || user_id % 7 END AS author, 'n ' || event_id AS note FROM events)"
_WHO = "coalesce(nullif(author, ''), '(unsigned)')"


def annots(spark: SparkSession, sf: str) -> DataFrame:
    """Events as annotations of documents."""
    author = F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, None).otherwise(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")))
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("doc"), F.col("event_id").alias("id"), (F.col("event_id") % 37).alias("page"), F.col("event_type").alias("kind"), author.alias("author"),
        F.concat(F.lit("n  "), F.col("event_id").cast("string")).alias("note"),
    )


@_query("annotation_filter", f"WITH {_ANNOTS} SELECT doc, id FROM a WHERE kind IN ('click', 'error') AND {_WHO} IN ('(unsigned)', 'u2')")
def annotation_filter(spark: SparkSession, sf: str) -> DataFrame:
    return N.chosen(annots(spark, sf), ["click", "error"], ["", "u2"]).select("doc", "id")


@_query("annotation_strip", f"WITH {_ANNOTS} SELECT doc, id FROM a WHERE kind <> 'click' AND {_WHO} <> '(unsigned)'")
def annotation_strip(spark: SparkSession, sf: str) -> DataFrame:
    return N.stripped(annots(spark, sf), ["click"], [N.UNSIGNED]).select("doc", "id")


@_query("annotation_summary", f"WITH {_ANNOTS} SELECT doc, 'kind' AS facet, kind AS value, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT doc, 'author', {_WHO}, count(*) FROM a GROUP BY ALL UNION ALL SELECT doc, 'pages', '', count(DISTINCT page) FROM a GROUP BY doc")
def annotation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return N.summary(annots(spark, sf))


@_query("annotation_groups", f"WITH {_ANNOTS} SELECT doc, {_WHO} AS key, page // 10 AS nth, count(*) AS n, string_agg(replace(note, ' ', '  '), '|' ORDER BY page, id) AS items FROM a GROUP BY ALL")
def annotation_groups(spark: SparkSession, sf: str) -> DataFrame:
    return N.grouped(annots(spark, sf), "author", 10).withColumn("items", F.array_join("items", "|"))


@_query("annotation_tasks", f"WITH {_ANNOTS} SELECT doc, page, id, '- [ ] p.' || page || ' ' || {_WHO} || ': ' || note AS line FROM a")
def annotation_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return N.tasks(annots(spark, sf))


_TERMS = ["the", "tion", "der Die", "die", "les"]


@_query("glossary_match", r"SELECT doc_id, lower(t) AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:\b(?:der die|tion|die|les|the)\b)')) AS t FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '/', 'g') AS text FROM documents)) GROUP BY ALL")
def glossary_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z0-9 ]", "/").alias("text"))
    return N.terms_found(docs, _TERMS, "doc_id")


@_query("glossary_protect", "SELECT doc_id, text AS back, NOT regexp_matches(text, '(?i)\\b(the|les)\\b') AS same FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '/', 'g') AS text FROM documents)")
def glossary_protect(spark: SparkSession, sf: str) -> DataFrame:
    """Terms give way to marks and come back; the marked text is the text itself only without any term."""
    text = F.regexp_replace("text", "[^A-Za-z0-9 ]", "/")
    marked, hits = N.protected(F.col("text"), ["the", "les"])
    rows = table(spark, sf, "documents").select("doc_id", text.alias("text")).select("doc_id", "text", marked.alias("marked"), hits.alias("hits"))
    return rows.select("doc_id", N.restored(F.col("marked"), F.col("hits")).alias("back"), (F.col("marked") == F.col("text")).alias("same"))


@_query("glossary_pairs", "SELECT lang, source, count(*) AS n FROM documents WHERE n_chars >= 20 GROUP BY lang, source")
def glossary_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Y.pair_counts(table(spark, sf, "documents"), "lang", "source", F.col("n_chars") >= 20)


@_query("chinese_numbers", "SELECT p_partkey, CAST(p_partkey % 9999 + 1 AS INTEGER) AS n FROM part")
def chinese_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers written in numerals and read back."""
    return table(spark, sf, "part").select("p_partkey", L.chinese_int(L.chinese_number(F.col("p_partkey") % 9999 + 1)).alias("n"))


@_query("label_match", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 THEN p_brand END AS key FROM part")
def label_match(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as forms write them, found by their bare form among the brands; every fifth has no synonym."""
    brand = F.col("p_brand")
    shape = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("1. "), brand, F.lit("："))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" * "), F.upper(brand), F.lit(" (note) ")))
    shape = shape.when(F.col("p_partkey") % 5 == 2, F.translate(brand, "BR#", "ＢＲ＃")).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("（三）"), brand)).otherwise(F.concat(brand, F.lit("?")))
    part = table(spark, sf, "part")
    index = part.select(brand.alias("key")).distinct().withColumn("bare", L.label(F.col("key")))
    return part.select("p_partkey", L.label(shape).alias("bare")).join(index, "bare", "left").select("p_partkey", "key")


@_query("labels_unmatched", "SELECT DISTINCT lower(p_brand) || '?' AS bare FROM part WHERE p_partkey % 5 = 4")
def labels_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    seen = part.select(L.label(F.concat("p_brand", F.when(F.col("p_partkey") % 5 == 4, "?").otherwise(""))).alias("bare")).distinct()
    return seen.join(part.select(L.label(F.col("p_brand")).alias("bare")).distinct(), "bare", "left_anti")


SQL["labels_unmatched"] = "SELECT DISTINCT replace(lower(p_brand), '-', '') || '?' AS bare FROM part WHERE p_partkey % 5 = 4"


@_query("numeric_ranges", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN '10以下' WHEN p_size BETWEEN 11 AND 30 THEN '11~30人' WHEN p_size >= 31 THEN '31以上' END AS option FROM part")
def numeric_ranges(spark: SparkSession, sf: str) -> DataFrame:
    options = F.array(*map(F.lit, ["10以下", "11~30人", "31以上", "other"]))
    return table(spark, sf, "part").select("p_partkey", F.get(F.filter(options, lambda o: L.in_range(o, F.col("p_size"))), F.lit(0)).alias("option"))


@_query(
    "page_order",
    """WITH s AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS a, CAST(p_partkey % 50 + 1 AS INTEGER) AS b FROM part), l AS (SELECT p_partkey, a, b, list_filter([7] || CASE WHEN a <= b THEN range(a, b + 1) ELSE list_reverse(range(b, a + 1)) END, lambda x: x <= 40) AS pages FROM s)
    SELECT p_partkey, array_to_string(pages, ',') AS pages, array_to_string(list_filter(range(1, 41), lambda x: NOT list_contains(pages, x)), ',') AS rest FROM l""",
)
def page_order(spark: SparkSession, sf: str) -> DataFrame:
    spec = F.concat(F.lit(" 7; "), F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_partkey") % 50 + 1).cast("string"))
    spec = F.regexp_replace(spec, " - ", "-")
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return table(spark, sf, "part").select("p_partkey", joined(L.page_order(spec, F.lit(40))).alias("pages"), joined(L.pages_left(spec, F.lit(40))).alias("rest"))


@_query("toc_entries", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 3 + 1 AS INTEGER) END AS level, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS INTEGER) END AS page FROM part")
def toc_entries(spark: SparkSession, sf: str) -> DataFrame:
    indent = F.repeat(F.lit("  "), (F.col("p_partkey") % 3).cast("int"))
    line = F.concat(indent, "p_name", F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit(" ....… "), F.col("p_size").cast("string"))).otherwise(F.lit(" x")))
    title, level, page = L.toc_entry(line)
    return table(spark, sf, "part").select("p_partkey", title.alias("title"), level.alias("level"), page.alias("page"))


@_query(
    "pages_merged",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM p GROUP BY conv_id),
    o AS (SELECT conv_id, coalesce(sum(n) OVER (PARTITION BY conv_id // 20 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
    SELECT conv_id // 20 AS volume, conv_id, turn, CAST(before + page AS BIGINT) AS page, CAST((before + page - 1) // 4 + 1 AS BIGINT) AS sheet FROM p JOIN o USING (conv_id)""",
)
def pages_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents, twenty to a volume, turns as pages numbered through the volume, four to a sheet."""
    return Y.volumes(table(spark, sf, "conversations").withColumn("volume", F.floor(F.col("conv_id") / 20)), "volume", "conv_id", "turn", 4)


@_query("page_sizes", "SELECT length(text) // 500 AS size, count(*) AS pages FROM conversations GROUP BY 1")
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return Y.size_histogram(table(spark, sf, "conversations"), F.length("text"), 500)


@_query("batch_replies", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderpriority || ' more|' || o_orderstatus END AS texts FROM orders")
def batch_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in two numbered segments; every fourth lacks one."""
    second = F.when(F.col("o_orderkey") % 4 != 3, F.concat(F.lit("⟦2⟧ "), "o_orderstatus")).otherwise(F.lit("⟦1⟧ again"))
    reply = F.concat(F.lit("so:\n⟦1⟧ "), "o_orderpriority", F.lit("\n\n  more \n"), second)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(L.batch_reply(reply, F.lit(2)), "|").alias("texts"))


@_query("json_salvage", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props END AS found FROM events")
def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Replies that are fenced, plain, in running text, broken, or end in another brace."""
    props, kind = F.col("props"), F.col("event_id") % 5
    reply = F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nor use {x}"))).when(kind == 1, F.concat(F.lit(" \n"), props, F.lit("\n"))).when(kind == 2, F.concat(F.lit("Here it is: "), props, F.lit(" - done")))
    reply = reply.when(kind == 3, F.concat(F.lit("{"), props)).otherwise(F.concat(props, F.lit(" or use {x}")))
    return table(spark, sf, "events").select("event_id", L.json_object(reply).alias("found"))


@_query("prompt_echoes", "SELECT doc_id, contains(text, 'the ') OR contains(text, 'der ') AS echo FROM documents")
def prompt_echoes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", L.echoes(F.col("text"), ["the ", "der "]).alias("echo"))


@_query("text_amounts", r"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '\b([0-9]{5,15})\b', 1), lambda x: CAST(x AS BIGINT)), lambda x: x >= 10000), ',') AS amounts FROM (SELECT doc_id, CAST(doc_id * 7919 AS VARCHAR) || ' and 123 and ' || CAST(doc_id + 10000 AS VARCHAR) AS text FROM documents)")
def text_amounts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat((F.col("doc_id") * 7919).cast("string"), F.lit(" and 123 and "), F.format_number(F.col("doc_id") + 10000, 0))
    return table(spark, sf, "documents").select("doc_id", F.array_join(L.amounts(text).cast("array<string>"), ",").alias("amounts"))


@_query("text_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 30 YEAR, '%Y-%m-%d') || ',' ELSE '' END || strftime(o_orderdate, '%Y-%m-%d') AS days FROM orders")
def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    later = F.add_months(day, 360)
    roc = F.concat((F.year(day) - 1911).cast("string"), F.lit(" 年 "), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日 2024-13-45"))
    text = F.concat(F.lit("at "), roc, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" until "), F.date_format(later, "yyyy/M/d"))).otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(L.dates(text), lambda d: d.cast("string")), ",").alias("days"))


@_query("times_with_offset", "SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS local, epoch_us(ts) // 60000000 * 60 AS back FROM events")
def times_with_offset(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    local = L.iso_time(seconds, 330)
    typed = F.concat(F.left(local, F.lit(16)), F.when(F.col("event_id") % 2 == 0, "+05:30").otherwise(""))
    return table(spark, sf, "events").select("event_id", local.alias("local"), L.epoch_of(typed, 330).alias("back"))


@_query("unit_sizes", "SELECT p_partkey, round(p_size * 72 / 25.4, 6) AS pt, round(p_size * 96 / 25.4, 6) AS px FROM part")
def unit_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(L.millimetres(F.col("p_size"), "pt"), 6).alias("pt"), F.round(L.millimetres(F.col("p_size"), "px"), 6).alias("px"))


_PARTS = """k AS (SELECT event_id, ['tax-id-invalid', 'identity-outlier', 'duplicate-hash', 'other'][event_id % 4 + 1] AS category, 'E' || event_id AS v FROM events)"""


@_query("finding_keys", f"WITH {_PARTS} SELECT event_id, category || ':' || CASE category WHEN 'duplicate-hash' THEN left(sha256(v), 16) WHEN 'other' THEN 'found ' || v || ':' || event_id % 9 ELSE v END AS key FROM k")
def finding_keys(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["tax-id-invalid", "identity-outlier", "duplicate-hash", "other"]))
    v = F.concat(F.lit("E"), F.col("event_id").cast("string"))
    evidence = F.create_map(F.lit("tax_id"), v, F.lit("outlier"), v, F.lit("sha256"), F.sha2(v, 256))
    category = F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", L.finding_key(category, evidence, F.concat(F.lit("found "), v), F.col("event_id") % 9).alias("key"))


@_query("dates_expiring", "SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_custkey")
def dates_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with days after today and before the deadline; both are parameters."""
    at = F.col("o_orderdate")
    soon = table(spark, sf, "orders").filter((at > F.lit("1996-01-01").cast("timestamp")) & (at < F.lit("1997-01-01").cast("timestamp")))
    return soon.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))


@_query("attachment_counts", "SELECT l_orderkey, max(CAST(l_quantity AS INTEGER)) % 9 AS declared, count(*) AS files FROM lineitem GROUP BY l_orderkey HAVING abs(max(CAST(l_quantity AS INTEGER)) % 9 - count(*)) > 1")
def attachment_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Y.attachments_off(table(spark, sf, "lineitem"), "l_orderkey", F.max(F.col("l_quantity").cast("int")) % 9)


@_query(
    "hidden_content",
    """SELECT page_id, regexp_matches(lower(html), '<script') AS script, regexp_matches(lower(html), '<(iframe|embed|object)') AS embedded, regexp_matches(lower(html), '<a [^>]*href') AS link,
    regexp_matches(lower(html), 'display: *none|visibility: *hidden|font-size: *0') AS hidden FROM pages""",
)
def hidden_content(spark: SparkSession, sf: str) -> DataFrame:
    html = F.lower("html")
    rules = {"script": "<script", "embedded": "<(iframe|embed|object)", "link": "<a [^>]*href", "hidden": "display: *none|visibility: *hidden|font-size: *0"}
    return table(spark, sf, "pages").select("page_id", *(html.rlike(p).alias(k) for k, p in rules.items()))


@_query("template_fingerprints", "SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda w: trim(w)), lambda w: length(w) BETWEEN 1 AND 20)))[1:60], '|')) AS print FROM (SELECT doc_id, regexp_replace(text, '[^a-z ]', '', 'g') AS text FROM documents)")
def template_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", L.fingerprint(F.split(F.regexp_replace("text", "[^a-z ]", ""), " ")).alias("print"))


@_query("trips_booked", "SELECT transport, key, min(event_id) AS event_id FROM (SELECT event_id, event_type AS transport, CASE WHEN event_id % 3 = 0 THEN event_type || '|trip:' || user_id WHEN event_id % 3 = 1 THEN event_type || '|T' || user_id % 9 ELSE event_type || '|' || user_id || '|' || value END AS key FROM events) GROUP BY ALL")
def trips_booked(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    key = L.trip_key(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, user), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(" T"), (F.col("user_id") % 9).cast("string"))).otherwise(" "), F.col("user_id"), F.col("value"))
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("transport"), key.alias("key")).groupBy("transport", "key").agg(F.min("event_id").alias("event_id"))


@_query("line_prefixes", "SELECT p_partkey, ['- ', '  * ', '12. ', '> ', '### ', ''][p_partkey % 6 + 1] AS prefix, p_name AS body FROM part")
def line_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array(*map(F.lit, ["- ", "  * ", "12. ", "> ", "### ", ""]))
    prefix, body = L.line_prefix(F.concat(F.element_at(marks, (F.col("p_partkey") % 6 + 1).cast("int")), "p_name"))
    return table(spark, sf, "part").select("p_partkey", prefix.alias("prefix"), body.alias("body"))


@_query(
    "block_kinds",
    """WITH m AS (SELECT p_brand, median(p_size) AS m FROM part GROUP BY p_brand)
    SELECT p_partkey, CASE WHEN p_size / m >= 1.6 THEN 1 WHEN p_size / m >= 1.3 THEN 2 WHEN p_size / m >= 1.15 AND p_partkey % 2 = 0 THEN 3 ELSE 0 END AS level FROM part JOIN m USING (p_brand)""",
)
def block_kinds(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.accounts import percentiles

    part = table(spark, sf, "part")
    rows = part.join(percentiles(part, "p_brand", "p_size", [0.5]), "p_brand")
    return rows.select("p_partkey", L.block_kind(F.col("p_name"), F.col("p_size"), F.col("p_partkey") % 2 == 0, F.col("p50")).alias("level"))


@_query("number_checks", r"SELECT c_custkey, regexp_matches(left(c_name, 1) || '8' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '^[A-Z][A-D89]\d{8}$') AS residence, c_custkey % 2 = 0 AS phone, c_custkey % 3 = 0 AS account FROM customer")
def number_checks(spark: SparkSession, sf: str) -> DataFrame:
    pad = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    phone = F.concat(F.when(F.col("c_custkey") % 2 == 0, "+1 (743) 555-").otherwise("(143) 555-"), F.right(pad, F.lit(4)))
    account = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.left(pad, F.lit(4)), F.lit("-"), F.right(pad, F.lit(4)))).otherwise(F.right(pad, F.lit(7)))
    return table(spark, sf, "customer").select("c_custkey", C.tw_residence(F.concat(F.left("c_name", F.lit(1)), F.lit("8"), pad)).alias("residence"), C.us_phone(phone).alias("phone"), C.bank_account(account).alias("account"))


@_query("registry_tokens", "WITH t AS (SELECT DISTINCT s_suppkey, unnest(string_split(lower(replace(s_name, '#', ' ')), ' ')) AS token FROM supplier), w AS (SELECT DISTINCT p_partkey, unnest(['supplier', lpad(CAST(p_partkey % 40 AS VARCHAR), 9, '0')]) AS token FROM part) SELECT p_partkey, s_suppkey FROM w JOIN t USING (token) GROUP BY ALL HAVING count(*) = 2")
def registry_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Names by whole tokens: an index (token, key), met by the tokens of each question and kept where all are there."""
    from ..operators.registry import token_search

    words = F.array(F.lit("Supplier"), F.lpad((F.col("p_partkey") % 40).cast("string"), 9, "0"))
    asked = table(spark, sf, "part").select("p_partkey", F.array_join(words, " ").alias("query"))
    return token_search(asked, table(spark, sf, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit(" ")).alias("name")), "p_partkey", "s_suppkey", "name")


@_query(
    "cells_right",
    """WITH c AS (SELECT user_id AS page, event_id AS id, CAST(floor(value * 37) % 600 AS BIGINT) AS x, event_id * 7 % 200 AS y, 20 + event_id % 30 AS width, 8 + event_id % 20 AS height FROM events)
    SELECT a.page, a.id, arg_min(b.id, (b.x, b.id)) AS other FROM c a JOIN c b ON a.page = b.page AND b.x >= a.x + a.width AND b.x - a.x - a.width <= 120 AND 2 * abs(a.y - b.y) < a.height GROUP BY a.page, a.id""",
)
def cells_right(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.reconcile import nearest_right

    cells = table(spark, sf, "events").select(
        F.col("user_id").alias("page"), F.col("event_id").alias("id"), (F.floor(F.col("value") * 37) % 600).alias("x"), (F.col("event_id") * 7 % 200).alias("y"), (F.col("event_id") % 30 + 20).alias("width"), (F.col("event_id") % 20 + 8).alias("height")
    )
    return nearest_right(cells, 120.0)


@_query(
    "receipts",
    """SELECT o_orderkey, ['thsrc', 'tra', 'uber_trip', 'unknown'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN 'S' || o_custkey END AS origin, CAST(floor(o_totalprice) AS BIGINT) AS fare, strftime(o_orderdate + INTERVAL 30 YEAR, '%Y-%m-%d') AS day FROM orders""",
)
def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts written from the orders and read back: kind, station, fare and day."""
    from ..functions import invoices as I

    head = F.element_at(F.array(*map(F.lit, ["高鐵 車票", "臺鐵 車票", "Uber", "note"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    origin = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("S"), F.col("o_custkey").cast("string"), F.lit("車站"))).otherwise("")
    day = F.add_months(F.col("o_orderdate").cast("date"), 360)
    text = F.concat(head, F.lit("\n 起站： "), origin, F.lit("\n票價: NT$ "), F.format_number(F.floor("o_totalprice").cast("long"), 0), F.lit(" 元\n日期："), F.date_format(day, "yyyy/MM/dd"), F.lit("\n"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    t = F.col("text")
    place = F.nullif(L.station(I.labelled(t, "起站")), F.lit(""))
    return rows.select("o_orderkey", I.receipt_kind(t).alias("kind"), place.alias("origin"), I.first_integer(I.labelled(t, "票價")).alias("fare"), F.array_join(F.transform(L.dates(t), lambda d: d.cast("string")), ",").alias("day"))


@_query("relative_times", "SELECT event_id, CASE WHEN s < 60 THEN '剛剛' WHEN s < 3600 THEN s // 60 || ' 分鐘前' WHEN s < 86400 THEN s // 3600 || ' 小時前' WHEN s < 604800 THEN s // 86400 || ' 天前' ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-30')::BIGINT - epoch_us(ts) // 1000000 AS s FROM events)")
def relative_times(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import invoices as I

    return table(spark, sf, "events").select("event_id", I.relative_time(F.col("ts").cast("timestamp"), F.lit("2024-01-30").cast("timestamp")).alias("ago"))
