"""Queries over lines and texts of documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from .tables import table

QUERIES, SQL = {}, {}

_SEP = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES = f"""lines AS (SELECT doc_id, unnest(p) AS line, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS pos FROM (
  SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS p FROM (SELECT doc_id, string_split_regex(text, '{_SEP}') AS s FROM documents WHERE text IS NOT NULL)))"""
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
_SPACE = r"[\s\x0b\x1c-\x1f\p{Z}\x{85}]"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.of_documents(table(spark, sf, "documents"))


def _op(name: str, sql: str, op: str, **params) -> None:
    """A query for one line operation inside each document."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = L.OPS[op](_lines(spark, sf), ["doc_id"], **params)
        return out.select("doc_id", "pos", "line")

    QUERIES[name] = run
    SQL[name] = f"WITH {LINES} {sql}"


_op("lines_trim", f"SELECT doc_id, pos, {_STRIP.format('line')} AS line FROM lines", "trim")
_op("lines_drop_empty", r"SELECT doc_id, pos, line FROM lines WHERE regexp_matches(line, '[^\s\p{Z}\x{85}\x1c-\x1f]')", "drop_empty")
_op("lines_upper", "SELECT doc_id, pos, upper(replace(line, 'ß', 'SS')) AS line FROM lines", "case", mode="upper")
_op("lines_lower", "SELECT doc_id, pos, lower(line) AS line FROM lines", "case", mode="lower")
_op("lines_wrap", "SELECT doc_id, pos, '<' || line || '>' AS line FROM lines", "wrap", prefix="<", suffix=">")
_op("lines_filter_include", "SELECT doc_id, pos, line FROM lines WHERE contains(line, 'tion')", "filter", pattern="tion")
_op("lines_filter_exclude", "SELECT doc_id, pos, line FROM lines WHERE NOT contains(lower(line), 'the')", "filter", pattern="The", mode="exclude", case_insensitive=True)
_op("lines_filter_regex", r"SELECT doc_id, pos, line FROM lines WHERE regexp_matches(line, '[0-9]{3,}|[A-Z]{4,}')", "filter", pattern="[0-9]{3,}|[A-Z]{4,}", regex=True)
_op("lines_dedup_first", "SELECT doc_id, min(pos) AS pos, line FROM lines GROUP BY doc_id, line", "dedup")
_op("lines_dedup_last", "SELECT doc_id, max(pos) AS pos, line FROM lines GROUP BY doc_id, line", "dedup", keep="last")
_op("lines_dedup_count", "SELECT doc_id, min(pos) AS pos, count(*) || chr(9) || line AS line FROM lines GROUP BY doc_id, line", "dedup", keep="count")
_op("lines_dedup_ignore_case", "SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM lines GROUP BY doc_id, lower(line)", "dedup", case_insensitive=True)
_op("lines_sort", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) - 1 AS pos, line FROM lines", "sort")
_op("lines_sort_desc", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line DESC, pos) - 1 AS pos, line FROM lines", "sort", order="desc")
_op("lines_sort_ignore_case", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lower(line), pos) - 1 AS pos, line FROM lines", "sort", case_insensitive=True)
_op(
    "lines_sort_natural",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(regexp_extract_all(lower(line), '[0-9]+|[^0-9]+'),
    lambda x: {'kind': CASE WHEN regexp_full_match(x, '[0-9]+') THEN 0 ELSE 1 END, 'n': CASE WHEN regexp_full_match(x, '[0-9]+') THEN length(regexp_replace(x, '^0+([0-9])', '\\1')) ELSE 0 END,
    't': CASE WHEN regexp_full_match(x, '[0-9]+') THEN regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END}), pos) - 1 AS pos, line FROM lines""",
    "sort",
    natural=True,
)
_op("lines_reverse", "SELECT doc_id, -pos AS pos, line FROM lines", "reverse")
_op("lines_head", "SELECT doc_id, pos, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3", "head", n=3)
_op("lines_tail", "SELECT doc_id, pos, line FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 3", "tail", n=3)


@_query("lines_shuffle")
def lines_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return L.shuffle(_lines(spark, sf), ["doc_id"], seed=7)


@_query("lines_title")
def lines_title(spark: SparkSession, sf: str) -> DataFrame:
    return L.case(_lines(spark, sf), mode="title")


@_query(
    "lines_corpus_dedup_count",
    f"WITH {LINES} SELECT count(*) AS n, line FROM lines WHERE length(line) > 0 GROUP BY line",
)
def lines_corpus_dedup_count(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as one list: each distinct line once, with its count. Partial counts leave a hot line one row a task."""
    return _lines(spark, sf).filter("length(line) > 0").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "lines_pipeline",
    f"""WITH {LINES}, a AS (SELECT doc_id, pos, lower({_STRIP.format('line')}) AS line FROM lines), b AS (SELECT * FROM a WHERE length(line) > 0),
    c AS (SELECT doc_id, line, min(pos) AS pos FROM b GROUP BY doc_id, line), d AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, pos) - 1 AS pos FROM c)
    SELECT doc_id, pos, '- ' || line AS line FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5""",
)
def lines_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    ops = [{"op": "trim"}, {"op": "drop_empty"}, {"op": "case", "mode": "lower"}, {"op": "dedup"}, {"op": "nothing"}, {"op": "sort"}, {"op": "head", "n": 5}, {"op": "wrap", "prefix": "- "}]
    return L.pipeline(_lines(spark, sf), ops, ["doc_id"])[0].select("doc_id", "pos", "line")


def _class_sql() -> str:
    out, left = [], "text"
    for name, pattern in (("cjk", _CJK), ("whitespace", _SPACE), ("digit", r"\p{Nd}"), ("en_letter", r"\p{L}"), ("punct", r"[\p{P}\p{S}]")):
        after = f"regexp_replace({left}, '{pattern}', '', 'g')"
        out.append(f"length({left}) - length({after}) AS {name}")
        left = after
    return ", ".join([*out, f"length({left}) AS other"])


@_query("wc_char_classes", f"SELECT doc_id, {_class_sql()} FROM documents")
def wc_char_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in T.char_classes(F.col("text")).items()))


_PIECES = r"len(list_filter(string_split_regex(text, '{0}'), lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\p{{Z}}\x{{85}}]')))"
_COUNTS = f"""length(text) AS char_total, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS char_no_ws, length(text) - length(regexp_replace(text, '{_CJK}', '', 'g')) AS cjk_chars,
len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS en_words, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS numbers,
length(text) - length(regexp_replace(text, '{_CJK}', '', 'g')) + len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS word_total,
{_PIECES.format(r'\n\s*\n+')} AS paragraphs, {_PIECES.format(r'[。！？!?\.]+\s*|[\r\n]{2,}')} AS sentences, {_PIECES.format(_SEP)} AS lines"""


@_query("wc_counts", f"SELECT doc_id, {_COUNTS} FROM documents")
def wc_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Characters, words, sentences, paragraphs and lines of every document."""
    return table(spark, sf, "documents").select("doc_id", *(c.alias(n) for n, c in T.text_counts(F.col("text")).items()))


@_query(
    "wc_corpus",
    f"""SELECT source, count(*) AS documents, CAST(sum(char_total) AS BIGINT) AS chars, CAST(sum(word_total) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(lines) AS BIGINT) AS lines,
    round(sum(word_total) / count(*), 4) AS words_a_document FROM (SELECT source, {_COUNTS} FROM documents) GROUP BY source""",
)
def wc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the documents of each source."""
    counts = table(spark, sf, "documents").select("source", *(c.alias(n) for n, c in T.text_counts(F.col("text")).items()))
    total = lambda c, n: F.sum(c).cast("long").alias(n)
    return counts.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), total("char_total", "chars"), total("word_total", "words"), total("sentences", "sentences"), total("lines", "lines"),
        F.round(F.sum("word_total") / F.count(F.lit(1)), 4).alias("words_a_document"),
    )


@_query("wc_ranking", f"SELECT doc_id, word_total, row_number() OVER (ORDER BY word_total DESC, doc_id) AS place FROM (SELECT doc_id, {_COUNTS} FROM documents) ORDER BY place LIMIT 50")
def wc_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty documents with most words: a top-k report."""
    top = wc_counts(spark, sf).select("doc_id", "word_total").orderBy(F.desc("word_total"), "doc_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("word_total"), "doc_id")).cast("long"))


_STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS)))


@_query(
    "wc_top_words",
    f"""SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'))) AS term FROM documents)
    WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term ORDER BY n DESC, term LIMIT 20""",
)
def wc_top_words(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most frequent words of the corpus."""
    terms = table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(20)


@_query(
    "wc_top_words_by_lang",
    f"""SELECT lang, term, n, place FROM (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS place FROM (
    SELECT lang, term, count(*) AS n FROM (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'))) AS term FROM documents)
    WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY lang, term)) WHERE place <= 10""",
)
def wc_top_words_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("term"))
    counts = terms.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term")).cast("long")
    return counts.withColumn("place", place).filter("place <= 10")


_CJK_TEXT = "'電話簿與' || translate(CAST(c_custkey AS VARCHAR), '0123456789', '零一二三四五六七八九') || '，' || c_name || '臺北市'"


@_query(
    "wc_cjk_bigrams",
    f"""WITH t AS (SELECT c_custkey AS id, {_CJK_TEXT} AS s FROM customer), c AS (SELECT id, unnest(string_split(s, '')) AS ch, generate_subscripts(string_split(s, ''), 1) AS i FROM t),
    p AS (SELECT id, ch || lead(ch) OVER (PARTITION BY id ORDER BY i) AS term FROM c)
    SELECT term, count(*) AS n FROM p WHERE regexp_full_match(term, '{_CJK}{{2}}') GROUP BY term""",
)
def wc_cjk_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.translate(F.col("c_custkey").cast("string"), "0123456789", "零一二三四五六七八九")
    text = F.concat(F.lit("電話簿與"), digits, F.lit("，"), F.col("c_name"), F.lit("臺北市"))
    return table(spark, sf, "customer").select(F.explode(T.cjk_bigrams(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "wc_reading_time",
    f"SELECT doc_id, CAST(floor((2 * cjk_chars + 3 * en_words + 30) / 60) AS BIGINT) AS tenths FROM (SELECT doc_id, {_COUNTS} FROM documents)",
)
def wc_reading_time(spark: SparkSession, sf: str) -> DataFrame:
    c = T.text_counts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.reading_tenths(c["cjk_chars"], c["en_words"]).alias("tenths"))


@_query(
    "lang_detect",
    f"""SELECT doc_id, CASE WHEN c + l = 0 THEN 'auto' WHEN c > 0.3 * (c + l) THEN 'zh' ELSE 'en' END AS detected FROM (
    SELECT doc_id, length(h) - length(regexp_replace(h, '{_CJK}', '', 'g')) AS c, length(h) - length(regexp_replace(h, '[A-Za-z]', '', 'g')) AS l FROM (SELECT doc_id, substr(text, 1, 2000) AS h FROM documents))""",
)
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.language(F.col("text")).alias("detected"))


@_query(
    "sentence_split",
    r"""SELECT conv_id, turn, len(s) AS sentences, array_to_string(s, '¦') AS texts FROM (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '([.!?。！？])([A-Z])', '\1' || chr(1) || '\2', 'g'), '[\n\x01]+'),
    lambda x: regexp_matches(x, '\S')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS s FROM conversations)""",
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    found = T.sentences(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("sentences"), F.array_join(found, "¦").alias("texts"))


@_query("fragment_merge")
def fragment_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences after those of marks alone have been merged into the one before."""
    merged = T.merge_fragments(T.sentences(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(merged).alias("nth", "sentence"))


@_query(
    "batch_packing",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    r AS (SELECT conv_id, turn, i, n AS held, 1 AS items, 0 AS batch FROM t WHERE i = 1 UNION ALL
      SELECT t.conv_id, t.turn, t.i, CASE WHEN r.held + t.n > 1200 OR r.items >= 40 THEN t.n ELSE r.held + t.n END, CASE WHEN r.held + t.n > 1200 OR r.items >= 40 THEN 1 ELSE r.items + 1 END,
             r.batch + CASE WHEN r.held + t.n > 1200 OR r.items >= 40 THEN 1 ELSE 0 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
    SELECT conv_id, turn, batch FROM r""",
)
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation in order, cut into batches of at most 40 texts and 1,200 characters."""
    from ..operators.sequences import packed

    return packed(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text"), 40, 1200)


@_query(
    "csv_neutralise",
    r"SELECT part_key, CASE WHEN regexp_matches(cell, '^[=+\-@\t\r]') THEN '''' || cell ELSE cell END AS cell FROM (SELECT p_partkey AS part_key, CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || p_name AS cell FROM part)",
)
def csv_neutralise(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.when(F.col("p_partkey") % 4 == 0, "=").when(F.col("p_partkey") % 4 == 1, "-").otherwise("")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), T.neutral_cell(F.concat(lead, "p_name")).alias("cell"))


@_query(
    "page_markup",
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS BIGINT) AS tags, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_chars,
    regexp_matches(lower(html), '^\s*(<!doctype html|<html)') AS is_page FROM pages""",
)
def page_markup(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", T.matches(html, "<[a-zA-Z][^>]*>").cast("long").alias("tags"), F.length(F.regexp_replace(html, "<[^>]*>", "")).cast("long").alias("text_chars"), F.lower(html).rlike(r"^\s*(<!doctype html|<html)").alias("is_page"))


@_query(
    "error_pages",
    r"""WITH h AS (SELECT page_id, lower(left(regexp_replace(html, '^\s+', ''), 500)) AS t FROM pages)
    SELECT page_id, CASE WHEN NOT (regexp_matches(t, '^(<html|<!doctype|<head)') OR contains(left(t, 200), '<title>')) THEN ''
      WHEN regexp_extract(t, '(\b50[02-4]\b|\b40[0-9]\b)\s*(gateway|server error|timeout|unavailable|bad|forbidden|too many)', 1) <> '' THEN regexp_extract(t, '(\b50[02-4]\b|\b40[0-9]\b)\s*(gateway|server error|timeout|unavailable|bad|forbidden|too many)', 1)
      WHEN regexp_matches(t, 'gateway time-out|bad gateway|service unavailable') THEN coalesce(nullif(regexp_extract(t, '\b(50[02-4])\b', 1), ''), '5xx')
      WHEN contains(t, 'cloudflare') AND regexp_matches(t, 'error|timeout') THEN 'cf-error' ELSE 'html-body' END AS status FROM h""",
)
def error_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.error_page(F.col("html")).alias("status"))
