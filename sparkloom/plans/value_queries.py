"""Queries over personal data, entities, amounts, invoices, differences and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as C
from ..functions import invoices as I
from ..operators import diffs, pii
from ..operators import reconcile as X
from ..operators.sequences import page_ranges as ranges_of
from .tables import table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b"
_CARD = r"\b(?:\d[ \-]?){13,19}\b"
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[-i] AS INT) * 2 - CASE WHEN CAST(d[-i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(d[-i] AS INT) END)) % 10 = 0"""


@_query("pii_email_count", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_EMAIL}')) AS BIGINT) AS email FROM documents")
def pii_email_count(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counts(table(spark, sf, "documents"), ["email"])


@_query("pii_ip_count", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_IP}')) AS BIGINT) AS ip FROM documents")
def pii_ip_count(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counts(table(spark, sf, "documents"), ["ip"])


@_query("pii_network_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b')) AS BIGINT) AS mac, CAST(len(regexp_extract_all(text, '\b[A-Z][12]\d{8}\b')) AS BIGINT) AS ids FROM documents")
def pii_network_count(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.size(F.regexp_extract_all("text", F.lit(pii.BY_NAME["tw_id"].pattern), F.lit(0))).cast("long")
    macs = F.size(F.regexp_extract_all("text", F.lit(pii.BY_NAME["mac"].pattern), F.lit(0))).cast("long")
    return table(spark, sf, "documents").select("doc_id", macs.alias("mac"), ids.alias("ids"))


@_query(
    "pii_card_luhn",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CARD}')) AS v FROM documents), d AS (SELECT doc_id, v, regexp_replace(v, '[\\s-]', '', 'g') AS d FROM c)
    SELECT doc_id, trim(v) AS value, CAST({_LUHN} AS BOOLEAN) AS valid FROM d""",
)
def pii_card_luhn(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_CARD), F.lit(0))).alias("value"))
    return hits.select("doc_id", F.trim("value").alias("value"), C.card(F.col("value")).alias("valid"))


@_query(
    "pii_mask_email",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM documents)
    SELECT doc_id, value, CASE WHEN length(split_part(value, '@', 1)) <= 2 THEN repeat('*', length(split_part(value, '@', 1))) ELSE substr(value, 1, 2) || '***' END || '@' || regexp_extract(value, '@(.*)$', 1) AS masked FROM c""",
)
def pii_mask_email(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))).alias("value"))
    return hits.withColumn("masked", C.mask_email(F.col("value")))


@_query("pii_spans")
def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    return pii.spans(table(spark, sf, "documents"))


@_query(
    "pii_redact",
    f"""SELECT doc_id, regexp_replace(text, '{_EMAIL}', '(mail)', 'g') AS text FROM documents""",
)
def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    """Every e-mail address gives way to one word."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.chosen(["email"])).withColumn("fake", F.lit("(mail)"))
    return pii.rewrite(docs, found, "fake")


@_query("pii_pseudonymise")
def pii_pseudonymise(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kinds = pii.defaults() + pii.chosen(["ip"])
    return pii.rewrite(docs, pii.pseudonyms(pii.spans(docs, kinds)), "fake")


@_query("pii_redact_all")
def pii_redact_all(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks for all kinds that are on unless they are left out; pii_redact is what its SQL says, e-mail."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.rewrite(docs, pii.spans(docs, pii.defaults()), "redact")


@_query(
    "find_term",
    """SELECT doc_id, CAST(unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * 8)) AS INTEGER) AS start
    FROM (SELECT doc_id, string_split(lower(text), 'tion the') AS parts FROM documents)""",
)
def find_term(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_term(table(spark, sf, "documents"), "Tion The")


_KINDS = {"tax_id": X.ENTITIES["tax_id"], "case_number": X.ENTITIES["case_number"], "number": (r"\b(\d{3,7})\b", 0, 99)}
_ENT = r"""e AS (SELECT doc_id, 'tax_id' AS kind, unnest(regexp_extract_all(text, '\b(\d{8})\b', 1)) AS value FROM documents UNION ALL SELECT doc_id, 'case_number', unnest(regexp_extract_all(text, '\b([A-Z]{2,5}-?\d{2,4}-?\d{2,8})\b', 1)) FROM documents
  UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '\b(\d{3,7})\b', 1)) FROM documents)"""


@_query("entities", f"WITH {_ENT} SELECT doc_id, kind, value, count(*) AS n FROM e GROUP BY ALL")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return X.entities(table(spark, sf, "documents"), _KINDS)


@_query("entities_all")
def entities_all(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of all kinds, and numbers; `entities` has those of its SQL."""
    return X.entities(table(spark, sf, "documents"), X.ENTITIES | _KINDS)


@_query("entities_aggregate", f"WITH {_ENT} SELECT kind, value, count(*) AS total, count(DISTINCT doc_id) AS documents FROM e GROUP BY kind, value")
def entities_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return X.across(X.entities(table(spark, sf, "documents"), _KINDS))


@_query("duplicate_hash", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash(spark: SparkSession, sf: str) -> DataFrame:
    return X.duplicates(table(spark, sf, "documents"), F.col("text"))


@_query(
    "amount_digit_shift",
    """WITH v AS (SELECT l_orderkey AS d, CAST(round(l_quantity * 10) AS BIGINT) + l_partkey % 7 AS a FROM lineitem UNION ALL SELECT o_orderkey, CAST(o_totalprice / 1000 AS BIGINT) FROM orders),
    u AS (SELECT a, min(d) AS lo, max(d) AS hi FROM v GROUP BY a), f AS (SELECT unnest([10, 100, 1000]) AS factor)
    SELECT x.a AS amount, y.a AS other, CAST(factor AS INTEGER) AS factor FROM u x CROSS JOIN f JOIN u y ON y.a = x.a * factor WHERE x.a > 0 AND (x.lo <> y.lo OR x.hi <> y.hi OR x.lo <> x.hi)""",
)
def amount_digit_shift(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("d"), (F.round(F.col("l_quantity") * 10).cast("long") + F.col("l_partkey") % 7).alias("a"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("d"), F.round(F.col("o_totalprice") / 1000).cast("long").alias("a"))
    return X.digit_shifts(a.unionByName(b).filter("a > 0"), "d", "a")


SQL["amount_digit_shift"] = SQL["amount_digit_shift"].replace("CAST(o_totalprice / 1000 AS BIGINT)", "CAST(round(o_totalprice / 1000) AS BIGINT)")


@_query(
    "identity_outlier",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, event_type AS top FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) = 1)
    SELECT user_id, event_type, n, top FROM c JOIN t USING (user_id) WHERE event_type <> top""",
)
def identity_outlier(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return X.outliers(counts, "user_id", "event_type", "n")


@_query(
    "typing_errors",
    """WITH v AS (SELECT DISTINCT p_name || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE 'xy' END AS value FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
    d AS (SELECT value, name, levenshtein(value, name) AS distance FROM v, n), g AS (SELECT * FROM d WHERE distance BETWEEN 1 AND 3 AND distance < 0.4 * least(length(value), length(name)) AND length(value) >= 4)
    SELECT value, name, CAST(distance AS INTEGER) AS distance FROM g QUALIFY row_number() OVER (PARTITION BY value ORDER BY distance, name) = 1""",
)
def typing_errors(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "").otherwise("xy")
    part = table(spark, sf, "part")
    return X.typing_errors(part.select(F.concat("p_name", tail).alias("value")), part.select(F.col("p_name").alias("name")).distinct())


_FINDINGS = """f AS (SELECT l_orderkey AS case_id, l_orderkey || '-' || l_linenumber AS key, CASE WHEN l_discount > 0.08 THEN 'fail' WHEN l_discount > 0.06 THEN 'warn' ELSE 'info' END AS severity FROM lineitem)"""


def _severity() -> Column:
    return F.when(F.col("l_discount") > 0.08, "fail").when(F.col("l_discount") > 0.06, "warn").otherwise("info")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), _severity().alias("severity"))


@_query("case_score", f"WITH {_FINDINGS} SELECT case_id, count(*) FILTER (WHERE severity = 'fail') AS fail, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, greatest(0, 100 - 10 * count(*) FILTER (WHERE severity = 'fail') - 3 * count(*) FILTER (WHERE severity = 'warn')) AS score FROM f GROUP BY case_id")
def case_score(spark: SparkSession, sf: str) -> DataFrame:
    return X.scores(_findings(spark, sf), "case_id")


@_query("override_apply", f"WITH {_FINDINGS} SELECT key, case_id, CASE WHEN key IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag = 'R') THEN 'info' ELSE severity END AS severity FROM f")
def override_apply(spark: SparkSession, sf: str) -> DataFrame:
    overrides = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return X.overridden(_findings(spark, sf), overrides)


# Other names of the two above.
for _name in ("case_score", "override_apply"):
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]


@_query("diff_keyed", "WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 3 <> 0) SELECT k, a.v AS before, b.v AS after FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v")
def diff_keyed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    changed = rows.withColumn("v", F.when(F.col("k") % 7 == 0, "CHANGED").otherwise(F.col("v")))
    return X.keyed_diff(rows.filter("k % 5 <> 0"), changed.filter("k % 3 <> 0"), "k", "v")


@_query("diff_lines")
def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation against the next one."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("pair"), "conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return diffs.line_diff(turns.join(after, ["conv_id", "turn"]), "pair", "text", "next")


@_query(
    "invoice_period_sum",
    """WITH d AS (SELECT o_totalprice, date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS m FROM orders)
    SELECT year(m) AS year, CAST(ceil(month(m) / 2.0) AS INTEGER) AS period, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM d GROUP BY 1, 2""",
)
def invoice_period_sum(spark: SparkSession, sf: str) -> DataFrame:
    start, _, number = I.period_of(F.col("o_orderdate").cast("date"))
    rows = table(spark, sf, "orders").select(F.year(start).cast("long").alias("year"), number.alias("period"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return rows.groupBy("year", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@_query(
    "date_formats",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y/%m/%d') AS slash, strftime(o_orderdate, '%Y年%m月%d日') AS chinese, lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0') || strftime(o_orderdate, '/%m/%d') AS roc,
    '民國' || (year(o_orderdate) - 1911) || strftime(o_orderdate, '年%m月%d日') AS roc_chinese FROM orders""",
)
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", *(I.date_format(day, h).alias(h) for h in ("iso", "slash", "chinese", "roc", "roc_chinese")))


@_query("amount_formats", "SELECT o_orderkey, CAST(a AS VARCHAR) AS plain, format('{:,}', a) AS comma, 'NT$ ' || format('{:,}', a) AS currency FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders)")
def amount_formats(spark: SparkSession, sf: str) -> DataFrame:
    a = F.floor("o_totalprice").cast("long")
    return table(spark, sf, "orders").select("o_orderkey", *(I.amount_format(a, h).alias(h) for h in ("plain", "comma", "currency")))


_CODE = """c AS (SELECT o_orderkey, 'AB' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0') || CASE WHEN o_orderkey % 11 = 0 THEN '1399' ELSE strftime(o_orderdate, '%m%d') END || '1234' || lpad(upper(to_hex(CAST(floor(o_totalprice) AS BIGINT))), 8, '0')
  || lpad(upper(to_hex(CAST(floor(o_totalprice * 1.05) AS BIGINT))), 8, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '00000000' ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END || lpad(CAST(o_custkey + 7 AS VARCHAR), 8, '0') || repeat('x', 24) AS s FROM orders)"""


@_query(
    "invoice_qr_parse",
    f"""WITH {_CODE} SELECT o_orderkey, substr(s, 1, 10) AS invoice_number, strftime(try_cast((CAST(substr(s, 11, 3) AS INT) + 1911) || '-' || substr(s, 14, 2) || '-' || substr(s, 16, 2) AS DATE), '%Y-%m-%d') AS day,
    CAST('0x' || substr(s, 22, 8) AS BIGINT) AS amount_untaxed, CAST('0x' || substr(s, 30, 8) AS BIGINT) AS amount_total, nullif(substr(s, 38, 8), '00000000') AS buyer_vat, substr(s, 46, 8) AS seller_vat FROM c""",
)
def invoice_qr_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Codes written from the orders, and read back."""
    hexa = lambda x: F.lpad(F.hex(F.floor(x).cast("long")), 8, "0")
    pad = lambda x: F.lpad(x.cast("string"), 8, "0")
    day = F.col("o_orderdate").cast("date")
    code = F.concat(
        F.lit("AB"), pad(F.col("o_orderkey")), F.lpad((F.year(day) - 1911).cast("string"), 3, "0"), F.when(F.col("o_orderkey") % 11 == 0, "1399").otherwise(F.date_format(day, "MMdd")), F.lit("1234"), hexa(F.col("o_totalprice")),
        hexa(F.col("o_totalprice") * 1.05), F.when(F.col("o_orderkey") % 2 == 0, "00000000").otherwise(pad(F.col("o_custkey"))), pad(F.col("o_custkey") + 7), F.repeat(F.lit("x"), F.lit(24)),
    )
    f = I.qr_fields(F.col("s"))
    rows = table(spark, sf, "orders").select("o_orderkey", code.alias("s"))
    return rows.select("o_orderkey", f["invoice_number"].alias("invoice_number"), F.date_format(f["date"], "yyyy-MM-dd").alias("day"), *(f[k].alias(k) for k in ("amount_untaxed", "amount_total", "buyer_vat", "seller_vat")))


@_query(
    "invoice_qr_items",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'item ' || o_orderkey || '|box ' || o_custkey WHEN 1 THEN o_orderpriority || '|' || o_clerk END AS items
    FROM (SELECT o_orderkey, o_custkey, o_orderpriority, 'c' || o_custkey % 9 AS o_clerk FROM orders)""",
)
def invoice_qr_items(spark: SparkSession, sf: str) -> DataFrame:
    """Second codes written from orders: counted lists, triples, triples without a number, and encrypted lists."""
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    code = F.when(F.col("o_orderkey") % 4 == 0, text("**1:0:0:2:2:UTF8:item ", key, ": box ", who, "::**x")).when(F.col("o_orderkey") % 4 == 1, text("**:", F.col("o_orderpriority"), ":2:7.50:c", (F.col("o_custkey") % 9).cast("string"), ":1:", key))
    code = code.when(F.col("o_orderkey") % 4 == 2, text("**:a:1:2:b:x:", key)).otherwise(text("**1:0:1:5:5:Big5:", key))
    items = I.qr_items(code)
    return table(spark, sf, "orders").select("o_orderkey", F.when(items.isNotNull(), F.array_join(items, "|")).alias("items"))


_SUM = "list_sum(list_transform(range(1, len({w}) + 1), lambda i: CAST(({s})[i] AS BIGINT) * ({w})[i]))"
_BUSINESS = "list_sum(list_transform(range(1, 9), lambda i: CAST(biz[i] AS BIGINT) * [1, 2, 1, 2, 1, 2, 4, 1][i] // 10 + CAST(biz[i] AS BIGINT) * [1, 2, 1, 2, 1, 2, 4, 1][i] % 10))"


@_query(
    "checksums",
    f"""WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 10 + c_nationkey % 10 AS VARCHAR), 8, '0') AS num, lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS biz FROM customer)
    SELECT c_custkey, {_SUM.format(s="'101' || num", w="[1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]")} % 10 = 0 AS tw_id, {_BUSINESS} % 10 = 0 OR biz[7] = '7' AND ({_BUSINESS} + 1) % 10 = 0 AS tw_business,
    list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CAST(('41110000' || num)[i] AS BIGINT) * 2 // 10 + CAST(('41110000' || num)[i] AS BIGINT) * 2 % 10 ELSE CAST(('41110000' || num)[i] AS BIGINT) END)) % 10 = 0 AS card,
    CAST('32142829' || num || biz || '1611' || right(num, 2) AS HUGEINT) % 97 = 1 AS iban,
    CAST(right(num, 1) AS BIGINT) = CASE WHEN {_SUM.format(s="'1234' || num", w="[6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]")} % 11 <= 1 THEN 0 ELSE 11 - {_SUM.format(s="'1234' || num", w="[6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]")} % 11 END AS jp_number FROM n""",
)
def checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of five kinds written from customers, most of which fail their check."""
    key = F.col("c_custkey")
    num, biz = F.lpad((key * 10 + F.col("c_nationkey") % 10).cast("string"), 8, "0"), F.lpad((key * 7919 % 100000000).cast("string"), 8, "0")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    values = {"tw_id": C.tw_id(text("A1", num)), "tw_business": C.tw_business(biz), "card": C.card(text("4111 0000 ", F.left(num, F.lit(4)), "-", F.right(num, F.lit(4)))), "iban": C.iban(text("GB", F.right(num, F.lit(2)), " WEST", num, " ", biz)), "jp_number": C.jp_number(text("1234", num))}
    return table(spark, sf, "customer").select("c_custkey", *(v.alias(k) for k, v in values.items()))


@_query("masks", "SELECT p_partkey, substr(p_brand, 1, 2) || repeat('*', length(p_brand) - 3) || substr(p_brand, length(p_brand), 1) AS plate, substr(p_name, 1, 1) || repeat('O', length(p_name) - 2) || substr(p_name, length(p_name), 1) AS name, regexp_replace(p_name, '[^\\s,.#/-]', '*', 'g') AS address FROM part")
def masks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.keep_edges(F.col("p_brand"), 2, 1).alias("plate"), C.mask_name(F.col("p_name")).alias("name"), C.mask_address(F.col("p_name")).alias("address"))


SQL["masks"] = SQL["masks"].replace("\\\\s", "\\s")


@_query(
    "page_ranges",
    """SELECT p_partkey, array_to_string(list_filter([array_to_string(list_filter(range(p_size, p_size + 4), lambda x: x <= 50), ','), CASE WHEN p_partkey % 60 BETWEEN 1 AND 50 THEN CAST(p_partkey % 60 AS VARCHAR) ELSE '' END, '48,49,50', '1,2'], lambda x: x <> ''), '|') AS parts FROM part""",
)
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Page lists written from parts: a range, a page that may be none, open ends and a part that is no range."""
    size, page = F.col("p_size").cast("int"), (F.col("p_partkey") % 60).cast("string")
    spec = F.concat(size.cast("string"), F.lit("-"), (size + 3).cast("string"), F.lit(", "), page, F.lit(",48-,x,-2"))
    parts = ranges_of(spec, F.lit(50))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(parts, lambda r: F.array_join(r.cast("array<string>"), ",")), "|").alias("parts"))
