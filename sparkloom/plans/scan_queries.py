"""Queries over scanned codes, edits of records, cursors, and what is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import invoices as I
from ..functions import labels as L
from ..operators import records as R
from ..operators import summaries as Y
from ..sources import exports as X
from .tables import table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CODES = """c AS (SELECT o_custkey AS batch, o_orderkey AS pos, CASE WHEN o_orderkey % 5 < 2 THEN 'AB' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS number, CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'i' || o_orderkey || '|j' END AS items,
  row_number() OVER (PARTITION BY o_custkey, CASE WHEN o_orderkey % 5 < 2 THEN 0 WHEN o_orderkey % 5 < 4 THEN 1 ELSE 2 END ORDER BY o_orderkey) AS nth FROM orders)"""


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    code = F.when(key % 5 < 2, F.concat(F.lit("AB"), F.lpad(key.cast("string"), 8, "0"), F.repeat(F.lit("0"), F.lit(70)))).when(key % 5 < 4, F.concat(F.lit("**:i"), key.cast("string"), F.lit(":1:2:j:3:4"))).otherwise(F.when(key % 2 == 0, F.concat(F.lit("junk "), key.cast("string"))))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), key.alias("pos"), code.alias("code"))


@_query("qr_pairs", f"WITH {_CODES} SELECT coalesce(a.batch, b.batch) AS batch, coalesce(a.nth, b.nth) AS nth, a.number AS invoice_number, b.items FROM (SELECT * FROM c WHERE number IS NOT NULL) a FULL JOIN (SELECT * FROM c WHERE items IS NOT NULL) b ON a.batch = b.batch AND a.nth = b.nth")
def qr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return R.zipped(_codes(spark, sf))[0].withColumn("items", F.when(F.col("items").isNotNull(), F.array_join("items", "|")))


@_query(
    "qr_stats",
    f"""WITH {_CODES} SELECT batch, count(number) AS invoices, count(items) AS lists, count_if(number IS NULL AND items IS NULL) AS unknown,
    coalesce(string_agg(CASE WHEN number IS NULL AND items IS NULL AND nth <= 3 THEN CASE WHEN pos % 2 = 0 THEN 'junk ' || pos ELSE '(empty)' END END, '|' ORDER BY pos), '') AS samples FROM c GROUP BY batch""",
)
def qr_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.zipped(_codes(spark, sf))[1].withColumn("samples", F.array_join("samples", "|"))


@_query(
    "items_attached",
    """WITH l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey)
    SELECT o.o_custkey AS user, o_orderkey AS id, 'a|b' || CASE WHEN o_orderkey = latest AND o.o_custkey % 3 <> 0 THEN '|c' || o.o_custkey ELSE '' END AS items FROM orders o JOIN l USING (o_custkey)""",
)
def items_attached(spark: SparkSession, sf: str) -> DataFrame:
    who = F.col("o_custkey")
    held = table(spark, sf, "orders").select(who.alias("user"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("added"), F.col("o_orderdate").alias("scanned_at"), F.array(F.lit("a"), F.lit("b")).alias("items"))
    new = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user"), F.posexplode(F.array(F.lit("b"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("a"))).alias("pos", "item"))
    return R.attached(held, new).select("user", "id", F.array_join("items", "|").alias("items"))


@_query(
    "notes_updated",
    """WITH c AS (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY l_orderkey)
    SELECT o_orderkey AS id, CASE WHEN last IS NOT NULL THEN 'line ' || last ELSE o_orderpriority END AS note, o_orderstatus AS status FROM (SELECT *, 'P' AS o_orderstatus FROM (SELECT o_orderkey, o_orderpriority FROM orders)) LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def notes_updated(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of notes are taken, those of other fields are refused."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"), F.lit("P").alias("status"))
    n = F.col("l_linenumber")
    changes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(n % 2 == 0, "note").otherwise("status").alias("field"), F.concat(F.lit("line "), n.cast("string")).alias("value"), n.alias("at"))
    return R.updated(rows, changes)


@_query(
    "results_cursor",
    """WITH r AS (SELECT o_custkey AS job, o_orderkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT job, count(*) AS total FROM r GROUP BY job),
    c AS (SELECT c_custkey AS job, coalesce(total, 0) AS total, greatest(0, least(c_custkey % 9 - 2, coalesce(total, 0))) AS start FROM customer LEFT JOIN n ON job = c_custkey)
    SELECT c.job, c.start, c.total, r.pos, r.line FROM c LEFT JOIN r ON r.job = c.job AND r.pos >= c.start""",
)
def results_cursor(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    results = table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("line"), pos.alias("pos"))
    return R.results_from(results, table(spark, sf, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 9 - 2).alias("start")))


@_query(
    "recent_periods",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT o_orderkey, day, unnest(range(0, 18)) AS i FROM d),
    q AS (SELECT o_orderkey, day, make_date(year(day) - i // 6, (6 - i % 6) * 2 - 1, 1) AS s FROM p), k AS (SELECT * FROM q WHERE s <= day QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s DESC) <= 4)
    SELECT o_orderkey, string_agg(strftime(s, '%Y-%m-%d') || ' ' || strftime(s + INTERVAL 2 MONTH - INTERVAL 1 DAY, '%m-%d') || CASE WHEN s + INTERVAL 2 MONTH - INTERVAL 1 DAY >= day THEN ' now' ELSE '' END, '|' ORDER BY s DESC) AS periods FROM k GROUP BY o_orderkey""",
)
def recent_periods(spark: SparkSession, sf: str) -> DataFrame:
    last = I.recent_periods(F.col("o_orderdate").cast("date"), 4)
    told = F.transform(last, lambda p: F.concat(p["start"].cast("string"), F.lit(" "), F.date_format(p["end"], "MM-dd"), F.when(p["running"], " now").otherwise("")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(told, "|").alias("periods"))


@_query("tax_derived", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) - o_custkey END AS tax FROM orders")
def tax_derived(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", I.tax(F.floor("o_totalprice").cast("long"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))).alias("tax"))


@_query("categories_chosen", "SELECT c_custkey FROM customer WHERE c_nationkey % 4 <> 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')")
def categories_chosen(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.when(F.col("c_nationkey") % 4 == 0, '["BUILDING", "MACHINERY"]').when(F.col("c_nationkey") % 4 == 1, "[]").when(F.col("c_nationkey") % 4 == 2, "no list")
    return table(spark, sf, "customer").filter(R.in_json(F.col("c_mktsegment"), lists)).select("c_custkey")


@_query("finding_hints", "SELECT event_id, CASE event_type WHEN 'click' THEN 'editor' ELSE '' END AS tool, CASE event_type WHEN 'click' THEN 'check the amount' WHEN 'error' THEN 'nothing to do' ELSE '' END AS hint FROM events")
def finding_hints(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "events").select("event_id", F.col("event_type").alias("category"))
    return R.with_hints(found, {"click": ("editor", "check the amount"), "error": ("", "nothing to do")}).drop("category")


@_query("bilingual_lines", "SELECT conv_id AS doc, turn AS pos, '| ' || replace(replace(text, '|', '\\|'), chr(10), '<br>') || ' | ' || role || '\\| |' AS md, rtrim(text, ' ' || chr(10)) || chr(10) || role || '|' || chr(10) AS txt FROM conversations")
def bilingual_lines(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("text").alias("source"), F.concat("role", F.lit("|")).alias("target"))
    return X.bilingual_lines(pairs, "md").withColumnRenamed("line", "md").join(X.bilingual_lines(pairs, "txt").withColumnRenamed("line", "txt"), ["doc", "pos"])


_NOTE = "CASE event_id % 3 WHEN 0 THEN 'first' || chr(10) || 'second ' || event_id WHEN 1 THEN '' END"


@_query(
    "annotation_lines",
    f"""SELECT event_id AS id, '- **第 ' || event_id % 7 || ' 頁** · ' || event_type || ' · ' || CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE '(未署名)' END || chr(10) || CASE event_id % 3 WHEN 0 THEN '  > first' || chr(10) || '  > second ' || event_id ELSE '  > (無內容)' END || chr(10) AS review,
    '- [ ] **第 ' || event_id % 7 || ' 頁**: ' || coalesce(nullif({_NOTE}, ''), CASE WHEN event_id % 2 = 0 THEN 'subject' END, event_type) || ' _(來源:' || CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE '?' END || ' · ' || event_type || ')_' AS task FROM events""",
)
def annotation_lines(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    annots = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("doc"), key.alias("id"), (key % 7).alias("page"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("author"),
        F.when(key % 2 == 0, "subject").alias("subject"), F.when(key % 3 == 0, F.concat(F.lit("first\nsecond "), key.cast("string"))).when(key % 3 == 1, "").alias("content"),
    )
    both = X.annotation_lines(annots, "review").select("id", F.col("line").alias("review")).join(X.annotation_lines(annots, "task").select("id", F.col("line").alias("task")), "id")
    return both


@_query(
    "text_dates_expiring",
    """SELECT o_orderkey, count(DISTINCT d) AS n, strftime(min(d), '%Y-%m-%d') AS first FROM (SELECT o_orderkey, unnest([day, day + 400, day]) AS d FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 30 YEAR AS DATE) AS day FROM orders)) WHERE d > DATE '2026-01-01' AND d < DATE '2027-01-01' GROUP BY o_orderkey""",
)
def text_dates_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """Days in texts that lie between two days."""
    day = F.add_months(F.col("o_orderdate").cast("date"), 360)
    text = F.concat(F.lit("valid from "), F.date_format(day, "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.date_add(day, 400), "yyyy/MM/dd"), F.lit(" ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")"))
    found = Y.expiring(table(spark, sf, "orders"), "o_orderkey", text, F.lit("2026-01-01").cast("date"), F.lit("2027-01-01").cast("date"))
    return found.withColumn("first", F.date_format("first", "yyyy-MM-dd"))


@_query(
    "cases_deleted",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '1999-01-01' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09) THEN '2024-01-30' END AS deleted_at FROM orders",
)
def cases_deleted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "1999-01-01").alias("deleted_at"))
    return Y.soft_deleted(rows, table(spark, sf, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("id")), F.lit("2024-01-30"))


@_query(
    "users_online",
    """WITH s AS (SELECT user_id, ts, event_id % 3 > 0 AS open FROM events) SELECT c_custkey AS user_id, c_name, count(*) AS n, max(epoch_us(ts)) AS last_us FROM s JOIN customer ON c_custkey = user_id
    WHERE open AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 2 DAY GROUP BY c_custkey, c_name""",
)
def users_online(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sessions, two of three of which have not expired, met with their users."""
    now = F.lit("2024-01-20").cast("timestamp")
    at = F.col("ts").cast("timestamp")
    sessions = table(spark, sf, "events").select("user_id", at.alias("last_seen_at"), F.when(F.col("event_id") % 3 > 0, F.lit("2030-01-01").cast("timestamp")).otherwise(F.lit("2000-01-01").cast("timestamp")).alias("expires_at"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return Y.online(sessions, users, now, 2 * 86400).select("user_id", "c_name", "n", F.unix_micros("last_seen_at").alias("last_us"))


@_query(
    "tax_ids_found",
    """WITH t AS (SELECT o_orderkey, unnest(list_distinct([lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), lpad(CAST(o_custkey * 7 AS VARCHAR), 8, '0')])) AS value FROM orders),
    d AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: CAST(value[i] AS BIGINT) * [1, 2, 1, 2, 1, 2, 4, 1][i] // 10 + CAST(value[i] AS BIGINT) * [1, 2, 1, 2, 1, 2, 4, 1][i] % 10)) AS s FROM t)
    SELECT o_orderkey, value, s % 10 = 0 OR value[7] = '7' AND (s + 1) % 10 = 0 AS valid FROM d""",
)
def tax_ids_found(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of eight digits in texts written from orders, beside longer and repeated ones."""
    a, b = F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lpad((F.col("o_custkey") * 7).cast("string"), 8, "0")
    text = F.concat(F.lit("no. "), a, F.lit("，統編"), b, F.lit(" 123456789 "), a, F.lit("1"), F.lit(" ("), a, F.lit(")"))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(L.tax_ids(text)).alias("x")).select("o_orderkey", "x.value", "x.valid")
