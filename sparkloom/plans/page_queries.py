"""Queries over pages, cells, blocks and forms of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment, pii
from ..operators import cells as C
from ..operators import forms as O
from ..operators import receipts as R
from .tables import spread, table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cut(spark: SparkSession, sf: str, lines: int) -> DataFrame:
    """(doc_id, t): the pages of each document, of so many lines; null without lines, as a filter on their number would be put below the split and split again."""
    each = table(spark, sf, "documents").select("doc_id", T.split_lines(F.col("text")).alias("l"))
    n = F.ceil(F.size("l") / lines).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.array_join(F.slice("l", p * lines + 1, lines), "\n"))
    return each.select("doc_id", F.when(F.size("l") > 0, cut).alias("t"))


def _each_page(docs: DataFrame, pages: Column) -> DataFrame:
    """(doc_id, page, text). The outer form, as the plain one has a filter on its size put below it, which splits the text again for every page."""
    return docs.select("doc_id", F.posexplode_outer(pages).alias("page", "text")).filter("page is not null")


def pages(spark: SparkSession, sf: str, lines: int = 4) -> DataFrame:
    """(doc_id, page, text): documents cut into pages of so many lines."""
    return _each_page(_cut(spark, sf, lines), F.col("t"))


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pages of documents, and of a later version: a page put in, every eleventh left out, every seventh changed."""
    docs = _cut(spark, sf, 4)

    def later(text: Column, page: Column) -> Column:
        some = F.col("doc_id") + page
        changed = F.when(some % 7 == 0, F.regexp_replace(text, "e", "E")).otherwise(text)
        return F.array_compact(F.array(F.when(page == F.col("doc_id") % 3, F.concat(F.lit("a page that is new in document "), F.col("doc_id").cast("string"))), F.when(some % 11 != 0, changed)))

    return _each_page(docs, F.col("t")), _each_page(docs, F.flatten(F.transform("t", later)))


@_query("page_pairing")
def page_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.page_pairs(*versions(spark, sf), "doc_id")


@_query("document_compare")
def document_compare(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.document_totals(*versions(spark, sf), "doc_id")


# cells of a form: a label and its value side by side, or one under the other, in columns and rows that customers share
_LABELS = ["Date of Birth:", "Account No:", "Contact Person:", "Passport No.", "Remarks"]
_CELL_SQL = """c AS (SELECT c_custkey % 3000 AS page, c_custkey * 10 + k AS id, CAST((c_custkey // 3000 % 4) * 150 + CASE WHEN c_custkey % 2 = 0 THEN k % 2 * 90 ELSE 0 END + c_custkey % 7 AS DOUBLE) AS x0,
  CAST((c_custkey // 12000) * 60 + k // 2 * 40 + CASE WHEN c_custkey % 2 = 1 THEN k % 2 * 14 ELSE 0 END + c_custkey % 3 AS DOUBLE) AS y0, 40.0 + c_custkey % 40 AS w, 9.0 + c_custkey % 5 AS h FROM customer, unnest(range(6)) AS t(k))"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as three pairs of cells each, many customers to a page."""
    key, k = F.col("c_custkey"), F.col("k")
    rows = table(spark, sf, "customer").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    x0 = F.floor(key / 3000) % 4 * 150 + F.when(key % 2 == 0, k % 2 * 90).otherwise(0) + key % 7
    y0 = F.floor(key / 12000) * 60 + F.floor(k / 2) * 40 + F.when(key % 2 == 1, k % 2 * 14).otherwise(0) + key % 3
    label = F.element_at(F.array(*map(F.lit, _LABELS)), ((key + F.floor(k / 2)) % 5 + 1).cast("int"))
    kind = (key + F.floor(k / 2)) % 5
    value = (
        F.when(kind == 0, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (key % 9000).cast("int")), "yyyy-MM-dd")).when(kind == 1, F.concat(F.lit("12-"), F.lpad(key.cast("string"), 8, "0")))
        .when(kind == 2, F.concat(F.lit("Ann Customer"), F.translate((key % 1000).cast("string"), "0123456789", "abcdefghij"))).when(kind == 3, F.concat(F.lit("AB"), F.lpad(key.cast("string"), 7, "0"))).otherwise(F.lit("銀行帳號"))
    )
    text = F.when(k % 2 == 0, label).otherwise(value)
    x0, y0 = x0.cast("double"), y0.cast("double")
    return rows.select((key % 3000).alias("page"), (key * 10 + k).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 40 + key % 40).alias("x1"), (y0 + 9 + key % 5).alias("y1"), text.alias("text"))


@_query(
    "cell_neighbours",
    f"""WITH {_CELL_SQL}, b AS (SELECT page, id, x0, y0, x0 + w AS x1, y0 + h AS y1, w, h FROM c)
    SELECT a.page, a.id, 'right' AS side, arg_min(o.id, (o.x0 - a.x1, o.id)) AS other FROM b a JOIN b o ON o.page = a.page AND o.id <> a.id
    WHERE least(a.y1, o.y1) - greatest(a.y0, o.y0) > 0.5 * least(a.h, o.h) AND o.x0 >= a.x1 - 2 AND o.x0 - a.x1 <= 300 GROUP BY a.page, a.id
    UNION ALL SELECT a.page, a.id, 'below', arg_min(o.id, (o.y0 - a.y1, o.id)) FROM b a JOIN b o ON o.page = a.page AND o.id <> a.id
    WHERE least(a.x1, o.x1) - greatest(a.x0, o.x0) > 0.3 * least(a.w, o.w) AND o.y0 - a.y1 BETWEEN 0 AND 1.6 * a.h GROUP BY a.page, a.id""",
)
def cell_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return C.neighbours(cells(spark, sf))


@_query("cell_findings")
def cell_findings(spark: SparkSession, sf: str) -> DataFrame:
    return C.findings(cells(spark, sf), pii.defaults() + pii.chosen(["person_name"]))


# receipts written from orders in four layouts, and letters that are none
_RECEIPT_SQL = """r AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey // 5 AS n, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(floor(o_totalprice) AS BIGINT) AS price, o_custkey AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'thsrc' WHEN 1 THEN 'tra' WHEN 2 THEN 'uber_trip' WHEN 3 THEN 'uber_invoice' END AS kind, CASE WHEN k < 4 THEN day END AS day,
CASE k WHEN 0 THEN 'S' || c WHEN 1 THEN 'S' || c WHEN 2 THEN '高雄市甲區' || c || '號' END AS origin, CASE k WHEN 0 THEN 'T' || c % 7 WHEN 1 THEN 'T' || c % 7 WHEN 2 THEN 'Place ' || c END AS destination,
CASE k WHEN 0 THEN lpad(CAST(n % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') WHEN 1 THEN n % 24 || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') WHEN 2 THEN lpad(CAST(n % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') END AS depart,
CASE WHEN k < 4 THEN price END AS fare, CASE k WHEN 0 THEN 'T' || c WHEN 1 THEN 'N' || lpad(CAST(c AS VARCHAR), 14, '0') WHEN 3 THEN 'AB' || lpad(CAST(c AS VARCHAR), 8, '0') END AS ticket, CASE WHEN k = 4 THEN 'unknown kind' END AS problem FROM r"""


@_query("receipts_parsed", f"WITH {_RECEIPT_SQL}")
def receipts_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Receipts in the layouts of two railways, of rides and of their fees, written from orders and read back."""
    key, n, c = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 5), F.col("o_custkey").cast("string")
    day, price = F.col("o_orderdate"), F.format_number(F.floor("o_totalprice"), 0)
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    to, minute = F.concat(F.lit("T"), (F.col("o_custkey") % 7).cast("string")), two(n % 60)
    fast = F.concat(line("台灣高鐵"), line("乘車日期： ", F.date_format(day, "yyyy/M/d"), " ", (n % 24).cast("string"), ":", minute, ":00"), line("起程站 : 高鐵S", c, "站"), line("到達站："), line(to, "車站"), line("票價："), line("NT$ ", price), line("票號: T", c))
    rail = F.concat(line("購票證明 印製日期"), line("1990/01/01"), line(F.date_format(day, "yyyy/MM/dd")), line((n % 24).cast("string"), ":", minute, " S", c, " ＞ 23:59 ", to), line("自強(3000) 477 車次 全票"), line(price, " 元 N", F.lpad(c, 14, "0")))
    half, hour = F.when(n % 24 < 12, "上午").otherwise("下午"), F.when(n % 12 == 0, 12).otherwise(n % 12).cast("string")
    ride = F.concat(line("Uber ", F.date_format(day, "yyyy 年 M 月 d 日")), line("上午 0:01"), line("叫車時間"), line("總計"), line("$", price, ".00"), line("行程詳細資訊"), line(half, " ", hour, ":", minute), line("TWN80041台灣 高雄市高雄市甲區", c, "號"), line("下午 11:59"), line("Place ", c))
    fee = F.concat(line("電子發票證明聯 優步"), line("發票號碼：AB-", F.lpad(c, 8, "0")), line(F.date_format(day, "yyyy-MM-dd")), line("總計: ", price))
    text = F.when(key % 5 == 0, fast).when(key % 5 == 1, rail).when(key % 5 == 2, ride).when(key % 5 == 3, fee).otherwise(line("a letter of ", c))
    # parsing a receipt costs far more than moving an order
    read = R.parsed(spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")).select("o_orderkey", text.alias("text")))
    return read.select("o_orderkey", "kind", "receipt.day", "receipt.origin", "receipt.destination", F.col("receipt.depart_time").alias("depart"), "receipt.fare", F.col("receipt.ticket_no").alias("ticket"), "problem")


# parts as fields of forms, suppliers' nations as forms with options
_FORM_SQL = """o AS (SELECT s_nationkey AS form, s_suppkey AS option, s_suppkey AS place, ['電匯', 'T/T', 'ＮＴＤ', '10人以下', '11~50人', '51以上', 'Cash', '月結 30 天', 'Check'][s_suppkey % 9 + 1] AS raw FROM supplier),
ot AS (SELECT *, replace(replace(replace(replace(lower(raw), 'ｎｔｄ', 'ntd'), ' ', ''), '電', '电'), '內', '内') AS t FROM o),
v AS (SELECT DISTINCT p_partkey % 25 AS form, p_partkey % 7 AS field, ['電匯、匯款', '台幣', '7', '33', '月結三十天', '現金', 'wire'][p_partkey % 7 + 1] AS value FROM part),
w(value, nth, c) AS (VALUES ('電匯、匯款', 0, '电匯、匯款'), ('台幣', 0, '台币'), ('台幣', 1, 'ntd'), ('台幣', 2, 'twd'), ('台幣', 3, '新台币'), ('台幣', 4, '新台币'), ('台幣', 5, '台币'), ('台幣', 6, 'ntd'), ('台幣', 7, 'twd'), ('台幣', 8, '新台币'), ('台幣', 9, '新台币'), ('台幣', 10, 'ntd'), ('台幣', 11, 'twd'),
  ('7', 0, '7'), ('33', 0, '33'), ('現金', 0, '現金'), ('現金', 1, 'cash'), ('wire', 0, 'wire'), ('wire', 1, '电匯'), ('wire', 2, 't/t'), ('wire', 3, 'tt'), ('月結三十天', 0, '月結三十天'), ('月結三十天', 1, '30'), ('月結三十天', 2, '三十'), ('月結三十天', 3, '30天'), ('月結三十天', 4, '三十天'), ('月結三十天', 5, '月結30天'),
  ('月結三十天', 6, '月結30'), ('月結三十天', 7, 'net30'), ('月結三十天', 8, 'net30days')),
f AS (SELECT v.*, option, place, 0 AS stage, 0 AS nth, 0 AS how FROM v JOIN ot USING (form) WHERE value = '7' AND t = '10人以下' OR value = '33' AND t = '11~50人'
  UNION ALL SELECT v.*, option, place, 1, nth, 0 FROM v JOIN w USING (value) JOIN ot ON ot.form = v.form AND c = t
  UNION ALL SELECT v.*, option, place, 2, nth, CASE WHEN contains(c, t) THEN 0 ELSE 1 END FROM v JOIN w USING (value) JOIN ot ON ot.form = v.form AND (contains(c, t) OR contains(t, c)))"""


def _forms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    key, part = F.col("s_suppkey"), F.col("p_partkey")
    options = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("form"), key.alias("option"), key.alias("place"), pick(["電匯", "T/T", "ＮＴＤ", "10人以下", "11~50人", "51以上", "Cash", "月結 30 天", "Check"], key % 9).alias("text"))
    return options, table(spark, sf, "part").select((part % 25).alias("form"), (part % 7).alias("field"), pick(["電匯、匯款", "台幣", "7", "33", "月結三十天", "現金", "wire"], part % 7).alias("value")).distinct()


@_query("option_best", f"WITH {_FORM_SQL} SELECT form, field, value, option FROM f QUALIFY row_number() OVER (PARTITION BY form, field, value ORDER BY stage, nth, how, place) = 1")
def option_best(spark: SparkSession, sf: str) -> DataFrame:
    return O.best_option(*_forms(spark, sf), O.aliases(spark))


@_query("option_all", f"WITH {_FORM_SQL} SELECT DISTINCT form, field, value, option FROM f WHERE stage > 0")
def option_all(spark: SparkSession, sf: str) -> DataFrame:
    return O.all_options(*_forms(spark, sf), O.aliases(spark))


@_query(
    "same_as_fields",
    """WITH r AS (SELECT c_custkey AS record, unnest(['address', 'invoice_address', 'factory_address', 'bank_account_name', 'company_name']) AS key,
    unnest([CASE WHEN c_custkey % 4 = 0 THEN '同上' ELSE c_name || ' Rd' END, CASE WHEN c_custkey % 3 = 0 THEN '同上' ELSE 'own ' || c_custkey END, CASE c_custkey % 3 WHEN 0 THEN '（同登記地址）' WHEN 1 THEN '與公司 地址相同' ELSE '同心路' END, '〃', c_name]) AS value FROM customer),
    g AS (SELECT *, CASE WHEN key = 'invoice_address' AND value = '同上' OR key = 'factory_address' AND value <> '同心路' THEN 'address' WHEN key = 'bank_account_name' THEN 'company_name' END AS goal FROM r)
    SELECT g.record, g.key, g.value, coalesce(o.value, g.value) AS resolved, CASE WHEN o.value IS NOT NULL THEN goal END AS source FROM g LEFT JOIN r o ON o.record = g.record AND o.key = g.goal AND o.value <> '同上'""",
)
def same_as_fields(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    fields = {
        "address": F.when(key % 4 == 0, "同上").otherwise(F.concat("c_name", F.lit(" Rd"))), "invoice_address": F.when(key % 3 == 0, "同上").otherwise(F.concat(F.lit("own "), key.cast("string"))),
        "factory_address": F.when(key % 3 == 0, "（同登記地址）").when(key % 3 == 1, "與公司 地址相同").otherwise("同心路"), "bank_account_name": F.lit("〃"), "company_name": F.col("c_name"),
    }
    rows = table(spark, sf, "customer").select(key.alias("record"), F.explode(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))).alias("key", "value"))
    labels = spark.createDataFrame([("address", "登記地址"), ("address", "公司地址："), ("company_name", "公司名稱(全名)")], "key string, label string")
    return O.same_as(rows, labels)


# lines of lists, an order's key as the number of each; every eleventh line is a fence
_LINES = """o AS (SELECT o_custkey AS doc, o_orderkey AS n, o_orderkey % 220 + 1 AS v, o_orderkey % 11 = 0 AS fence FROM orders),
m AS (SELECT *, CASE WHEN v >= 100 THEN '零一二三四五六七八九'[v // 100 + 1] || '百' ELSE '' END || CASE WHEN v % 100 >= 10 THEN '零一二三四五六七八九'[v % 100 // 10 + 1] || '十' WHEN v >= 100 AND v % 10 > 0 THEN '零' ELSE '' END
  || CASE WHEN v % 10 > 0 THEN '零一二三四五六七八九'[v % 10 + 1] ELSE '' END AS numeral FROM o),
l AS (SELECT *, CASE WHEN fence THEN '```' WHEN n % 3 = 0 THEN numeral || '、 item' WHEN n % 3 = 1 THEN '（' || numeral || ') part' ELSE '  ' || translate(CAST(n % 10 AS VARCHAR), '0123456789', '０１２３４５６７８９') || '. wide' END AS line,
  count_if(fence) OVER (PARTITION BY doc ORDER BY n) % 2 = 1 AS code FROM m)"""


def list_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, at, n, line) with markers of three forms."""
    from pyspark.sql import Window

    from ..functions import labels as L

    n = F.col("o_orderkey")
    numeral = L.chinese_number(n % 220 + 1)
    line = F.when(n % 11 == 0, "```").when(n % 3 == 0, F.concat(numeral, F.lit("、 item"))).when(n % 3 == 1, F.concat(F.lit("（"), numeral, F.lit(") part"))).otherwise(F.concat(F.lit("  "), F.translate((n % 10).cast("string"), "0123456789", "０１２３４５６７８９"), F.lit(". wide")))
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), at.alias("at"), n.alias("n"), line.alias("line"))


@_query(
    "list_markers",
    f"""WITH {_LINES} SELECT doc, n, CASE WHEN fence OR code OR n % 3 < 2 AND v > 200 THEN line WHEN n % 3 = 0 THEN v || '. item' WHEN n % 3 = 1 THEN '   ' || v || '. part' ELSE '  ' || n % 10 || '. wide' END AS markdown FROM l""",
)
def list_markers(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import markdown

    return markdown.converted(list_lines(spark, sf), "doc").select("doc", "n", "markdown")


@_query("page_paragraphs")
def page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as spans on pages of forty lines, and read back as paragraphs."""
    from ..operators import blocks

    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("at", "text"))
    size = F.when(F.col("at") % 13 == 0, 16.0).otherwise(10.0)
    y0 = (F.col("at") % 40 * 14 + F.floor(F.col("at") / 5) * 20).cast("double")
    page = F.concat_ws("/", F.col("doc_id").cast("string"), F.floor(F.col("at") / 40).cast("string"))
    spans = lines.select(page.alias("page"), F.col("at").alias("id"), F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(400.0).alias("x1"), (y0 + size).alias("y1"), "text", size.alias("size"), (F.col("at") % 13 == 0).alias("bold"))
    return blocks.paragraphs(blocks.blocks_of(blocks.lines_of(spans)), 10.0)
