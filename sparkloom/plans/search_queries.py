"""Queries over registries, entities and findings: phrase search, containment, consistency, close matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks as C
from ..operators import consistency as K
from ..operators import fakes, pii, token_index
from .tables import spread, table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CJK = "零一二三四五六七八九"
_CJK_NAME = f"CASE WHEN c_custkey % 2 = 0 THEN '臺北' ELSE '台北' END || translate(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0123456789', '{_CJK}') || '號 ' || c_mktsegment"
_PHRASE = f"SELECT DISTINCT p_partkey % 1000 AS q, translate(lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'), '0123456789', '{_CJK}') AS digits FROM part"


def cjk_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with names in CJK: (c_custkey, name, segment, nation)."""
    digits = F.translate(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), "0123456789", _CJK)
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "臺北").otherwise("台北"), digits, F.lit("號 "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", name.alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


def cjk_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords of three CJK digits, every other one with a second keyword."""
    q = (F.col("p_partkey") % 1000).alias("q")
    digits = F.translate(F.lpad(F.col("q").cast("string"), 3, "0"), "0123456789", _CJK)
    return table(spark, sf, "part").select(q).distinct().select("q", F.concat(digits, F.when(F.col("q") % 2 == 0, " building 台北").otherwise("")).alias("query"))


_FOUND = f"SELECT q, c_custkey FROM ({_PHRASE}) p JOIN (SELECT *, {_CJK_NAME} AS name FROM customer) c ON contains(name, digits) AND (q % 2 = 1 OR c_mktsegment = 'BUILDING')"


@_query("registry_phrases", _FOUND)
def registry_phrases(spark: SparkSession, sf: str) -> DataFrame:
    index = token_index.postings(cjk_registry(spark, sf), "c_custkey", ["name"])
    return token_index.search(cjk_questions(spark, sf), index, "q", "c_custkey")


@_query(
    "registry_phrase_counts",
    f"""WITH f AS ({_FOUND}), s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY c_custkey) <= 50),
    v AS (SELECT q, 'segment' AS facet, c_mktsegment AS value FROM s JOIN customer USING (c_custkey) UNION ALL SELECT q, 'nation', CAST(c_nationkey AS VARCHAR) FROM s JOIN customer USING (c_custkey)),
    n AS (SELECT q, facet, value, count(*) AS n FROM v GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY q, facet ORDER BY n DESC, value) AS place FROM n QUALIFY place <= 3)
    SELECT q, total, least(total, 50) AS sampled, facet, value, n, place FROM b JOIN (SELECT q, count(*) AS total FROM f GROUP BY q) USING (q)""",
)
def registry_phrase_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = cjk_registry(spark, sf)
    found = token_index.search(cjk_questions(spark, sf), token_index.postings(rows, "c_custkey", ["name"]), "q", "c_custkey")
    return token_index.counted(found, rows, "q", "c_custkey", ["segment", "nation"], 50, 3)


@_query("pii_fakes")
def pii_fakes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with their personal data replaced by pseudonyms of the same shape."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.rewrite(docs, fakes.pseudonyms(pii.spans(docs, pii.defaults() + pii.chosen(["ip"])), "a secret of the owner"), "fake")


@_query(
    "fake_numbers",
    """SELECT c_custkey, kind, true AS passes, true AS differs, regexp_replace(value, '[0-9]', '9', 'g') AS shape FROM (
    SELECT c_custkey, unnest(['cc', 'tw_biz', 'jp_corp_no', 'order_num']) AS kind, unnest(['4' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '0', lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '1' || lpad(CAST(c_custkey AS VARCHAR), 12, '0'),
      'PO-' || c_custkey || '/' || c_nationkey]) AS value FROM customer)""",
)
def fake_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of customers with their pseudonyms: the shape stays, they differ, and check digits hold."""
    key = F.col("c_custkey").cast("string")
    values = {"cc": F.concat(F.lit("4"), F.lpad(key, 14, "0"), F.lit("0")), "tw_biz": F.lpad(key, 8, "0"), "jp_corp_no": F.concat(F.lit("1"), F.lpad(key, 12, "0")), "order_num": F.concat(F.lit("PO-"), key, F.lit("/"), F.col("c_nationkey").cast("string"))}
    given = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey"))  # a pseudonym costs far more than moving a customer
    rows = given.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()))).alias("x")).select("c_custkey", "x.*")
    made = fakes.pseudonyms(rows, "k")
    passes = F.when(F.col("kind") == "cc", C.card(F.col("fake"))).when(F.col("kind") == "tw_biz", C.tw_business(F.col("fake"))).when(F.col("kind") == "jp_corp_no", C.jp_corporate(F.col("fake"))).otherwise(True)
    shape = F.regexp_replace(F.when(F.col("kind") == "order_num", F.regexp_replace("fake", "^[A-Z][A-Z]-", "PO-")).otherwise(F.col("fake")), "[0-9]", "9")
    return made.select("c_custkey", "kind", passes.alias("passes"), (F.col("fake") != F.col("value")).alias("differs"), shape.alias("shape"))


_OWN = "SELECT DISTINCT c_nationkey AS entity, CASE c_nationkey % 3 WHEN 0 THEN 'Nation ' || c_nationkey ELSE 'n' || c_nationkey || 'x' END AS name FROM customer"
_VALUES = "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'The Nation' || c_custkey % 40 || ' Office' WHEN 1 THEN 'tion' || c_custkey % 30 ELSE 'in n' || c_custkey % 60 || 'x' END AS value FROM customer"


def _own_names(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.col("c_nationkey")
    name = F.when(nation % 3 == 0, F.concat(F.lit("Nation "), nation.cast("string"))).otherwise(F.concat(F.lit("n"), nation.cast("string"), F.lit("x")))
    return table(spark, sf, "customer").select(nation.alias("entity"), nation.alias("place"), name.alias("name")).distinct()


def _own_values(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    n = lambda m: (key % m).cast("string")
    value = F.when(key % 3 == 0, F.concat(F.lit("The Nation"), n(40), F.lit(" Office"))).when(key % 3 == 1, F.concat(F.lit("tion"), n(30))).otherwise(F.concat(F.lit("in n"), n(60), F.lit("x")))
    return table(spark, sf, "customer").select(value.alias("value")).distinct()


_PAIRS = f"SELECT value, name, entity FROM ({_VALUES}) v JOIN ({_OWN}) o ON contains(replace(value, ' ', ''), replace(name, ' ', '')) OR contains(replace(name, ' ', ''), replace(value, ' ', ''))"


@_query("own_entities", f"SELECT value, min(entity) AS entity FROM ({_PAIRS}) GROUP BY value")
def own_entities(spark: SparkSession, sf: str) -> DataFrame:
    return K.own_entities(_own_values(spark, sf), _own_names(spark, sf))


@_query("names_contained", f"SELECT value, name FROM ({_PAIRS})")
def names_contained(spark: SparkSession, sf: str) -> DataFrame:
    return K.contained(_own_values(spark, sf), _own_names(spark, sf))


@_query(
    "own_typing_errors",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), v AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN left(p_name, 3) || substr(p_name, 5) ELSE 'x' || substr(p_name, 2) END AS value FROM part),
    f AS (SELECT value FROM v WHERE NOT EXISTS (SELECT 1 FROM n WHERE contains(replace(name, ' ', ''), replace(value, ' ', '')) OR contains(replace(value, ' ', ''), replace(name, ' ', '')))),
    d AS (SELECT value, name, levenshtein(value, name) AS distance FROM f, n), g AS (SELECT * FROM d WHERE distance BETWEEN 1 AND 3 AND distance < 0.4 * least(length(value), length(name)) AND length(value) >= 4)
    SELECT value, name, CAST(distance AS INTEGER) AS distance FROM g QUALIFY row_number() OVER (PARTITION BY value ORDER BY distance, name) = 1""",
)
def own_typing_errors(spark: SparkSession, sf: str) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey")
    value = F.when(key % 3 == 0, F.concat(name, F.lit("s"))).when(key % 3 == 1, F.concat(F.left(name, F.lit(3)), F.substring(name, 5, 1000))).otherwise(F.concat(F.lit("x"), F.substring(name, 2, 1000)))
    part = table(spark, sf, "part")
    return K.own_typing_errors(part.select(value.alias("value")), part.select(name.alias("name")))


# orders as entities of cases: a case is a customer, a file a month of the year
_ENTITIES = """e AS (SELECT o_custkey AS "case", o_orderkey % 4 AS file, ['company', 'legal_person', 'school', 'government', 'tax_id', 'case_number'][o_orderkey % 6 + 1] AS kind,
  CASE o_orderkey % 6 WHEN 4 THEN CASE WHEN o_orderkey % 5 = 0 THEN '12345675' WHEN o_orderkey % 5 = 1 THEN '04595257' ELSE lpad(CAST(o_orderkey % 7919 AS VARCHAR), 8, '1') END WHEN 5 THEN 'C-' || o_orderkey % 3 ELSE 'Org' || o_orderkey % 17 || 'Ltd' END AS value,
  o_orderkey % 3 + 1 AS n FROM orders),
k AS (SELECT c_custkey AS "case", CASE WHEN c_custkey % 2 = 0 THEN 'Org' || c_custkey % 17 END AS main, CASE WHEN c_custkey % 3 = 0 THEN '04595257' END AS identifier, CASE WHEN c_custkey % 4 = 0 THEN 'Org 5 Ltd' END AS counterparty, CASE WHEN c_custkey % 5 < 3 THEN 'C-1' END AS number FROM customer),
t AS (SELECT "case", kind, value, sum(n) AS n, count(DISTINCT file) AS n_files, list_distinct(list(file)) AS files FROM e GROUP BY ALL),
r AS (SELECT t.*, main, identifier, replace(counterparty, ' ', '') AS other, number,
  kind = 'tax_id' AND (list_sum(list_transform(range(1, 9), lambda i: (try_cast(value[i] AS INT) * [1, 2, 1, 2, 1, 2, 4, 1][i]) // 10 + try_cast(value[i] AS INT) * [1, 2, 1, 2, 1, 2, 4, 1][i] % 10)) % 10 = 0
    OR value[7] = '7' AND (list_sum(list_transform(range(1, 9), lambda i: (try_cast(value[i] AS INT) * [1, 2, 1, 2, 1, 2, 4, 1][i]) // 10 + try_cast(value[i] AS INT) * [1, 2, 1, 2, 1, 2, 4, 1][i] % 10)) + 1) % 10 = 0) AS good FROM t LEFT JOIN k USING ("case")),
top AS (SELECT "case", value AS tv, kind AS tk, n_files AS tf FROM r WHERE main IS NULL AND kind IN ('company', 'legal_person') QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY n DESC, kind, value) = 1),
f AS (SELECT "case", 'L2' AS layer, 'warn' AS severity, 'identity-mismatch' AS category, value, main AS expected, n, n_files FROM r WHERE main IS NOT NULL AND kind IN ('company', 'legal_person', 'school', 'government') AND (kind <> 'government' OR other IS NULL)
    AND NOT (contains(value, main) OR contains(main, value)) AND NOT coalesce(contains(value, other) OR contains(other, value), false) AND NOT contains(value, 'Org16') AND value <> 'Org3Ltd'
  UNION ALL SELECT r."case", 'L2', 'warn', 'identity-outlier', value, tv, n, n_files FROM r JOIN top ON r."case" = top."case" WHERE kind IN ('company', 'legal_person') AND (kind <> tk OR value <> tv) AND (n_files <= tf // 2 OR tf >= 2 AND n_files = 1)
  UNION ALL SELECT "case", 'L1', 'warn', 'tax-id-mismatch', value, identifier, n, n_files FROM r WHERE kind = 'tax_id' AND identifier IS NOT NULL AND value <> identifier
  UNION ALL SELECT "case", 'L1', 'warn', 'tax-id-multiple', string_agg(value, ', ' ORDER BY value), NULL, sum(n), len(list_distinct(flatten(list(files)))) FROM r WHERE kind = 'tax_id' AND identifier IS NULL AND good AND value <> '12345675' GROUP BY "case" HAVING count(*) >= 2
  UNION ALL SELECT "case", 'L1', CASE WHEN n_files >= 2 OR n >= 3 THEN 'info' ELSE 'warn' END, 'tax-id-invalid', value, NULL, n, n_files FROM r WHERE kind = 'tax_id' AND NOT good
  UNION ALL SELECT "case", 'L2', 'info', 'case-num-other', value, number, n, n_files FROM r WHERE kind = 'case_number' AND number IS NOT NULL AND value <> number)"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    key, who = F.col("o_orderkey"), F.col("c_custkey")
    text = lambda c: c.cast("string")
    number = F.when(key % 5 == 0, "12345675").when(key % 5 == 1, "04595257").otherwise(F.lpad(text(key % 7919), 8, "1"))
    value = F.when(key % 6 == 4, number).when(key % 6 == 5, F.concat(F.lit("C-"), text(key % 3))).otherwise(F.concat(F.lit("Org"), text(key % 17), F.lit("Ltd")))
    kind = F.element_at(F.array(*map(F.lit, ["company", "legal_person", "school", "government", "tax_id", "case_number"])), (key % 6 + 1).cast("int"))
    entities = table(spark, sf, "orders").select(F.col("o_custkey").alias("case"), (key % 4).alias("file"), kind.alias("kind"), value.alias("value"), (key % 3 + 1).alias("n"))
    truth = table(spark, sf, "customer").select(
        who.alias("case"), F.when(who % 2 == 0, F.concat(F.lit("Org"), text(who % 17))).alias("main"), F.when(who % 3 == 0, "04595257").alias("identifier"), F.when(who % 4 == 0, "Org 5 Ltd").alias("counterparty"), F.when(who % 5 < 3, "C-1").alias("case_number")
    )
    own = spark.createDataFrame([("Org 16", "1234 5675"), ("Our Org3Ltd branch", None), (None, None), ("", "")], "name string, tax_id string")
    return K.findings(entities, truth, own)


@_query("consistency_findings", f"""WITH {_ENTITIES} SELECT "case", layer, severity, category, value, expected, CAST(n AS BIGINT) AS n, n_files, category || ':' || CASE WHEN category IN ('tax-id-multiple', 'case-num-other') THEN left(value, 50) || ':' ELSE value END AS key FROM f""")
def consistency_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)


@_query("consistency_counts", f'WITH {_ENTITIES} SELECT "case", category, severity, count(*) AS n FROM f GROUP BY ALL')
def consistency_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.counts(_findings(spark, sf))


@_query("close_matches")
def close_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts as they were read, with errors, against the names themselves."""
    from ..operators import close

    name, key = F.col("p_name"), F.col("p_partkey")
    at = (key % 7 + 2).cast("int")
    read = F.when(key % 4 == 0, F.concat(name, F.lit("  box"))).when(key % 4 == 1, F.concat(F.substring(name, F.lit(1), at), F.lit("x"), F.substring(name, at + 2, F.lit(1000)))).when(key % 4 == 2, F.upper(F.regexp_replace(name, " ", "  "))).otherwise(F.concat(F.lit("a "), name))
    part = table(spark, sf, "part")
    return close.close_pairs(part.select(name.alias("expected")), part.select(read.alias("read")))
