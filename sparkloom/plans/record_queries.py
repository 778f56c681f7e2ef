"""Queries over the registry (customers and suppliers), the event log, intervals of orders and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import hierarchy as H
from ..operators import registry as R
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



_REG = """reg AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS vat, c_name AS name, n_name || ', ' || r_name AS address, c_mktsegment AS org_type, r_name AS category, c_mktsegment || ' / ' || n_name AS industries
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_RULES = [("tools", ["machinery", "furniture"]), ("cars", ["automobile"]), ("home", ["household", "building"])]


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a registry of companies."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("vat"), F.col("c_name").alias("name"), F.concat("n_name", F.lit(", "), "r_name").alias("address"), F.col("c_mktsegment").alias("org_type"),
        F.col("r_name").alias("category"), F.concat("c_mktsegment", F.lit(" / "), "n_name").alias("industries"),
    )


@_query(
    "registry_lookup_batch",
    f"""WITH {_REG}, k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'x' || o_custkey ELSE lpad(CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 50000000 ELSE 0 END AS VARCHAR), 8, '0') END AS vat FROM orders)
    SELECT o_orderkey, k.vat, name, category, CASE WHEN NOT regexp_full_match(k.vat, '[0-9]{{8}}') THEN 'not 8 digits' WHEN reg.vat IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM k LEFT JOIN reg ON reg.vat = k.vat""",
)
def registry_lookup_batch(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lpad((F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 50000000).otherwise(0)).cast("string"), 8, "0")
    keys = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise(key).alias("vat"))
    return R.batch_lookup(keys, registry(spark, sf)).select("o_orderkey", "vat", "name", "category", "status")


@_query("registry_search_and", f"WITH {_REG} SELECT vat, name, address, org_type FROM reg WHERE contains(lower(name || '|' || address || '|' || org_type || '|' || industries), 'nation_1') AND contains(lower(industries), 'machin') ORDER BY name, vat LIMIT 50")
def registry_search_and(spark: SparkSession, sf: str) -> DataFrame:
    return R.search(registry(spark, sf).withColumn("owner", F.lit(None).cast("string")), "nation_1 machin", limit=50).select("vat", "name", "address", "org_type")


@_query("registry_search_fields", f"WITH {_REG} SELECT vat, name FROM reg WHERE contains(lower(name), '00001') AND category = 'ASIA'")
def registry_search_fields(spark: SparkSession, sf: str) -> DataFrame:
    return R.faceted(registry(spark, sf), categories=["ASIA"]).filter(R.contains_all("00001", ["name"])).select("vat", "name")


@_query(
    "registry_facets",
    f"""WITH {_REG}, v AS (SELECT 'org_type' AS facet, org_type AS value FROM reg UNION ALL SELECT 'category', category FROM reg UNION ALL SELECT 'industries', industries FROM reg)
    SELECT facet, value, count(*) AS count FROM v GROUP BY facet, value QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) <= 8""",
)
def registry_facets(spark: SparkSession, sf: str) -> DataFrame:
    return R.facets(registry(spark, sf), ["org_type", "category", "industries"])


@_query("registry_category_counts", f"WITH {_REG} SELECT category, count(*) AS count, row_number() OVER (ORDER BY CASE category WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, count(*) DESC, category) AS place FROM reg GROUP BY category")
def registry_category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.category_counts(registry(spark, sf), ["EUROPE", "ASIA"])


@_query("registry_last_wins", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def registry_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.last_wins(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@_query(
    "registry_upsert",
    """WITH a AS (SELECT c_custkey AS vat, c_name AS name, c_mktsegment AS category FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT s_suppkey * 2 AS vat, s_name AS name, 'supplier' AS category FROM supplier)
    SELECT coalesce(a.vat, b.vat) AS vat, CASE WHEN a.vat IS NOT NULL THEN a.name ELSE b.name END AS name, coalesce(b.category, a.category) AS category FROM a FULL JOIN b ON a.vat = b.vat""",
)
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("vat"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    more = table(spark, sf, "supplier").select((F.col("s_suppkey") * 2).alias("vat"), F.col("s_name").alias("name"), F.lit("supplier").alias("category"))
    return R.supplement(base, more)


_CASE = "CASE WHEN contains(lower({0}), 'machinery') OR contains(lower({0}), 'furniture') THEN 'tools' WHEN contains(lower({0}), 'automobile') THEN 'cars' WHEN contains(lower({0}), 'household') OR contains(lower({0}), 'building') THEN 'home' END"


@_query(
    "registry_enrich",
    f"""WITH {_REG} SELECT o_orderkey, name, {_CASE.format('industries')} AS subject, CASE WHEN {_CASE.format('industries')} IS NOT NULL THEN 'industries' END AS subject_source
    FROM orders LEFT JOIN reg ON reg.vat = lpad(CAST(o_custkey AS VARCHAR), 8, '0')""",
)
def registry_enrich(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("seller", F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return R.enrich(orders, registry(spark, sf), "seller", _RULES).select("o_orderkey", "name", "subject", "subject_source")


@_query("registry_anti_unmatched", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def registry_anti_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return Y.orphans(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@_query(
    "buffer_append",
    """WITH held AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 5 = 0), fresh AS (SELECT l_orderkey, min(l_linenumber) AS l_linenumber, arg_min(l_partkey, l_linenumber) AS l_partkey
      FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey FROM held UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM fresh WHERE l_orderkey NOT IN (SELECT l_orderkey FROM held)""",
)
def buffer_append(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    batch = items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return R.append_new(items.filter("l_linenumber <= 2 and l_orderkey % 5 = 0"), batch, "l_orderkey", "l_linenumber")


def _has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


_CHEAP, _BIG = ("promo", "economy"), ("large", "bolt", "gear")


@_query(
    "rule_cascade",
    f"""SELECT p_partkey, CASE WHEN {_has('p_type', *_CHEAP)} THEN 'cheap' WHEN {_has('p_type', *_BIG)} THEN 'big' WHEN {_has('p_name', *_CHEAP)} THEN 'cheap' WHEN {_has('p_name', *_BIG)} THEN 'big' ELSE 'other' END AS subject FROM part""",
)
def rule_cascade(spark: SparkSession, sf: str) -> DataFrame:
    subject, _ = R.cascade([("cheap", _CHEAP), ("big", _BIG)], ["p_type", "p_name"], "other")
    return table(spark, sf, "part").select("p_partkey", subject.alias("subject"))


NOW = "2024-01-30 00:00:00"
_TS = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@_query("events_filter_page", f"SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' AND ts < {_TS} ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def events_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    return E.page(E.audit(events(spark, sf), kind="purchase", until=_now()), "event_id", 3, 50).select("event_id", "event_type", "user_id")


@_query("events_distinct_values", "SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def events_distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return Y.distinct_values(events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "day"])


@_query("events_json_field", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def events_json_field(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf).withColumn("k", k).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@_query("events_by_user_30d", f"SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes FROM events WHERE ts >= {_TS} - INTERVAL 30 DAY AND ts < {_TS} AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 GROUP BY user_id")
def events_by_user_30d(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    recent = E.audit(events(spark, sf), since=_now() - F.expr("INTERVAL 30 DAYS"), until=_now()).withColumn("k", k).filter("k > 0")
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("bytes"))


@_query("events_online_users", f"SELECT count(DISTINCT user_id) AS users FROM events WHERE ts > {_TS} - INTERVAL 6 HOUR AND ts <= {_TS}")
def events_online_users(spark: SparkSession, sf: str) -> DataFrame:
    return E.active_users(events(spark, sf), _now(), 6 * 3600)


_B = "CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000.0) AS BIGINT)"


@_query(
    "events_bucket_gauge",
    f"""WITH b AS (SELECT {_B} AS bucket, value FROM events), s AS (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM b)
    SELECT CAST(s.bucket AS BIGINT) AS bucket, count(b.bucket) AS samples, round(avg(value), 6) AS v_avg, max(value) AS v_max FROM s LEFT JOIN b ON b.bucket = s.bucket GROUP BY s.bucket""",
)
def events_bucket_gauge(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour buckets, empty ones included."""
    out = E.gauge(events(spark, sf), F.lit("2024-01-01").cast("timestamp"), 21600, {"v": "value"})
    return out.withColumn("v_avg", F.round("v_avg", 6))


@_query(
    "jobs_overlap_load",
    """WITH j AS (SELECT o_orderkey, epoch_us(o_orderdate) AS a, greatest(epoch_us(max(l_shipdate)), epoch_us(o_orderdate)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate),
    k AS (SELECT CAST(floor((a - epoch_us(TIMESTAMP '1995-01-01')) / 2592000000000.0) AS BIGINT) AS x, CAST(floor((b - epoch_us(TIMESTAMP '1995-01-01')) / 2592000000000.0) AS BIGINT) AS y FROM j), s AS (SELECT CAST(unnest(range(min(x), max(y) + 1)) AS BIGINT) AS bucket FROM k)
    SELECT bucket, count(*) FILTER (WHERE x = bucket) AS started, count(x) AS active FROM s LEFT JOIN k ON x <= bucket AND y >= bucket GROUP BY bucket""",
)
def jobs_overlap_load(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are open between their date and their last shipment, by thirty days."""
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").cast("timestamp").alias("end"))
    jobs = table(spark, sf, "orders").join(ships, "o_orderkey").withColumn("start", F.col("o_orderdate").cast("timestamp"))
    return E.overlap(jobs, F.col("start"), F.greatest("start", "end"), F.lit("1995-01-01").cast("timestamp"), 30 * 86400)


@_query(
    "events_sessions",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, session""",
)
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = E.sessions_of(events(spark, sf), "user_id", 4 * 3600)
    return out.select("user_id", F.col("session").cast("long").alias("session"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@_query(
    "events_lockouts",
    """WITH a AS (SELECT *, event_type = 'error' AS f FROM events WHERE event_type IN ('error', 'signup')),
    b AS (SELECT *, CASE WHEN lag(f) OVER w IS NULL OR NOT f OR NOT lag(f) OVER w OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 THEN 1 ELSE 0 END AS anew FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT event_id, user_id, CAST(sum(CAST(f AS INT)) OVER w2 AS BIGINT) AS failures, sum(CAST(f AS INT)) OVER w2 >= 3 AS locked FROM c WINDOW w2 AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def events_lockouts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    out = E.lockouts(events(spark, sf), "user_id", kind == "error", kind == "signup", 3, 2 * 86400)
    return out.select("event_id", "user_id", F.col("failures").cast("long").alias("failures"), "locked")


@_query("events_retention", f"SELECT event_type, count(*) AS kept FROM events WHERE ts >= {_TS} - INTERVAL 7 DAY OR event_type = 'purchase' GROUP BY event_type")
def events_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = E.retained(events(spark, sf), "ts", _now(), 7, F.col("event_type") == "purchase")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@_query(
    "events_cooldown",
    """WITH RECURSIVE t AS (SELECT event_type, epoch_us(ts) AS u FROM events), r AS (SELECT event_type, min(u) AS u FROM t GROUP BY event_type UNION ALL
      SELECT r.event_type, (SELECT min(t.u) FROM t WHERE t.event_type = r.event_type AND t.u - r.u >= 43200000000) FROM r WHERE r.u IS NOT NULL)
    SELECT event_type, u AS micros FROM r WHERE u IS NOT NULL""",
)
def events_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return E.cooled(events(spark, sf), "event_type", 12 * 3600)


@_query("inbox_unread", "SELECT o_custkey, count(*) AS jobs, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01') AS unread FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_custkey")
def inbox_unread(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("finished_at"))
    box = E.inbox(jobs, ["F", "P"], F.lit("1998-01-01").cast("timestamp"))
    return box.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("jobs"), F.count_if("unread").alias("unread"))


@_query(
    "usage_full_outer",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS events FROM events GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events FROM a FULL JOIN b ON a.k = b.k""",
)
def usage_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return Y.usage([(table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "orders"), (events(spark, sf).withColumnRenamed("user_id", "k"), "events")], "k")


_EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "d"), ("f", "f")]
_EDGE_SQL = "edges(child, parent) AS (SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL VALUES ('a', 'b'), ('b', 'c'), ('c', 'a'), ('d', 'b'), ('e', 'd'), ('f', 'f'))"
_CLOSURE_SQL = """up(child, ancestor, steps, path) AS (SELECT child, parent, 1, [child, parent] FROM edges WHERE child <> parent
  UNION ALL SELECT up.child, e.parent, steps + 1, list_append(path, e.parent) FROM up JOIN edges e ON e.child = up.ancestor WHERE steps < 10 AND NOT list_contains(path, e.parent))"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return own.unionByName(region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))).unionByName(spark.createDataFrame(_EDGES, "child string, parent string"))


@_query("groups_closure", f"WITH RECURSIVE {_EDGE_SQL}, {_CLOSURE_SQL} SELECT child, ancestor, CAST(min(steps) AS INTEGER) AS steps FROM up GROUP BY child, ancestor")
def groups_closure(spark: SparkSession, sf: str) -> DataFrame:
    return H.closure(edges(spark, sf))


@_query(
    "effective_tools",
    f"""WITH RECURSIVE {_EDGE_SQL}, {_CLOSURE_SQL}, m AS (SELECT c_custkey AS user_id, n_name AS g FROM customer JOIN nation ON n_nationkey = c_nationkey),
    g AS (SELECT user_id, g FROM m UNION SELECT user_id, ancestor FROM m JOIN up ON up.child = m.g), s AS (SELECT user_id, 'group:' || g AS subject FROM g UNION SELECT c_custkey, 'user:' || c_custkey FROM customer),
    roles(subject, role) AS (VALUES ('group:ASIA', 'editor'), ('group:WORLD', 'viewer'), ('user:7', 'admin'), ('user:8', 'auditor'), ('group:EUROPE', 'editor')), grants(role, tool) AS (VALUES ('editor', 'merge'), ('editor', 'split'), ('viewer', 'count')),
    tools(tool) AS (VALUES ('merge'), ('split'), ('count'), ('fill')), held AS (SELECT DISTINCT user_id, role FROM s JOIN roles USING (subject)), flags AS (SELECT user_id, bool_or(role = 'auditor') AS auditor, bool_or(role = 'admin') AS admin FROM held GROUP BY user_id)
    SELECT user_id, tool FROM flags CROSS JOIN tools WHERE admin AND NOT auditor UNION SELECT user_id, tool FROM held JOIN flags USING (user_id) JOIN grants USING (role) WHERE NOT admin AND NOT auditor""",
)
def effective_tools(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    members = users.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("user_id", F.col("n_name").alias("group_id"))
    roles = spark.createDataFrame([("group:ASIA", "editor"), ("group:WORLD", "viewer"), ("user:7", "admin"), ("user:8", "auditor"), ("group:EUROPE", "editor")], "subject string, role string")
    grants = spark.createDataFrame([("editor", "merge"), ("editor", "split"), ("viewer", "count")], "role string, tool string")
    tools = spark.createDataFrame([("merge",), ("split",), ("count",), ("fill",)], "tool string")
    return H.effective_tools(users, H.memberships(members, edges(spark, sf)), roles, grants, tools)


@_query("tree_order", "SELECT name, depth, row_number() OVER (ORDER BY r, depth, name) AS place FROM (SELECT n_name AS name, 1 AS depth, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 0, r_name FROM region)")
def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region").select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent"), F.col("n_name").alias("name"))
    rows = H.tree_order(region.unionByName(nation))
    place = F.row_number().over(Window.orderBy("path"))  # thirty rows
    return rows.select("name", "depth", place.cast("long").alias("place"))
