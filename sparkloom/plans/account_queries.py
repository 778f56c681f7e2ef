"""Queries over accounts, roles, queues, stores and cases, made from customers, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts as A
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


@_query("roles_attached", "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS roles FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def roles_attached(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("role"))
    return A.with_list(table(spark, sf, "customer").select("c_custkey"), roles, "c_custkey", "role", "roles").select("c_custkey", F.array_join("roles", ",").alias("roles"))


@_query(
    "group_listing",
    """SELECT n_name AS name, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS n_members,
    coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0), '') AS roles FROM nation""",
)
def group_listing(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").withColumn("group_id", F.col("c_nationkey"))
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    rows = A.group_listing(groups, customers.select("group_id", F.col("c_custkey").alias("user_id")), customers.filter("c_acctbal < 0").select("group_id", F.col("c_mktsegment").alias("role")))
    return rows.select("name", "n_members", F.array_join("roles", ",").alias("roles"))


@_query("group_page", "SELECT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY r_name, n_name LIMIT 10 OFFSET 5")
def group_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return Y.group_page(rows, "r_name", "n_name", 5, 10)


@_query("role_listing", "SELECT o_orderpriority AS role, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS builtin, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS tools FROM orders GROUP BY o_orderpriority")
def role_listing(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("tool"))
    roles = orders.select("role").distinct().withColumn("builtin", F.col("role").rlike("^[12]"))
    return A.with_list(roles, orders, "role", "tool", "tools").select("role", "builtin", F.array_join("tools", ",").alias("tools")).orderBy(F.desc("builtin"), "role")


@_query(
    "permissions_explained",
    """WITH u AS (SELECT DISTINCT c_custkey AS user_id, c_mktsegment AS role, 'user/' || c_mktsegment AS source FROM customer WHERE c_acctbal > 5000
      UNION SELECT c_custkey, n_name, c_nationkey || '/' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3),
    g AS (SELECT DISTINCT c_mktsegment AS role, left(c_mktsegment, 1) AS tool FROM customer UNION SELECT n_name, 'A' FROM nation UNION SELECT n_name, 'T' || n_regionkey FROM nation)
    SELECT user_id, tool, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u JOIN g USING (role) GROUP BY user_id, tool""",
)
def permissions_explained(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    subject = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string")).alias("subject")
    roles = customer.filter("c_acctbal > 5000").select(subject("user", "c_custkey"), F.col("c_mktsegment").alias("role")).unionByName(nation.filter("n_regionkey < 3").select(subject("group", "n_nationkey"), F.col("n_name").alias("role")))
    grants = customer.select(F.col("c_mktsegment").alias("role"), F.left("c_mktsegment", F.lit(1)).alias("tool")).distinct()
    grants = grants.unionByName(nation.select(F.col("n_name").alias("role"), F.lit("A").alias("tool"))).unionByName(nation.select(F.col("n_name").alias("role"), F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("tool")))
    members = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("group_id"))
    return A.explained(members, roles, grants.distinct()).select("user_id", "tool", F.array_join("sources", ",").alias("sources"))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4 != 0).alias("enabled"), (F.col("c_custkey") % 10 == 1).alias("admin"), "c_acctbal", "c_nationkey")


@_query(
    "guarded_update",
    """WITH u AS (SELECT c_custkey AS user_id, c_custkey % 4 <> 0 AS enabled, c_acctbal < 0 AS few, c_acctbal > 0 AS many FROM customer),
    g AS (SELECT count(*) FILTER (WHERE few AND enabled) <= 0.2 * count(*) AS few_go, count(*) FILTER (WHERE many AND enabled) <= 0.2 * count(*) AS many_go FROM u)
    SELECT user_id, enabled AND NOT (few AND few_go) AS after_few, enabled AND NOT (many AND many_go) AS after_many FROM u, g""",
)
def guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    users = _users(spark, sf)
    few, many = A.disabled(users, F.col("c_acctbal") < 0), A.disabled(users, F.col("c_acctbal") > 0)
    return few.select("user_id", F.col("enabled").alias("after_few")).join(many.select("user_id", F.col("enabled").alias("after_many")), "user_id")


@_query("admins_left", "SELECT count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 10 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def admins_left(spark: SparkSession, sf: str) -> DataFrame:
    return A.admins_left(_users(spark, sf), table(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("user_id")))


_OWNERS = ["3-MEDIUM", "1-URGENT", "5-LOW"]


@_query(
    "queue_positions",
    """WITH q AS (SELECT o_orderkey, o_orderdate, nullif(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 0 END, 0) AS rank FROM orders WHERE o_orderstatus = 'O')
    SELECT o_orderkey, CAST(rank AS BIGINT) AS rank, row_number() OVER (ORDER BY rank NULLS LAST, o_orderdate, o_orderkey) AS position FROM q""",
)
def queue_positions(spark: SparkSession, sf: str) -> DataFrame:
    queue = A.ranked(table(spark, sf, "orders").filter("o_orderstatus = 'O'"), _OWNERS, "o_orderpriority")
    return A.positions(queue, "rank", "o_orderdate", "o_orderkey").select("o_orderkey", "rank", "position")


@_query("queue_stats", "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS running, count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, greatest(0, 2000 - count(*) FILTER (WHERE o_orderstatus = 'P')) AS free FROM orders")
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued")
    return A.queue_stats(table(spark, sf, "orders"), state, 2000)


@_query("storage_usage", "SELECT source, count(*) AS files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, sum(octet_length(encode(coalesce(text, '')))) > 30000 AS over FROM documents GROUP BY source")
def storage_usage(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return A.usage(table(spark, sf, "documents"), "source", size, None, None, 30_000).drop("oldest_days")


@_query("oldest_files", "SELECT user_id, count(*) AS files, CAST(sum(length(props)) AS BIGINT) AS bytes, CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-03-01') AS INTEGER) AS oldest_days FROM events GROUP BY user_id")
def oldest_files(spark: SparkSession, sf: str) -> DataFrame:
    return A.usage(table(spark, sf, "events"), "user_id", F.length("props"), F.col("ts"), F.lit("2024-03-01").cast("date"), 0).drop("over")


@_query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    found = A.percentiles(table(spark, sf, "events"), "event_type", "value", [0.5, 0.95, 0.99])
    return found.select("event_type", *(F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")))


@_query("median_size", "SELECT p_brand, CAST(median(p_size) AS DOUBLE) AS p50 FROM part GROUP BY p_brand")
def median_size(spark: SparkSession, sf: str) -> DataFrame:
    return A.percentiles(table(spark, sf, "part"), "p_brand", "p_size", [0.5])


_RULES = [("a", ["1", "2"]), ("b", ["3"])]


@_query("reclassified", "WITH p AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'a' END AS old, CASE WHEN contains(p_brand, '1') OR contains(p_brand, '2') THEN 'a' WHEN contains(p_brand, '3') THEN 'b' END AS new FROM part) SELECT count(*) AS total, count(new) AS classified, count(*) FILTER (WHERE old IS DISTINCT FROM new) AS changed FROM p")
def reclassified(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "a").alias("subject"), "p_brand")
    return A.changes(part, part.withColumn("subject", R.cascade(_RULES, ["p_brand"])[0]), "p_partkey", "subject")


_CASES = "c AS (SELECT o_orderkey, o_custkey % 5 AS owner, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS deleted_at, o_orderstatus, o_totalprice FROM orders)"


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("owner"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("deleted_at"), "o_orderstatus", "o_totalprice")


@_query("visible_cases", f"WITH {_CASES} SELECT o_orderkey, owner FROM c WHERE deleted_at IS NULL AND owner = 3")
def visible_cases(spark: SparkSession, sf: str) -> DataFrame:
    return A.visible(_cases(spark, sf), 3).select("o_orderkey", "owner")


@_query("case_stats", f"WITH {_CASES} SELECT owner, o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS gone, round(avg(o_totalprice) FILTER (WHERE deleted_at IS NULL), 2) AS score FROM c GROUP BY owner, o_orderstatus")
def case_stats(spark: SparkSession, sf: str) -> DataFrame:
    return Y.case_statistics(_cases(spark, sf).withColumnRenamed("o_orderstatus", "status").withColumnRenamed("o_totalprice", "score"), ["owner", "status"])


@_query("versions", "SELECT o_custkey, count(*) + 1 AS next_version, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey")
def versions(spark: SparkSession, sf: str) -> DataFrame:
    return Y.next_versions(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@_query(
    "pruned_tree",
    """WITH d AS (SELECT DISTINCT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 1)
    SELECT 'OU=' || n || ',OU=' || r || ',DC=x' AS dn, 'OU=' || r || ',DC=x' AS parent, CAST(3 AS INTEGER) AS depth FROM d UNION SELECT 'OU=' || r || ',DC=x', 'DC=x', 2 FROM d UNION SELECT 'DC=x', NULL, 1 FROM d""",
)
def pruned_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").filter("n_regionkey <> 1").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.pruned(rows.select(F.concat(F.lit("OU="), "n_name", F.lit(",OU="), "r_name", F.lit(",DC=x")).alias("dn")), "dn")


@_query(
    "schedules_due",
    """SELECT c_custkey, c_custkey % 7 = 4 AND c_custkey % 24 <= 15 AND (c_custkey % 5 = 0 OR CAST(c_custkey % 11 AS INTEGER) >= 6) AS due FROM customer""",
)
def schedules_due(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-03-01 15:30:00").cast("timestamp")  # a Friday
    last = F.when(F.col("c_custkey") % 5 != 0, now - F.make_dt_interval(days=(F.col("c_custkey") % 11).cast("int")))
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("weekday"), (F.col("c_custkey") % 24).alias("hour"), last.alias("last_run"))
    return A.due(rows, now).select("c_custkey", "due")


@_query(
    "fees_merged",
    """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1),
    i AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'own' END AS place FROM orders WHERE o_orderstatus = 'O')
    SELECT id, coalesce(nullif(place, ''), o_orderpriority) AS place, CASE WHEN t.day IS NULL THEN 'n' ELSE 'n fee' END AS note FROM i LEFT JOIN t USING (day)""",
)
def fees_merged(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    trips = orders.filter("o_orderstatus = 'F'").select("day", F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("place"))
    invoices = orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), "day", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("own").alias("place"), F.lit("n").alias("note"))
    return A.first_of_day(invoices, trips, "id", "day", F.lit("fee"), ["place"]).select("id", "place", "note")


@_query(
    "variants_merged",
    """WITH f AS (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE 'xy' END AS value, p_partkey % 50 AS doc, p_size AS n, p_name AS grp FROM part), b AS (SELECT grp, max_by(value, (length(value), value)) AS best FROM f GROUP BY grp)
    SELECT best AS value, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT doc) AS documents FROM f JOIN b USING (grp) GROUP BY best""",
)
def variants_merged(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "").otherwise("xy")
    part = table(spark, sf, "part").select(F.concat("p_name", tail).alias("value"), (F.col("p_partkey") % 50).alias("doc"), F.col("p_size").alias("n"), F.col("p_name").alias("grp"))
    return A.merged_variants(part.select("value", "doc", "n"), part.select("value", "grp").distinct())
