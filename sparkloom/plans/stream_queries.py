"""Streaming queries, run over what a folder holds; batch SQL says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..streaming import events as S
from .tables import table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return scratch.folder(spark, "stream")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_single(sf)).withColumn("ts", F.col("ts").cast("timestamp"))


def _single(sf: str) -> str:
    """A stream reads folders: a pattern names the one file."""
    return f"{sf}/events.parque[t]"


def _run(spark: SparkSession, out: DataFrame, mode: str = "complete") -> DataFrame:
    folder = _folder(spark)
    return S.run_now(out, f"{folder}/out", f"{folder}/checkpoint", mode)


@_query("stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, S.tumbling(_stream(spark, sf), "1 hour"))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


@_query("stream_sliding", "SELECT epoch_us(w) AS start_us, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 10 MINUTE]) AS w FROM events) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, S.sliding(_stream(spark, sf), "15 minutes", "5 minutes"))
    return out.select(F.unix_micros("start").alias("start_us"), "n")


@_query(
    "stream_session",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session""",
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(spark, S.sessions(_stream(spark, sf), "2 hours"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@_query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event comes twice, and once out."""
    events = _stream(spark, sf)
    twice = events.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_n")
    return _run(spark, S.first_of(twice, "event_id", "40 days").select("event_id"), "append")


@_query(
    "stream_lockouts",
    """WITH a AS (SELECT *, event_type = 'error' AS f FROM events WHERE event_type IN ('error', 'signup')),
    b AS (SELECT *, CASE WHEN lag(f) OVER w IS NULL OR NOT f OR NOT lag(f) OVER w OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 THEN 1 ELSE 0 END AS anew FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT user_id, epoch_us(ts) AS micros, CAST(sum(CAST(f AS INT)) OVER w2 AS INTEGER) AS failures, sum(CAST(f AS INT)) OVER w2 >= 3 AS locked FROM c WINDOW w2 AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def stream_lockouts(spark: SparkSession, sf: str) -> DataFrame:
    attempts = _stream(spark, sf).filter("event_type in ('error', 'signup')")
    return _run(spark, S.lockouts(attempts, F.col("event_type") == "error", 3, 2 * 86400), "append").select("user_id", "micros", "failures", "locked")
