"""Streams of events: windows, sessions, distinct ids, lockouts, and a forwarder that delivers in order at least once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, every: str, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of windows of one length. Amounts are summed as whole hundredths, in any order alike."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str = "1 hour") -> DataFrame:
    """(start, users): about how many users were active in each of the windows that overlap; a sketch holds the state."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"))
    return w.agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "users", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): events of a user with less than a gap between them."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten when the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


LOCK_STATE, LOCK_OUT = "count int, last long", "user_id long, micros long, failures int, locked boolean"


def lockouts(attempts: DataFrame, failed: Column, threshold: int, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """(user_id, micros, failures, locked) of every attempt (user_id, ts), with the state of a user kept between batches.

    A success sets the count back, and so does a pause longer than the window. Attempts of a batch are taken in order of
    time; the state of a user is dropped when the watermark is a window past the last attempt.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, -(1 << 60))
        rows = sorted((int(t), bool(f)) for frame in frames for t, f in zip(frame["micros"], frame["failed"]))
        out = []
        for t, f in rows:
            count = 0 if not f else 1 if t - last > window_seconds * 1_000_000 else count + 1
            last = t
            out.append((key[0], t, count, count >= threshold))
        state.update((count, last))
        state.setTimeoutTimestamp(max(last // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "micros", "failures", "locked"])

    rows = attempts.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("micros"), failed.alias("failed"))
    return rows.groupBy("user_id").applyInPandasWithState(step, LOCK_OUT, LOCK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_now(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it has written.

    In complete mode every batch replaces the table; else batches are appended, each one once.
    """

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/batch=*")


def forward(stream: DataFrame, checkpoint: str, send: Callable[[Iterator[str]], None], form: Column, key: str = "event_id", tries: int = 3, wait: float = 0.5, most: float = 60.0):
    """Sends the formatted rows of each batch in order of key to a destination; the checkpoint is its cursor.

    send gets the lines of the ordered batch, a partition at a time. After a failure it is called again, after wait seconds at first and twice as long each time, `most` at most; a
    batch that fails tries times stops the query, and the next start sends it again: delivery is at least once and in order.
    """

    def deliver(batch: DataFrame, n: int) -> None:
        lines = batch.orderBy(key).select(form.alias("line"))
        for i in range(tries):
            try:
                send(r["line"] for r in lines.toLocalIterator())  # one ordered destination: a partition at a time
                return
            except OSError:
                if i + 1 == tries:
                    raise
                time.sleep(min(most, wait * 2**i))

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def syslog_line(host: str = "app") -> Column:
    """An event as an RFC 5424 line."""
    return F.concat(F.lit("<134>1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f" {host} audit - "), F.col("event_type"), F.lit(" - "), F.to_json(F.struct("event_id", "user_id", "value")))


def cef_line(vendor: str = "app", product: str = "audit") -> Column:
    """An event in the common event format; bars and equals signs of values are escaped."""
    kind = F.regexp_replace(F.col("event_type"), r"([|\\])", r"\\$1")
    return F.concat(F.lit(f"CEF:0|{vendor}|{product}|1|"), kind, F.lit("|"), kind, F.lit("|3|rt="), F.unix_millis("ts").cast("string"), F.lit(" suser="), F.regexp_replace(F.col("user_id").cast("string"), r"([=\\])", r"\\$1"))


def gelf_line(host: str = "app") -> Column:
    """An event as a GELF 1.1 object."""
    return F.to_json(F.struct(F.lit("1.1").alias("version"), F.lit(host).alias("host"), F.col("event_type").alias("short_message"), (F.unix_millis("ts") / 1000).alias("timestamp"), F.col("user_id").alias("_user_id"), F.col("event_id").alias("_event_id")))
