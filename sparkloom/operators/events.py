"""Operational logs: filters, pages, buckets, overlaps, sessions, lockouts and retention. now is always a parameter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit(events: DataFrame, user: str | None = None, kind: str | None = None, since: Column | None = None, until: Column | None = None, exact_user: bool = False) -> DataFrame:
    """Events under the filters that are set; a user matches as a part of the name, or whole."""
    if user is not None:
        events = events.filter(F.col("username") == user if exact_user else F.col("username").contains(user))
    if kind is not None:
        events = events.filter(F.col("event_type") == kind)
    if since is not None:
        events = events.filter(F.col("ts") >= since)
    if until is not None:
        events = events.filter(F.col("ts") < until)
    return events


def page(rows: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """One page, newest key first: a top-k report. Sizes are clamped to 10..500."""
    size = max(10, min(size, 500))
    return rows.orderBy(F.desc(key)).offset(size * (max(1, number) - 1)).limit(size)


def bucket_start(ts: Column, origin: Column, seconds: int) -> Column:
    """Number of the bucket of a time."""
    return F.floor((F.unix_micros(ts) - F.unix_micros(origin)) / F.lit(seconds * 1_000_000)).cast("long")


def every_bucket(rows: DataFrame, low: str, high: str) -> DataFrame:
    """(bucket) from the least low to the greatest high of rows, without gaps; none for an empty table."""
    ends = rows.agg(F.min(low).alias("a"), F.max(high).alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("bucket"))


def gauge(rows: DataFrame, origin: Column, seconds: int, values: dict[str, str]) -> DataFrame:
    """(bucket, samples, average and maximum of each value) of every bucket from the first event to the last; 0 begins at origin."""
    at = rows.filter("ts is not null").withColumn("bucket", bucket_start(F.col("ts"), origin, seconds))
    aggs = [c for name, v in values.items() for c in (F.avg(v).alias(f"{name}_avg"), F.max(v).alias(f"{name}_max"))]
    sums = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"), *aggs)
    return every_bucket(sums, "bucket", "bucket").join(sums, "bucket", "left").fillna(0, ["samples"])


def overlap(jobs: DataFrame, start: Column, end: Column, origin: Column, seconds: int, buckets: int | None = None) -> DataFrame:
    """(bucket, started, active) of every bucket from the first start to the last end, or of buckets 0 to buckets - 1. A job counts +1 where it begins and -1
    after its end; running sums over the buckets give the active ones, so a long job is two rows and not one for each
    bucket that it covers."""
    a, b = bucket_start(start, origin, seconds), bucket_start(F.coalesce(end, start), origin, seconds)
    marked = jobs.select(a.alias("a"), b.alias("b")).filter(F.col("b") >= F.col("a"))
    edges = marked.select(F.explode(F.array(F.struct(F.col("a").alias("bucket"), F.lit(1).alias("d"), F.lit(1).alias("s")), F.struct((F.col("b") + 1).alias("bucket"), F.lit(-1).alias("d"), F.lit(0).alias("s")))).alias("e"))
    sums = edges.groupBy("e.bucket").agg(F.sum("e.d").alias("d"), F.sum("e.s").alias("started"))
    spine = every_bucket(marked, "a", "b")
    if buckets is not None:
        spine = spine.unionByName(jobs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")).distinct()
    spine = spine.join(sums, "bucket", "left").fillna(0)
    active = F.sum("d").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # a row a bucket
    out = spine.select("bucket", F.col("started").cast("long").alias("started"), active.cast("long").alias("active"))
    return out if buckets is None else out.filter(F.col("bucket").between(0, buckets - 1))


def active_users(events: DataFrame, now: Column, seconds: int) -> DataFrame:
    """(users): distinct users of the last seconds before now."""
    recent = events.filter((F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now))
    return recent.agg(F.count_distinct("user_id").alias("users"))


def live_sessions(sessions: DataFrame, now: Column, idle_seconds: int) -> DataFrame:
    """Sessions that are neither expired nor idle."""
    return sessions.filter((F.col("expires_at") > now) & (F.col("last_seen_at") >= now - F.make_dt_interval(secs=F.lit(idle_seconds))))


#: Gaps, or windows, in a range of times whose rows of one key are ordered in one task.
STRETCH = 64


def _stretch(seconds: int) -> Column:
    """The range of times that a row is in: a key with very many rows is shared by as many tasks as it has ranges."""
    return F.floor(F.unix_micros("ts") / (max(1, seconds) * 1_000_000 * STRETCH))


def sessions_of(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): events with less than a gap between neighbours are one session, numbered from 1 in order of time.

    Sessions are first told inside of ranges of times; then one row for each range of a key says whether its first session goes on from the range before, and how
    many have begun so far.
    """
    gap = gap_seconds * 1_000_000
    apart = lambda a, b: F.unix_micros(a) - F.unix_micros(b) > gap
    inside = Window.partitionBy(key, "_r").orderBy("ts", "event_id")
    before = F.lag("ts").over(inside)
    rows = events.select(key, "ts", "event_id", _stretch(gap_seconds).alias("_r")).withColumn("_open", (before.isNull() | apart("ts", before)).cast("int"))
    parts = rows.withColumn("_i", F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_r", "_i").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(key).orderBy("_r")
    ranges = parts.groupBy(key, "_r").agg(F.max("_i").alias("_m"), F.min("start").alias("_first"), F.max("end").alias("_last"))
    goes_on = F.coalesce(~apart("_first", F.lag("_last").over(along)), F.lit(False)).cast("int")
    ranges = ranges.withColumn("_on", goes_on).withColumn("_sum", F.sum(F.col("_m") - F.col("_on")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.select(F.col(key).alias("_k"), F.col("_r").alias("_q"), (F.col("_sum") - F.col("_m")).alias("_base"))
    numbered = parts.join(ranges, F.col(key).eqNullSafe(F.col("_k")) & F.col("_r").eqNullSafe(F.col("_q"))).withColumn("session", F.col("_base") + F.col("_i"))
    return numbered.groupBy(key, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def lockouts(attempts: DataFrame, key: str, failed: Column, reset: Column, threshold: int, window_seconds: int) -> DataFrame:
    """Attempts with the number of failures so far and whether the key is locked by them.

    The count starts anew after a success and when the failure before is older than the window. Failures are counted inside of
    ranges of times; one row for each range of a key says what the range before it hands on.
    """
    stale = lambda a, b: F.coalesce(F.unix_micros(a) - F.unix_micros(b) > window_seconds * 1_000_000, F.lit(False))
    inside = Window.partitionBy(key, "_r").orderBy("ts", "event_id")
    rows = attempts.filter(failed | reset).withColumn("_fail", failed).withColumn("_r", _stretch(window_seconds))
    before, before_fail = F.lag("ts").over(inside), F.lag("_fail").over(inside)
    anew = before_fail.isNull() | ~F.col("_fail") | ~before_fail | stale("ts", before)
    rows = rows.withColumn("_anew", anew.cast("int")).withColumn("_run", F.sum("_anew").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.sum(F.col("_fail").cast("int")).over(Window.partitionBy(key, "_r", "_run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    end = lambda pick, *cols: pick(F.struct(*cols), F.struct("ts", "event_id"))
    ranges = rows.groupBy(key, "_r").agg(end(F.min_by, "ts", "_fail").alias("_a"), end(F.max_by, "ts", "_fail", "_n", "_run").alias("_z"))
    along = Window.partitionBy(key).orderBy("_r")
    last = F.lag("_z").over(along)
    ranges = ranges.withColumn("_before", last).withColumn("_on", F.coalesce(F.col("_a._fail") & F.col("_before._fail") & ~stale("_a.ts", "_before.ts"), F.lit(False)))
    # a chain of ranges that are one run each hands its sum on; a range with a further run inside begins a new chain
    ranges = ranges.withColumn("_chain", F.sum((~F.col("_on") | (F.col("_before._run") > 1)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    handed = F.when(F.col("_on"), F.col("_before._n")).otherwise(0)
    ranges = ranges.withColumn("_given", F.sum(handed).over(Window.partitionBy(key, "_chain").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.select(F.col(key).alias("_k"), F.col("_r").alias("_q"), "_given")
    joined = rows.join(ranges, F.col(key).eqNullSafe(F.col("_k")) & F.col("_r").eqNullSafe(F.col("_q")))
    count = F.col("_n") + F.when(F.col("_run") == 1, F.col("_given")).otherwise(0)
    return joined.withColumn("failures", count).withColumn("locked", F.col("failures") >= threshold).select(*attempts.columns, "failures", "locked")


def retained(rows: DataFrame, ts: str, now: Column, days: int, keep: Column | None = None) -> DataFrame:
    """Rows younger than so many days, and those that keep holds for; no days: all."""
    if days <= 0:
        return rows
    young = F.col(ts) >= now - F.make_dt_interval(days=F.lit(days))
    return rows.filter(young if keep is None else young | keep)


def inbox(jobs: DataFrame, terminal: Sequence[str], seen: Column) -> DataFrame:
    """Finished jobs, and whether they finished after the inbox was last seen."""
    return jobs.filter(F.col("status").isin(list(terminal))).withColumn("unread", F.coalesce(F.col("finished_at") > seen, F.lit(False)))


#: Gaps in a range of times that a task of cooled() takes.
RANGE = 8


def cooled(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """The first event of a key and those that come at least so many seconds after the last that was let through.

    Letting through depends on what was let through before, so a range of times of a key says where it would be left
    for each event at which it may be entered; these are in its first gap, and most ways soon meet. A walk over such
    summaries of a key gives the earliest time that each range may let through, and each range its own events by that.
    """
    if seconds <= 0:
        return events.filter("ts is not null").select(key, F.unix_micros("ts").alias("micros"))
    gap = seconds * 1_000_000
    t = F.unix_micros("ts")
    times = events.filter("ts is not null").select(F.col(key).alias("_k"), (t - F.pmod(t, F.lit(RANGE * gap))).alias("_r"), t.alias("_t")).distinct()
    kind = events.schema[key].dataType.simpleString()

    def result(one: pa.Table, cols: dict[str, np.ndarray]) -> pa.Table:
        """Columns beside the key of a group."""
        n = len(next(iter(cols.values())))
        keys = one.column("_k").combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"_k": keys} | {k: pa.array(v, pa.int64()) for k, v in cols.items()})

    def summary(rows: pa.Table) -> pa.Table:
        at = np.sort(rows.column("_t").to_numpy())
        follow = np.append(np.searchsorted(at, at + gap), len(at))  # the place after the last stands for none
        left = np.where(follow[:-1] == len(at), np.arange(len(at)), follow[:-1])
        while True:  # twice as far each time
            far = left[left]
            if (far == left).all():
                break
            left = far
        first = min(len(at), int(follow[0]) + 1)
        last = np.append(left[1:first] != left[: first - 1], True)  # of the entries that are left at one place
        return result(rows, {"_r": np.full(int(last.sum()), rows.column("_r")[0].as_py()), "_upto": at[:first][last], "_left": at[left[:first][last]]})

    def walk(rows: pa.Table) -> pa.Table:
        r, upto, left = (rows.column(c).to_numpy() for c in ("_r", "_upto", "_left"))
        order = np.lexsort((upto, r))
        r, upto, left = r[order], upto[order], left[order]
        heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        since, out = np.iinfo(np.int64).min, []
        for a, b in zip(heads, np.append(heads[1:], len(r))):
            out.append(since)
            i = a + int(np.searchsorted(upto[a:b], since))
            if i < b:
                since = int(left[i]) + gap
        return result(rows, {"_r": r[heads], "_since": np.array(out, np.int64)})

    def let_through(rows: pa.Table, entry: pa.Table) -> pa.Table:
        at = np.sort(rows.column("_t").to_numpy())
        i, out = int(np.searchsorted(at, entry.column("_since")[0].as_py())), []
        while i < len(at):
            out.append(at[i])
            i = int(np.searchsorted(at, at[i] + gap))
        return result(rows, {"_t": np.array(out, np.int64)})

    summaries = times.groupBy("_k", "_r").applyInArrow(summary, f"_k {kind}, _r long, _upto long, _left long")
    entries = summaries.groupBy("_k").applyInArrow(walk, f"_k {kind}, _r long, _since long")
    out = times.groupBy("_k", "_r").cogroup(entries.groupBy("_k", "_r")).applyInArrow(let_through, f"_k {kind}, _t long")
    return out.select(F.col("_k").alias(key), F.col("_t").alias("micros"))
