"""Accounts, roles, groups, queues and stores: listings, guarded updates, positions, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_list(rows: DataFrame, more: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sorted distinct values that more has under their key; an empty array where it has none."""
    lists = more.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def group_listing(groups: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """groups (group_id, ...) with n_members and the list of roles; both sides are aggregated before the joins."""
    counts = members.groupBy("group_id").agg(F.count_distinct("user_id").alias("n_members"))
    return with_list(groups.join(counts, "group_id", "left").fillna(0, ["n_members"]), roles, "group_id", "role", "roles")


def explained(members: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, tool, sources): why a user may use a tool. members: (user_id, group_id), roles: (subject, role), grants: (role, tool).

    A source is user/role or group/role, for subjects user:id and group:id.
    """
    users = roles.filter(F.col("subject").startswith("user:")).select(F.substring_index("subject", ":", -1).cast("long").alias("user_id"), "role", F.concat(F.lit("user/"), "role").alias("source"))
    held = roles.filter(F.col("subject").startswith("group:")).select(F.substring_index("subject", ":", -1).cast("long").alias("group_id"), "role")
    groups = members.join(held, "group_id").select("user_id", "role", F.concat(F.col("group_id").cast("string"), F.lit("/"), "role").alias("source"))
    rows = users.unionByName(groups).join(grants, "role").select("user_id", "tool", "source").distinct()
    return rows.groupBy("user_id", "tool").agg(F.sort_array(F.collect_list("source")).alias("sources"))


def disabled(users: DataFrame, view: Column, most: float = 0.2) -> DataFrame:
    """users with those of a view disabled, or all as they were if the view holds more than this share of the users.

    The guard is one row of counts that every row meets.
    """
    picked = F.coalesce(view, F.lit(False)) & F.col("enabled")
    guard = users.agg(F.count_if(picked).alias("_picked"), F.count(F.lit(1)).alias("_all")).select((F.col("_picked") <= most * F.col("_all")).alias("_go"))
    rows = users.join(F.broadcast(guard))  # one row
    return rows.withColumn("enabled", F.col("enabled") & ~(picked & F.col("_go"))).drop("_go")


def admins_left(users: DataFrame, without: DataFrame) -> DataFrame:
    """(n): enabled admins that remain when those of without (user_id) go."""
    return users.filter("enabled and admin").join(without.select("user_id").distinct(), "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def positions(queue: DataFrame, rank: str, at: str, id_col: str) -> DataFrame:
    """queue with position from 1: by rank, without a rank last, then by time and id.

    Rows are numbered inside a rank and hour, and begin where the counts of those before end: no task sorts the queue.
    """
    rows = queue.withColumn("_rank", F.coalesce(F.col(rank).cast("long"), F.lit((1 << 62)))).withColumn("_hour", F.date_trunc("hour", at))
    counts = rows.groupBy("_rank", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_rank", "_hour").rowsBetween(Window.unboundedPreceding, -1)  # a row for each rank and hour
    starts = counts.select("_rank", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_rank", "_hour").orderBy(at, id_col))
    return rows.withColumn("_r", inside).join(starts, ["_rank", "_hour"]).withColumn("position", F.col("_start") + F.col("_r")).drop("_rank", "_hour", "_r", "_start")


def ranked(rows: DataFrame, order: Sequence, key: str) -> DataFrame:
    """rows with the place of their key in a list, from 1; null where it is not listed."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key)) if order else F.lit(0)
    return rows.withColumn("rank", F.nullif(place.cast("long"), F.lit(0).cast("long")))


def queue_stats(jobs: DataFrame, state: Column, limit: int) -> DataFrame:
    """(running, queued, free) of a queue that runs so many jobs at once."""
    out = jobs.agg(F.count_if(state == "running").alias("running"), F.count_if(state == "queued").alias("queued"))
    return out.withColumn("free", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("running")))


def usage(files: DataFrame, owner: str, size: Column, at: Column | None, now: Column | None, quota: int) -> DataFrame:
    """(owner, files, bytes, over, oldest_days): what a workspace holds against its quota, and the age of its oldest file."""
    age = F.datediff(now, F.min(at)) if at is not None else F.lit(None).cast("int")
    out = files.groupBy(owner).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), age.alias("oldest_days"))
    return out.withColumn("over", F.col("bytes") > quota)


def percentiles(rows: DataFrame, group: str, value: str, points: Sequence[float]) -> DataFrame:
    """(group, p50, ...): exact percentiles, interpolated; equal values are counted before they meet."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(*(F.percentile(value, p, F.col("_n")).alias(f"p{round(100 * p)}") for p in points))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(total, classified, changed): how many of old's rows have another value in new."""
    both = old.select(key, F.col(value).alias("_a")).join(new.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("_b").alias("classified"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def visible(cases: DataFrame, user: int | None, admin: bool = False) -> DataFrame:
    """Cases that are not deleted and belong to the user, or to anybody for an admin."""
    live = cases.filter("deleted_at is null")
    return live if admin else live.filter(F.col("owner").eqNullSafe(F.lit(user)))


def pruned(names: DataFrame, dn: str) -> DataFrame:
    """(dn, parent, depth): distinguished names with all that stands above them, each once."""
    from .hierarchy import dn_ancestors

    return names.select(F.explode(dn_ancestors(F.col(dn))).alias("dn")).distinct().select("dn", F.nullif(F.regexp_replace("dn", r"^[^,]*,?", ""), F.lit("")).alias("parent"), F.size(F.split("dn", ",")).alias("depth"))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """schedules with due: on the weekday (0: Monday), from the hour on, and at least six days after the last run."""
    late = F.col("last_run").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_run") >= 6 * 86_400)
    return schedules.withColumn("due", (F.weekday(now) == F.col("weekday")) & (F.hour(now) >= F.col("hour")) & late)


def first_of_day(invoices: DataFrame, trips: DataFrame, id_col: str, day: str, note: Column, blanks: Sequence[str]) -> DataFrame:
    """invoices whose empty columns are filled from the first trip (trip_id) of their day, with a note; one without a trip stays."""
    first = trips.groupBy(day).agg(F.min_by(F.struct(*trips.columns), "trip_id").alias("_t"))
    both = invoices.join(first, day, "left")
    for c in blanks:
        both = both.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_t.{c}")))
    return both.withColumn("note", F.when(F.col("_t").isNotNull(), F.concat_ws(" ", F.nullif(F.col("note"), F.lit("")), note)).otherwise(F.col("note"))).drop("_t")


def merged_variants(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(value, total, documents): found (value, doc, n) with the values of a group (value, grp) under its longest one."""
    named = groups.groupBy("grp").agg(F.max_by("value", F.struct(F.length("value"), F.col("value"))).alias("best"))
    best = groups.join(named, "grp").select("value", "best")
    rows = found.join(best, "value", "left").select(F.coalesce("best", "value").alias("value"), "doc", "n")
    return rows.groupBy("value").agg(F.sum("n").alias("total"), F.count_distinct("doc").alias("documents"))
