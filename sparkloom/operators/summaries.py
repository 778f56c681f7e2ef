"""Small reports over records: merged counts, missing partners, pages of groups, versions, deadlines, attachments, volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from . import events


def usage(counts: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """(key, one column of counts for each table): how often each key occurs in each table, 0 where it does not. Null keys are left out."""
    out = None
    for df, name in counts:
        one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out.fillna(0, [name for _, name in counts])


def orphans(rows: DataFrame, partners: DataFrame, key: str) -> DataFrame:
    """Rows whose key no partner has; rows with a null key are orphans."""
    return rows.join(partners.select(key).distinct(), key, "left_anti").select(rows.columns)


def distinct_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The different combinations of columns."""
    return rows.select(*columns).distinct()


def group_page(members: DataFrame, group: str, member: str, start: int, size: int) -> DataFrame:
    """(group, member): `size` rows of a listing by group and member, after the first `start`."""
    return members.select(group, member).orderBy(group, member).offset(max(0, start)).limit(size)


def case_statistics(cases: DataFrame, by: Sequence[str], deleted: str = "deleted_at", score: str = "score") -> DataFrame:
    """(by, n, gone, score): cases of each group, how many of them were deleted, and the mean score of the others to hundredths (null if there are none)."""
    live = F.avg(F.when(F.col(deleted).isNull(), F.col(score)))
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(deleted).alias("gone"), F.round(live, 2).alias("score"))


def next_versions(history: DataFrame, key: str, at: str) -> DataFrame:
    """(key, next_version, latest): the number that the next version of each key gets, and when the last one was made."""
    return history.groupBy(key).agg((F.count(F.lit(1)) + 1).alias("next_version"), F.max(at).alias("latest"))


def soft_deleted(rows: DataFrame, ids: DataFrame, now: Column, key: str = "id", deleted: str = "deleted_at") -> DataFrame:
    """rows with those of the ids marked as deleted now; what was deleted before keeps its time."""
    marks = ids.select(key).distinct().withColumn("_d", F.lit(True))
    gone = F.coalesce(F.col(deleted), F.when(F.col("_d"), now))
    return rows.join(marks, key, "left").select(*(gone.alias(c) if c == deleted else F.col(c) for c in rows.columns))


def pair_counts(terms: DataFrame, source: str, target: str, enabled: Column) -> DataFrame:
    """(source, target, n): terms in use of each pair of languages."""
    return terms.filter(enabled).groupBy(source, target).agg(F.count(F.lit(1)).alias("n"))


def expiring(docs: DataFrame, id_col: str, text: Column, today: Column, deadline: Column) -> DataFrame:
    """(id, n, first): how many different days of a text lie after today and before the deadline, and the first of them."""
    days = docs.select(id_col, F.explode(F.array_distinct(L.dates(text))).alias("day")).filter((F.col("day") > today) & (F.col("day") < deadline))
    return days.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"))


def attachments_off(files: DataFrame, key: str, declared: Column, slack: int = 1) -> DataFrame:
    """(key, declared, files): the keys whose number of files differs from the declared one by more than slack."""
    counts = files.groupBy(key).agg(declared.alias("declared"), F.count(F.lit(1)).alias("files"))
    return counts.filter(F.abs(F.col("declared") - F.col("files")) > slack)


def volumes(pages: DataFrame, volume: str, doc: str, order: str, sheet: int = 1) -> DataFrame:
    """(volume, doc, order, page, sheet): pages numbered through each volume, document by document, and the sheet each is on."""
    rows = pages.select(volume, doc, order, F.row_number().over(Window.partitionBy(volume, doc).orderBy(order)).alias("_n"))
    counts = rows.groupBy(volume, doc).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(volume).orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each document of a volume
    page = (F.col("_b") + F.col("_n")).cast("long")
    return rows.join(counts.withColumn("_b", before), [volume, doc]).select(volume, doc, order, page.alias("page"), (F.floor((page - 1) / sheet) + 1).alias("sheet"))


def size_histogram(pages: DataFrame, size: Column, step: int) -> DataFrame:
    """(size, pages): pages by their size in whole steps."""
    return pages.groupBy(F.floor(size / step).alias("size")).agg(F.count(F.lit(1)).alias("pages"))


def online(sessions: DataFrame, users: DataFrame, now: Column, idle_seconds: int, key: str = "user_id") -> DataFrame:
    """users with their sessions that are live now (n), and when they were last seen; users without one are left out."""
    live = events.live_sessions(sessions, now, idle_seconds).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("last_seen_at").alias("last_seen_at"))
    return users.join(live, key)
