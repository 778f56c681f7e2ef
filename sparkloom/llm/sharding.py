"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u)/weight, where u comes from a hash of
the row's key and the child's id, and the smallest draw wins: a child gets its weight's share, and when one child's
weight grows rows move only into it. A weight that changes below a node changes the node's own weight, so movement
stays inside subtrees whose weights changed. A shard that is added as a region of its own (grow) takes rows only into
itself, because no draw among the old nodes changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges in which rows of one shard are numbered; the table of their counts has shards x BUCKETS rows at most.
BUCKETS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(n: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """n shards of weight 1, per_rack in a rack and so many racks in a region."""
    return [Leaf(i // (per_rack * racks), i // per_rack % racks, i) for i in range(n)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _children(tree: list[Leaf]) -> dict[str, dict[str, float]]:
    """Weights of the children of each inner node; a node's weight is the sum of its leaves'."""
    out: dict[str, dict[str, float]] = {}
    for x in tree:
        path = ["", f"{x.region}", f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
        for parent, child in zip(path, path[1:]):
            inner = out.setdefault(parent, {})
            inner[child] = inner.get(child, 0.0) + x.weight
    return out


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard (int) of a key, null keys included, in JVM expressions only."""
    nodes = F.create_map(
        *(c for parent, kids in _children(tree).items() for c in (F.lit(parent), F.array(*(F.struct(F.lit(k).alias("id"), F.lit(float(w)).alias("w")) for k, w in kids.items() if w > 0))))
    )

    def descend(parent: Column) -> Column:
        def draw(x: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, x["id"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.ln(u) / x["w"]).alias("draw"), x["id"].alias("id"))

        return F.array_min(F.transform(F.element_at(nodes, parent), draw))["id"]

    leaf = descend(descend(descend(F.lit(""))))
    return F.element_at(F.split(leaf, "/"), -1).cast("int")


def with_slots(df: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds slot (long): the row's number in its shard from 0, without gaps.

    Rows are numbered inside hash ranges of their first order column, and a range starts where the counts of the ranges
    before it end, so no shard is sorted in one task. Rows equal in all order columns take neighbouring slots.
    """
    spread = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    counts = spread.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_b").orderBy("_h", *order)
    numbered = spread.withColumn("_r", F.row_number().over(inside).cast("long") - 1)
    joined = numbered.join(F.broadcast(starts), (F.col(shard) == F.col("_s")) & (F.col("_b") == F.col("_sb")))  # shards x BUCKETS rows
    return joined.withColumn("slot", F.col("_start") + F.col("_r")).drop("_h", "_b", "_s", "_sb", "_start", "_r")


def assign(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    Null texts count as empty (size 1); equal doc_ids always share a shard; a null doc_id is a key like any other; an
    empty table gives no rows. Only doc_id and the tree decide.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"), (F.length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"), shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown if grown is not None else grow(tree)).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ("doc_id", "text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
