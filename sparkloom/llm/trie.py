"""Prefix trie of conversations: mergeable partial tries, merged by keyed rounds, and a bottom-up rollup.

1. A turn is the digest of its role and text; the texts themselves are not shuffled. A node is named by the digest of its
   parent's name and its last turn, so equal sequences have equal names wherever they are met.
2. Turns are dealt out by ranges of conversations; a task streams its conversations in order and emits tables of nodes in
   which it has added up what it met (members, smallest member), and lists of the conversations that end at a node. Each
   node carries the names of its ancestors 1, 2, 4, ... levels up, which the task has at hand.
3. MERGE partial tries at a time are merged by node, round by round, until there is one; a hot node is then never more than
   MERGE rows. Lists of ends stay in pieces of bounded size, in order of ids, and are digested as they stream by.
4. Bottom-up: in round k every node adds the sums of its descendants 2^k levels down, each of which covers 2^k levels by then.
   The number of rounds is the logarithm of the depth, and a hot node gets partial sums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Conversations of one group: those whose ids have the same multiple of GROUP below; they share the first turns of that one.
GROUP = 5
#: A conversation shares fewer turns than this.
SHARED = 9
#: Partial tries that one round merges.
MERGE = 64
#: Nodes, or ends, that a task holds before it emits them.
NODES, ENDS = 20_000, 20_000
#: Characters of a text that decide the order of turns of one number and role; then their digests do.
HEAD = 64
ROOT = hashlib.blake2b(b"root", digest_size=16).digest()

_NODE = {"key": pa.binary(), "depth": pa.int32(), "n": pa.int64(), "low": pa.int64(), "bytes": pa.int64(), "ups": pa.list_(pa.binary()), "part": pa.int32(), "seq": pa.int64(), "ends": pa.binary()}
_NODE_TYPE = "key binary, depth int, n long, low long, bytes long, ups array<binary>, part int, seq long, ends binary"


def turns(rows: DataFrame, shared: bool = True) -> DataFrame:
    """(conv_id, base, turn, role, head, digest, bytes) of the turns that belong to a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    base = conv - conv % GROUP if shared else conv
    return rows.filter("conv_id is not null").select(conv.alias("conv_id"), base.alias("base"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


class _Partial:
    """The trie of the conversations that one task has met since it emitted the last one."""

    def __init__(self, part: int):
        self.part, self.seq, self.nodes, self.ends, self.n_ends = part, 0, {}, {}, 0

    def begin(self, conv: int) -> None:
        self.conv, self.path = conv, [ROOT]
        self._meet(ROOT, 0)

    def turn(self, digest: bytes, size: int) -> None:
        self.path.append(hashlib.blake2b(self.path[-1] + digest, digest_size=16).digest())
        self._meet(self.path[-1], size)

    def _meet(self, key: bytes, size: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            depth = len(self.path) - 1
            self.nodes[key] = [depth, 1, self.conv, size, [self.path[depth - (1 << i)] for i in range(depth.bit_length())]]
        else:
            node[1] += 1
            node[2] = min(node[2], self.conv)

    def end(self) -> None:
        self.ends.setdefault(self.path[-1], []).append(self.conv)
        self.n_ends += 1

    def table(self) -> pa.RecordBatch:
        """The nodes, which are forgotten here."""
        cols = list(zip(*((k, *v) for k, v in self.nodes.items()))) or [()] * 6
        n, self.nodes = len(self.nodes), {}
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _NODE.values())), pa.array([self.part] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], list(_NODE))

    def lists(self) -> pa.RecordBatch:
        """The lists of ends, which are forgotten here; later ones have greater ids."""
        n, keys = len(self.ends), list(self.ends)
        lists = [",".join(map(str, sorted(v))).encode() for v in self.ends.values()]
        self.ends, self.n_ends, self.seq = {}, 0, self.seq + 1
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.nulls(n, t) for t in list(_NODE.values())[1:6]), pa.array([self.part] * n, pa.int32()), pa.array([self.seq] * n, pa.int64()), pa.array(lists, pa.binary())], list(_NODE))


def partial_tries(rows: DataFrame, shared: bool = True) -> DataFrame:
    """Tables of nodes (ends is null) and lists of ends (the rest) of each part of the turns; a part is a range of conversations."""
    own = F.col("conv_id") != F.col("base")
    dealt = rows.repartitionByRange("base").sortWithinPartitions("base", own, "conv_id", "turn", "role", "head", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trie, base, conv, first, skip, place = _Partial(TaskContext.get().partitionId()), None, None, [], 0, 0
        for whole in batches:
            for b in common.parts([whole]):
                for c, of, digest, size in zip(*(b.column(i).to_pylist() for i in range(4))):
                    if c != conv:
                        if conv is not None:
                            trie.end()
                        if of != base:
                            base, first = of, []
                            if trie.n_ends >= ENDS:
                                yield trie.lists()
                        conv, place = c, 0
                        trie.begin(c)
                        # the first turns of the group's conversation, then its own after as many
                        skip = zlib.crc32(str(c).encode()) % SHARED if c != base else 0
                        for x in first[:skip]:
                            trie.turn(*x)
                    if c == base and len(first) < SHARED - 1:
                        first.append((digest, size))
                    if place >= skip:
                        trie.turn(digest, size)
                    place += 1
                    if len(trie.nodes) >= NODES:
                        yield trie.table()
        if conv is not None:
            trie.end()
            yield trie.table()
            yield trie.lists()

    return dealt.select("conv_id", "base", "digest", "bytes").mapInArrow(run, _NODE_TYPE)


def merged(tables: DataFrame, parts: int) -> DataFrame:
    """One row for each node (key, depth, n, low, bytes, ups), from the tables of so many parts."""
    while True:
        parts = -(-parts // MERGE)
        tables = tables.withColumn("part", (F.col("part") / MERGE).cast("int")).groupBy("key", "part").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.first("ups").alias("ups")
        )
        if parts <= 1:
            return tables.select("key", "depth", "n", "low", "bytes", "ups")


def ends_digests(lists: DataFrame) -> DataFrame:
    """(key, ends_sha256): the pieces of each node's list stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for k, piece in zip(b.column(0), b.column(1)):
                k, piece = k.as_py(), piece.as_py()
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return lists.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, *values): each value summed over the subtree of each node, itself included. nodes: (key, depth, ups, *values)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now = nodes.select("key", "ups", *values)
    for k in range(deepest.bit_length()):
        below = now.filter(F.size("ups") > k).groupBy(F.col("ups")[k].alias("key")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        after = common.materialise(now.join(below, "key", "left").select("key", "ups", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)), "rollup")
        if k:
            common.drop_scratch(now)
        now = after
    return now.drop("ups")


def prefix_trie(rows: DataFrame, shared: bool = True) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node of the trie.

    With shared, a conversation c takes the first h turns of conversation c - c % GROUP (% has the sign of c; all if there
    are fewer, none if it is absent), h = crc32 of decimal c modulo SHARED, and then its own turns after its first h.
    A node is a distinct sequence of first turns (role, text); conv_id is its smallest member. The root has depth 0 and all
    members, also those without a turn.

    Turns are ordered by turn, null first; those of one number by role, the first HEAD characters of the text, and their digest.
    Repeated rows are turns of their own. Null roles and texts are empty; rows without conv_id belong to no conversation and
    are left out. An empty table has no root. Other columns are not read. A conversation is streamed by one task, which holds 16
    bytes for each of its turns.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    given = common.materialise(turns(rows, shared), "turns")
    partial = common.materialise(partial_tries(given, shared), "tries")
    common.drop_scratch(given)
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    nodes = common.materialise(merged(partial.filter("ends is null"), parts), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("ups")[0].alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    known = known.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes"))
    known = common.materialise(known, "nodes")
    sums = rolled_up(known, ["leaves", "saved"])
    inner = known.filter("depth > 0").select("key", F.col("ups")[0].alias("parent"))
    parents = common.meet(inner, known.select(F.col("key").alias("parent"), F.col("low").alias("parent_conv_id")), "parent").drop("parent")
    digests = ends_digests(partial.filter("ends is not null"))
    out = known.drop("leaves", "saved", "ups").join(sums, "key").join(parents, "key", "left").join(digests, "key", "left")
    return out.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
