"""Links between embeddings of high cosine: randomised-rotation binary codes, their bounds, and exact recomputation.

Equal vectors are one class. A class has a binary code: the signs of its unit vector after random rotations, with the
factor <code, vector> that corrects the code's inner products. <code(a), b> / factor(a) is an unbiased estimate of the
cosine of a and b; its error has a standard deviation of about sqrt((1 - factor^2) / (factor^2 (D - 1))) for D bits, so a
pair whose estimate is ERRORS of them below the threshold is settled and every other pair is recomputed exactly.

Pairs meet in the buckets of hash tables: a key is the largest coordinate (with its sign) after each of several random
rotations, and there are as many tables as make it MISS likely that a pair at the threshold never meets. A pair counts
in the first table in which it meets. Buckets send link counts and spanning edges, never their pairs; a bucket of more
than BLOCK vectors is split into blocks, and pairs of blocks are dealt out.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 20250311
#: Bits of a code at least; a code has whole rotations.
BITS = 256
#: Standard deviations of an estimate within which a pair is recomputed.
ERRORS = 6.0
#: Probability that a pair at the threshold meets in no table.
MISS = 1e-5
#: Vectors of a block of a bucket.
BLOCK = 1024
#: Buckets of so many vectors at most are compared side by side, about TOGETHER vectors and PAIRS pairs at a time.
SMALL, TOGETHER, PAIRS = 64, 4096, 1 << 14
#: Bytes of the rotated vectors that a task holds at a time (a single wider one is alone).
TURNED_BYTES = 16 << 20
U64 = np.uint64


@functools.lru_cache(4)
def rotations(dim: int, n: int, salt: int) -> np.ndarray:
    """n random rotations side by side: (dim, n * dim)."""
    rng = np.random.default_rng([SEED, dim, salt])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def plan(dim: int, n: int, cosine: float) -> tuple[int, int]:
    """(hashes of a key, tables) for about n vectors: a bucket has a sixteenth of a chance neighbour, misses are MISS."""
    rng = np.random.default_rng([SEED, dim])
    a, b = rng.standard_normal((2, 20_000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-30)
    p = max(1e-3, float((largest(a) == largest(cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b)).mean()))
    hashes = max(1, round((math.log2(max(n, 2)) + 4) / math.log2(2 * dim)))
    return hashes, max(1, math.ceil(math.log(MISS) / math.log1p(-min(p**hashes, 1 - 1e-9))))


def largest(x: np.ndarray) -> np.ndarray:
    """Number of the largest coordinate in size, with its sign."""
    at = np.abs(x).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(x, at[..., None], -1)[..., 0] > 0)


def code_turns(dim: int) -> int:
    return max(1, -(-BITS // dim))


def turned(unit: np.ndarray) -> np.ndarray:
    """Unit vectors in the space of the codes: inner products stay."""
    turns = code_turns(unit.shape[1])
    return unit @ rotations(unit.shape[1], turns, 0) / math.sqrt(turns)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as bytes, factors)."""
    x = turned(unit)
    return np.packbits(x > 0, axis=1), np.abs(x).sum(axis=1) / math.sqrt(x.shape[1])


def estimates(bits: np.ndarray, factor: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of coded vectors with vectors (turned), and the standard deviation of each coded vector's."""
    d = others.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    return (signs @ others.T.astype(np.float32)) / (math.sqrt(d) * factor[:, None]), np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, d - 1)))


def _valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, vec): key is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for v in b.column(1):
                x = np.array([math.nan if c is None else c for c in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
                size = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
                raw = (x + 0.0).tobytes()
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if size > 0 else None)
                vecs.append(raw if size > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["id", "key", "vec"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, key binary, vec binary")


def units(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(classes: DataFrame, shape: dict[int, tuple[int, int]]) -> DataFrame:
    """(cid, n, vec, code, factor, marks, keys): marks has the keys as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for b in batches:
            cid, n, vecs = (b.column(i).to_pylist() for i in range(3))
            dims = np.array([len(v) // 8 for v in vecs])
            runs = []
            for dim in np.unique(dims).tolist():
                at, step = np.flatnonzero(dims == dim), max(1, TURNED_BYTES // (8 * dim * math.prod(shape[dim])))
                runs += [(dim, at[lo : lo + step]) for lo in range(0, len(at), step)]
            for dim, at in runs:
                hashes, tables = shape[dim]
                if dim not in turn:
                    turn[dim] = rotations(dim, hashes * tables, 1)
                unit = units([vecs[i] for i in at])
                which = largest((unit @ turn[dim]).reshape(len(at), tables, hashes, dim)).astype(U64)
                key = np.broadcast_to(np.arange(tables, dtype=U64) * U64(1 << 20) + U64(dim), which.shape[:2]).copy()
                for i in range(hashes):
                    key = common.mix(key * U64(0x9E3779B97F4A7C15) + which[:, :, i] + U64(1))
                bits, factor = codes(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cid[i] for i in at], pa.int64()), pa.array([n[i] for i in at], pa.int64()), pa.array([vecs[i] for i in at], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary()),
                        pa.array(factor, pa.float64()), pa.array([x.astype("<u8").tobytes() for x in key], pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["cid", "n", "vec", "code", "factor", "marks", "keys"],
                )

    return classes.mapInArrow(run, "cid long, n long, vec binary, code binary, factor double, marks binary, keys array<long>")


def _compare(rows: list[tuple], cosine: float, table_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket or pair of blocks: links of each vector that no earlier table has, and its root among them."""
    vecs, n = [r[5] for r in rows], np.array([r[4] for r in rows], np.int64)
    unit, block = units(vecs), np.array([r[3] for r in rows])
    bits = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
    factor = np.array([r[7] for r in rows])
    marks = np.frombuffer(b"".join(r[8] for r in rows), "<u8").reshape(len(rows), -1)
    cross = rows[0][1] != rows[0][2]
    left, right = (np.flatnonzero(block == rows[0][1]), np.flatnonzero(block == rows[0][2])) if cross else (np.arange(len(rows)),) * 2
    guess, error = estimates(bits[left], factor[left], turned(unit[right]))
    close = guess + ERRORS * error[:, None] >= cosine
    i, j = np.nonzero(close)
    i, j = left[i], right[j]
    if not cross:
        i, j = i[i < j], j[i < j]
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    adjacent = np.zeros((len(rows), len(rows)), bool)
    for lo in range(0, len(i), 1 << 15):
        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        a, b = a[linked], b[linked]
        first = (marks[a] == marks[b]).argmax(axis=1) == table_of
        np.add.at(links, a[first], n[b[first]])
        np.add.at(links, b[first], n[a[first]])
        adjacent[a, b] = adjacent[b, a] = True
    free = np.ones(len(rows), bool)
    for s in range(len(rows)):
        if free[s]:
            free[s], new = False, np.array([s])
            while len(new):
                new = np.flatnonzero(adjacent[new].any(axis=0) & free)
                free[new] = False
                root[new] = s
    return links, root, np.flatnonzero(adjacent.any(axis=1))


def _compare_small(rows: list[tuple], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _compare, for many small whole buckets of one length of vectors side by side."""
    vecs, n, table = [r[5] for r in rows], np.array([r[4] for r in rows], np.int64), np.array([r[10] for r in rows])
    key = np.array([r[0] for r in rows], np.int64)
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    end = ends[np.searchsorted(ends, np.arange(len(rows)))]  # last row of each row's bucket
    unit = units(vecs)
    other = turned(unit).astype(np.float32)
    d = other.shape[1]
    signs = np.unpackbits(np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=d).astype(np.float32) * 2 - 1
    factor = np.array([r[7] for r in rows])
    error = np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, d - 1)))
    marks = np.frombuffer(b"".join(r[8] for r in rows), "<u8").reshape(len(rows), -1)
    after = end - np.arange(len(rows))
    at = np.concatenate(([0], np.cumsum(after)))
    links, some_a, some_b = np.zeros(len(rows), np.int64), [], []
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(lo, hi), after[lo:hi])
        b = a + 1 + np.arange(at[lo], at[hi]) - at[a]
        lo = hi
        guess = np.einsum("ij,ij->i", signs[a], other[b]) / (math.sqrt(d) * factor[a])
        close = guess + ERRORS * error[a] >= cosine
        a, b = a[close], b[close]
        linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        a, b = a[linked], b[linked]
        first = (marks[a] == marks[b]).argmax(axis=1) == table[a]
        np.add.at(links, a[first], n[b[first]])
        np.add.at(links, b[first], n[a[first]])
        some_a.append(a)
        some_b.append(b)
    a, b = np.concatenate(some_a), np.concatenate(some_b)
    root, last = np.arange(len(rows)), None
    while last is None or (root != last).any():  # the smallest row reachable, SMALL steps at most
        last = root.copy()
        np.minimum.at(root, a, last[b])
        np.minimum.at(root, b, last[a])
    return links, root, np.unique(np.concatenate((a, b)))


def _buckets(coded: DataFrame, cosine: float) -> DataFrame:
    """(cid, links, root): link counts of each bucket's vectors, and an edge to its component's first vector there."""
    exploded = coded.select(F.posexplode("keys").alias("t", "key"), "cid")
    sizes = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = exploded.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("cid", "key", "t", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "blocks")
    rows = members.join(coded.drop("keys"), "cid").select("key", "x", "y", "block", "n", "vec", "code", "factor", "marks", "cid", "t", "blocks")
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting: dict[int, list[tuple]] = {}

        def told(rows: list[tuple], links: np.ndarray, root: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rows[i][9] for i in some], pa.int64()), pa.array(links[some], pa.int64()), pa.array([rows[root[i]][9] for i in some], pa.int64())], ["cid", "links", "root"])

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > SMALL or (held and held[0][11] > 1):
                yield told(held, *_compare(held, cosine, held[0][10]))
            elif len(held) > 1:
                small = waiting.setdefault(len(held[0][5]), [])
                small += held
                if len(small) >= TOGETHER:
                    yield told(small, *_compare_small(small, cosine))
                    small.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:3] != row[:3]:
                    yield from done()
                    held = []
                held.append(row)
        yield from done()
        for small in filter(None, waiting.values()):
            yield told(small, *_compare_small(small, cosine))

    return dealt.mapInArrow(run, "cid long, links long, root long")


def links(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: vectors are linked at this cosine (double precision) or more.

    n_links counts the other rows that are linked directly, component_id is the smallest id reachable over links.
    Vectors that are null, empty or zero or hold null or non-finite components link with nothing; vectors of different
    lengths never link; equal vectors always do. Repeated rows are vectors of their own. A row without id counts as a
    link, but its own component_id is the smallest id that it reaches (null if there is none) and kept is false. An
    empty table gives no rows. Other columns are not read.
    """
    common.small_batches(rows.sparkSession)
    ids = common.materialise(_valid(rows, id_col, vec_col), "vectors")
    grouped = ids.filter("key is not null").groupBy("key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = common.materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy((F.length("vec") / 8).cast("int").alias("dim")).count().collect()  # a row for each length of vectors
    shape = {r["dim"]: plan(r["dim"], r["count"], cosine) for r in sizes}
    coded = common.materialise(_coded(classes.select("cid", "n", "vec"), shape), "codes")
    found = common.materialise(_buckets(coded, cosine), "links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = components(found.filter("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = classes.select("key", "cid", "n", "least").join(counts, "cid", "left").join(comps, classes.cid == comps.id, "left")
    named = named.select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("c"))
    lowest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "c").select("key", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = ids.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
