"""Nearest neighbours by largest inner product: cross-polytope hash tables with many probes, and exact reranking.

1. Equal vectors are one class, with its k + 1 smallest ids: no later one can be among k nearest.
2. Every class is put on the unit sphere: the vector over the largest norm of all, with one more coordinate that makes
   the norm 1. The largest inner products with a query are then the smallest angles to it.
3. A hash is the signed axis nearest to the vector after a pseudo-rotation (three rounds of random signs and a fast
   Hadamard transform). A key has one hash, or two where one would leave over BUCKET classes in a bucket. Each of TABLES
   tables has every class once; a query probes the keys nearest to it, in order of how little its coordinates are short
   of the largest.
4. How many keys a query probes is measured: the true neighbours of SAMPLE queries, found by a pass over all classes, must
   be met in TARGET of all cases. Every class is in the tables; only the number of probes rests on the sample.
5. Buckets and their queries meet in one task, a block of them at most; queries stand first, classes stream by. Only the k + 1
   best of each query leave it. The nearest FIRST of a query's probes go before the others, which then send only what is as good
   as the k + 1 found so far. Scores are products of the original vectors in double precision, added up in one order.
6. Queries that met too few classes are searched against all of them, in blocks.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 20250719
TABLES = 4
#: Classes of a bucket, on average, from which a key has two hashes.
BUCKET = 4096
#: Queries whose true neighbours tell how many keys are probed, and the part of these that the probes must meet.
SAMPLE, TARGET = 256, 0.96
#: Part of a query's probes that go first.
FIRST = 1 / 8
#: Classes and queries of a bucket that meet in one task (a larger bucket has at most PARTS blocks of classes).
ROWS, QUERIES, PARTS = 4096, 1024, 64
#: Scores that one pass computes at a time, and those that a task keeps before it takes the best.
SCORES, POOL = 1 << 20, 1 << 17


def width(dim: int) -> int:
    """Coordinates after a pseudo-rotation: a power of two that has room for one more."""
    return 1 << max(2, dim.bit_length())


@functools.lru_cache(64)
def _signs(dim: int, table: int, nth: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table, nth]).choice([-1.0, 1.0], (3, width(dim)))


def rotated(unit: np.ndarray, dim: int, table: int, nth: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform: (n, width), norms stay."""
    n, d = unit.shape
    for signs in _signs(dim, table, nth):
        unit, half = unit * signs, 1
        while half < d:
            pairs = unit.reshape(n, -1, 2, half)
            unit = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, d)
            half *= 2
        unit = unit / math.sqrt(d)
    return unit


def on_sphere(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Unit vectors of one coordinate more, padded with zeros; a query (largest is None) has 0 there."""
    n, dim = x.shape
    out = np.zeros((n, width(dim)))
    top = np.abs(x).max(axis=1, keepdims=True)
    y = x / top
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    if largest is None:
        out[:, :dim] = y / norm
    else:
        share = np.minimum(1.0, norm * (top / largest))
        out[:, :dim] = y / norm * share
        out[:, dim] = np.sqrt(1 - share[:, 0] ** 2)
    return out


def _short(unit: np.ndarray, dim: int, table: int, hashes: int) -> list[np.ndarray]:
    """For each hash: how much each signed axis is short of the nearest, (n, 2 * width)."""
    out = []
    for nth in range(hashes):
        x = rotated(unit, dim, table, nth)
        both = np.concatenate((x, -x), axis=1)
        out.append(both.max(axis=1, keepdims=True) - both)
    return out


def keys_of(unit: np.ndarray, dim: int, hashes: int) -> np.ndarray:
    """(n, TABLES): the key of each vector in each table."""
    axes, out = 2 * width(dim), []
    for table in range(TABLES):
        code = np.full(len(unit), table, np.int64)
        for short in _short(unit, dim, table, hashes):
            code = code * axes + short.argmin(axis=1)
        out.append(code)
    return np.stack(out, axis=1)


def _costs(unit: np.ndarray, dim: int, table: int, hashes: int) -> np.ndarray:
    """How far each key of a table is from each query, (n, keys)."""
    first, *rest = _short(unit, dim, table, hashes)
    for short in rest:
        first = (first[:, :, None] ** 2 + short[:, None, :] ** 2).reshape(len(unit), -1)
    return first


def probes_of(unit: np.ndarray, dim: int, hashes: int, probes: int) -> np.ndarray:
    """(n, probes * TABLES): the nearest keys of each query in each table, nearer ones first."""
    n_keys, out = (2 * width(dim)) ** hashes, []
    for table in range(TABLES):
        cost = _costs(unit, dim, table, hashes)
        near = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < n_keys else np.broadcast_to(np.arange(n_keys), cost.shape)
        near = np.take_along_axis(near, np.take_along_axis(cost, near, 1).argsort(axis=1, kind="stable"), 1)
        out.append(near + table * n_keys)
    return np.stack(out, axis=2).reshape(len(unit), -1)


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, vec, norm) of the vectors that take part; key names the bytes of vec, its components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.parts([whole]):
                v = b.column(1)
                raw = (v.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0).tobytes()
                at = np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64) * 8
                vecs = [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                norms = [float(np.abs(y).max() * np.linalg.norm(y / np.abs(y).max())) for y in (np.frombuffer(x, "<f8") for x in vecs)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in vecs], pa.binary()), pa.array(vecs, pa.binary()), pa.array(norms, pa.float64())], ["id", "key", "vec", "norm"])

    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    takes_part = F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    return rows.filter(takes_part).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).mapInArrow(run, "id long, key binary, vec binary, norm double")


def _matrix(vecs: pa.Array) -> np.ndarray:
    data, at = common.text_arrays(vecs)
    return np.frombuffer(data[at[0] : at[-1]].tobytes(), "<f8").reshape(len(vecs), -1)


def _names(keys: pa.Array) -> np.ndarray:
    data, at = common.text_arrays(keys)
    return np.frombuffer(data[at[0] : at[-1]].tobytes(), "<u8").reshape(len(keys), 2)


class _Best:
    """The n best classes of queries, over the batches of classes that go by."""

    def __init__(self, n: int):
        self.n, self.held, self.size = n, [], 0

    def add(self, queries: tuple[np.ndarray, np.ndarray, np.ndarray], names: np.ndarray, low: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """queries: names, vectors, and the score under which no class can be among the best, which rises here."""
        q_names, q, floor = queries
        step = max(1, SCORES // max(1, len(q)))
        for lo in range(0, len(x), step):
            y = x[lo : lo + step]
            with np.errstate(all="ignore"):
                score = q @ y.T
                slack = 1e-10 * np.linalg.norm(q, axis=1) * np.linalg.norm(y, axis=1).max()
            if len(y) >= self.n:
                np.maximum(floor, np.partition(score, len(y) - self.n, axis=1)[:, len(y) - self.n] - slack, out=floor)
            i, j = np.nonzero(score >= (floor - slack)[:, None])
            for a in range(0, len(i), 1 << 14):
                u, v = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
                with np.errstate(all="ignore"):
                    exact = (q[u] * y[v]).sum(axis=1)
                self.held.append((q_names[u], names[lo + v], exact, low[lo + v], ids[lo + v]))
            self.size += len(i)

    def taken(self) -> pa.RecordBatch:
        """What is held, no more than n classes a query."""
        if not self.held:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in _FOUND.values()], list(_FOUND))
        q, c, score, low, ids = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((c[:, 1], c[:, 0], low, -score, q[:, 1], q[:, 0]))
        new_q, new_c = np.ones(len(order), bool), np.ones(len(order), bool)
        new_q[1:] = (q[order[1:]] != q[order[:-1]]).any(axis=1)
        new_c[1:] = new_q[1:] | (c[order[1:]] != c[order[:-1]]).any(axis=1)
        order, new_q = order[new_c], new_q[new_c]
        first = np.flatnonzero(new_q)
        nth = np.arange(len(order)) - first[np.cumsum(new_q) - 1]
        o = order[nth < self.n]
        self.held, self.size = [], 0
        fixed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
        return pa.RecordBatch.from_arrays([fixed(q[o]), fixed(c[o]), pa.array(score[o]), pa.array(low[o]), pa.array(ids[o].tolist(), pa.binary())], list(_FOUND))


_FOUND = {"query": pa.binary(), "key": pa.binary(), "score": pa.float64(), "low": pa.int64(), "ids": pa.binary()}
_FOUND_TYPE = "query binary, key binary, score double, low long, ids binary"


def _scan(rows: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query, key, score, low, ids): the n best classes of each query in each cell (rows and queries of equal c), repeats between cells included.

    rows: (c, key, vec, low, ids), queries: (c, key, vec, floor); all vectors of a cell have one length. A cell's queries stand
    first and are held, its classes stream by. A class under a query's floor is left out (null: none is).
    """
    left = queries.select("c", F.lit(0).alias("side"), "key", "vec", F.lit(0).cast("long").alias("low"), F.lit(None).cast("binary").alias("ids"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    dealt = left.unionByName(rows.select("c", F.lit(1).alias("side"), "key", "vec", "low", "ids", F.lit(0.0).alias("floor"))).repartition("c").sortWithinPartitions("c", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, cell, held, queries = _Best(n), None, [], None
        for whole in batches:
            for b in common.parts([whole]):
                cells, side = b.column(0).to_pylist(), b.column(1).to_numpy()
                new = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1] or side[i] != side[i - 1]), len(cells)]
                for lo, hi in zip(new[:-1], new[1:]):
                    if cells[lo] != cell:
                        cell, held, queries = cells[lo], [], None
                    part = b.slice(lo, hi - lo)
                    if side[lo] == 0:
                        held.append((_names(part.column(2)), _matrix(part.column(3)), part.column(6).to_numpy()))
                    elif held:
                        if queries is None:
                            queries = tuple(np.concatenate(x) for x in zip(*held))
                        best.add(queries, _names(part.column(2)), part.column(4).to_numpy(), np.array(part.column(5).to_pylist(), object), _matrix(part.column(3)))
                        if best.size > POOL:
                            yield best.taken()
        yield best.taken()

    return dealt.mapInArrow(run, _FOUND_TYPE)


def _true(classes: DataFrame, names: np.ndarray, q: np.ndarray, n: int) -> DataFrame:
    """As _scan, of a bounded set of queries against all classes of their length, without a shuffle of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = _Best(n), np.full(len(q), -np.inf)
        for whole in batches:
            for b in common.parts([whole]):
                if b.num_rows:
                    best.add((names, q, floor), _names(b.column(0)), b.column(2).to_numpy(), np.array(b.column(3).to_pylist(), object), _matrix(b.column(1)))
                    if best.size > POOL:
                        yield best.taken()
        yield best.taken()

    return classes.select("key", "vec", "low", "ids").mapInArrow(run, _FOUND_TYPE)


def _top(found: DataFrame, n: int) -> DataFrame:
    """The n best classes of each query, each once."""
    nth = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score"), "low", "key"))  # repeats of a class share a rank
    return found.withColumn("nth", nth).filter(F.col("nth") <= n).dropDuplicates(["query", "nth"])


def fit(classes: DataFrame, dim: int, hashes: int, largest: float, n: int) -> int:
    """Keys that a query probes in each table; classes: (key, vec, low, ids, asks) of one length of vectors."""
    asked = classes.filter("asks").select("key", "vec").orderBy("key").limit(SAMPLE).collect()  # keys are hashes: a random sample, bounded
    if not asked:
        return 1
    names, q = np.frombuffer(b"".join(bytes(r["key"]) for r in asked), "<u8").reshape(-1, 2), np.stack([np.frombuffer(r["vec"], "<f8") for r in asked])
    # SAMPLE * n pairs at most
    best = _top(_true(classes, names, q, n), n).select("query", "key").join(classes.select("key", "vec"), "key").collect()
    place = {bytes(r["key"]): i for i, r in enumerate(asked)}
    pairs = [(place[bytes(r["query"])], np.frombuffer(r["vec"], "<f8")) for r in best if bytes(r["query"]) != bytes(r["key"])]
    if not pairs:
        return 1
    who, near = np.array([p[0] for p in pairs]), keys_of(on_sphere(np.stack([p[1] for p in pairs]), largest), dim, hashes)
    unit, n_keys = on_sphere(q, None), (2 * width(dim)) ** hashes
    rank = np.full(len(who), n_keys)
    for i in range(len(asked)):
        mine = np.flatnonzero(who == i)
        for table in range(TABLES):
            cost = _costs(unit[i : i + 1], dim, table, hashes)[0]
            order = np.sort(cost)
            rank[mine] = np.minimum(rank[mine], np.searchsorted(order, cost[near[mine, table] - table * n_keys]))
    return int(np.sort(rank)[min(len(rank) - 1, int(TARGET * len(rank)))]) + 1


def _keyed(classes: DataFrame, shape: dict[int, tuple[int, float, int]], asks: bool) -> DataFrame:
    """classes (those that ask, or all) with their length and the keys that they have, or probe."""
    source = classes.filter("asks") if asks else classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.parts([whole]):
                sizes = pc.binary_length(b.column(1)).to_numpy() // 8
                for dim in np.unique(sizes).tolist():
                    if dim not in shape:
                        continue
                    hashes, largest, probes = shape[dim]
                    at = np.flatnonzero(sizes == dim)
                    some = max(1, (1 << 21) // (2 * width(dim)) ** hashes) if asks else max(1, (1 << 20) // width(dim))
                    for lo in range(0, len(at), some):
                        part = b.take(pa.array(at[lo : lo + some]))
                        unit = on_sphere(_matrix(part.column(1)), None if asks else largest)
                        keys = probes_of(unit, dim, hashes, probes) if asks else keys_of(unit, dim, hashes)
                        first = math.ceil(probes * FIRST) * TABLES
                        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x] * part.num_rows, pa.int32()) for x in (dim, first)), pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["key", "vec", "low", "ids", "dim", "first", "keys"])

    return source.select("key", "vec", "low", "ids").mapInArrow(run, "key binary, vec binary, low long, ids binary, dim int, first int, keys array<long>")


def _cells(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and queries by (dim, bucket), dealt into cells (c) of bounded blocks; both have dim, bucket, key, vec."""

    def large(df: DataFrame, block: int) -> DataFrame:
        sizes = df.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"))
        least = max(block, df.count() // common.HOT)
        return sizes.filter(F.col("n") > least).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))

    m = large(rows, ROWS).select("dim", "bucket", F.least("blocks", F.lit(PARTS)).alias("m"))
    q = large(queries, QUERIES).select("dim", "bucket", F.col("blocks").alias("q"))
    # fewer than 2 * HOT buckets are this large, whatever the size of the table
    hot = common.materialise(m.join(q, ["dim", "bucket"], "full"), "large")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.coalesce(own, F.lit(1))).cast("int").alias(f"x{own}")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(f"x{other}")
        out = df.join(F.broadcast(hot), ["dim", "bucket"], "left").select("*", mine, theirs)
        return out.withColumn("c", F.concat_ws("/", "dim", "bucket", "xm", "xq")).drop("m", "q", "xm", "xq", "dim", "bucket")

    return dealt(rows, "m", "q"), dealt(queries, "q", "m")


def nearest(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by every.

    Nearest first by inner product in double precision, equal ones by id. Vectors that are null, empty or zero or hold
    null or non-finite components, and rows without id, take no part; nor does a query's own id. Vectors of other
    lengths are no candidates. Repeated rows count once; an id with several vectors is a query, and a candidate, with each. Fewer
    than k candidates are all returned; an empty table gives no rows. Other columns are not read.
    """
    common.small_batches(rows.sparkSession)
    ids = common.materialise(_vectors(rows, id_col, vec_col).withColumn("asks", F.col("id") % every == 0), "vectors")
    n = k + 1
    members = ids.select("key", "id").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("nth") <= n)
    members = members.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("l"))  # n ids at most
    packed = F.unhex(F.array_join(F.transform("l", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    whole = ids.groupBy("key").agg(F.first("vec").alias("vec"), F.first("norm").alias("norm"), F.max("asks").alias("asks"))
    classes = common.materialise(whole.join(members.select("key", F.col("l")[0].alias("low"), packed.alias("ids")), "key"), "classes")

    none = F.lit(None).cast("double")
    shape: dict[int, tuple[int, float, int]] = {}
    size = (F.length("vec") / 8).cast("int")
    for r in classes.groupBy(size.alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest"), F.max("asks").alias("asks")).collect():  # a row for each length of vectors
        dim, count, largest = r["dim"], r["n"], r["largest"]
        if count > n and r["asks"]:
            hashes = 1 if count <= BUCKET * 2 * width(dim) else 2
            shape[dim] = hashes, largest, fit(classes.filter(F.length("vec") == 8 * dim), dim, hashes, largest, n)
    keyed = common.materialise(_keyed(classes, shape, False), "keyed").select("dim", F.explode("keys").alias("bucket"), "key", "vec", "low", "ids")
    probing = common.materialise(_keyed(classes, shape, True), "probing").select("dim", "key", "vec", "first", F.posexplode("keys").alias("pos", "bucket"))
    before = common.materialise(_top(_scan(*_cells(keyed, probing.filter("pos < first").withColumn("floor", none)), n), n), "before")
    floors = before.filter(F.col("nth") == n).select(F.col("query").alias("key"), F.col("score").alias("floor"))
    later = _scan(*_cells(keyed, probing.filter("pos >= first").join(floors, "key", "left")), n)
    found = common.materialise(_top(before.drop("nth").unionByName(later), n), "found")

    # queries that met too few classes, of lengths without tables too
    counts = classes.groupBy(size.alias("dim")).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("enough"))
    met = found.groupBy(F.col("query").alias("key")).agg(F.count(F.lit(1)).alias("met"))
    wanting = classes.filter("asks").join(met, "key", "left").withColumn("dim", size).join(F.broadcast(counts), "dim")
    wanting = common.materialise(wanting.filter(F.coalesce("met", F.lit(0)) < F.col("enough")).select("dim", F.lit(-1).cast("long").alias("bucket"), "key", "vec"), "wanting")
    if not wanting.isEmpty():
        all_rows = classes.select(size.alias("dim"), F.lit(-1).cast("long").alias("bucket"), "key", "vec", "low", "ids")
        more = _top(_scan(*_cells(all_rows.join(F.broadcast(wanting.select("dim").distinct()), "dim"), wanting.withColumn("floor", none)), n), n)
        found = found.join(wanting.select(F.col("key").alias("query")), "query", "left_anti").unionByName(more)

    each = F.transform(F.sequence(F.lit(0), F.expr("length(ids) DIV 8 - 1").cast("int")), lambda i: F.conv(F.hex(F.substring("ids", 1 + 8 * i, 8)), 16, -10).cast("long"))
    one = found.select("query", "score", F.explode(each).alias("id"))
    listed = one.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, n).alias("near"))  # n * n at most
    queries = ids.filter("asks").select("key", "id").distinct()
    out = common.meet(queries, listed.withColumnRenamed("query", "key"), "key")
    out = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("nth", "x"))
    return out.select("query_id", (F.col("nth") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
