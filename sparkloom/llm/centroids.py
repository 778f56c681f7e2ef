"""Clusters of integer vectors around centroids: plain Lloyd with exact sums.

Every round broadcasts the centroids (a few hundred integers), a pandas batch at a time takes the squared differences to
each of them, and each task sends one row of integer sums per cluster and component; a groupBy adds them up. All
arithmetic is on integers, so the result depends neither on the order of rows nor on how they are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CLUSTERS = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
#: Differences of integers under this in size have squares whose sums over a vector fit 64 bits; others are Python's integers.
NARROW = 1 << 26
_MOST = (1 << 63) - 1


def integers(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def fits(vec: Column, dim: int, scale: int = SCALE) -> Column:
    """Whether a vector has dim components, none of them null or not finite, all of whose integers fit 64 bits."""
    bound = F.lit(float(1 << 62) / scale)
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < bound)), F.lit(False))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smallest of equals; its squared distance)."""
    wide = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) >= NARROW
    if wide:
        x, centroids = x.astype(object), centroids.astype(object)
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = far.argmin(axis=1).astype(np.int64)
    return best, far[np.arange(len(x)), best]


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Of each cluster that is not empty: rows, sums of the components, sum of the squared distances."""
    k, dim = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, rows, far = np.zeros((k, dim), object), [0] * k, [0] * k
        for b in batches:
            if not len(b):
                continue
            x = _rows(b["v"])
            best, distance = nearest(x, centroids)
            exact = x if int(np.abs(x).max()) < NARROW else x.astype(object)
            for c in np.unique(best).tolist():
                mine = best == c
                rows[c] += int(mine.sum())
                far[c] += sum(min(d, _MOST + 1) for d in distance[mine].tolist())  # a sum with a greater one does not fit either way
                sums[c] += exact[mine].sum(axis=0).astype(object)
        out = [(c, i, str(v)) for c in range(k) if rows[c] for i, v in [(-2, rows[c]), (-1, far[c]), *enumerate(sums[c].tolist())]]
        yield pd.DataFrame(out, columns=["cluster", "place", "total"])

    added = vectors.select("v").mapInPandas(run, "cluster int, place int, total string")
    # a row for each cluster and component: what comes to the driver does not grow with the table
    got = added.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    by = {(r["cluster"], r["place"]): int(r["total"]) for r in got}
    for c in sorted({c for c, _ in by}):
        out[c] = by[c, -2], [by[c, i] for i in range(dim)], by[c, -1]
    return out


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds over the integer vectors in column v; the centroid of an empty cluster stays."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, sums, _) in _totals(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose lowercase-hex sha256 of `seed:<id>` is smallest, in ascending order of it (fewer if there are fewer)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def clusters(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "3", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors with another number of components than dim, with null or non-finite ones, or with one whose integer is
    beyond 62 bits, are left out, as are null vectors. Distances and their sums that do not fit a long are null. Repeated
    rows and equal vectors are vectors of their own; those without id come last in the choice of the first centroids, and
    equal hashes are told apart by the vectors. Fewer vectors than k give as many clusters; no vector gives no rows.
    Other columns are not read.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e")).filter(fits(F.col("e"), dim, scale))
    vectors = common.materialise(kept.select("id", integers(F.col("e"), scale).alias("v")), "integers")
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return vectors.limit(0).selectExpr("id AS vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    final = lloyd(vectors, start, rounds)
    totals = _totals(vectors, final)
    fit = lambda n: n if n <= _MOST else None
    whole = fit(sum(t[2] for t in totals.values()))
    facts = [(c, fit(t[2]), whole, hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest()) for c, t in totals.items()]
    facts_df = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                best, distance = nearest(_rows(b["v"]), final)
                yield pd.DataFrame({"vec_id": b["id"].astype("Int64"), "cluster": best, "distance": pd.array([fit(d) for d in distance.tolist()], "Int64")})

    found = vectors.mapInPandas(run, "vec_id long, cluster int, distance long")
    return found.join(F.broadcast(facts_df), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
