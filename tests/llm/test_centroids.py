import hashlib
import math

import numpy as np
import pytest

from sparkloom.llm import centroids, queries
from tests.llm.helpers import SF


def brute(rows, k=8, rounds=10, dim=64):
    """Plain Python integers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(1024 * x) < 1 << 62 for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
    for _ in range(rounds):
        best = assign()
        new = []
        for c, old in enumerate(cents):
            mine = [v for (_, v), b in zip(kept, best) if b == c]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
        cents = new
    best = assign()
    each = [far(v, cents[b]) for (_, v), b in zip(kept, best)]
    inertia = [sum(d for d, b in zip(each, best) if b == c) for c in range(len(cents))]
    fit = lambda n: n if n < 1 << 63 else None
    out = [(i, b, fit(d), fit(inertia[b]), fit(sum(each)), hashlib.sha256(",".join(map(str, cents[b])).encode()).hexdigest()) for (i, _), b, d in zip(kept, best, each)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, inertia string")


def test_query_against_plain_python(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(queries.op13_centroids(spark, SF)) == brute(rows)


def test_odd_vectors_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 64).astype(float).tolist()) for i in range(60)]
    rows += [rows[0]] * 30 + [(None, rows[1][1]), (None, rows[2][1]), (90, None), (91, []), (92, [1.0] * 63), (93, [None] * 64), (94, [float("nan")] * 64), (95, [float("inf")] + [0.0] * 63), (96, [1e300] * 64)]
    assert found(centroids.clusters(frame(spark, rows))) == brute(rows)
    assert found(centroids.clusters(frame(spark, rows[:3]))) == brute(rows[:3])  # fewer vectors than clusters
    assert found(centroids.clusters(frame(spark, rows).limit(0))) == []
    assert found(centroids.clusters(frame(spark, rows).filter("vec_id >= 90"))) == []


@pytest.mark.parametrize("size", [1e5, 1e9, 1e15])
def test_values_beyond_64_bits(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (size * rng.standard_normal(64)).tolist()) for i in range(40)] + [(40, [0.25] * 64)]
    assert found(centroids.clusters(frame(spark, rows))) == brute(rows)


def test_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(20)]
    got = found(centroids.clusters(frame(spark, rows)))
    assert got == brute(rows) and len({r[1] for r in got}) == 2
