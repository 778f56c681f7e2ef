import numpy as np
import pytest

from sparkloom.llm import neighbours, queries
from tests.llm.helpers import SF


def brute(rows, k=20, every=20):
    """{(query id, vector): [(score, id)]}, each list all candidates in order."""
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for dim in {len(v) for _, v in ok}:
        part = [(i, v) for i, v in ok if len(v) == dim]
        ids, x = np.array([i for i, _ in part]), np.array([v for _, v in part])
        for i, v in part:
            if i % every == 0:
                score = (x * np.array(v)).sum(axis=1)
                order = np.lexsort((ids, -score))
                out[i, v] = [(float(score[j]), int(ids[j])) for j in order if ids[j] != i][:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, query_id string, score double")


def exact(rows, got):
    want = sorted((i, n + 1, j, s) for (i, _), near in brute(rows).items() for n, (s, j) in enumerate(near))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def recall(rows, got):
    want, met = brute(rows), 0
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    vec = {i: np.array(v) for i, v in rows}
    for (i, v), near in want.items():
        mine = by[i]
        assert len(mine) == len(near) and mine == sorted(mine, key=lambda x: (-x[1], x[0])) and i not in {x[0] for x in mine}
        assert all(abs(s - float((vec[j] * np.array(v)).sum())) < 1e-12 for j, s in mine)
        met += len({x[0] for x in mine} & {j for _, j in near})
    return met / sum(len(n) for n in want.values())


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(rows, queries.op12_neighbours(spark, SF).collect()) >= 0.9


def test_recall_of_many_vectors_of_many_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 40)) * rng.uniform(0.5, 2, (6000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(rows, neighbours.nearest(frame(spark, rows)).collect()) >= 0.9


def test_ties_equal_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i - 40, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(150)]  # few different vectors, ties everywhere
    rows += [rows[45]] * 3 + [(rows[45][0], [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (200, None), (220, []), (240, [0.0] * 3), (260, [None] * 3), (280, [float("nan")] * 3), (300, [float("inf"), 0.0, 0.0])]
    rows += [(320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, [5.0])]  # one candidate, none
    df = frame(spark, rows)
    exact(rows, neighbours.nearest(df).collect())
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 340")).count() == 0


def test_large_buckets_in_blocks(spark, monkeypatch):
    for name, v in (("ROWS", 16), ("QUERIES", 4), ("PARTS", 3), ("POOL", 50), ("SCORES", 64)):
        monkeypatch.setattr(neighbours, name, v)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.01 * rng.standard_normal(16)).tolist()) for i in range(700)]  # one bucket
    assert recall(rows, neighbours.nearest(frame(spark, rows)).collect()) >= 0.9


@pytest.mark.parametrize("hashes", [1, 2])
def test_keys_probes_and_rotations(hashes):
    rng = np.random.default_rng(7)
    unit = neighbours.on_sphere(rng.standard_normal((30, 5)), None)
    turned = neighbours.rotated(unit, 5, 0, 0)
    assert np.allclose(turned @ turned.T, unit @ unit.T)
    own = neighbours.keys_of(unit, 5, hashes)
    first = neighbours.probes_of(unit, 5, hashes, 1)
    assert (own == first).all()  # the nearest key is a vector's own
    assert len(np.unique(neighbours.probes_of(unit, 5, hashes, 16**hashes)[0])) == 4 * 16**hashes


def test_norms_become_angles():
    x = np.array([[3.0, 4.0], [0.3, 0.4], [1e300, 0.0]])
    out = neighbours.on_sphere(x[:2], 5.0)
    assert np.allclose(np.linalg.norm(out, axis=1), 1) and np.allclose(out[:, :2], x[:2] / 5)
    assert np.isfinite(neighbours.on_sphere(x, 1e300)).all()
