import numpy as np
import pytest

from sparkloom.llm import embeddings, queries
from tests.llm.helpers import SF


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for dim in {len(v) for _, v in ok}:
        at = [i for i, v in ok if len(v) == dim]
        unit = np.array([v / np.linalg.norm(v) for _, v in ok if len(v) == dim])
        linked = unit @ unit.T >= cosine
        for a, i in enumerate(at):
            links[i] = int(linked[a].sum()) - 1
            for b in np.flatnonzero(linked[a]):
                parent[find(i)] = find(at[b])
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).extend([] if d is None else [d])
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(low[find(i)], default=None)
        out.append((d, links[i], c, d is not None and d == c))
    return sorted(out, key=repr)


def near_groups(n=700):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 64))
    rows = [(i * 3 + 1, (base[int(40 * rng.random() ** 3)] + rng.choice([0, 0.2, 0.3, 0.35, 0.45]) * rng.standard_normal(64)).tolist()) for i in range(n)]
    odd = [None, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [], [None] * 64, rows[0][1], rows[0][1], [-0.0] * 63 + [1.0], [0.0] * 63 + [1.0]]
    return rows + [(7000 + i, v) for i, v in enumerate(odd)] + [(7008, rows[0][1]), (None, rows[1][1]), (None, None)]


@pytest.mark.parametrize("block", [1024, 32])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = near_groups()
    df = spark.createDataFrame([(d, v, "x", 1) for d, v in rows], "vec_id long, embedding array<double>, label string, n_links int")
    assert sorted((tuple(r) for r in embeddings.links(df).collect()), key=repr) == brute(rows)
    assert embeddings.links(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 64))
    b = a + 0.8 * rng.standard_normal((300, 64))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    bits, factor = embeddings.codes(a)
    guess, error = embeddings.estimates(bits, factor, embeddings.turned(b))
    wrong = guess - a @ b.T
    assert abs(wrong.mean()) < 0.005
    assert 0.7 < (wrong / error[:, None]).std() < 1.3 and (np.abs(wrong) < embeddings.ERRORS * error[:, None]).all()


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op3_embedding_links(spark, SF).collect()), key=repr) == brute(rows)
