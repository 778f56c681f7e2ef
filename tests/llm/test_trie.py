import hashlib
import zlib

import pytest

from sparkloom.llm import queries, trie
from tests.llm.helpers import SF


def brute(rows, shared=True):
    """Plain Python over whole sequences."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        path = (convs.get(base, [])[:h] + own[h:]) if shared else own
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in children.get(p, [])) or 1
        saved = sum(sums[x][1] for x in children.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        sums[p] = leaves, saved
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x", None) for r in rows], "conv_id long, turn long, role string, text string, depth int, key string, ends string")


def test_query_against_plain_python(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(queries.op11_trie(spark, SF)) == brute(rows)


ODD = [
    (0, None, None, None), (0, 0, "user", "hé"), (0, 1, "", ""), (0, 2, "user", "x" * 200_000),
    (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "", "z"), (3, None, "user", "first"),
    (7, 5, "user", "only"), (8, 0, "a", "bc"), (9, 0, "ab", "c"), (-3, 1, "user", "n"), (-7, 1, "user", "n"), (-5, 0, "user", "n"),
    (None, 0, "user", "lost"), (2**62 + 1, 0, "user", "hé"), (2**62, 0, "user", "hé"),
]


@pytest.mark.parametrize("shared", [True, False])
def test_odd_rows(spark, monkeypatch, shared):
    for name, v in (("NODES", 3), ("ENDS", 2), ("MERGE", 2)):
        monkeypatch.setattr(trie, name, v)
    assert found(trie.prefix_trie(frame(spark, ODD), shared)) == brute(ODD, shared)
    assert found(trie.prefix_trie(frame(spark, ODD).limit(0), shared)) == []
    assert found(trie.prefix_trie(frame(spark, ODD).filter("conv_id is null"), shared)) == []


def test_hot_and_deep(spark):
    rows = [(c, t, "user", f"t{t if c % 3 else (t, c)}") for c in range(300) for t in range(4)]
    rows += [(5000 + c, t, "user", f"t{t}") for c in range(3) for t in range(150)]
    assert found(trie.prefix_trie(frame(spark, rows))) == brute(rows)
