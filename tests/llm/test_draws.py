"""The draws of the hash tree against plain Python."""

import math

import pytest
import xxhash

from sparkloom.llm import sharding


def draw(key, child, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    u = ((xxhash.xxh64_intdigest(child.encode(), seed=seed) >> 11) + 0.5) / float(1 << 53)
    return -math.log(u) / weight, child


def shard(key, tree):
    node, depth = "", 0
    for level in ("region", "rack", "shard"):
        weights = {}
        for x in tree:
            path = f"{x.region}/{x.rack}/{x.shard}".split("/")
            if "/".join(path[:depth]) == node:
                child = "/".join(path[: depth + 1])
                weights[child] = weights.get(child, 0.0) + x.weight
        node, depth = min(draw(key, c, w) for c, w in weights.items() if w > 0)[1], depth + 1
    return int(node.split("/")[-1])


@pytest.mark.parametrize("tree", [sharding.even_tree(16), sharding.grow(sharding.even_tree(16)), [sharding.Leaf(0, 0, 0, 2.5), sharding.Leaf(0, 1, 1, 0.0), sharding.Leaf(3, 0, 7, 1.0), sharding.Leaf(0, 0, 2, 0.25)]])
def test_draws(spark, tree):
    keys = [None, 0, 1, -1, 2**63 - 1, -(2**63), *range(2, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", sharding.shard_of(df.doc_id, tree).alias("s")).collect()}
    assert got == {k: shard(k, tree) for k in keys}
