"""Sketches, sharding and mixing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm import mixing, queries, sharding, sketch
from tests.llm.helpers import ODD_ROWS, SF, no_docs, odd_docs


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_edited_pairs_against_plain_python(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs(spark)):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        got = sketch.edited_pairs(docs).collect()
        assert len(got) == len(rows)
        want, errors = Counter(), []
        by = defaultdict(list)
        for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
            a, b = shingle_set(text), shingle_set(edited)
            by[doc].append(len(a & b) / len(a | b) if a | b else 1.0)
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        for r in got:
            errors.append(min(abs(r["near_edited"] - x) for x in by[r["doc_id"]]))
            assert 0 <= r["near_next"] <= 1
        assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.04
    assert sketch.edited_pairs(no_docs(spark)).count() == 0
    one = odd_docs(spark).filter("doc_id = 1")
    assert [r["near_next"] for r in sketch.edited_pairs(one).collect()] == [1.0]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 5000, 3000)]
    a, b = " ".join(words), " ".join(words[:1500])
    x, y = sketch.sketches([a.encode(), b.encode()])
    ratios = []
    for seed in range(60):  # one text can be four standard errors off, as this one is; many must not be
        text = " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 5000, 3000))
        ratios.append(sketch.distinct_count(sketch.sketches([text.encode()])[0]) / len(shingle_set(text)))
    assert abs(np.mean(ratios) - 1) < 4 / (sketch.K * len(ratios)) ** 0.5 and np.std(ratios) < 1.5 / sketch.K**0.5
    assert abs(sketch.resemblance(x, y) - 0.5) < 0.15 and sketch.containment(y, x) > 0.7
    assert (sketch.merge([x, y]) == x).all()
    assert (sketch.from_string(sketch.to_string(x)) == x).all()


def test_merged_by_group(spark):
    prints = sketch.fingerprints(odd_docs(spark)).withColumn("g", sketch.F.lit("all"))
    rows = [sketch.from_string(r["fingerprint"]) for r in prints.collect()]
    merged = sketch.merged(prints, "g").collect()
    assert len(merged) == 1 and (sketch.from_string(merged[0]["fingerprint"]) == sketch.merge(rows)).all()


def test_shards(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs(spark)):
        rows = docs.collect()
        got = sharding.assign(docs, sharding.even_tree(16)).collect()
        assert Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
        slots = defaultdict(list)
        for r in got:
            assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(no_docs(spark), sharding.even_tree(16)).count() == 0


def test_shares_and_confined_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree(8, 2, 2)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 1 else 1.0) for x in tree]
    got = ids.select(sharding.shard_of(ids.doc_id, tree).alias("a"), sharding.shard_of(ids.doc_id, heavier).alias("b"), sharding.shard_of(ids.doc_id, sharding.grow(tree)).alias("c")).collect()
    n = Counter(r["a"] for r in got)
    assert all(abs(v - 2500) < 250 for v in n.values())
    assert {r["c"] for r in got if r["a"] != r["c"]} == {8}
    assert abs(Counter(r["b"] for r in got)[1] - 20000 * 2 / 9) < 350
    region = lambda s: s // 4
    assert {region(r["b"]) for r in got if r["a"] != r["b"]} == {0}  # moves end in the region whose weight grew
    assert all(r["a"] == r["b"] for r in got if region(r["a"]) == region(r["b"]) == 1)


def edf(weights):
    """The schedule by plain simulation."""
    q, names, done, out = sum(weights.values()), list(weights), Counter(), []
    for t in range(q):
        ready = [(-(-(done[k] + 1) * q // weights[k]), i) for i, k in enumerate(names) if done[k] < weights[k] and done[k] * q // weights[k] <= t]
        k = names[min(ready)[1]]
        out.append(k)
        done[k] += 1
    return out


def test_schedule_and_lag(spark):
    for weights in ({"a": 1}, {"a": 3, "b": 2, "c": 7}, queries.SOURCE_WEIGHTS):
        got = [r["mix_class"] for r in mixing.schedule(spark, weights).orderBy("at").collect()]
        assert got == edf(weights)
        q, seen = sum(weights.values()), Counter()
        for t, k in enumerate(got, 1):
            seen[k] += 1
            assert all(abs(seen[x] - t * w / q) < 1 for x, w in weights.items())


def test_mix_keeps_rows_and_windows(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs(spark)):
        weights = {"src0": 3, "src1": 2, mixing.OTHER: 5}
        got = mixing.mix(docs, weights, 4).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
        assert len({r["position"] for r in got}) == len(got)
        for r in got:
            w = weights[r["mix_class"]]
            assert r["mix_class"] == (r["source"] if r["source"] in weights else mixing.OTHER)
            assert r["block"] * 10 // w <= r["slot"] < -(-(r["block"] + 1) * 10 // w) and r["position"] // 4 == r["slot"]
        sizes = Counter((r["mix_class"], r["block"]) for r in got)
        last = {k: max(b for c, b in sizes if c == k) for k, _ in sizes}
        assert all(n == 4 or b == last[k] for (k, b), n in sizes.items())
    assert mixing.mix(no_docs(spark), weights).count() == 0
    ordered = [r["position"] for r in mixing.in_order(mixing.mix(docs, weights, 4)).collect()]
    assert ordered == sorted(ordered)
