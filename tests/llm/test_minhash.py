import re
from collections import Counter

import numpy as np

from sparkloom.llm import components, minhash, queries
from tests.llm.helpers import ODD_ROWS, SF, no_docs, odd_docs


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, percent):
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return Counter((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets))


def edited(n=60):
    """Copies with a few words exchanged, in chains whose ends are far apart."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 4000)}"
    rows, words = [], [word() for _ in range(200)]
    for i in range(n):
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = word()
        rows.append((1000 - i, " ".join(words)))
    return rows + [(2000 + i, " ".join(words)) for i in range(20)]


def test_against_brute_force(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows in (real, edited()):
        for percent in (85, 80):
            got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent)
            assert Counter(tuple(r) for r in got.collect()) == brute(rows, percent)


def test_odd_rows(spark):
    got = Counter(tuple(r) for r in minhash.near_duplicates(odd_docs(spark), 85).collect())
    assert {r: n for r, n in got.items() if r[0] is not None} == brute([r[:2] for r in ODD_ROWS], 85)
    assert sum(n for r, n in got.items() if r[0] is None and not r[3]) == 1
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op10_minhash(spark, SF).collect()) == brute(rows, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 101), (7, 7), (200, 199), (200, 199)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100, 199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def morse(n):
    """Two words of the same letters in an order that polynomial hashes with an odd base do not tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_regular_build_are_told_apart(spark):
    rows = []
    for i, n in enumerate((64, 1024, 4096)):
        a, b = morse(n)
        rows += [(10 * i + 1, a), (10 * i + 2, b), (10 * i + 3, f"{a} {b} x y z u"), (10 * i + 4, f"{b} {a} x y z u")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 85)
    assert all(r["kept"] for r in got)


def test_links_are_confirmed_on_bytes(spark):
    """Equal signatures alone make no link."""
    rows = [(i, f"one two three four five {i} {i} {i} {i} {i}") for i in range(6)] + [(7, "one two three four five 1 1 1 1 1")]
    texts = spark.createDataFrame([(d, t, b"ab") for d, t in rows], "id long, text string, sig binary")
    pairs = spark.createDataFrame([(1, 2), (1, 7)], "a long, b long")
    got = minhash.verify(pairs, texts, 85, 5).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 7)]


def test_very_long_texts(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(400_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000), (4, "X" * 3_000_000), (5, "x" * 2_999_999)]
    assert len(long) > 2 << 20
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 85)
