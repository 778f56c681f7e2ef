import hashlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import queries, repeats
from tests.llm.helpers import ODD_ROWS, SF, no_docs, odd_docs

LAST = 1 << 62


def brute(rows, length):
    first = {}
    key = lambda d: LAST if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, LAST), key(d))
    out = Counter()
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()] += 1
    return out


def planted(spark):
    """A hot passage before and after different texts, near copies, ties in doc_id and a text of many chunks' pieces."""
    shared = "a passage that very many of the documents hold, word for word and mark for mark, to the end. "
    rows = [(i, f"{'xyz'[i % 3] * (i % 40)} opening {i * 7919} {shared}{i * 104729} closing {'ab' * (i % 25)}") for i in range(120)]
    rows += [(5, shared), (5, shared + shared), (900, shared[:60]), (901, shared[20:]), (None, shared), (None, "alone " * 20)]
    return rows


@pytest.mark.parametrize("split", [4096, 2])
def test_kept_against_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "CHUNK", 20_000)
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for rows in (real, [r[:2] for r in ODD_ROWS], planted(spark)):
        for length in (50, 150):
            docs = spark.createDataFrame(rows, "doc_id long, text string")
            got = Counter(tuple(r)[:5] for r in repeats.without_repeats(docs, length).collect())
            assert got == brute(rows, length)


#: Different strings whose polynomial sums of the segment hash are equal.
FALL_TOGETHER = ("LRLRWWIKNQVKQ", "SMTNHIVTRNJUO")


def test_contents_whose_hashes_fall_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    ends = [(word(60), word(60)) for _ in range(40)]
    rows = [(2 * i + k, a + FALL_TOGETHER[k] + b) for i, (a, b) in enumerate(ends) for k in (0, 1)]
    rows += [(100 + 2 * i + k, a + FALL_TOGETHER[1 - k] + b) for i, (a, b) in enumerate(ends[:20]) for k in (0, 1)]
    want = brute(rows, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, split in ((2 << 20, 4096), (150, 4096), (2 << 20, 1), (150, 1)):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        monkeypatch.setattr(repeats, "SPLIT", split)
        assert Counter(tuple(r)[:5] for r in repeats.without_repeats(docs, 50).collect()) == want


def test_apart_compares_bytes():
    data = np.frombuffer(b"abcdefghijabcdefghijabcdefghiXabc", np.uint8)
    start, size = np.array([0, 10, 20, 0, 30]), np.array([10, 10, 10, 3, 3])
    assert repeats.apart(data, start, size, np.array([0, 0, 0, 1, 1])).tolist() == [0, 0, 1, 0, 0]
    assert repeats.apart(data, start, size, np.zeros(5, np.int64)).tolist() == [0, 0, 1, 2, 2]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op1_suffix_array(spark, SF).collect()) == brute(rows, 50)


def test_texts_and_characters(spark):
    same = "ünïcode passage, långer than fifty bytes, thåt two documents hold in common "
    docs = spark.createDataFrame([(1, "é" + same), (2, "è" + same + "tail"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.Repeats(docs).kept(characters=True).collect()}
    assert got[1].decode() == "é" + same and got[2].decode() == "ètail" and got[3] == b""
    raw = {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(docs).collect()}
    assert raw[2] == b"\xc3\xa8tail" and raw[1] == got[1]
    half = spark.createDataFrame([(1, "ä" + same), (2, "¤" + same)], "doc_id long, text string")  # C3 A4 and C2 A4: the second byte is shared
    assert {r["doc_id"]: bytes(r["kept"]) for r in repeats.without_repeats(half).collect()}[2] == b"\xc2"
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in repeats.Repeats(half).kept(characters=True).collect()}[2] == "¤"


def test_groups_are_maximal(spark):
    rows = [(1, "11 " + "k" * 10 + "the quick brown fox jumps over the lazy dog and runs away" + "p" * 9), (2, "2 " + "m" * 11 + "the quick brown fox jumps over the lazy dog and runs away" + "q" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.Repeats(docs).groups().collect()
    texts = {d: t.encode() for d, t in rows}
    groups = {}
    for r in found:
        groups.setdefault((r["anchor"], r["nth"], r["n_bytes"]), []).append((r["doc_id"], r["start"]))
    assert groups
    for (_, _, n), at in groups.items():
        assert len(at) > 1 and len({texts[d][s : s + n] for d, s in at}) == 1
    covered = {s + i for (_, _, n), at in groups.items() for d, s in at if d == 2 for i in range(n)}
    assert covered == set(range(13, 13 + 57))


def test_copies_have_all_occurrences(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    text = "one passage of more than fifty bytes that three of the documents hold, and a fourth has only the half of "
    rows = [(4, text), (2, text), (9, text), (7, text[:60] + "other words that nobody else has in this place at all, not once"), (8, "z" * 70), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in repeats.Repeats(docs).copies().collect():
        found.setdefault((r["anchor"], r["content"], r["n_bytes"]), set()).add((r["doc_id"], r["start"]))
    whole = [v for v in found.values() if {d for d, _ in v} == {2, 4, 9, None}]
    assert whole and all(len({s for _, s in v}) == 1 for v in whole)
    covered = {s + i for k, v in found.items() for d, s in v if d == 9 for i in range(k[2])}
    assert covered == set(range(len(text.encode())))


def test_empty_and_clashing(spark):
    assert repeats.without_repeats(no_docs(spark)).count() == 0
    assert repeats.without_repeats(odd_docs(spark)).count() == len(ODD_ROWS)
    with pytest.raises(ValueError):
        repeats.Repeats(no_docs(spark), 20)


@pytest.mark.parametrize("split", [4096, 2])
def test_groups_have_all_occurrences(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "CHUNK", 5_000)
    rows = planted(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for r in repeats.Repeats(docs).groups().collect():
        groups.setdefault((r["anchor"], r["nth"], r["n_bytes"], r["n_occurrences"]), []).append((r["doc_id"], r["start"]))
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t.encode())
    places = lambda w: Counter((e, i) for e, ts in texts.items() for t in ts for i in range(len(t) - len(w) + 1) if t[i : i + len(w)] == w)
    seen = {}
    for (_, _, n, count), at in groups.items():
        d, s = at[0]
        w = next(w for w in (t[s : s + n] for t in texts[d]) if places(w) == Counter(at))
        assert len(w) == n and count == len(at) > 1
        seen[w] = count
    assert max(map(len, seen)) > 50 and max(seen.values()) > 100


def maximal(texts, length):
    """Maximal repeats by brute force: text -> places, for texts in which the substrings of every length are few."""
    places = {}
    for d, t in texts:
        for i in range(len(t)):
            for n in range(length, len(t) - i + 1):
                places.setdefault(t[i : i + n], set()).add((d, i))
    by_id = dict(texts)
    out = {}
    for w, at in places.items():
        left = [by_id[d][i - 1] if i else (d, i) for d, i in at]
        right = [by_id[d][i + len(w)] if i + len(w) < len(by_id[d]) else (d, i) for d, i in at]
        if len(at) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
            out[w] = at
    return out


def test_groups_are_all_maximal_repeats(spark, monkeypatch):
    """Repeats within and far over a segment, nested ones, whole copies and repeats inside a document."""
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = np.random.default_rng(8)
    some = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    long, short = some(400), some(70)
    texts = [(1, some(30) + long + some(20)), (2, some(25) + long + some(31)), (3, long[100:260] + b"." + short), (4, short + b"-" + short + some(9)), (5, some(64)), (7, long[:130] + some(40) + long[90:180])]
    texts += [(6, texts[4][1]), (8, b"x" + texts[4][1])]
    got = {}
    for r in repeats.Repeats(spark.createDataFrame([(d, t.decode()) for d, t in texts], "doc_id long, text string")).groups().collect():
        got.setdefault((r["anchor"], r["nth"], r["n_bytes"]), []).append((r["doc_id"], r["start"], r["n_occurrences"]))
    by_id = dict(texts)
    found = {}
    for (_, _, n), at in got.items():
        w = by_id[at[0][0]][at[0][1] : at[0][1] + n]
        assert w not in found and all(k == len(at) for _, _, k in at)
        found[w] = {(d, i) for d, i, _ in at}
    assert found == maximal(texts, 50)
    assert max(map(len, found)) == 400
