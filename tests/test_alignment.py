"""Alignment of pages, lines and characters against Python's sequence matcher."""

import difflib

import numpy as np
import pytest

from sparkloom.operators import alignment


def matcher(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_text_steps(monkeypatch):
    rng = np.random.default_rng(1)
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("abc", "abc"), ("qabxcd", "abycdf"), ("ÿ😀é", "é😀"), ("aaaa", "aa")]
    pairs += [tuple("".join(rng.choice(list("ab c"), int(rng.integers(0, 30)))) for _ in range(2)) for _ in range(300)]
    for cells in (1 << 22, 0):
        monkeypatch.setattr(alignment, "CELLS", cells)
        for a, b in pairs:
            assert alignment.text_steps(a, b) == matcher(a, b), (a, b)


def test_steps_of_replaced_and_repeated_items(monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [("eEe", "EEE"), ("xEveEv", "xEvEEv"), ("Ev eve", "Ev EvE"), ("abcabd" * 40, ("abcabd" * 40)[7:-5].replace("d", "x")), ("na " * 50, "an " * 45)]
    for n in (8, 40, 200):
        for letters in ("eE", "abeE ", "abcdefghiE "):
            for _ in range(25):
                a = "".join(rng.choice(list(letters), int(rng.integers(1, n)))) * int(rng.integers(1, 4))
                b, at = a.replace("e", "E"), int(rng.integers(0, len(a) + 1))
                pairs += [(a, b), (b, a), (a, b[:at] + "new" + b[at:]), (a, a[:at] + "E" + a[at + 1 :])]
    for cells in (1 << 21, 3000, 0):
        monkeypatch.setattr(alignment, "CELLS", cells)
        (x, n), (y, m) = alignment._codes([a for a, _ in pairs]), alignment._codes([b for _, b in pairs])
        got = [[] for _ in pairs]  # of all pairs side by side
        for pair, tag, *places in zip(*(z.tolist() for z in alignment.many_steps(x, y, n, m))):
            got[pair].append((alignment.TAGS[tag], *places))
        assert got == [matcher(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def versions():
    rng = np.random.default_rng(2)
    out = {}
    for doc in range(60):
        a = [f"page {x}" if x else "" for x in rng.integers(0, 6 + doc, int(rng.integers(0, 25)))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(int(rng.integers(0, 4))):
            b.insert(int(rng.integers(0, len(b) + 1)), f"new {rng.integers(0, 3)}")
        out[doc] = a, b
    out[100] = [f"p{i}" for i in range(20)], [f"p{i}" for i in range(3)] + ["inserted"] + [f"p{i}" for i in range(3, 20)]
    out[101], out[102] = ([], ["x"]), (["x", None], [])
    return out


def frames(spark, versions):
    flat = lambda k: [(d, i, x, "clash") for d, v in versions.items() for i, x in enumerate(v[k])]
    return [spark.createDataFrame(flat(k), "doc long, page int, text string, tag string") for k in (0, 1)]


def test_pages(spark, versions):
    got = {}
    for r in alignment.page_pairs(*frames(spark, versions), "doc").collect():
        got.setdefault(r["doc"], set()).add((r["a_page"], r["b_page"], r["tag"]))
    for doc, (a, b) in versions.items():
        want = set()
        for tag, i1, i2, j1, j2 in matcher([x or "" for x in a], [x or "" for x in b]):
            for k in range(max(i2 - i1, j2 - j1)):
                x, y = (i1 + k if k < i2 - i1 else None), (j1 + k if k < j2 - j1 else None)
                want.add((x, y, "equal" if tag == "equal" else "delete" if y is None else "insert" if x is None else "change"))
        assert got.get(doc, set()) == want
    assert len([p for p in got[100] if p[2] == "equal"]) == 20 and (None, 3, "insert") in got[100]
    a, b = frames(spark, versions)
    assert alignment.page_pairs(a.limit(0), b.limit(0), "doc").count() == 0


def test_totals(spark):
    a = {1: ["one\ntwo\nthree  ", "same\n\nsame", "gone\naway"], 2: ["", None]}
    b = {1: ["one\ntwos\nthree\nfour", "same\n\nsame", "new", "more"], 2: ["x"]}
    rows = alignment.document_totals(*frames(spark, {d: (a[d], b[d]) for d in a}), "doc").collect()
    got = {(r["doc"], r["a_page"], r["b_page"]): tuple(r)[3:] for r in rows}
    assert got == {
        (1, 0, 0): (1, 0, 1, 5, 0, 0, 11, 16), (1, 1, 1): (0, 0, 0, 0, 0, 0, 8, 8), (1, 2, 2): got[1, 2, 2],
        (1, None, 3): (1, 0, 0, 4, 0, 0, 0, 4), (2, 0, 0): (1, 0, 0, 1, 0, 0, 0, 1), (2, 1, None): (0, 0, 0, 0, 0, 0, 0, 0),
    }
    want = [0, 0, 0]
    for tag, i1, i2, j1, j2 in matcher("gone", "new"):
        want[0] += j2 - j1 if tag == "insert" else 0
        want[1] += i2 - i1 if tag == "delete" else 0
        want[2] += max(i2 - i1, j2 - j1) if tag == "replace" else 0
    assert got[1, 2, 2] == (0, 1, 1, want[0], want[1] + 4, want[2], 8, 3)


def test_queries(spark):
    from sparkloom.plans import page_queries as Q

    sf = "/root/testdata/sf0.001"
    texts = [{}, {}]
    for k, df in enumerate(Q.versions(spark, sf)):
        for r in df.collect():
            texts[k].setdefault(r["doc_id"], {})[r["page"]] = r["text"]
    as_list = lambda d: [d[i] for i in range(len(d))]
    lines = lambda t: [x.rstrip() for x in (t or "").split("\n")] if t else []
    pairs, totals = set(), {}
    for doc, old in texts[0].items():
        a, b = as_list(old), as_list(texts[1].get(doc, {}))
        for tag, i1, i2, j1, j2 in matcher(a, b):
            for k in range(max(i2 - i1, j2 - j1)):
                x, y = (i1 + k if k < i2 - i1 else None), (j1 + k if k < j2 - j1 else None)
                pairs.add((doc, x, y, "equal" if tag == "equal" else "delete" if y is None else "insert" if x is None else "change"))
                s, t = ([] if x is None else lines(a[x])), ([] if y is None else lines(b[y]))
                n = [0] * 6
                for tag2, p1, p2, q1, q2 in matcher(s, t):
                    for m in range(max(p2 - p1, q2 - q1) if tag2 != "equal" else 0):
                        u, v = (s[p1 + m] if m < p2 - p1 else None), (t[q1 + m] if m < q2 - q1 else None)
                        if u is None or v is None:
                            n[0 if u is None else 1] += 1
                            n[3 if u is None else 4] += len(u or v or "")
                        else:
                            n[2] += 1
                            for c, w1, w2, z1, z2 in matcher(u, v):
                                n[3] += z2 - z1 if c == "insert" else 0
                                n[4] += w2 - w1 if c == "delete" else 0
                                n[5] += max(w2 - w1, z2 - z1) if c == "replace" else 0
                totals[doc, x, y] = (*n, sum(map(len, s)), sum(map(len, t)))
    assert {tuple(r) for r in Q.page_pairing(spark, sf).collect()} == pairs
    assert {tuple(r)[:3]: tuple(r)[3:] for r in Q.document_compare(spark, sf).collect()} == totals
