"""Phrase search against plain Python over whole token lists."""

import re
import unicodedata

from pyspark.sql import functions as F

from sparkloom.operators import token_index as X

ROWS = [
    (1, "台北市信義區公司", "王小明"), (2, "臺北公司信義", "信義 王"), (3, "ACME Co., Ltd. 台北", None), (4, "Café-Müller acme", "co ltd"), (5, "", ""), (6, None, None),
    (7, "公司公司台", "北"), (8, "アクメ公司", "明小王"), (9, "acme acme co 12 34", "12-34"), (9, "acme", "twice"),
]
QUESTIONS = [(1, "台北"), (2, "北台"), (3, "公司"), (4, "acme co"), (5, "co.ltd"), (6, "Cafe-muller"), (7, "臺北 公司"), (8, ""), (9, None), (10, "-- ??"), (11, "12-34"), (12, "クメ公"), (13, "王小明 信義"), (14, "公司公司"), (15, "co.ltd"), (1, "台北")]


def plain(s):
    s = "".join(unicodedata.normalize("NFD", c)[0] if 0xC0 <= ord(c) < 0x250 else c for c in (s or "").replace("臺", "台").lower())
    s = re.sub("([぀-ヿ㐀-鿿])", r" \1 ", s)
    return re.findall(r"[^\W_]+", s)


def brute(fields=("name", "owner")):
    out = set()
    for q, text in QUESTIONS:
        want = [p for p in map(plain, (text or "").split()) if p]
        for key, *values in ROWS:
            mine = [plain(v) for f, v in zip(("name", "owner"), values) if f in fields]
            has = lambda p: any(t[i : i + len(p)] == p for t in mine for i in range(len(t)))  # noqa: E731, B023
            merged = all(any(has(p) for _ in (0,)) for p in want)
            if want and merged:
                out.add((q, key))
    return out


def test_search(spark):
    rows = spark.createDataFrame(ROWS, "vat int, name string, owner string")
    asked = spark.createDataFrame([(*q, "x", 5) for q in QUESTIONS], "q int, query string, token string, pos int")
    assert {r["s"]: r["t"] for r in spark.createDataFrame([(r[1],) for r in ROWS if r[1]], "s string").select("s", X.tokens(F.col("s")).alias("t")).collect()} == {r[1]: plain(r[1]) for r in ROWS if r[1]}
    index = X.postings(rows, "vat", ["name", "owner"])
    assert {tuple(r) for r in X.search(asked, index, "q", "vat").collect()} == brute()
    assert {tuple(r) for r in X.search(asked, index, "q", "vat", ["owner"]).collect()} == brute(("owner",))
    assert X.search(asked.limit(0), index, "q", "vat").count() == 0 and X.search(asked, index.limit(0), "q", "vat").count() == 0


def test_counts_and_sample(spark):
    found = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 3)], "q int, vat int")
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i else None, " ") for i in range(10)], "vat int, city string, org string")
    got = {(r["q"], r["facet"], r["value"]): (r["total"], r["sampled"], r["n"], r["place"]) for r in X.counted(found, rows, "q", "vat", ["city", "org"], 5, 2).collect()}
    assert got == {(1, "city", "a"): (10, 5, 2, 1), (1, "city", "b"): (10, 5, 2, 2), (1, "org", "other"): (10, 5, 5, 1), (2, "city", "b"): (1, 1, 1, 1), (2, "org", "other"): (1, 1, 1, 1)}
