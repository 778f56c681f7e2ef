"""Markers, blocks and close pairs against plain Python."""

import difflib
import re

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import blocks, close, markdown

DIGITS = dict(zip("零一二三四五六七八九", range(10)))


def cn(n):
    out = ""
    for unit, name in ((100, "百"), (10, "十"), (1, "")):
        d = n // unit % 10
        if d:
            out += "零一二三四五六七八九"[d] + name
        elif out and n % unit and unit > 1:
            out += "零"
    return out


def test_numerals_by_a_list(spark):
    """All numbers of markers, written out by another rule than the one that reads them, and ten in its short form."""
    lines = [(0, n - 1, f"{cn(n)}、 item {n}") for n in range(1, 251)] + [(1, 0, "十、x"), (1, 1, "十二、x"), (1, 2, "、x"), (1, 3, "百二十、y")]
    got = {(r["doc"], r["at"]): r["markdown"] for r in markdown.converted(spark.createDataFrame(lines, "doc int, at int, line string"), "doc").collect()}
    assert all(got[0, n - 1] == (f"{n}. item {n}" if n <= 200 else f"{cn(n)}、 item {n}") for n in range(1, 251))
    assert [got[1, i] for i in range(4)] == ["10. x", "12. x", "、x", "120. y"]


def test_fences_and_forms(spark, monkeypatch):
    text = ["  一、top", "（二） nested", "      (三)deep", "３. wide", "```py", "一、code", "``` ", "二、after", "  ```", "（一）code", None, "`` 一、no", "一、" + "x" * 100000]
    want = ["  1. top", "   2. nested", "      3. deep", "3. wide", "```py", "一、code", "``` ", "2. after", "  ```", "（一）code", None, "`` 一、no", "一、" + "x" * 100000]
    for run in (2, 4096):
        monkeypatch.setattr(markdown, "RUN", run)
        df = spark.createDataFrame([(d, i, t, 1) for d in (1, 2) for i, t in enumerate(text)], "doc int, at int, line string, markdown_old int")
        rows = {(r["doc"], r["at"]): r["markdown"] for r in markdown.converted(df, "doc").collect()}
        assert [rows[2, i] for i in range(len(text))] == want
    assert markdown.converted(df.limit(0), "doc").count() == 0


CJK = re.compile(r"[一-鿿㐀-䶿　-〿＀-￯]")
END, ITEM = re.compile(r"[。！？：.!?]$"), re.compile(r"[-*•●◆‣▪▫◦▶►]|\d+[.)、]")


def join(a, b):
    return a + b if CJK.match(a[-1]) or CJK.match(b[0]) else a + " " + b


def test_joined_lines(spark):
    rng = np.random.default_rng(1)
    parts = ["alpha", "beta.", "中文", "結束。", "- item", "3) point", "：", "ok?", "ＡＢ"]
    cases = [[str(x) for x in rng.choice(parts, int(n))] for n in rng.integers(0, 8, 200)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>").select("i", blocks.join_lines(F.col("l")).alias("t")).collect()
    for r in got:
        out = []
        for x in cases[r["i"]]:
            if out and not END.search(out[-1]) and not ITEM.match(x):
                out[-1] = join(out[-1], x)
            else:
                out.append(x)
        assert r["t"] == "\n".join(out)


def test_spans_to_paragraphs(spark):
    s = lambda i, x, y, t, size=10.0, bold=False: (1, i, x, y, x + 30, y + size, t, size, bold)
    spans = [s(1, 0.0, 0.0, "TITLE", 20.0, True), s(3, 40.0, 50.0, "world"), s(2, 0.0, 51.0, "hello "), s(4, 0.0, 62.0, "goes on"), s(5, 0.0, 90.0, "next block"), s(6, 0.0, 120.0, "ends."), s(7, 0.0, 150.0, "new one"), s(8, 0.0, 180.0, " "), (1, 9, None, 0.0, 1.0, 1.0, "x", 1.0, True)]
    df = spark.createDataFrame(spans, "page int, id int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean")
    lines = blocks.lines_of(df)
    assert [r["text"] for r in lines.orderBy("line").collect()] == ["TITLE", "hello world", "goes on", "next block", "ends.", "new one"]
    made = blocks.blocks_of(lines)
    assert [r["text"] for r in made.orderBy("block").collect()] == ["TITLE", "hello world goes on", "next block", "ends.", "new one"]
    got = [(r["kind"], r["text"]) for r in blocks.paragraphs(made, 10.0).orderBy("nth").collect()]
    assert [t for _, t in got] == ["TITLE", "hello world goes on next block ends.", "new one"] and got[1][0] == 0 and got[0][0] == 1
    assert blocks.paragraphs(blocks.blocks_of(blocks.lines_of(df.limit(0))), 10.0).count() == 0


def nearly(e, a):
    norm = lambda s: re.sub(r"\s+", "", re.sub(r"([,.\-_;:])\1+", r"\1", s.strip())).lower()
    x, y = norm(e or ""), norm(a or "")
    if not x or not y:
        return None
    if x == y:
        return "equal"
    if len(x) >= 3 and y.startswith(x):
        return "begins"
    if len(x) >= 5 and x in y:
        return "part"
    if abs(len(x) - len(y)) <= max(4, len(x) // 5) and difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92:
        return "near"
    return None


def test_close_pairs(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcde ,"), n))
    expected = ["Acme Co.,Ltd", "ab", "abc", "", None, "台北市中正區重慶南路一段", *(word(int(n)) for n in rng.integers(1, 60, 80))]
    read = ["ACME CO.,,LTD", "abx", "xxabc", "", None, "台北市中正區重慶南路一殷"]
    for e in expected[6:]:
        for _ in range(3):
            t = list(e)
            for _ in range(int(rng.integers(0, 4))):
                i = int(rng.integers(0, len(t) + 1))
                t[i : i + int(rng.integers(0, 2))] = list(word(int(rng.integers(0, 2))))
            read.append("".join(t))
    a, b = spark.createDataFrame([(x, 1) for x in expected], "expected string, how int"), spark.createDataFrame([(x, 1) for x in read], "read string, ratio int")
    got = {(r["expected"], r["read"]): r["how"] for r in close.close_pairs(a, b).collect()}
    want = {(e, r): nearly(e, r) for e in set(expected) for r in set(read) if e and r and nearly(e, r)}
    assert got == want and {"equal", "begins", "part", "near"} <= set(want.values())
    assert close.close_pairs(a.limit(0), b).count() == 0


def test_queries_against_plain_python(spark):
    from sparkloom.plans import page_queries, search_queries

    sf = "/root/testdata/sf0.001"
    names = [r["p_name"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    got = {(r["expected"], r["read"]): r["how"] for r in search_queries.close_matches(spark, sf).collect()}
    read = {r for _, r in got}
    assert got == {(e, r): nearly(e, r) for e in set(names) for r in read if nearly(e, r)}
    pages = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for at, t in enumerate(re.sub("\n$", "", r["text"]).split("\n") if r["text"] else []):
            pages.setdefault(f"{r['doc_id']}/{at // 40}", []).append((at, t.strip(" ")))
    for page, lines in pages.items():
        lines[:] = [x for x in lines if x[1]]
    got = {}
    for r in page_queries.page_paragraphs(spark, sf).collect():
        got.setdefault(r["page"], []).append((r["nth"], r["text"]))
    for page, lines in pages.items():
        letters = lambda t: sorted(t.replace(" ", "").replace("\n", ""))
        assert letters("".join(t for _, t in sorted(got.get(page, [])))) == letters("".join(t for _, t in lines))
