"""Literal cases of lines, texts, records, sequences, exports and sources."""

import datetime
import difflib

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import checks as C
from sparkloom.functions import invoices as I
from sparkloom.functions import text as T
from sparkloom.operators import diffs, events, hierarchy, pii, registry, sequences
from sparkloom.operators import lines as L
from sparkloom.operators import reconcile as X
from sparkloom.sources import exports, files
from sparkloom.streaming import events as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def listed(spark, items, op, **params):
    rows = spark.createDataFrame(list(enumerate(items)), "pos long, line string")
    return [r["line"] for r in L.OPS[op](rows, **params).orderBy("pos").collect()]


def test_line_operations(spark):
    assert listed(spark, "abacb", "dedup", keep="last") == ["a", "c", "b"]
    assert listed(spark, ["a", "a", "b"], "dedup", keep="count") == ["2\ta", "1\tb"]
    assert listed(spark, ["Apple", "apple", "APPLE"], "dedup", case_insensitive=True) == ["Apple"]
    assert listed(spark, ["item10", "item2", "a", "10", "9"], "sort", natural=True) == ["9", "10", "a", "item2", "item10"]
    assert listed(spark, ["b", "A", "a"], "sort", case_insensitive=True, order="desc") == ["b", "A", "a"]
    assert listed(spark, ["x", "", "　"], "drop_empty") == ["x"]
    assert listed(spark, ["　 x \t"], "trim") == ["x"]
    assert listed(spark, ["o'neil-smith ab1c"], "case", mode="title") == ["O'Neil-Smith Ab1C"]
    assert listed(spark, list("abc"), "tail", n=2) == ["b", "c"] and listed(spark, list("abc"), "head", n=0) == []
    assert listed(spark, list("abc"), "reverse") == ["c", "b", "a"] and sorted(listed(spark, list("abc"), "shuffle", seed=1)) == ["a", "b", "c"]
    assert listed(spark, ["ab", "b"], "filter", pattern="^A", regex=True, case_insensitive=True) == ["ab"]
    with pytest.raises(ValueError):
        listed(spark, ["a"], "head", n=-1)
    with pytest.raises(Exception, match="unterminated"):
        listed(spark, ["a"], "filter", pattern="(", regex=True)
    rows = spark.createDataFrame([(0, "b"), (1, "a")], "pos long, line string")
    out, applied = L.pipeline(rows, [{"op": "sort"}, "no", {"op": "none"}, {"op": "wrap", "prefix": ">"}])
    assert [r["line"] for r in out.orderBy("pos").collect()] == [">a", ">b"] and applied == ["sort", "wrap"]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb", "\n\n", "a\x0bb\x0cc\x1cd e\x85f\r", None])
def test_lines_as_splitlines(spark, text):
    assert one(spark, T.split_lines(F.lit(text).cast("string"))) == (text or "").splitlines()


def test_counts_of_mixed_text(spark):
    s = F.lit("電話 is 42.5，OK! 好。\n\nNext line.")
    c = {k: one(spark, v) for k, v in {**T.char_classes(s), **T.text_counts(s)}.items()}
    assert (c["cjk"], c["digit"], c["en_letter"], c["punct"], c["other"]) == (3, 3, 12, 5, 0)
    assert (c["word_total"], c["numbers"], c["paragraphs"], c["lines"]) == (7, 1, 2, 2)
    assert one(spark, T.language(s)) == "en" and one(spark, T.language(F.lit("電話簿"))) == "zh" and one(spark, T.language(F.lit("12"))) == "auto"
    assert one(spark, T.cjk_bigrams(F.lit("電話簿 字a字"))) == ["電話", "話簿"]


def test_sentences_and_fragments(spark):
    parts = one(spark, T.merge_fragments(T.sentences(F.lit("... One two. Three!Four\n. .\n5"))))
    assert parts == ["One two.", "Three!", "Four .", "5"]  # a second lone full stop adds nothing
    assert one(spark, sequences.merge_markers(F.array(*map(F.lit, ["1.", "first", "text", "-"])))) == ["1. first", "text", "-"]


def test_display_and_escapes(spark):
    assert one(spark, T.padded(F.lit("電話a"), 7)) == "電話a  "
    assert [one(spark, T.neutral_cell(F.lit(x))) for x in ("=1", "-", "a-b", "12", "'=1")] == ["'=1", "'-", "a-b", "12", "'=1"]
    assert one(spark, T.markdown_cell(F.lit("a|b\nc"))) == "a\\|b c" and one(spark, T.xml_text(F.lit('<a&"'))) == "&lt;a&amp;&quot;"
    assert [one(spark, T.error_page(F.lit(x))) for x in ("<html><title>502 Bad Gateway</title>", "<html>fine", "  <!doctype html>service unavailable", "fine", "<head>cloudflare error", None, "x <title>y")] == ["502", "html-body", "5xx", "", "cf-error", "", "html-body"]
    assert [one(spark, T.no_translation(F.lit(x))) for x in ("```py", "---", "https://a.b/c", "<br>", "|---|", "....", "word")] == [True] * 6 + [False]


def test_invoice_code(spark):
    code = "AB12345678" + "1150513" + "9999" + "000003E8" + "0000041A" + "00000000" + "12345675" + "x" * 24
    f = {k: one(spark, c) for k, c in I.qr_fields(F.lit(code)).items()}
    assert f == {"invoice_number": "AB12345678", "date": datetime.date(2026, 5, 13), "random_code": "9999", "amount_untaxed": 1000, "amount_total": 1050, "buyer_vat": None, "seller_vat": "12345675"}
    for bad in ("ab" + code[2:], code[:70], None):
        assert all(one(spark, c) is None for c in I.qr_fields(F.lit(bad).cast("string")).values())
    wrong = {k: one(spark, c) for k, c in I.qr_fields(F.lit(code[:10] + "1151399" + code[17:])).items()}
    assert wrong["date"] is None and wrong["amount_total"] == 1050
    assert one(spark, I.any_date(F.lit("115/5/3"))) == datetime.date(2026, 5, 3) and one(spark, I.any_date(F.lit("2026-02-30"))) is None
    assert one(spark, I.amount(F.lit("1,234.56"))) == 1234 and one(spark, I.amount(F.lit("x"))) is None
    assert one(spark, I.number_format(F.lit("AB12345678"), "dash")) == "AB-12345678"
    assert one(spark, I.period_of(F.lit("2026-01-15").cast("date"))[0]) == datetime.date(2025, 11, 1)
    assert one(spark, I.to_24h(F.lit("下午"), F.lit("12"), F.lit("05"))) == "12:05"


def test_checks_and_masks(spark):
    assert one(spark, C.mask_email(F.lit("jane@x.org"))) == "ja***@x.org" and one(spark, C.mask_ip(F.lit("10.2.3.4"))) == "10.***.***.***"
    assert one(spark, C.mask_card(F.lit("4111-1111-1111-1111"))) == "4111-****-****-1111"
    assert one(spark, C.mask_digits(F.lit("0912-345-678"), 4, 3)) == "0912-***-678"
    assert one(spark, C.mask_name(F.lit("Ann Lee"))) == "AOOOOOe" and one(spark, C.mask_address(F.lit("1 A St."))) == "* * **."


def test_spans_rewrite_and_pseudonyms(spark):
    text = "a@b.org and a@b.org, c@d.org; card 4111 1111 1111 1111, not 4111 1111 1111 1112"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    found = pii.spans(docs, pii.chosen(["email", "cc"], [("mine", "n.t"), ("bad", "(")]))
    got = sorted((r["kind"], r["start"], text[r["start"] : r["end"]] == r["value"]) for r in found.collect())
    assert got == [("cc", 35, True), ("email", 0, True), ("email", 12, True), ("email", 21, True), ("mine", 56, True)]
    out = {r["doc_id"]: r["text"] for r in pii.rewrite(docs, pii.pseudonyms(found.filter("kind = 'email'")), "fake").collect()}
    assert out[1].startswith("[EMAIL-1] and [EMAIL-1], [EMAIL-2];") and out[2] is None and out[3] == ""
    red = {r["doc_id"]: r["text"] for r in pii.rewrite(docs, found, "redact").collect()}
    assert red[1].startswith("█" * 7 + " and ") and len(red[1]) == len(text)


def test_line_diff(spark):
    pairs = spark.createDataFrame([(1, "alpha\nbeta\ngamma", "alpha\r\nBETA-changed\ngamma\ndelta"), (2, "x", "x"), (3, None, "y")], "k int, a string, b string")
    rows = diffs.line_diff(pairs, "k", "a", "b").collect()
    count = lambda k, op: sum(r["k"] == k and r["op"] == op for r in rows)
    assert (count(1, "insert"), count(1, "change"), count(1, "delete"), count(2, "equal"), count(3, "insert")) == (1, 1, 0, 1, 1)
    assert next(r["ratio"] for r in rows if r["op"] == "change") == difflib.SequenceMatcher(None, "beta", "BETA-changed", autojunk=False).ratio()


def test_registry_ingest(spark):
    raw = spark.createDataFrame([("12345675", " Acme ", "a", "b", "a"), ("1234", "short", None, None, None), ("87654321", "", None, None, None)], "`Tax ID` string, Company string, i1 string, i2 string, i3 string")
    named = registry.renamed(raw, {"vat": ["tax id"], "name": ["company"], "i1": [], "i2": [], "i3": [], "owner": ["boss"]})
    got = registry.valid_records(named, ["i1", "i2", "i3"]).collect()
    assert [(r["vat"], r["name"], r["owner"], r["industries"]) for r in got] == [("12345675", "Acme", None, "a / b")]
    with pytest.raises(ValueError):
        registry.renamed(raw, {"vat": ["x"], "name": ["company"]})
    rows = spark.createDataFrame([("臺北市中山", "甲"), ("台南市", "乙"), (None, "丙")], "address string, name string")
    assert sorted(r["c"] for r in rows.select(registry.city_of(F.col("address")).alias("c")).collect()) == ["其他", "台北市", "台南市"]
    assert rows.filter(registry.contains_all("台北 甲", ["address", "name"])).count() == 1


def test_closures_and_names(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert {tuple(r) for r in hierarchy.closure(edges).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2)}
    assert one(spark, hierarchy.dn_ancestors(F.lit("CN=x, OU=y,DC=z"))) == ["CN=x,OU=y,DC=z", "OU=y,DC=z", "DC=z"]


def test_sequences(spark):
    items = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(v).alias("level"), F.lit(p).alias("page")) for t, v, p in (("a", 3, 0), ("b", 2, 9), ("c", 5, 4))))
    assert [tuple(x) for x in one(spark, sequences.levels(items, F.lit(5)))] == [("a", 1, 1), ("b", 2, 5), ("c", 3, 4)]


def test_overlap_counts_both_ends(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h, 30)
    jobs = spark.createDataFrame([(at(0), at(2)), (at(1), None), (at(3), at(3))], "s timestamp, e timestamp")
    got = events.overlap(jobs, F.col("s"), F.col("e"), F.lit("2024-01-01").cast("timestamp"), 3600, 5)
    assert [(r["started"], r["active"]) for r in got.orderBy("bucket").collect()] == [(1, 1), (1, 2), (0, 1), (1, 1), (0, 0)]


def test_typing_errors_find_what_levenshtein_finds(spark):
    names = ["acme trading", "northern light", "green valley", "blue"]
    values = ["acme tradng", "acme trading", "nothern lght", "gren vally", "bule", "something else", "northern"]
    got = {r["value"]: (r["name"], r["distance"]) for r in X.typing_errors(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"acme tradng": ("acme trading", 1), "nothern lght": ("northern light", 2), "gren vally": ("green valley", 2)}


def test_sources_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("﻿一\r\n二\n".encode())
    (tmp_path / "in" / "b.txt").write_bytes("中文".encode("big5"))
    got = sorted((r["path"][-5:], r["pos"], r["line"]) for r in files.text_lines(spark, str(tmp_path / "in")).collect())
    assert got == [("a.txt", 0, "一"), ("a.txt", 1, "二"), ("b.txt", 0, "中文")]
    df = spark.createDataFrame([("=x", 1, None), ('q"r', 2, "y|z")], "a string, n int, b string")
    exports.write_csv(df, str(tmp_path / "csv"))
    back = files.csv_records(spark, str(tmp_path / "csv")).collect()
    assert sorted(r["a"] for r in back) == ["'=x", 'q"r']
    assert [r["line"] for r in exports.markdown_lines(df.orderBy("n")).collect()] == ["| '=x | 1 |  |".replace("'", ""), '| q"r | 2 | y\\|z |']
    assert exports.xml_lines(df.filter("n = 2")).first()["line"] == "<row><a>q&quot;r</a><n>2</n><b>y|z</b></row>"
    assert exports.resolved(["b", "x", "a"], ["a", "b"], ["a", "b", "c"]) == ["b", "a"]


def test_forwarder_delivers_in_order_and_again_after_a_failure(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parque[t]"
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    sent, calls = [], []

    def down(lines):
        calls.append(next(lines))
        raise OSError("not reachable")

    query = S.forward(stream(), str(tmp_path / "c"), down, F.col("event_id").cast("string"), tries=2)
    with pytest.raises(Exception, match="not reachable"):
        query.awaitTermination()
    assert calls == ["0", "0"]
    S.forward(stream(), str(tmp_path / "c"), lambda lines: sent.extend(lines), F.col("event_id").cast("string")).awaitTermination()
    assert sent == [str(i) for i in range(len(sent))] and len(sent) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    S.forward(stream(), str(tmp_path / "c"), lambda lines: sent.append("more"), S.syslog_line()).awaitTermination()
    assert "more" not in sent
    row = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(1)
    assert row.select(S.cef_line().alias("x")).first()["x"].startswith("CEF:0|app|audit|1|") and row.select(S.gelf_line().alias("x")).first()["x"].startswith('{"version":"1.1"')
