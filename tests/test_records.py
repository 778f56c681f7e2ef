"""Odd rows of records, listings and exports."""

import datetime

from pyspark.sql import functions as F

from sparkloom.functions import invoices as I
from sparkloom.operators import records as R
from sparkloom.sources import exports, files


def test_listing_and_usage(spark, tmp_path):
    for name, size in (("ann/a.txt", 3), ("ann/deep/b.bin", 5), ("bob/c.txt", 1), ("top.txt", 2)):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    found = files.listing(spark, str(tmp_path))
    assert "content" not in found.columns and found.count() == 4
    assert {r["owner"]: (r["files"], r["bytes"]) for r in files.usage_by_folder(found, str(tmp_path)).collect()} == {"ann": (2, 8), "bob": (1, 1), "": (1, 2)}
    assert files.listing(spark, str(tmp_path), "*.bin").count() == 1


def test_zipped_and_attached(spark):
    codes = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, "x" * 300), (1, 4, "y"), (2, 1, "**:a:1:2"), (2, 2, "**:b:1:2")], "batch int, pos int, code string")
    pairs, stats = R.zipped(codes)
    assert {(r["batch"], r["nth"], r["invoice_number"], tuple(r["items"])) for r in pairs.collect()} == {(2, 1, None, ("a",)), (2, 2, None, ("b",))}
    assert {r["batch"]: (r["invoices"], r["lists"], r["unknown"], r["samples"]) for r in stats.collect()} == {1: (0, 0, 4, ["(empty)", "(empty)", "x" * 200]), 2: (0, 2, 0, [])}
    held = spark.createDataFrame([("u", 1, 1, "2024", ["a"]), ("u", 2, 2, "2024", None), ("u", 3, 3, None, None), ("v", 4, 1, None, ["z"])], "user string, id int, added int, scanned_at string, items array<string>")
    items = spark.createDataFrame([("u", 0, "b"), ("u", 1, "b"), ("u", 2, None), ("w", 0, "x")], "user string, pos int, item string")
    assert {r["id"]: r["items"] for r in R.attached(held, items).collect()} == {1: ["a"], 2: ["b"], 3: None, 4: ["z"]}


def test_updates_cursors_and_lists(spark):
    rows = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "id int, note string, status string")
    changes = spark.createDataFrame([(1, "note", None, 2), (1, "note", "x", 1), (2, "status", "t", 1), (3, "note", "y", 1)], "id int, field string, value string, at int")
    assert {tuple(r) for r in R.updated(rows, changes).collect()} == {(1, None, "s"), (2, "b", "s")}
    assert R.updated(rows, changes, ()).count() == 2
    results = spark.createDataFrame([("j", 0, "a"), ("j", 1, "b")], "job string, pos int, text string")
    cursors = spark.createDataFrame([("j", 1), ("j2", 5), ("j", -3), ("j", None)], "job string, start int")
    got = sorted((r["job"], r["start"], r["total"], r["text"] or "") for r in R.results_from(results, cursors).collect())
    assert got == [("j", 0, 2, "a"), ("j", 0, 2, "a"), ("j", 0, 2, "b"), ("j", 0, 2, "b"), ("j", 1, 2, "b"), ("j2", 0, 0, "")]
    df = spark.createDataFrame([("a", '["a"]'), ("b", '["a"]'), (None, '["a"]'), ("b", None), ("b", "{}")], "v string, l string")
    assert [r["k"] for r in df.select(R.in_json(F.col("v"), F.col("l")).alias("k")).collect()] == [True, False, False, True, True]
    assert R.with_hints(spark.createDataFrame([("x",), (None,)], "category string"), {}).collect()[1]["hint"] == ""


def test_periods(spark):
    df = spark.createDataFrame([(datetime.date(2024, 3, 1),), (datetime.date(2024, 12, 31),), (None,)], "d date")
    got = [r["p"] for r in df.select(I.recent_periods(F.col("d"), 2).alias("p")).collect()]
    assert [(p["start"].isoformat(), p["number"], p["running"]) for p in got[0]] == [("2024-03-01", 2, True), ("2024-01-01", 1, False)]
    assert [(p["end"].isoformat(), p["running"]) for p in got[1]] == [("2024-12-31", True), ("2024-10-31", False)] and not got[2]


def test_lines(spark):
    blocks = spark.createDataFrame([(1, 0, 2, "T", 9.0), (1, 1, 0, "p", 9.0)], "page int, nth int, kind int, text string, size double")
    assert [r["line"] for r in exports.block_lines(blocks, "md").collect()] == ["## T\n", "p\n"] and [r["line"] for r in exports.block_lines(blocks).collect()] == ["T\n", "p\n"]
    annots = spark.createDataFrame([(1, 1, 2, "Note", None, None, None)], "doc int, id int, page int, kind string, author string, subject string, content string")
    assert exports.annotation_lines(annots, "json").first()["line"] == '{"page":2,"kind":"Note"}'
    assert exports.annotation_cells(annots, True).first()["todo"] == "Note" and exports.annotation_cells(annots).columns == ["page", "type", "author", "subject", "content"]


def test_summaries(spark):
    from sparkloom.operators import summaries as Y

    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert {tuple(r) for r in Y.usage([(a, "x"), (b, "y")], "k").collect()} == {(1, 2, 0), (2, 0, 1)}
    assert [r["k"] for r in Y.orphans(a, b.withColumn("k", F.lit(1)), "k").collect()] == [None]
    rows = spark.createDataFrame([(1, None), (2, "old"), (3, None)], "id int, deleted_at string")
    assert {tuple(r) for r in Y.soft_deleted(rows, spark.createDataFrame([(1,), (1,), (2,)], "id int"), F.lit("now")).collect()} == {(1, "now"), (2, "old"), (3, None)}
    text = spark.createDataFrame([(1, "2024-01-05, 2024/01/05 and 113年2月1日"), (2, None), (3, "2024-01-01")], "id int, t string")
    day = lambda s: F.lit(s).cast("date")
    assert [(r["id"], r["n"], r["first"].isoformat()) for r in Y.expiring(text, "id", F.col("t"), day("2024-01-01"), day("2025-01-01")).collect()] == [(1, 2, "2024-01-05")]
    assert Y.group_page(rows.limit(0), "id", "deleted_at", -1, 5).count() == 0


def test_csv_of_any_encoding(spark, tmp_path):
    from sparkloom.operators import registry

    head = "統一編號,名稱,行業代號,名稱1,行業代號1,名稱1,x\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + (head + "12345675,甲,1,零售,2,批發,y\n").encode())
    (tmp_path / "b.csv").write_bytes(("統一編號,名稱\n04595257,乙\n").encode("big5"))
    got = files.csv_of_any(spark, str(tmp_path))
    assert {r["統一編號"] for r in got.collect()} == {"12345675", "04595257"}
    assert registry.industry_columns(["﻿統一編號", "行業代號", "名稱", "行業代號1", "名稱1", "行業代號2", "名稱3", "行業代號3"]) == ["名稱", "名稱1"]
