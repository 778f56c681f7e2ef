"""Steps whose rows are far more than their files say: no side of a join over them is sent to the driver."""

import time

from pyspark.sql import functions as F

from sparkloom.functions.text import split_lines
from sparkloom.operators import alignment, annotations, diffs, token_index
from sparkloom.plans import page_queries, search_queries

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    """Joins of the plan that send a side whole through the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_cells_meet_by_shuffles(spark):
    assert broadcasts(page_queries.cell_neighbours(spark, SF)) == []


def test_texts_of_neighbours_meet_by_shuffles(spark):
    assert broadcasts(page_queries.cell_findings(spark, SF)) == []


def test_postings_and_questions_meet_by_shuffles(spark):
    assert broadcasts(search_queries.registry_phrases(spark, SF)) == []


def test_phrases_longer_than_a_gram(spark):
    rows = spark.createDataFrame([(1, "a b c d e a b"), (2, "b c d e"), (3, "a b c e d"), (4, "d e a b c d")], "key long, name string")
    asked = spark.createDataFrame([(1, "a-b-c-d e-a"), (2, "b-c-d-e"), (3, "c-d-e-a-b b"), (4, "a-b-c-d-e-f"), (5, "a-b b-c"), (6, "d")], "q long, query string")
    found = token_index.search(asked, token_index.postings(rows, "key", ["name"]), "q", "key").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (1, 4), (2, 1), (2, 2), (3, 1), (5, 1), (5, 3), (5, 4), (6, 1), (6, 2), (6, 3), (6, 4)]


def test_facets_of_hits_meet_by_shuffles(spark):
    assert broadcasts(search_queries.registry_phrase_counts(spark, SF)) == []


def test_receipts_are_dealt_out_and_parsed_once(spark):
    df = page_queries.receipts_parsed(spark, SF)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Taiwan|TWN") == 1  # the addresses of a ride's stops, which four fields are read from


def test_numbers_are_dealt_out_for_their_pseudonyms(spark):
    assert search_queries.fake_numbers(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_marks_of_a_text_are_looked_for_once(spark):
    text, hits = annotations.protected(F.col("text"), ["the"])
    rows = spark.createDataFrame([("the " * 20000,), ("no term",), (None,), ("⟪1⟫ the",)], "text string").select("text", text.alias("m"), hits.alias("h"))
    began = time.monotonic()
    got = rows.select("text", annotations.restored(F.col("m"), F.col("h")).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in got)
    assert time.monotonic() - began < 30  # all marks were looked for at every part: not done after 60 s


def test_versions_of_documents_are_read_once_for_each_use(spark):
    plan = page_queries.document_compare(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4  # each version for its digests and for its texts
    old, _ = page_queries.versions(spark, SF)
    filters = [line for line in old._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("transform(" in line for line in filters)  # there the text was split again for every page


def test_many_changes_of_long_texts(spark):
    words = [f"{i * 7919 % 10007:x}e" for i in range(4000)]
    a = " ".join(words)
    began = time.monotonic()
    (changed,) = alignment._changes([a], [a.replace("e", "E")]).T.tolist()
    assert changed == [len(a) - a.count("e"), 0, 0, a.count("e")]
    assert time.monotonic() - began < 20


def test_changes_of_long_repeated_texts():
    a = "Heing " * 3000
    b = a.replace("e", "E")
    began = time.monotonic()
    assert alignment._changes([a], [b])[:, 0].tolist() == [15000, 0, 0, 3000]
    assert alignment._changes([a], ["x" + b])[:, 0].tolist() == [15000, 1, 0, 3000]
    assert time.monotonic() - began < 20  # runs of pairs of places were looked at anew for every anchor: half of one took 200 s


def test_pages_meet_by_one_shuffle_of_their_digests(spark):
    plan = page_queries.page_pairing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan


def test_texts_are_split_into_lines_once(spark):
    for df, times in ((page_queries.pages(spark, SF), 1), (page_queries.page_pairing(spark, SF), 2)):  # 2: each version
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == times
    ends = ["\r", "\n", *"\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "\x1f", " ", ""]
    texts = [a + x + y + b for a in ("", "a") for x in ends for y in ends for b in ("", "b")]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", split_lines(F.col("text")).alias("lines")).collect()
    assert len(rows) == len(texts) + 1 and all(r["lines"] == (r["text"] or "").splitlines() for r in rows)


def test_texts_are_brought_to_changed_pages_only(spark):
    plan = page_queries.document_compare(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2 and all("_page" in line for line in joins)
    aligned = plan[plan.index("MapInArrow") :]
    before = plan[: plan.index("MapInArrow")]
    assert before.count("split(") == 2 and "CASE WHEN (tag" in before  # a changed page's texts; lines of all pages were split there and shuffled, those of a twice
    assert aligned.count("sha2(") == 2  # with the digests go numbers of lines and characters


def test_lines_end_before_all_white_space(spark):
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(m, f"a {m}b {m}") for m in marks], "m string, t string")
    kept = F.regexp_replace("t", r"(?U)\s+$", "")
    assert rows.filter(F.rtrim("t", F.lit(alignment.BLANKS)) != kept).count() == 0
    assert rows.filter(kept.endswith("b") & (F.col("m") != "b")).count() == len(alignment.BLANKS) == 25


def test_lines_are_compared_in_the_row_of_their_texts(spark):
    rows = spark.createDataFrame([(1, "a\nb", "a\nc"), (1, "a\nb", "a\nc"), (None, None, "x"), (2, "", None)], "k long, a string, b string")
    found = diffs.line_diff(rows, "k", "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == [(1, "change", 1, 1, "b", "c", 0.0), (1, "equal", 0, 0, "a", "a", 1.0), (None, "insert", None, 0, None, "x", 0.0)]
