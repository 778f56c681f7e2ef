import re
from collections import Counter

import numpy as np

import corpus_pipeline as P
from sparkloom.llm import quality, queries
from tests.llm.helpers import SF, no_docs, odd_docs


def test_quality_on_labels_that_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", "kept", "text_score").collect()
    share = lambda rs: sum(r["kept"] for r in rs) / len(rs)
    assert share([r for r in rows if r["quality"] == 1 and not r["toxic"]]) > 0.97
    assert share([r for r in rows if r["quality"] == 0]) < 0.2
    assert share([r for r in rows if r["quality"] == 1 and r["toxic"]]) < 0.75  # about 100 toxic documents to learn from
    assert sum((r["text_score"] >= 0.5) == (r["quality"] == 1 and not r["toxic"]) for r in rows) / len(rows) > 0.85


def test_views_are_apart():
    """The metadata view sees nothing of a text, the text view nothing else."""
    page = (["s"], ["en"], ["http://a.b/c"], [12.0])
    none = np.zeros(0, np.uint64)
    a, b, c = (quality.features([t], *p, none) for t, p in ((b"one two", page), (b"three!", page), (b"one two", (["t"], [None], [None], [None]))))
    assert (a[1] == b[1]).all() and (a[0] != b[0]).any() and (a[0] == c[0]).all() and (a[1] != c[1]).any()


def test_quality_without_enough_labels(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = quality.score(odd_docs(spark), labels).collect()
    assert len(got) == 10 and all(r["kept"] and r["score"] is None for r in got)
    both = spark.createDataFrame([(1, 1), (7, 0), (5, 0), (8, 1), (3, 0), (6, 1), (4, 0), (2, 1)], "doc_id long, quality int")
    assert quality.score(odd_docs(spark), both).count() == 10
    assert quality.score(no_docs(spark), both).count() == 0


def test_quality_query_has_every_document(spark):
    got = queries.op7_quality(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 for r in got)


def passages(text, length):
    b = text.encode()
    return {b[i : i + length] for i in range(len(b) - length + 1)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = P.common.materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if stage is P.drop_near_duplicates:
            sets = {d: set(zip(*(w[i:] for i in range(5)))) for d, w in ((d, re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower())) for d, r in after.items())}
            ids = sorted(sets)
            assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= P.NEAR * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i])
        if stage is P.cut_repeats:
            first = {}
            for d in sorted(before):
                for w in passages(before[d]["text"], P.PASSAGE):
                    first.setdefault(w, d)
            for d, r in after.items():
                own = all(first[w] == d for w in passages(before[d]["text"], P.PASSAGE))
                assert (r["text"] == before[d]["text"]) == own and r["n_chars"] == len(r["text"])
        if stage is P.mix_sources:
            assert after == before
    last = P.encode(spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(list(after))
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_run_and_odd_rows(spark):
    assert P.run(spark, SF).count() > 0
    for _, stage in P.STAGES[1:]:
        assert stage(spark, odd_docs(spark), SF).count() > 0
        assert stage(spark, no_docs(spark), SF).count() == 0


def test_rows_without_or_with_repeated_ids_keep_their_columns(spark):
    rows = [(None, "first of two without an id", "src1"), (None, "second of two without an id", "src2"), (5, "one text of an id", "src3"), (5, "another text of an id", "src4"), (5, "one text of an id", "src3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = P.drop_near_duplicates(spark, docs, SF)
    assert Counter(tuple(r) for r in near.collect()) == Counter(set(rows))
    assert Counter(tuple(r) for r in P.cut_repeats(spark, near, SF).collect()) == Counter(set(rows))
