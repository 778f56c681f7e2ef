"""Containment against nested loops; odd rows of the rules."""

import numpy as np

from sparkloom.operators import consistency as K


def test_contained(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("ab 公司"), n))
    values = [word(int(n)) for n in rng.integers(0, 7, 150)] + [None, "", "  ", "aa", "公"]
    names = [word(int(n)) for n in rng.integers(0, 9, 60)] + [None, "", "a a", "司"]
    bare = lambda s: "".join((s or "").split())
    want = {(v, n) for v in values for n in names if bare(v) and bare(n) and (bare(v) in bare(n) or bare(n) in bare(v))}
    v, n = spark.createDataFrame([(x, 1) for x in values], "value string, a int"), spark.createDataFrame([(x, 1) for x in names], "name string, b int")
    assert {tuple(r) for r in K.contained(v, n).collect()} == want and want
    assert K.contained(v.limit(0), n).count() == K.contained(v, n.limit(0)).count() == 0
    errors = K.own_typing_errors(spark.createDataFrame([("Acme Widget",), ("Acme Widgetz Co",), ("Acme",)], "value string"), spark.createDataFrame([("Acme Widgets Co",), ("Zzzzzzzzz",)], "name string")).collect()
    assert [tuple(r) for r in errors] == [("Acme Widgetz Co", "Acme Widgets Co", 1)]  # the others are parts of the name


def test_nothing_known(spark):
    e = spark.createDataFrame([(1, 1, "company", "A", 5), (1, 2, "company", "A", 5), (1, 1, "company", "B", 1), (1, 1, None, "x", 1), (1, 1, "tax_id", None, 1), (None, 1, "tax_id", "1", 1)], "case int, file int, kind string, value string, n int")
    truth = spark.createDataFrame([], "case int, main string, identifier string, counterparty string, case_number string")
    own = spark.createDataFrame([], "name string, tax_id string")
    got = {(r["category"], r["value"], r["severity"]) for r in K.findings(e, truth, own).collect()}
    assert ("identity-outlier", "B", "warn") in got and len(got) <= 2
    assert K.findings(e.limit(0), truth, own).count() == 0
