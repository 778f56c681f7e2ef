"""Shape-preserving pseudonyms against the same network in plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from sparkloom.functions import checks as C
from sparkloom.operators import fakes

RANGES = ((0x30, 10), (0x41, 26), (0x61, 26), (0xFF10, 10))


def plain(value, key, kind):
    place = lambda c: next(((f, n) for f, n in RANGES if f <= ord(c) < f + n), None)
    sym = [(place(c)[0], place(c)[1], ord(c) - place(c)[0]) for c in value if place(c)]
    start = list(sym)
    for r in range(fakes.ROUNDS):
        still = ",".join(str(f + v) for i, (f, _, v) in enumerate(sym) if i % 2 != r % 2)
        d = hashlib.sha256(f"{key}|{kind}|{r}|{len(sym)}|{still}".encode()).hexdigest()
        sym = [(f, n, (v + int(d[i // 2 % 16 * 4 :][:4], 16)) % n if i % 2 == r % 2 else v) for i, (f, n, v) in enumerate(sym)]
    if sym and sym == start:
        sym[0] = (sym[0][0], sym[0][1], (sym[0][2] + 1) % sym[0][1])
    it = iter(sym)
    out = ""
    for c in value:
        if place(c):
            f, _, v = next(it)
            out += chr(f + v)
        else:
            out += ("例" if c == "範" else "範") if c.isalpha() else "0" if c.isdecimal() else c
    return out


VALUES = ["", "a", "7", "A-1 b", "王小明", "範", "ａＢ３", "x" * 90, "2024-01-02", "١٢", "--", "😀é1", "１２"] + [f"{i:03d}" for i in range(1000)]


def test_permutation(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "value string")
    got = {r["value"]: r["f"] for r in df.select("value", fakes.permuted(F.col("value"), "k", F.lit("n")).alias("f")).collect()}
    assert got == {v: plain(v, "k", "n") for v in VALUES}
    assert all(got[v] != v for v in VALUES if re.search(r"\w", v))
    numbers = {got[f"{i:03d}"] for i in range(1000)}
    assert len(numbers) >= 995  # a permutation, but for values that would have been their own pseudonym
    other = {r["value"]: r["f"] for r in df.select("value", fakes.permuted(F.col("value"), "k2", F.lit("n")).alias("f")).collect()}
    assert sum(other[v] == got[v] for v in VALUES) < 20


CHECKED = {
    "cc": (["4111 1111 1111 1111", "5500-0000-0000-0004"], C.card), "tw_biz": (["12345675", "04595257"], C.tw_business), "tw_id": (["A123456789"], C.tw_id), "iban": (["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], C.iban),
    "jp_mynumber": (["1234 5678 9018", "１２３４－５６７８－９０１８"], C.jp_personal), "jp_corp_no": (["7000012050002"], C.jp_corporate),
}


def test_checks_hold_or_fail(spark):
    rows = [(k, v) for k, (vs, _) in CHECKED.items() for v in vs] + [("email", "ann.lee@corp.tw"), ("ip", "10.0.0.1"), ("mobile", "0912-345-678"), ("us_ssn", "123-45-6789"), ("person_name", None), ("mac", "aa:bb:cc:dd:ee:ff")]
    df = spark.createDataFrame(rows, "kind string, value string")
    for valid in (True, False):
        made = fakes.pseudonyms(df, "secret", valid)
        ok = F.lit(None).cast("boolean")
        for k, (_, check) in CHECKED.items():
            ok = F.when(F.col("kind") == k, check(F.col("fake"))).otherwise(ok)
        for r in made.withColumn("ok", ok).collect():
            if r["kind"] in CHECKED:
                assert r["ok"] is valid, r
                assert r["fake"] != r["value"] and re.sub(r"\d", "9", r["fake"]) == re.sub("[A-Z]", lambda m: m[0], re.sub(r"\d", "9", r["value"])) or r["kind"] == "iban", r
    got = {r["kind"]: r["fake"] for r in made.collect()}
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}@example\.com", got["email"]) and re.fullmatch(r"192\.0\.2\.\d+", got["ip"]) and re.fullmatch(r"09\d\d-\d{3}-\d{3}", got["mobile"])
    assert re.fullmatch(r"900-\d\d-\d{4}", got["us_ssn"]) and got["person_name"] is None and got["mac"].startswith("00:00:5E:00:53:")
    assert {r["fake"] for r in fakes.pseudonyms(df, "secret", False).collect()} == set(got.values()) | {r["fake"] for r in made.collect()}
