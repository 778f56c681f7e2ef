"""Options and references against the same rules in plain Python loops."""

import re
import unicodedata

import numpy as np

from sparkloom.functions.unicode import VARIANTS
from sparkloom.operators import forms as O


def norm(s):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", s)).translate(str.maketrans(VARIANTS)).lower()


def words_for(value):
    out, low = [value], value.strip().lower()
    for k, syns in O.ALIASES.items():
        if norm(k) == norm(value):
            out += syns
        elif low in [s.lower() for s in syns]:
            out += [k] + [s for s in syns if s.lower() != low]
    return out


def best(options, value):
    if value is None or not value.strip():
        return None
    if re.fullmatch("[0-9]+", value.strip()):
        n = int(value)
        for o, t in options:
            nums = [int(x) for x in re.findall(r"\d+", norm(t))]
            if not nums:
                continue
            t = norm(t)
            if ("以下" in t or "以内" in t or "≤" in t) and n <= nums[0]:
                return o
            if not ("以下" in t or "以内" in t or "≤" in t) and ("以上" in t or "≥" in t) and n >= nums[0]:
                return o
            if not re.search("以下|以内|≤|以上|≥", t) and len(nums) >= 2 and min(nums[:2]) <= n <= max(nums[:2]):
                return o
    said = [norm(w) for w in words_for(value) if norm(w)]
    opts = [(o, norm(t)) for o, t in options if norm(t)]
    for c in said:
        for o, t in opts:
            if t == c:
                return o
    for c in said:
        for o, t in opts:
            if t in c:
                return o
        for o, t in opts:
            if c in t:
                return o
    return None


OPTIONS = ["電匯", "T/T", "ＮＴＤ", "新臺幣", "10人以下", "11~50人", "51-200", "201以上", "月結 30 天", "現金", "支票Check", "", "  ", "其他", "①", "USD", "≤5", "5以內"]
VALUES = ["電匯、匯款", "wire", "台幣", "臺幣", "7", "11", "300", " 42 ", "月結三十天", "CASH", "支", "", None, "  ", "nothing", "1", "美金", "美 元", "net 30", "60", "三十", "check", "x現金y", "99999999999999999999"]


def test_options(spark):
    rng = np.random.default_rng(6)
    options, values = [], []
    for form in range(25):
        some = [str(x) for x in rng.permutation(OPTIONS)[: int(rng.integers(0, 9))]]
        options += [(form, form * 100 + i, i, t, "clash") for i, t in enumerate(some)]
        values += [(form, f"f{i}", v) for i, v in enumerate(VALUES)]
    o = spark.createDataFrame(options, "form int, option int, place int, text string, rank string")
    v = spark.createDataFrame(values, "form int, field string, value string")
    of = lambda f: [(x[1], x[3]) for x in options if x[0] == f]
    want = {(f, k, x, b) for f, k, x in values for b in [best(of(f), x)] if b is not None}
    assert {tuple(r) for r in O.best_option(o, v, O.aliases(spark)).collect()} == want
    every = {(f, k, x, i) for f, k, x in values if x and x.strip() for i, t in of(f) for c in map(norm, words_for(x)) if c and norm(t) and (norm(t) in c or c in norm(t))}
    assert {tuple(r) for r in O.all_options(o, v, O.aliases(spark)).collect()} == every
    assert O.best_option(o.limit(0), v, O.aliases(spark)).count() == 0


def test_same_as(spark):
    labels = spark.createDataFrame([("address", "登記地址"), ("address", "公司 地址："), ("company_name", "公司名稱(全名)"), ("phone", "電話"), ("phone", "ﾃﾚﾎﾝ")], "key string, label string")
    rows = {
        (1, "address"): "台北市 1 號", (1, "invoice_address"): "同上", (1, "factory_address"): "（同登記地址）", (1, "english_address"): "同上", (1, "bank_account_name"): "〃", (1, "company_name"): "同心圓公司", (1, "phone"): "同電話", (1, "note"): "同公司地址相同",
        (2, "address"): "同上", (2, "invoice_address"): "同上", (2, "a"): "與登記地址一致", (2, "b"): None, (2, "c"): "", (2, "d"): "如電話", (2, "phone"): " 02 ", (2, "e"): "同" + "登記地址" * 5, (2, "f"): "同テレホン",
        (3, "invoice_address"): "同上", (3, "short_name"): "ditto",
    }
    want = {
        (1, "invoice_address"): ("台北市 1 號", "address"), (1, "factory_address"): ("台北市 1 號", "address"), (1, "bank_account_name"): ("同心圓公司", "company_name"), (1, "note"): ("台北市 1 號", "address"), (2, "d"): ("02", "phone"), (2, "f"): ("02", "phone"),
    }
    df = spark.createDataFrame([(*k, v, 1) for k, v in rows.items()], "record int, key string, value string, source_page int")
    got = {(r["record"], r["key"]): (r["resolved"], r["source"]) for r in O.same_as(df, labels).collect()}
    assert got == {k: want.get(k, (v, None)) for k, v in rows.items()}
    assert O.same_as(df.limit(0), labels).count() == 0
