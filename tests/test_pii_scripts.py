"""Personal data in digits and letters of all scripts; gates against plain searches."""

import dataclasses
import re
import unicodedata

from sparkloom.operators import pii

SF = "/root/testdata/sf0.001"
#: (text, kind, value): the check digits are right.
WIDE = [
    ("番号 １２３４－５６７８－９０１８ です", "jp_mynumber", "１２３４－５６７８－９０１８"),
    ("〒１２３－４５６７ 東京", "jp_postcode", "〒１２３－４５６７"),
    ("統編１２３４５６７５。", "tw_biz", "１２３４５６７５"),
    ("電話 0３－１２３４－５６７８ まで", "jp_phone", "0３－１２３４－５６７８"),
    ("Account Name: José García, Tel 1", "account_name", "José García"),
    ("Account No: 1234-5678-90", "bank_account", "1234-5678-90"),
    ("hash " + "ab" * 28 + " end", "hash_value", "ab" * 28),
    ("$2b$12$" + "a" * 53, "hash_value", "$2b$12$" + "a" * 53),
    ("sk-ssh-ed25519@openssh.com " + "A" * 24 + " me@x", "ssh_pubkey", "sk-ssh-ed25519@openssh.com " + "A" * 24 + " me@x"),
]


def test_digits_of_all_scripts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(WIDE)], "doc_id long, text string")
    found = {(r["doc_id"], r["kind"], r["value"]) for r in pii.spans(docs).collect()}
    assert {(i, k, v) for i, (_, k, v) in enumerate(WIDE)} <= found


def test_checks_are_asked(spark):
    texts = ["Account No: 1---------2", "統編１２３４５６７８", "ABCD", "番号 １２３４－５６７８－９０１９"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not {(r["doc_id"], r["kind"]) for r in pii.spans(docs).collect()} & {(0, "bank_account"), (1, "tw_biz"), (3, "jp_mynumber")}


def test_own_patterns(spark):
    docs = spark.createDataFrame([(1, "id 12 and ab"), (2, None), (3, "")], "doc_id long, text string")
    rows = pii.spans(docs, pii.chosen([], [("two", r"(?P<x>\d\d)"), ("bad", "(")])).collect()
    assert [(r["doc_id"], r["kind"], r["value"], r["masked"]) for r in rows] == [(1, "two", "12", "**")]


def test_gates_lose_nothing(spark):
    odd = ["ſecret: x", "TOKEN: İ", "２０２４-01-02", "KK.com", "a.ı", "PNR ABC123", "dob 1/1/1999", "3.5.6.7", "٠١٢٣٤٥٦٧"]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]] + [w[0] for w in WIDE] + odd
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for k in pii.KINDS:
        if k.check is None:
            p = re.compile(k.pattern, re.IGNORECASE if k.ignore_case else 0)
            for i, t in enumerate(texts):
                want |= {(i, k.name, m.start(), m.end()) for m in p.finditer(t)}
    got = {(r["doc_id"], r["kind"], r["first"], r["last"]) for r in pii.hits(docs, [k for k in pii.KINDS if k.check is None]).collect()}
    assert got == want
    for names in (["email"], ["cc", "tw_biz"], ["ad_dn", "ip"]):
        some = pii.chosen(names)
        one = {(r["doc_id"], r["kind"], r["first"]) for r in pii.hits(docs, some).collect()}
        assert one == {(r["doc_id"], r["kind"], r["first"]) for r in pii.hits(docs).collect() if r["kind"] in names}
    assert all(unicodedata.decimal(c, None) is not None for c in "٠１")


def test_hashes_and_tokens_are_searched_where_they_can_be(spark):
    kinds = [k for k in pii.KINDS if k.name in ("hash_value", "api_token")]
    values = ["0123456789abcdef" * n for n in (2, 4, 6, 8)] + ["A" * 40, "f" * 56, "$2b$10$" + "aB./5" * 10 + "xyz", "sk-" + "a" * 16, "hub__" + "Z9-_" * 4, "aB3+/=_-" * 4 + "z"]
    rows = [(i, f"see {v} there") for i, v in enumerate(values)] + [(100, "words of no secret at all " * 50), (101, "f" * 31), (102, "sk-" + "a" * 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [dataclasses.replace(k, near=None) for k in kinds]
    got, want = (sorted(map(tuple, pii.hits(docs, k).collect())) for k in (kinds, plain))
    assert got == want and {r[0] for r in got} == set(range(len(values)))
    assert not any(re.search(k.near, rows[-3][1]) for k in kinds)  # these patterns were tried at every place of every text
