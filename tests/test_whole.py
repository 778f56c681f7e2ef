"""Queries take all of their input: cases in which a part of it was left out."""

import inspect
import random
import re
from collections import Counter

import __spark_entry__ as entry
from pyspark.sql import functions as F

from sparkloom.operators import events as E
from sparkloom.operators import pii
from sparkloom.operators import reconcile as X

SF = "/root/testdata/sf0.01"


def test_every_line_is_a_finding(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert lines.agg(F.max("l_orderkey")).first()[0] > 3000
    scored = entry.queries()["case_score_all"](spark, SF)
    assert scored.count() == lines.select("l_orderkey").distinct().count()
    assert scored.agg(F.sum(F.expr("fail + warn + info"))).first()[0] == lines.count()
    assert entry.queries()["override_apply_all"](spark, SF).count() == lines.count()


HITS = {
    "landline": "電話 02-2345-6789。", "driver_license": "Driver's License No. AB123456", "dob": "DOB: 12/18/1998", "addr": "台北市中正區忠孝東路一段100號", "bank_branch": "Branch Code: 0123", "account_name": "Account Name: Ann Lee, x",
    "company": "by Acme Widgets Co., Ltd. now", "person_name": "Contact Person: Sarah O'Brien  Tel", "us_ssn_label": "SSN: 123456789", "uk_ni": "NI AB 12 34 56 C", "dob_en": "born: January 5, 1985", "nanp_phone": "call +1 (743) 555-3824 now",
    "uk_phone": "at +44 20 7946 0958", "us_addr": "at 1842 Maple Street, Springfield, IL 62704", "uk_postcode": "in SW1A 1AA", "jp_mynumber": "1234 5678 9018", "jp_corp_no": "番号 7000012050002", "jp_phone": "03-1234-5678", "jp_postcode": "〒100-0001",
    "jp_addr": "東京都千代田区丸の内1-2-3", "jp_name": "氏名：山田 太郎", "jp_driver_license": "免許証番号: 123456789012", "jp_health_insurance": "記号 12345 番号 90", "plate": "車牌 ABC-1234", "gps": "25.0330,121.5654", "hostname": "db01.corp.local",
    "ad_dn": "CN=Ann,OU=Staff,DC=corp", "url_internal": "http://wiki.intra/x", "domain": "see example.com now", "user_path": "/home/ann/x", "api_token": "t aB3" + "x" * 40, "cred_pair": "use admin/qazwsxedc",
}
MASKS = {"nanp_phone": "+1 (743) ***-*824", "dob": "****-**-**", "user_path": "/home/USER/x", "jp_addr": "東京都〇〇市〇〇町〇-〇", "uk_postcode": "SW******", "us_addr": "**** ***** ******, ***********, ** *****", "gps": "[GPS-REDACTED]", "person_name": "SOOOOOOOOOOOn"}


def test_all_kinds_of_personal_data(spark):
    assert len(pii.KINDS) == 58 and set(HITS) <= set(pii.BY_NAME)
    docs = spark.createDataFrame([*HITS.items(), ("none", "1234 5678 9012 and 1000012050002"), ("null", None)], "doc_id string, text string")
    found = pii.spans(docs).collect()
    got = {(r["doc_id"], r["kind"]): r for r in found}
    assert set(HITS) == {k for k in HITS if (k, k) in got}
    assert {k: got[k, k]["masked"] for k in MASKS} == MASKS
    assert not {r["kind"] for r in found if r["doc_id"] == "none"} & {"jp_mynumber", "jp_corp_no"}
    assert all(HITS[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in found if r["doc_id"] in HITS)
    assert {"nanp_phone", "email"} <= {k.name for k in pii.defaults("en")} and "landline" not in {k.name for k in pii.defaults("en")}


def test_what_stands_out_of_a_span_goes(spark):
    docs = spark.createDataFrame([(1, "ab1234cd")], "doc_id int, text string")
    found = pii.spans(docs, pii.chosen([], [("one", "b12"), ("two", "234c")]))
    assert pii.rewrite(docs, found, "redact").first()["text"] == "a" + "█" * 6 + "d"


def test_default_redaction_and_all_entities(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    new = {r["doc_id"]: r["text"] for r in entry.queries()["pii_redact_all"](spark, SF).collect()}
    phone = re.compile(pii.BY_NAME["nanp_phone"].pattern)
    assert new.keys() == texts.keys() and any(phone.search(t or "") for t in texts.values())
    assert not any(phone.search(t or "") for t in new.values()) and all(len(new[d] or "") == len(t or "") for d, t in texts.items())
    docs = spark.createDataFrame([(1, "台灣大學 與 宏碁股份有限公司 2024-01-05 財團法人天主教會 AB-2024-001")], "doc_id int, text string")
    want = Counter((k, re.sub(r"\s+", "", v)) for t in ("台灣大學 與 宏碁股份有限公司 2024-01-05 財團法人天主教會 AB-2024-001",) for k, (p, lo, hi) in X.ENTITIES.items() for v in re.findall(p, t) if lo <= len(re.sub(r"\s+", "", v)) <= hi)
    assert Counter({(r["kind"], r["value"]): r["n"] for r in X.entities(docs).collect()}) == want and {k for k, _ in want} >= {"company", "school", "date", "legal_person"}
    kinds = X.ENTITIES | {"number": (r"\b(\d{3,7})\b", 0, 99)}
    values = Counter((d, k, re.sub(r"\s+", "", v)) for d, t in texts.items() for k, (p, lo, hi) in kinds.items() for v in re.findall(p, t or "", re.ASCII) if lo <= len(re.sub(r"\s+", "", v)) <= hi)
    assert Counter({(r["doc_id"], r["kind"], r["value"]): r["n"] for r in entry.queries()["entities_all"](spark, SF).collect()}) == values


def test_cooldown_against_brute_force(spark):
    """Ranges that are dense, sparse and older than 1970, ties and null keys; no list of all times of a key."""
    assert "collect_list" not in inspect.getsource(E.cooled)
    draw = random.Random(1)
    rows = [(k, draw.randrange(-n, n)) for k, n in (("dense", 900), ("wide", 90_000), (None, 4_000)) for _ in range(700)] + [("ten", 10 * i) for i in range(300)] + [("one", 5)] * 9
    docs = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    for gap in (1, 10, 97, 100_000):
        want = Counter()
        for k in {k for k, _ in rows}:
            last = None
            for s in sorted(s for x, s in rows if x == k):
                if last is None or s - last >= gap:
                    last = s
                    want[k, s * 1_000_000] += 1
        assert Counter(tuple(r) for r in E.cooled(docs, "k", gap).collect()) == want
