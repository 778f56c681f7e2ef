"""Free-text JSON and form labels of odd shapes."""

from pyspark.sql import functions as F

from sparkloom.functions import labels as L

JSON = {
    '```json\n{"a":1}\n```\nor use {x}': '{"a":1}', '```\n[1, 2]\n```': "[1, 2]", ' {"a": {"b": []}} ': '{"a": {"b": []}}', 'so {"a":1} it is': '{"a":1}', '{"a":1} or {x}': None, '{"a":1}} x': None, '{"a":1}] x': '{"a":1}', '{"a":1}, {"b":2}': None,
    '{"a":1': None, "": None, None: None, "no": None, "```\nnot json {\"a\":1}\n```": '{"a":1}', '{"a":1}, "b": 2': '{"a":1}', "12": "12",
}
LABELS = {
    "公 司 名 稱：": "公司名稱", "＊＊聯 絡 人": "聯絡人", "1. 電話": "电話", "（2）統一編號": "統一編号", "公司名稱(全名)": "公司名稱", "(中)": "(中)", "聯絡E－Mail": "聯絡email", "①傳真": "1傳真", "ﾃﾚﾎﾝ": "テレホン", "內/外": "内/外", "主要產品／服務": "主要产品/服务",
    "立": "立", "": "", None: None, "SWIFT Code::": "swiftcode",
}


def test_json(spark):
    df = spark.createDataFrame([(k,) for k in JSON], "s string").select("s", L.json_object(F.col("s")).alias("f"))
    assert {r["s"]: r["f"] for r in df.collect()} == JSON


def test_labels(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "s string").select("s", L.label(F.col("s")).alias("f"))
    assert {r["s"]: r["f"] for r in df.collect()} == LABELS
