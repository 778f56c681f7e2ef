import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import queries, urls
from tests.llm.helpers import SF

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def plain(url, rules=RULES, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def test_judged_as_by_plain_python(spark):
    odd = ["http://a.EXAMPLE.com/en/71?x", "https://example.com/en/7", "http://com/en/", "http://com", "no scheme", None, "", "x://", "http://b.example.net/de/80#t", "http://net/de/", "http://notnet/de/", "http://évil.org/es/1",
           "http://a://org/es/", "http://" + "a." * 3000 + "org/es/" + "p" * 50_000, "http://user@org/es/", "HTTP://x.ORG/es/?q#f", "http://x.org/ES/"]
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(10_000 + i, u) for i, u in enumerate(odd)] + [(10_000, odd[0])]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, host string, rule int")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, RULES).collect()), key=repr)
    assert got == sorted(((i, *plain(u)) for i, u in pages), key=repr)
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, [], default="block").collect()} == {"block"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 50 = 0").unionByName(spark.createDataFrame([(None,), ("not there",)], "key string"))
    cascade = urls.build(listed, universe)
    rows = universe.select(urls.hashes(F.col("key")).alias("h"), (F.expr("crc32(key) % 50") == 0).alias("want")).collect()
    a, b = (np.array([r["h"][i] for r in rows], np.int64).view(np.uint64) for i in (0, 1))
    assert (cascade.contains(a, b) == np.array([r["want"] for r in rows])).all()
    assert len(cascade.levels) > 1
    assert not urls.build(listed.limit(0), universe).contains(a, b).any() and not urls.build(listed, universe.limit(0)).contains(a, b).any()


def test_query(spark):
    urls_of = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_url_rules(spark, SF).collect():
        assert tuple(r)[1:] == plain(urls_of[r["page_id"]])


def test_large_lists_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BYTES", 700)
    rules = [("block" if i % 3 else "allow", f"h{i % 40}.example/{i}") for i in range(600)]
    pages = [(i, f"http://www.h{i % 40}.example/{i}/x") for i in range(900)]
    universe = spark.createDataFrame([(r,) for _, r in rules] + [(f"k{i}",) for i in range(4000)], "key string")
    assert len(urls.build(spark.createDataFrame([(r,) for _, r in rules], "key string"), universe).parts) > 1
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    for i, u in pages:
        host, path = u.removeprefix("http://").split("/", 1)
        fits = [(len(r), r, v) for v, r in rules if ("." + host).endswith("." + r.split("/")[0]) and ("/" + path).startswith("/" + r.split("/", 1)[1])]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow"))
