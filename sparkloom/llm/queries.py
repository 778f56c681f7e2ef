"""The numbered operators as queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, common, embeddings, minhash, mixing, neighbours, quality, repeats, sharding, sketch, tokenfile, trie, urls

VOCAB = "word_bpe_49k.json"
#: Parts of a period for the named sources; sources that are not named share the rest.
SOURCE_WEIGHTS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, mixing.OTHER: 4}

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def vocab_path() -> str:
    import public_tokenizers

    return os.environ.get("SPARKLOOM_VOCAB") or public_tokenizers.path(VOCAB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept", "text_sha256")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(table(spark, sf_dir, "embeddings"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), vocab_path(), out)
    return tokenfile.digests(spark, out)


def op5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_pairs(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocab_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SOURCE_WEIGHTS).select("doc_id", "source", "mix_class", "block", "slot", "position")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.even_tree(16))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array, op2_url_rules, op3_embedding_links, op4_token_files, op5_sketches, op6_bpe, op7_quality, op8_mixing, op9_sharding, op10_minhash, op11_trie, op12_neighbours, op13_centroids)
}


def _lloyd_sql() -> str:
    """The rounds written out one after the other."""
    best = lambda i: f"a{i} AS MATERIALIZED (SELECT v.r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c) v GROUP BY v.r)"
    move = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY p) AS v FROM (
      SELECT c, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.v) AS x, unnest(range(1, {centroids.DIM} + 1)) AS p FROM v JOIN a{i} a ON a.r = v.r) GROUP BY c, p)) GROUP BY c) m ON m.c = c.c)"""  # noqa: E731
    steps = [x for i in range(centroids.ROUNDS) for x in (best(i), move(i))] + [best(centroids.ROUNDS)]
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {centroids.DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIM}),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('3:' || vec_id) LIMIT {centroids.CLUSTERS}),
{", ".join(steps)},
t AS (SELECT c, sum(d) AS cluster_inertia FROM a{centroids.ROUNDS} GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(cluster_inertia AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM a{centroids.ROUNDS}) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN v ON v.r = a.r JOIN t ON t.c = a.c JOIN c{centroids.ROUNDS} c ON c.c = a.c
"""


_RULES = ", ".join(f"('{verdict}', '{rule}', '{rule.split('/')[0]}', '{rule[rule.index('/'):]}')" for verdict, rule in URL_RULES)
_NAMES = [k for k, w in SOURCE_WEIGHTS.items() if w > 0]
_WEIGHTS = [SOURCE_WEIGHTS[k] for k in _NAMES]
_PERIOD = sum(_WEIGHTS)
SQL: dict[str, str] = {
    "op1_suffix_array": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM b)),
f AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win),
c AS (SELECT w.doc_id, p, p - lag(p) OVER (PARTITION BY w.doc_id ORDER BY p) AS gap FROM w JOIN f USING (win) WHERE low < w.doc_id),
r AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
s AS (SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT s.doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) s JOIN b USING (doc_id) GROUP BY s.doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)
""",
    "op2_url_rules": f"""
WITH rules(verdict, rule, rule_host, rule_path) AS (VALUES {_RULES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, got.rule AS rule, coalesce(got.verdict, 'allow') AS verdict
FROM split LEFT JOIN LATERAL (
  SELECT rule, rules.verdict FROM rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule) DESC, length(rule_host) DESC LIMIT 1) got ON true
""",
    "op3_embedding_links": """
WITH RECURSIVE
v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'max') = 0
      AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS (SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN low ON low.x = v.r LEFT JOIN n ON n.x = v.r
""",
    "op8_mixing": f"""
WITH RECURSIVE given AS (SELECT {_NAMES} AS names, {_WEIGHTS} AS ws),
e(t, done, pick) AS (SELECT 0, list_transform(ws, lambda w: 0), CAST(NULL AS BIGINT) FROM given
  UNION ALL SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT t, done, ws, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND done[i] * {_PERIOD} // ws[i] <= t),
      lambda i: ((done[i] + 1) * {_PERIOD} + ws[i] - 1) // ws[i] * 1000 + i)) % 1000 AS p FROM e, given WHERE t < {_PERIOD})),
plan AS (SELECT names[pick] AS mix_class, ws[pick] AS w, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth, t - 1 AS turn FROM e, given WHERE pick IS NOT NULL),
rows AS (SELECT doc_id, source, CASE WHEN list_contains(names, source) THEN source ELSE '{mixing.OTHER}' END AS mix_class FROM documents, given),
placed AS (SELECT *, row_number() OVER (PARTITION BY mix_class ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS place FROM rows)
SELECT doc_id, source, r.mix_class, place // 32 AS block, place // 32 // w * {_PERIOD} + turn AS slot, (place // 32 // w * {_PERIOD} + turn) * 32 + place % 32 AS position
FROM placed r JOIN plan ON plan.mix_class = r.mix_class AND plan.nth = place // 32 % w
""",
    "op10_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op11_trie": f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY p) AS xs, CAST(c AS VARCHAR) AS name FROM t GROUP BY c),
h AS (SELECT c, xs, xor(4294967295, list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)),
      lambda acc, b: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, b)), CAST(4294967295 AS BIGINT))) % {trie.SHARED} AS h FROM own),
r AS MATERIALIZED (SELECT h.c, coalesce(b.xs[1:h], []) || h.xs[h + 1:] AS path FROM h LEFT JOIN own b ON b.c = h.c - h.c % {trie.GROUP}),
nodes AS MATERIALIZED (SELECT path[1:d] AS node, d AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN len(path) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
  FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM r) GROUP BY 1, 2),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
facts AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].body) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids USING (node)),
above AS (SELECT node[1:d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS d FROM facts) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN above USING (node) LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.node = f.node[1:f.depth - 1]
""",
    "op13_centroids": _lloyd_sql(),
}
