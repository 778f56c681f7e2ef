"""Bottom-k sketches of word shingles: fingerprints of documents that can be merged and compared.

A sketch is the ascending array of the k smallest 64-bit hashes of a text's distinct shingles (fewer if it has fewer).
The sketch of a union is the k smallest of both sketches' values, so sketches of parts merge without the texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

K = 128
WORDS = 5
_TOP = float(1 << 64)


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    for lo, hi in common.text_chunks(at):
        values, bounds = common.distinct_by_text(*common.shingle_hashes(data, at[lo : hi + 1], words))
        out += [values[a : min(b, a + k)] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles; exact while both sets have at most k in all. Two empty sets are alike (1)."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    firsts = np.concatenate(([True], ~twice))
    rank = np.cumsum(firsts)
    n = min(k, int(rank[-1]))
    return float(np.count_nonzero(twice & (rank[1:] <= n)) / n)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / _TOP)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained in any (1)."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge([a, b], k), k) / distinct_count(a, k))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles_est, fingerprint) of every text; null and wordless texts have the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.parts(batches):
            found = sketches([t.encode() for t in b.column(1).to_pylist()], k, words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([distinct_count(x, k) for x in found], pa.float64()), pa.array(map(to_string, found), pa.string())], ["doc_id", "n_shingles_est", "fingerprint"])

    return common.documents(docs).mapInArrow(run, "doc_id long, n_shingles_est double, fingerprint string")


def merged(prints: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, fingerprint): one sketch for each value of by. Partitions are merged first, so a hot value sends one row a task."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[key] = merge([held[key], from_string(s)], k) if key in held else from_string(s)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([to_string(v) for v in held.values()], pa.string())], [by, "fingerprint"])

    schema = f"`{by}` string, fingerprint string"
    parts = prints.select(F.col(by).cast("string").alias(by), "fingerprint").mapInArrow(within, schema)
    return parts.repartition(by).mapInArrow(within, schema)


def place_among(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most value (null: none): a look at every 64th cut, then at the 64 after it."""
    if not cuts:
        return F.lit(0)
    rows = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    at_most = lambda xs: F.coalesce(F.size(F.filter(xs, lambda c: c <= value)), F.lit(0))
    longs = lambda xs: F.array(*(F.lit(c).cast("long") for c in xs))
    row = at_most(longs([r[0] for r in rows]))
    return F.when(row > 0, (row - 1) * 64 + at_most(F.element_at(F.array(*map(longs, rows)), F.greatest(row, F.lit(1))))).otherwise(0)


def edited_pairs(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each text, its half-edited form (the tail replaced by the head of the next text) and the three sketches' likeness.

    Order is by doc_id, ties by text, nulls first; the document after the last is the first, and a single document
    follows itself. doc_id ranges are dealt out, and the first row of each range also goes to the range before it, so
    every row meets its successor without a global window. Null texts are empty; an empty table gives no rows.
    """
    common.small_batches(docs.sparkSession)
    rows = common.documents(docs)
    ids = rows.select("doc_id")
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    bucket = place_among(F.col("doc_id"), cuts)
    heads = sorted((r["b"], r["first"]) for r in ids.groupBy(bucket.alias("b")).agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")).collect())  # one row a range
    dealt = rows.withColumn("to", bucket).withColumn("lent", F.lit(0))
    if heads:
        to = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
        key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
        lent = rows.filter(key.isin(list(to)))
        place = F.element_at(F.create_map(*(F.lit(x) for kv in to.items() for x in kv)), key)
        dealt = dealt.unionByName(lent.withColumn("to", place).withColumn("lent", F.lit(1)))
    dealt = dealt.repartition("to").sortWithinPartitions("to", "lent", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple] = []  # rows of one range without a successor yet: one at most, (range, doc_id, text, sketch)
        single = None
        for b in common.parts(batches):
            out: list[tuple] = []
            texts = b.column(1).to_pylist()
            prints = sketches([t.encode() for t in texts], k, words)
            for doc, text, to, lent, p in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), b.column(3).to_pylist(), prints):
                row = (to, doc, text, p)
                if wait and wait[0][0] == to and single != to:
                    out.append((wait[0], row))
                wait = [row]
                single = to if lent else None  # what follows a lent row is a repeat of it
            yield from pairs(out)

    def pairs(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        edited = []
        for (_, _, text, _), (_, _, after, _) in found:
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        marks = sketches(edited, k, words)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([x[0][1] for x in found], pa.int64()), "n_chars": pa.array([len(x[0][2]) for x in found], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), "fingerprint": pa.array([to_string(x[0][3]) for x in found], pa.string()),
                "edited_fingerprint": pa.array(map(to_string, marks), pa.string()), "near_edited": pa.array([resemblance(x[0][3], e, k) for x, e in zip(found, marks)], pa.float64()),
                "near_next": pa.array([resemblance(x[0][3], x[1][3], k) for x in found], pa.float64()),
            }
        )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
