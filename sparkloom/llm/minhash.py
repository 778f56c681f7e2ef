"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact check, components.

Texts with equal word sequences are one class, told by a digest of their bytes and represented by its smallest doc_id;
only representatives are compared. Hashes find the candidates; a link is confirmed on the bytes of the shingles themselves.
Representatives that share a band's minima are candidates, but a bucket is never expanded into all its pairs. Each
member is compared with the bucket's centre, the member that shares most buckets. Members that are one component by
then need no further comparison. For the rest, any two members x and y of a bucket have the same centre c, so both
sets can be put into one order: shingles that c lacks first, then by hash. If x and y are similar enough, they share
a shingle among the first |x| - need + 1 of x and |y| - need + 1 of y, where need is the overlap that the threshold
asks for at their sizes. So an equi-join of these prefixes on (centre, shingle) finds every remaining link between
components, and an edited copy that is too far from the centre has a prefix of its own edits that meets nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
BANDS = 25
ROWS = 5
SEED = 20240607
#: Standard deviations below the threshold at which a signature rules a pair out without the exact check.
SIGMAS = 6.0
#: Classes or buckets that can hold more than 1 / HOT of all rows: these meet their rows by broadcast.
HOT = 500


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n minima (uint32, upper half of a*x + b mod 2^64) of each set; sets must not be empty."""
    a, b = _family(n)
    out = np.empty((len(at) - 1, n), np.uint32)
    if not len(at) - 1:
        return out
    # a few sets at a time, so that one pass stays in the cache
    step = np.concatenate((np.flatnonzero(np.diff(at[:-1] // (1 << 15), prepend=-1)), [len(at) - 1]))
    for lo, hi in zip(step[:-1], step[1:]):
        part, starts = values[at[lo] : at[hi]], at[lo:hi] - at[lo]
        for i in range(n):
            out[lo:hi, i] = np.minimum.reduceat(part * a[i] + b[i], starts) >> np.uint64(32)
    return out


def sets_of(texts: list[bytes], words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts a few at a time: first, end, distinct shingle hashes and their offsets."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    for lo, hi in common.text_chunks(at):
        yield lo, hi, *common.distinct_by_text(*common.shingle_hashes(data, at[lo : hi + 1], words))


def profiles(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, same, sig, bands) of every text. same: digest of its words; sig: 16 bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.parts(batches):
            texts = [t.encode() for t in b.column(1).to_pylist()]
            same = [hashlib.blake2b(common.normal(t), digest_size=16).digest() for t in texts]
            for lo, hi, values, at in sets_of(texts, words):
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((hi - lo, bands * rows), np.uint32)
                if len(full):
                    starts = at[:-1][full]
                    sig[full] = signatures(values, np.append(starts, at[-1]), bands * rows)
                keys = np.zeros((hi - lo, bands), np.uint64)
                for i in range(bands):
                    key = np.full(hi - lo, i + 1, np.uint64)
                    for j in range(rows):
                        key = common.mix(key + sig[:, i * rows + j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    keys[:, i] = key
                keys = keys.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(same[lo:hi], pa.binary()),
                        pa.array([s.astype("<u2").tobytes() for s in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands, pa.int32()), pa.array(keys.ravel())),
                    ],
                    ["doc_id", "n_shingles", "same", "sig", "bands"],
                )

    return common.documents(docs).mapInArrow(run, "doc_id long, n_shingles long, same binary, sig binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, words: int, prefixes: bool = False) -> DataFrame:
    """(a, b, size, linked, prefix) of the pairs (a, b): whether 100 * intersection >= percent * union of their whole sets.

    texts: (id, text, sig). Pairs meet the text of a while they are two numbers wide, so a centre that many pairs share
    costs little there, and the text of b after that. size: of b's set. prefix: the first shingles of b in the order
    that a gives, as many as a partner of the least possible size asks for (only with prefixes; else empty).
    Without prefixes, only linked pairs are returned.
    """
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("sig").alias("sa")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("sig").alias("sb")), "b").select("a", "b", "ta", "tb", "sa", "sb")
    share = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.parts(batches):
            sa, sb = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(b.num_rows, -1) for i in (4, 5))
            least = share - SIGMAS * (share * (1 - share) / sa.shape[1]) ** 0.5
            close = (sa == sb).mean(axis=1) >= least
            rows = np.arange(b.num_rows) if prefixes else np.flatnonzero(close)
            ta, tb = (b.column(i).take(pa.array(rows)).to_pylist() for i in (2, 3))
            names = {t: i for i, t in enumerate(dict.fromkeys(ta + tb))}  # a text of many pairs is cut into shingles once
            sets = [common.distinct_shingles(t.encode(), words) for t in names]
            keep, linked, size, prefix = [], [], [], []
            for i, x, y in zip(rows, ta, tb):
                (tx, x, *in_x), (ty, y, *in_y) = sets[names[x]], sets[names[y]]
                link = False
                if close[i] or prefixes:
                    there = np.searchsorted(x, y)
                    there[there == len(x)] = 0
                    have = x[there] == y
                    n = int(np.count_nonzero(have))
                    if 100 * n >= percent * (len(x) + len(y) - n):
                        places = (*(p[there[have]].tolist() for p in in_x), *(p[have].tolist() for p in in_y))
                        n = sum([tx[i:j] == ty[k:m] for i, j, k, m in zip(*places)])
                    link = 100 * n >= percent * (len(x) + len(y) - n)
                if link or prefixes:
                    keep.append(i)
                    linked.append(link)
                    size.append(len(y))
                    prefix.append(np.concatenate((y[~have], y[have]))[: len(y) + (-percent * len(y)) // 100 + 1].view(np.int64) if prefixes else [])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(size, pa.int64()), pa.array(linked, pa.bool_()), pa.array(prefix, pa.list_(pa.int64()))], ["a", "b", "size", "linked", "prefix"])

    return both.mapInArrow(run, "a long, b long, size long, linked boolean, prefix array<long>")


def _across(checked: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components under one centre whose prefixes meet as far as their sizes ask for."""
    where = comps.select(F.col("id").alias("cid"), "component")
    rows = checked.join(where, F.col("b") == F.col("cid"), "left").select(F.col("a").alias("centre"), "b", "size", F.coalesce("component", "b").alias("c"), "prefix")
    rows = rows.select("centre", "b", "size", "c", F.posexplode("prefix").alias("rank", "shingle"))
    # a shingle that one component alone has under this centre makes no pair
    several = rows.groupBy("centre", "shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("centre", "shingle")
    rows = rows.join(several, ["centre", "shingle"])
    other = rows.select("centre", "shingle", F.col("b").alias("b2"), F.col("size").alias("size2"), F.col("c").alias("c2"), F.col("rank").alias("rank2"))
    need = F.ceil((F.col("size") + F.col("size2")) * percent / (100 + percent) - 1e-9)
    close = (F.col("c") < F.col("c2")) & (F.col("rank") <= F.col("size") - need) & (F.col("rank2") <= F.col("size2") - need)
    same = (rows.centre == other.centre) & (rows.shingle == other.shingle)
    return rows.join(other, same & close).select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct()


def _members(full: DataFrame, total: int) -> DataFrame:
    """(doc_id, rep): every document with the smallest doc_id of its class.

    A class of over total / HOT rows meets its rows by broadcast, as there are HOT of these at most; the rows of the
    others are dealt out by class.
    """
    classes = common.materialise(full.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    hot = F.broadcast(classes.filter(F.col("rows") * HOT > total).select("same", "rep"))
    rows = full.select("doc_id", "same")
    rest = rows.join(hot.drop("rep"), "same", "left_anti").join(classes.select("same", "rep"), "same")
    return rows.join(hot, "same").select("doc_id", "rep").unionByName(rest.select("doc_id", "rep"))


def _stars(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id) of what shares a bucket, and (a, b): the centre of each bucket with each of its other members.

    keyed: distinct (key, id). The centre is the member that shares most buckets. A bucket of over 1 / HOT of all rows
    meets them by broadcast.
    """
    sizes = common.materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT > total  # HOT keys at most

    def with_buckets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
        large = F.broadcast(buckets.filter(hot))
        small = rows.join(large.select("key"), "key", "left_anti").join(buckets.filter(~hot), "key")
        return rows.join(large, "key").unionByName(small)

    members = common.materialise(with_buckets(keyed, sizes), "members")
    shown = members.groupBy("id").agg(F.sum("n").alias("shown"))
    best = F.max(F.struct("shown", (-F.col("id")).alias("minus")))["minus"]
    first = common.materialise(members.join(shown, "id").groupBy("key", "n").agg((-best).alias("centre")), "centres")
    stars = with_buckets(members.select("key", "id"), first).filter("id <> centre")
    return members.select("id").distinct(), stars.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Documents are linked when 100 * |intersection| >= percent * |union| of their whole shingle sets; component_id is
    the smallest doc_id reachable over links, itself included. Null, empty and wordless texts have no set and no
    links. Rows that share a doc_id are one document; rows without doc_id have component_id null and kept false. A
    link is missed only if no band of its pair agrees (at 85 %: 4 in 10 million).
    """
    common.small_batches(docs.sparkSession)
    prof = common.materialise(profiles(docs, words, bands, rows), "profiles")
    full = prof.filter("n_shingles > 0 and doc_id is not null")
    member = common.materialise(_members(full, prof.count()).distinct(), "classes")
    own = member.filter("doc_id = rep").select(F.col("doc_id").alias("id")).distinct()
    reps = full.join(own, full.doc_id == own.id, "left_semi")
    keyed = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")).distinct()
    ids, stars = _stars(keyed)
    sigs = full.select(F.col("doc_id").alias("id"), "sig").join(ids, "id", "left_semi")
    texts = common.materialise(common.documents(docs).select(F.col("doc_id").alias("id"), "text").join(sigs, "id"), "texts")
    checked = common.materialise(verify(stars, texts, percent, words, prefixes=True), "checked")
    links = checked.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = components(links)
    pairs = common.materialise(_across(checked, comps, percent), "pairs")
    more = common.materialise(verify(pairs, texts, percent, words).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    comps = components(comps.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
    found = member.join(comps, member.rep == comps.id, "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "rep").alias("c"))
    found = found.groupBy("_d").agg(F.min("c").alias("component_id"))
    out = prof.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("_d"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
