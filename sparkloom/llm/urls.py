"""URL rules by exact Bloom filter cascades.

A cascade holds a set of listed keys exactly with respect to a universe of keys, here all that the corpus can ask about.
Level 1 is a Bloom filter of the listed keys, level 2 one of the other keys of the universe that pass level 1, level 3
one of the listed keys that pass level 2, and so on until no key passes wrongly. A key is listed if the number of levels
that it passes in a row is odd. Only the levels travel to the tasks; no table of keys is joined to the corpus. A list whose
levels would take more room than a task should hold is dealt out by a hash of the key: each part is a cascade of its own,
and the corpus is passed over once for each part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of the levels that are sent to every task at a time, about; larger lists are built and asked in several passes.
MOST_BYTES = 64 << 20
U64 = np.uint64


def hashes(key: Column) -> Column:
    """Two 64-bit hashes of a key; every level derives its bits from them."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(0x5BD1E995), key).alias("b"))


@dataclass(frozen=True)
class Level:
    seed: int
    n_bits: int
    n_hashes: int
    words: np.ndarray

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = common.mix(b + U64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))) | U64(1)
        return (common.mix(a + U64(self.seed))[:, None] + step[:, None] * np.arange(self.n_hashes, dtype=U64)) % U64(self.n_bits)

    def passes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b)
        return ((self.words[at >> U64(6)] >> (at & U64(63))) & U64(1)).all(axis=1)


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return tuple(column.field(i).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for i in (0, 1))


def bits_for(n: int, n_hashes: int) -> int:
    return max(64, math.ceil(n * n_hashes / math.log(2)))


def _level(keys: DataFrame, seed: int, n: int, rate: float) -> Level:
    """A Bloom filter of the hashes in keys: each task sends the words that it sets, merged by word."""
    n_hashes = max(1, round(-math.log2(rate)))
    n_bits = bits_for(n, n_hashes)
    empty = Level(seed, n_bits, n_hashes, np.zeros(0, U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = empty.positions(*_pairs(b.column(0))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], ["word", "bits"])

    words = np.zeros(n_bits // 64 + 1, U64)
    for r in keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # n_bits / 64 rows at most
        words[r["word"]] = U64(r["bits"] & (1 << 64) - 1)
    return Level(seed, n_bits, n_hashes, words)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)  # under MOST_BYTES
    schema = keys.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.passes(*_pairs(b.column(0)))))

    return keys.mapInArrow(run, schema)


@dataclass(frozen=True)
class Part:
    """The cascade of the listed keys of one part of so many."""

    levels: tuple[Level, ...]
    part: int
    parts: int

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed in this part; a key outside of it may be taken for a listed one."""
        inside, live = np.zeros(len(a), bool), np.flatnonzero(_part(a, self.parts) == self.part)
        for i, level in enumerate(self.levels):
            live = live[level.passes(a[live], b[live])]
            inside[live] = i % 2 == 0
        return inside

    def bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


@dataclass(frozen=True)
class Cascade:
    parts: tuple[Part, ...]

    @property
    def levels(self) -> list[Level]:
        return [level for part in self.parts for level in part.levels]

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([p.contains(a, b) for p in self.parts]) if self.parts else np.zeros(len(a), bool)


def _part(a: np.ndarray, parts: int) -> np.ndarray:
    return (common.mix(a + U64(0x632BE59BD9B4E019)) % U64(parts)).astype(np.int64)


def _of_part(keys: DataFrame, part: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_part(_pairs(b.column(0))[0], parts) == part))

    return keys if parts == 1 else keys.mapInArrow(run, keys.schema)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the column key of listed (distinct or not) among the column key of universe, in as many parts as it needs.

    Null keys are left out. Listed keys that the universe lacks need no place. An empty list or universe gives
    a cascade that contains nothing.
    """
    own = common.materialise(listed.select("key").filter("key is not null").distinct(), "listed")
    every = universe.select("key").filter("key is not null")
    n = own.count()
    many = every.agg(F.approx_count_distinct("key")).first()[0]
    if not n or not many:
        return Cascade(())
    rate = min(0.5, n * math.sqrt(0.5) / many)
    # the levels after the first shrink by half and more each, so twice the first and the listed keys' bits bounds them all
    parts = -(-(2 * bits_for(n, max(1, round(-math.log2(rate)))) + 4 * bits_for(n, 1)) // (8 * MOST_BYTES))
    keyed = [x.select(hashes(F.col("key")).alias("k"), "key") for x in (own, every)]
    return Cascade(tuple(_cascade(*(_of_part(x, i, parts) for x in keyed), own, rate, i, parts) for i in range(parts)))


def _cascade(sides: DataFrame, others: DataFrame, own: DataFrame, rate: float, part: int, parts: int) -> Part:
    levels: list[Level] = []
    n = sides.count()
    while n:
        levels.append(_level(sides.select("k"), len(levels) + 1, n, rate))
        wrong = _passing(others, levels[-1])
        if len(levels) == 1:
            wrong = wrong.distinct().join(own, "key", "left_anti").select("k", "key")
        wrong = common.materialise(wrong, "passed")
        # what passed wrongly is the next level's set; it is held against the keys of the level before
        sides, others, n, rate = wrong, sides, wrong.count(), 0.5
    return Part(tuple(levels), part, parts)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """Keys under which a rule for this host and path could be listed, the longest first.

    A key is a host suffix of whole labels, as many as the longest rule has, and a prefix of the path, of a length that
    some rule has: their number depends on the rules, not on the url.
    """
    labels = max((len(r.split("/")[0].split(".")) for r in rules), default=0)
    lengths = sorted({len(r) - len(r.split("/")[0]) for r in rules})
    split = F.split(host, r"\.")
    n = F.size(split)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda i: F.concat_ws(".", F.slice(split, n - i + 1, i))) if labels else F.array().cast("array<string>")
    heads = F.filter(F.array(*(F.when(F.length(path) >= l, F.substring(path, 1, l)) for l in lengths)), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.struct(F.length(F.concat(s, p)).alias("n"), F.length(s).alias("host"), F.concat(s, p).alias("key")))))
    return F.transform(F.sort_array(keys, asc=False), lambda k: k["key"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    rules: (allow or block, host/path). A rule fits its host and all subdomains if the path starts with its path; the
    longest fitting rule wins, of equally long ones that with the longer host. Without a fitting rule the url is in no
    list: rule is null and verdict the default. Rules of each verdict are one cascade. Null urls have an empty host and
    path, and no rule fits them; repeated rows are all kept; an empty table gives no rows. Other columns are not read.
    """
    verdicts = dict.fromkeys(v for v, _ in rules)
    names = [r for _, r in rules]
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    asked = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), names))
    spark: SparkSession = pages.sparkSession
    universe = common.materialise(asked.select(F.explode("keys").alias("key")).distinct(), "universe")
    every = [(i, c) for i, v in enumerate(verdicts) for c in build(spark.createDataFrame([(r,) for w, r in rules if w == v], "key string"), universe).parts]
    passes: list[list[tuple[int, Part]]] = [[]]
    for x in every:  # as many parts at a time as have room
        if passes[-1] and sum(c.bytes() for _, c in passes[-1]) + x[1].bytes() > MOST_BYTES:
            passes.append([])
        passes[-1].append(x)

    def asking(cascades: list[tuple[int, Part]]) -> Callable:
        sent = spark.sparkContext.broadcast(cascades)  # about MOST_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, c = _pairs(b.column(4).flatten())
                which = b.column(5).flatten().to_numpy(zero_copy_only=False).copy()
                for i, cascade in sent.value:
                    which[cascade.contains(a, c)] = i
                sizes = b.column(4).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(which, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], found], b.schema.names)

        return run

    rows = asked.withColumn("pairs", F.transform("keys", hashes)).withColumn("which", F.transform("keys", lambda _: F.lit(-1)))
    for cascades in passes:
        rows = rows.mapInArrow(asking(cascades), rows.schema)
    first = F.array_position(F.transform("which", lambda w: w >= 0), True).cast("int")  # keys stand the longest first
    hit = first > 0
    verdict = F.element_at(F.array(*map(F.lit, verdicts)), F.element_at("which", first) + 1) if verdicts else F.lit(None).cast("string")
    return rows.select("page_id", "host", "path", F.when(hit, F.element_at("keys", first)).alias("rule"), F.when(hit, verdict).otherwise(F.lit(default)).alias("verdict"))
