"""What several training-data operators share: inputs, scratch tables and vectorised hashing."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python worker takes at a time (a single larger row is a part of its own).
PART_BYTES = 2 << 20
#: Rows that it takes at a time at most: short texts have as wide results as long ones.
PART_ROWS = 500
#: Bytes that one vectorised pass over texts takes at a time (a single longer text is a pass of its own).
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch that goes to a Python worker, unless the session has a lower bound.

    Results are lazy, so the setting stays: Spark reads it when the caller's job starts.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > PART_BYTES:
        spark.conf.set(name, str(PART_BYTES))


def parts(batches: Iterator[pa.RecordBatch], limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about limit bytes and PART_ROWS rows at most, without copies: memory follows these, not Spark's batches."""
    for b in batches:
        rows = max(1, min(PART_ROWS, int(b.num_rows * limit / max(1, b.nbytes))))
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir (a local folder only where that is unset and all is local)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/sparkloom-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages restart from files, not from lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with over 1 / HOT of a table's rows is a hot one; there are fewer than HOT of them.
HOT = 10_000


def meet(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a table that has each key once: the hot keys of rows meet their rows by broadcast (fewer than HOT rows of named), all others by shuffle."""
    total = rows.count()
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(sizes.filter(F.col("_n") * HOT > total).select(key), "hot")
    large = rows.join(F.broadcast(named.join(F.broadcast(hot), key, "left_semi")), key)
    return large.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(named, key))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; any other column is left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows, without copies; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def text_chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes together."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, 2 * CHUNK_BYTES)
        for key, base in (("up", _BASE), ("down", _INV)):
            out = np.full(m, base, U64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Bytes of a word from which its hash is a digest; shorter words are hashed side by side, eight bytes a step.
LONG_WORD = 2048


def hashed(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes: eight bytes at a time go into the state, which is mixed after each step.

    No sum or product of bytes carries over from one step to the next, so texts of a regular build do not fall together.
    """
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((lower, np.zeros(8, np.uint8))), 8)
    left = end - start
    h = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15))
    live, at = np.flatnonzero(left < LONG_WORD), start
    at, left = at[live], left[live]
    while len(live):
        v = eight[at].view("<u8").ravel() & _FIRST[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ v) + U64(0xD1B54A32D192ED03))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(lower[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, A-Z lower-cased: start, end and 64-bit hash of each.

    Texts over CHUNK_BYTES are taken in pieces cut at white space, so that memory follows the piece, not the text.
    """
    starts, ends, hashes, lo = [], [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + 2 * CHUNK_BYTES)
        if hi < len(data):
            gap = np.flatnonzero(_SPACE[data[lo:hi]])
            while not len(gap) and hi < len(data):
                step = data[hi : hi + CHUNK_BYTES]
                gap = np.flatnonzero(_SPACE[step]) + (hi - lo)
                hi += len(step)
            hi = lo + int(gap[-1]) + 1 if len(gap) and hi < len(data) else hi
        piece = data[lo:hi]
        inside = np.empty(len(piece) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[piece], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(hashed(_LOWER[piece], s, e))
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _shingled(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of words (hashes h, texts end at bounds), and their offsets by text."""
    words = np.diff(bounds)
    count = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(count)))
    where = np.repeat(bounds[:-1], count) + (np.arange(out_at[-1]) - np.repeat(out_at[:-1], count))
    have = np.repeat(np.minimum(words, size), count)
    total = np.zeros(len(where), U64)
    ext = np.concatenate((h, np.zeros(size, U64)))
    for j in range(size):
        factor = mix(np.array([j + 1], U64))[0] | U64(1)  # no sum of some places' factors is that of others
        term = ext[where + j] * factor
        total += np.where(have > j, term, U64(j + 1))
    return mix(total), out_at


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of consecutive texts, and their offsets by text (repeats included).

    A text with fewer words than size has its whole word sequence as one shingle; one without words has none.
    at: byte offsets of the texts in data; a word never crosses a text, as each text's bytes are cut out by at.
    """
    base = int(at[0])
    sub = data[base : int(at[-1])]
    # a separator between texts keeps words apart: shift every text by its number
    n = len(at) - 1
    padded = np.full(len(sub) + n, 32, np.uint8)
    lengths = np.diff(at)
    owner = np.repeat(np.arange(n), lengths)
    padded[np.arange(len(sub)) + owner] = sub
    start = at[:-1] - base + np.arange(n)
    s, _, h = word_hashes(padded)
    return _shingled(h, np.append(np.searchsorted(s, start, side="left"), len(s)), size)


def normal(text: bytes) -> bytes:
    """The words of a UTF-8 text, A-Z lower-cased, joined by one blank."""
    return b" ".join(text.lower().split())


def distinct_shingles(text: bytes, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The normal form of a text, the sorted hashes of its distinct shingles, and where each stands in it."""
    plain = normal(text)
    s, e, h = word_hashes(np.frombuffer(plain, np.uint8))
    values, first = np.unique(_shingled(h, np.array([0, len(h)]), size)[0], return_index=True)
    return plain, values, s[first], e[np.minimum(first + size, len(e)) - 1]


def distinct_by_text(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their offsets."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.concatenate(([0], np.cumsum(np.bincount(o, minlength=n)))).astype(np.int64)
