"""Token ids in files of patched frame-of-reference blocks.

A file set has two Parquet tables, because any store that Spark reads takes them. `segments`: consecutive whole
documents in ascending (doc_id, text) order, at least SEGMENT ids but for the last of a part; columns part (int,
ascending with doc_id), seq (int), offset (long: ids of the part before this segment), docs (binary: int64 doc_ids),
lengths (binary: uint32 ids of each document), blocks (binary: uint32 byte offset in payload of each block), payload
(binary). `parts`: part, start (long: ids of all parts before) and n; a part is a range of (doc_id, text), the rows of one
task of the writing job.

A block has up to BLOCK ids: header <u32 minimum, u16 count, u8 width, u16 exceptions>, the ids minus the minimum cut to
width bits and packed (little-endian bits), then the exceptions: u16 places and u32 high parts. width is the number
of bits that PERCENTILE of the block's offsets need, or less packed bytes in all; outliers keep their high bits apart.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import BEYOND, LETTERS, read_spec

BLOCK = 1024
SEGMENT = 1 << 16
PERCENTILE = 90
#: Ranges of documents for each shuffle partition of the session.
PARTS = 4
#: New words of a generation of a task's cache, and words that are kept because an earlier generation had them too.
NEW_WORDS, KEPT_WORDS = 220_000, 450_000
#: Words that the library gets as one text.
TOGETHER = 200
_HEAD = struct.Struct("<IHBH")


def _packed(off: np.ndarray, width: int) -> bytes:
    """Lowest width bits of each value, little-endian; up to 16 bits, eight values become width bytes of two words."""
    if width > 16:
        return np.packbits(np.unpackbits(off.astype("<u4").view(np.uint8).reshape(len(off), -1), axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()
    v = np.zeros((-(-len(off) // 8), 8), np.uint64)
    v.ravel()[: len(off)] = off & np.uint32((1 << width) - 1)
    v <<= np.tile(np.arange(4, dtype=np.uint64) * np.uint64(width), 2)
    half = np.bitwise_or.reduce(v.reshape(-1, 2, 4), axis=2)
    words = half.copy()
    if 0 < width < 16:
        words[:, 0] |= half[:, 1] << np.uint64(4 * width)
        words[:, 1] >>= np.uint64(64 - 4 * width)
    return words.astype("<u8").view(np.uint8)[:, :width].tobytes()[: (len(off) * width + 7) // 8]


def _unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    if width > 16:
        whole = np.zeros((n, 32), np.uint8)
        whole[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    rows = -(-n // 8)
    flat = np.zeros(rows * width, np.uint8)
    flat[: len(raw)] = raw
    wide = np.zeros((rows, 16), np.uint8)
    wide[:, :width] = flat.reshape(rows, width)
    half = wide.view("<u8").astype(np.uint64)
    if 0 < width < 16:
        half[:, 1] = half[:, 0] >> np.uint64(4 * width) | half[:, 1] << np.uint64(64 - 4 * width)
    v = half[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(width))
    return (v & np.uint64((1 << width) - 1)).ravel()[:n].astype(np.uint32)


def pack_block(ids: np.ndarray) -> bytes:
    """One block of 1 to 65,535 ids (uint32)."""
    ids = ids.astype(np.uint32)
    low = int(ids.min())
    off = ids - np.uint32(low)
    place = -(-(len(ids) - 1) * PERCENTILE // 100)
    width = int(np.partition(off, place)[place]).bit_length()
    over = np.flatnonzero(off >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = (off[over] >> np.uint32(width)).astype("<u4") if width < 32 else np.zeros(0, "<u4")
    return _HEAD.pack(low, len(ids), width, len(over)) + _packed(off, width) + over.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, n, width, over = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    off = _unpacked(np.frombuffer(data, np.uint8, size, at), n, width)
    at += size
    place = np.frombuffer(data, "<u2", over, at)
    off[place] |= np.frombuffer(data, "<u4", over, at + 2 * over) << np.uint32(width)
    return off + np.uint32(low)


def _full_blocks(ids: np.ndarray) -> list[bytes]:
    """pack_block of each row of ids, rows of equal width together."""
    low = ids.min(axis=1)
    off = ids - low[:, None]
    place = -(-(BLOCK - 1) * PERCENTILE // 100)
    width = np.frexp(np.partition(off, place, axis=1)[:, place].astype(np.float64))[1].astype(np.uint32)
    high = np.where(width[:, None] < 32, off >> np.minimum(width, 31)[:, None], 0)
    row, over = np.nonzero(high)
    cut = np.searchsorted(row, np.arange(len(ids) + 1))
    over, high = over.astype("<u2"), high[row, over].astype("<u4")
    out: list[bytes] = [b""] * len(ids)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed, size = _packed(off[rows].ravel(), w), BLOCK * w // 8
        for n, i in enumerate(rows.tolist()):
            a, b = cut[i], cut[i + 1]
            out[i] = _HEAD.pack(int(low[i]), BLOCK, w, b - a) + packed[n * size : (n + 1) * size] + over[a:b].tobytes() + high[a:b].tobytes()
    return out


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(blocks, payload) of a segment."""
    full = len(ids) // BLOCK * BLOCK
    parts = _full_blocks(ids[:full].astype(np.uint32).reshape(-1, BLOCK)) if full else []
    if full < len(ids):
        parts.append(pack_block(ids[full:]))
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[: len(parts)]
    return starts.astype("<u4").tobytes(), b"".join(parts)


def read_range(blocks: bytes, payload: bytes, start: int, n: int) -> np.ndarray:
    """n ids from start of a segment; only the blocks that hold them are unpacked."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(blocks, "<u4")
    first, last = start // BLOCK, (start + n - 1) // BLOCK
    got = _whole_blocks(payload, at[first : last + 1])
    return got[start - first * BLOCK : start - first * BLOCK + n]


def _whole_blocks(payload: bytes, at: np.ndarray) -> np.ndarray:
    """unpack_block of blocks that follow each other, all but the last of them full; full ones of equal width together."""
    raw = np.frombuffer(payload, np.uint8)
    heads = [_HEAD.unpack_from(payload, int(i)) for i in at]
    out = np.empty((len(at), BLOCK), np.uint32)
    full = np.array([h[1] == BLOCK for h in heads])
    widths = np.array([h[2] for h in heads])
    for w in np.unique(widths[full]).tolist():
        rows = np.flatnonzero(full & (widths == w))
        size = BLOCK * w // 8
        packed = raw[at[rows].astype(np.int64)[:, None] + (_HEAD.size + np.arange(size))] if size else np.zeros((len(rows), 0), np.uint8)
        out[rows] = _unpacked(packed.ravel(), len(rows) * BLOCK, w).reshape(-1, BLOCK)
        for i in rows.tolist():
            low, _, _, over = heads[i]
            if over:
                end = int(at[i]) + _HEAD.size + size
                out[i, np.frombuffer(payload, "<u2", over, end)] |= np.frombuffer(payload, "<u4", over, end + 2 * over) << np.uint32(w)
            out[i] += np.uint32(low)
    if full.all():
        return out.ravel()
    return np.concatenate((out[:-1].ravel(), unpack_block(payload, int(at[-1]))))


class _Known(dict):
    """Ids of words as little-endian uint32. A new word gets an empty bytearray, which is filled when it is learnt and gives
    way to bytes.

    A full generation becomes the old one. Words that are met again are kept, so that words that occur once do not
    crowd them out.
    """

    def __init__(self, kept: dict | None = None, old: dict | None = None):
        super().__init__(kept or {})
        self.kept, self.old, self.new = len(self), old or {}, []
        self.again: dict = {}

    def __missing__(self, word: str):
        ids = self.old.get(word)
        if ids is None:
            ids = bytearray()
            self.new.append((word, ids))
        else:
            self.again[word] = ids
        self[word] = ids
        return ids

    def next(self) -> _Known:
        words = list(self.items())
        kept = dict(words[: self.kept]) if self.kept + len(self.again) <= KEPT_WORDS else {}
        kept.update(self.again)
        return _Known(kept, {w: x for w, x in words[self.kept :] if w not in kept})


class WordTokenizer:
    """The tokenizers library, asked once for each new word.

    The vocabulary's rules never look across white space, so a text's ids are those of its words in order, and words go
    to the library as they are. Only in texts of the blocks up to Latin Extended-A are words lower-cased here, and marks
    after a letter of these blocks are a piece of their own: every Unicode version agrees on that. Words that are not in the
    bounded cache go to the library many at a time, as one text; an end-of-word token ends each of them there.
    """

    def __init__(self, path: str, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.model._resize_cache(0)  # words come here once
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known = _Known()
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian uint32."""
        out, lo = [], 0
        while lo < len(texts):
            if len(self.known) - self.known.kept > NEW_WORDS:
                self.known = self.known.next()
            got, used, of = [], 0, self.known.__getitem__
            while lo < len(texts) and (not got or used < 1 << 20):
                t = texts[lo]
                low = t.lower() if t.isascii() or not BEYOND.search(t) else t
                if any(a in t or a in low for a in self.added) or _ODD.search(t):
                    got.append([self.one(t)])
                else:
                    t = low
                    got.append(list(map(of, " ".join(_STOP.split(t)).split())))
                used += len(t)
                lo += 1
            self.learn()
            out += [b"".join(g) for g in got]
        return out

    def learn(self) -> None:
        """Asks for the new words. Marks after letters are taken apart first, so the list may grow once."""
        known = self.known
        plain, odd, apart = [], [], []
        new, known.new = known.new, []
        for x in new:
            (plain if x[0].isalpha() else odd).append(x)
        for w, ids in odd:
            core = w.rstrip(string.punctuation)
            if core != w and core.isalpha() and LETTERS.match(core[-1]):
                apart.append((w, ids, known[core], known[w[len(core) :]]))
            else:
                ids += self.one(w)
                known[w] = bytes(ids)
        for x in known.new:
            if x[0].isalpha():
                plain.append(x)
            else:
                x[1].extend(self.one(x[0]))
                known[x[0]] = bytes(x[1])
        known.new = []
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        for group, e in zip(groups, self.whole.encode_batch_fast([" ".join([w for w, _ in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cut) == len(group) + 1:
                raw = ids.tobytes()
                for (w, to), a, b in zip(group, cut, cut[1:]):
                    own = known[w] = raw[a:b]
                    to += own
            else:  # some letters are none for the library
                for w, to in group:
                    to += self.one(w)
                    known[w] = bytes(to)
        for w, ids, a, b in apart:
            ids += a + b
            known[w] = bytes(ids)

    def one(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ODD = re.compile(r"[\x1c-\x1f]")
#: A full stop or comma that ends a word of letters is a piece of its own.
_STOP = re.compile(r"([.,])(?<=[a-zß-öø-ÿ].)(?!\S)")
_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str, spec: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordTokenizer(path, spec)
    return _loaded[path]


def write(docs: DataFrame, vocab_path: str, out: str, end_id: int = 1) -> None:
    """Encodes every whole text with the tokenizers library, appends end_id and writes the file set under out.

    Null and empty texts have end_id alone; repeated rows are all kept, ties in doc_id follow the text; an empty table
    gives empty tables. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    common.small_batches(docs.sparkSession)
    rows = common.documents(docs)
    spec = spark.sparkContext.broadcast(read_spec(vocab_path))  # the vocabulary file: fixed size
    # the head of a text deals out rows of one doc_id, in the order of the whole texts
    ranges = rows.repartitionByRange(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.substring("text", 1, 32))
    dealt = ranges.sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = _tokenizer(vocab_path, spec.value)
        part, seq, offset, held, ids = TaskContext.get().partitionId(), 0, 0, 0, []
        names: list = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, offset, held, ids, names
            whole = np.frombuffer(b"".join(ids), "<u4")
            blocks, payload = pack(whole)
            row = [part, seq, offset, len(whole), np.array([_NULL if x is None else x for x in names], "<i8").tobytes(), np.array([len(x) // 4 for x in ids], "<u4").tobytes(), blocks, payload]
            seq, offset, held, ids, names = seq + 1, offset + len(whole), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], _NAMES)

        for b in common.parts(batches):
            for doc, got in zip(b.column(0).to_pylist(), tok.ids(b.column(1).to_pylist())):
                names.append(doc)
                ids.append(got + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT:
                    yield flush()
        if names:
            yield flush()

    schema = "part int, seq int, offset long, n long, docs binary, lengths binary, blocks binary, payload binary"
    dealt.mapInArrow(run, schema).write.parquet(f"{out}/segments")
    sums = spark.read.parquet(f"{out}/segments").groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task of the job before
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n").write.parquet(f"{out}/parts")


_NULL = -(1 << 63)
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["part", "seq", "offset", "n", "docs", "lengths", "blocks", "payload"]


def read(spark, out: str) -> DataFrame:
    """(doc_id, start, ids binary: little-endian uint32) of every document of a file set."""
    parts = spark.read.parquet(f"{out}/parts").select("part", F.col("start").alias("before"))
    segments = spark.read.parquet(f"{out}/segments").join(F.broadcast(parts), "part")  # a row a task of the writing job
    rows = segments.select((F.col("before") + F.col("offset")).alias("start"), "docs", "lengths", "blocks", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, docs, lengths, blocks, payload in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(lengths, "<u4").astype(np.int64)
                at = np.concatenate(([0], np.cumsum(n)))
                raw = read_range(blocks, payload, 0, int(at[-1])).astype("<u4")
                names = np.frombuffer(docs, "<i8")
                if 4 * at[-1] < 1 << 31:
                    ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(raw)])
                else:
                    ids = pa.array([raw[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64(), mask=names == _NULL), pa.array(at[:-1] + start, pa.int64()), ids], ["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids binary")


def digests(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file set, as read back."""
    return read(spark, out).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
