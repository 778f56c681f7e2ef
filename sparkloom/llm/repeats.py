"""Repeated passages by enhanced suffix arrays over anchored segments.

Every string of `length` bytes has an anchor, its leftmost minimal K-gram (K = length - 30), so equal strings have equal
anchors at equal places. A text is cut into segments: an anchor's run of at most 31 window starts and the bytes of those
windows. Strings that repeat can only meet under one anchor, so a suffix array for each anchor finds every repeat,
however the anchors are dealt out to tasks.

1. Chunks of documents name their segments by (anchor hash, digest of the content); a chunk names a segment once, for its
   smallest document, and settles by their bytes which of its segments are equal. These names are dealt out by anchor: a
   hot passage sends one name a chunk, not one a document.
2. Anchors that have several segments ask for the bytes of one segment of each content (the class representative, of
   the smallest doc_id); its other members are copies of it. Anchors with very many contents are split by window.
3. Each task sorts the suffixes of its segments into an enhanced suffix array (order and common prefixes) and scans it
   with a stack into the tree of common-prefix intervals. An interval whose suffixes differ in the byte to the left is a
   maximal repeat, with all its occurrences.

What is removed needs no more than these segments: a repeat longer than one is the union of those of consecutive anchors.
groups() lists the maximal repeats themselves. It goes by levels: at level L a suffix is seen 2 * L bytes far, with the byte
to its left, so every maximal repeat of L to 2 * L - 1 bytes comes out whole under the anchor of its first L bytes; longer
ones have an anchor at a higher level. Levels double until nothing reaches the end of what is seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
#: Window starts of an anchor at most; one bit each in a mask.
RUN = 31
#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK = 2 << 20
#: Bytes of text whose names one bucket holds, on average.
BUCKET = 32 << 20
#: Contents of one anchor beyond which its windows are dealt out one by one.
SPLIT = 4096
#: Suffixes that one suffix array sorts together; anchors are not divided.
SLICE = 100_000
_LAST = np.int64((1 << 63) - 1)
#: Bytes of an anchor's hash in a name: anchors may fall together, as suffix arrays tell them apart.
NAME = 6
#: Bytes of the blake2b digest by which chunks tell contents; inside a chunk they are compared byte by byte.
DIGEST = 12
U64 = np.uint64


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, ids, lens, text): whole documents packed and compressed; null ids stand after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lens, parts, held, seq
            row = [(task << 32) + seq, np.concatenate(ids).tobytes(), np.concatenate(lens).tobytes(), press.compress(b"".join(parts))]
            ids, lens, parts, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "ids", "lens", "text"])

        for b in batches:
            data, at = common.text_arrays(b.column(1))
            names = b.column(0).fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK - held, side="right")) - 1)
                hi = min(hi, len(names))
                if held and at[hi] - at[lo] + held > CHUNK:
                    yield flush()
                    continue
                ids.append(names[lo:hi])
                lens.append(np.diff(at[lo : hi + 1]))
                parts.append(data[at[lo] : at[hi]].tobytes())
                held += int(at[hi] - at[lo]) + 64 * (hi - lo)
                lo = hi
                if held >= CHUNK:
                    yield flush()
        if ids:
            yield flush()

    common.small_batches(docs.sparkSession)
    return common.documents(docs).mapInArrow(run, "chunk long, ids binary, lens binary, text binary")


def open_chunk(ids: bytes, lens: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(lens, np.int64)
    at = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(text) if at[-1] else b""
    return np.frombuffer(ids, np.int64), at, np.frombuffer(raw, np.uint8)


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = common._power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    return total


def segments(data: np.ndarray, at: np.ndarray, length: int, most: int = RUN) -> tuple[np.ndarray, ...]:
    """Segments of texts: text number, first start, number of starts, anchor place, anchor hash, content hash (no proof of equality)."""
    k = length - most + 1
    out: list[tuple] = []
    # a few megabytes at a time; pieces of one long text overlap by a window, so that no start is lost or met twice
    for lo, hi in common.text_chunks(at, 1 << 18):
        if hi - lo > 1 or at[hi] - at[lo] <= 4 << 20:
            spans = [(int(at[lo]), int(at[hi]), int(at[hi]) - int(at[lo]))]
        else:
            spans = [(x, min(int(at[hi]), x + (2 << 20) + length - 1), min(2 << 20, int(at[hi]) - x)) for x in range(int(at[lo]), int(at[hi]), 2 << 20)]
        for first, end, starts in spans:
            piece = data[first:end]
            if len(piece) < length:
                continue
            total = _prefix(piece)
            _, down = common._power(len(piece) + 1)
            grams = common.mix((total[k:] - total[:-k]) * down[: len(piece) - k + 1])
            # the leftmost minimum of so many grams: the place is in the low bits
            places = U64((1 << max(22, len(grams).bit_length())) - 1)
            order = (grams & ~places) | np.arange(len(grams), dtype=U64)
            low, have = order, 1
            while have < most:
                step = min(have, most - have)
                low = np.minimum(low[: len(low) - step], low[step:])
                have += step
            place = (low & places).astype(np.int64)[:starts]
            lens = np.diff(at[lo : hi + 1]) if hi - lo > 1 else [len(piece)]
            owner = np.repeat(np.arange(lo, hi), lens)[: len(place)]
            s = np.flatnonzero(np.repeat(at[lo + 1 : hi + 1], lens)[: len(place)] - np.arange(first, first + len(place)) >= length)
            if not len(s):
                continue
            new = np.ones(len(s), bool)
            new[1:] = (place[s[1:]] != place[s[:-1]]) | (owner[s[1:]] != owner[s[:-1]])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(s)))
            start, anchor = s[head], place[s[head]]
            stop = start + n + length - 1
            content = common.mix((total[stop] - total[start]) * down[start] + (anchor - start).astype(U64) * U64(0x9E3779B97F4A7C15) + n.astype(U64))
            out.append((owner[s[head]], start + first, n, anchor + first, common.mix(grams[anchor] + U64(7)), content))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out))


_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def apart(data: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the different contents of its group each range of bytes has: 0 for all of a group whose bytes are equal.

    of: number of the group (equal hashes), from 0 on.
    """
    sub = np.zeros(len(of), np.int64)
    if not len(of):
        return sub
    first = np.zeros(int(of.max()) + 1, np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    x = np.flatnonzero(first[of] != np.arange(len(of)))
    y = first[of[x]]
    differ = size[x] != size[y]
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    for lo in range(0, int(size[x].max(initial=0)), 8):
        more = np.flatnonzero(~differ & (size[x] > lo))
        i, j = x[more], y[more]
        differ[more] = ((wide[start[i] + lo].view("<u8").ravel() ^ wide[start[j] + lo].view("<u8").ravel()) & _EIGHT[np.minimum(size[i] - lo, 8)]) != 0
    if differ.any():  # hashes that fell together
        seen: dict[tuple[int, bytes], int] = {}
        count: dict[int, int] = {}
        for i in np.flatnonzero(np.isin(of, of[x[differ]])).tolist():
            key = int(of[i]), data[start[i] : start[i] + size[i]].tobytes()
            if key not in seen:
                seen[key] = count[key[0]] = count.get(key[0], -1) + 1
            sub[i] = seen[key]
    return sub


def named(ids: np.ndarray, data: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of equal anchors and bytes as one name: the name of each segment, the first segment and the smallest id of each name.

    Names ascend with the upper half of h: every pass over a chunk numbers them alike.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper = U64(0xFFFFFFFF_00000000)
    order = np.argsort((h & upper) | (common.mix(g + h) >> U64(32)), kind="stable")

    def starts(order: np.ndarray, *by: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in by])
        return new

    new = starts(order, h, g)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    sub = apart(data, start, size, of)
    if sub.any():
        order = np.lexsort((sub, of))
        new = starts(order, of, sub)
    of, doc = np.cumsum(new) - 1, ids[owner[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    name = np.empty(len(order), np.int64)
    name[order] = of
    at = np.flatnonzero(doc == least[of])
    at = at[np.diff(of[at], prepend=-1) > 0]
    return name, order[at], least


def digests(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(n, DIGEST) bytes: blake2b of ranges of bytes and of how many of them stand before the anchor."""
    view = memoryview(np.ascontiguousarray(data))
    out = [hashlib.blake2b(view[a:b], digest_size=DIGEST, salt=b"%d" % c).digest() for a, b, c in zip(start.tolist(), (start + size).tolist(), before.tolist())]
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, DIGEST)


def windows(data: np.ndarray, start: np.ndarray, runs: np.ndarray, h: np.ndarray, first: np.ndarray, doc: np.ndarray, w: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The windows of the names w: name, step, key (a hash of the whole window), number of the distinct window, and for each
    distinct window its representative (a place in these arrays) and its smallest id."""
    many = runs[first[w]]
    which = np.repeat(w, many)
    step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    if not len(which):
        z = np.zeros(0, np.int64)
        return which, step, np.zeros(0, U64), z, z, z
    total, down = _prefix(data), common._power(len(data) + 1)[1]
    s = start[first[which]] + step
    key = common.mix(h[first[which]] ^ (total[s + length] - total[s]) * down[s])
    _, of = np.unique(key, return_inverse=True)
    sub = apart(data, s, np.full(len(s), length), of)
    order = np.lexsort((doc[which], sub, of))
    new = np.ones(len(order), bool)
    new[1:] = (of[order[1:]] != of[order[:-1]]) | (sub[order[1:]] != sub[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return which, step, key, number, order[new], doc[which[order[new]]]


def _short(x: np.ndarray) -> bytes:
    """The upper bytes of hashes."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - NAME :].tobytes()


def _long(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // NAME, 8), np.uint8)
    out[:, 8 - NAME :] = np.frombuffer(x, np.uint8).reshape(-1, NAME)
    return out.view("<u8").ravel()


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch of large values, one at a time."""
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in b.columns)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _names(table: DataFrame, length: int, n: int) -> DataFrame:
    """(bucket, chunk, h, g, docs): the names of each chunk, a row for each bucket of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, *blobs in _rows(b):
                ids, at, data = open_chunk(*blobs)
                owner, start, runs, anchor, h, g = segments(data, at, length)
                size = runs + length - 1
                _, first, doc = named(ids, data, owner, start, size, h, g)
                content = digests(data, start[first], size[first], (anchor - start)[first])
                cut = np.searchsorted(_buckets(h[first], n), np.arange(n + 1))  # names ascend with h, and so do buckets
                full = np.flatnonzero(np.diff(cut))
                press = zstandard.ZstdCompressor(1)
                cols = ([], [], [])
                for i in full:
                    x = slice(cut[i], cut[i + 1])
                    cols[0].append(_short(h[first[x]]))
                    cols[1].append(content[x].tobytes())
                    cols[2].append(press.compress(np.diff(doc[x], prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "chunk", "h", "g", "docs"])

    return table.mapInArrow(run, "bucket int, chunk long, h binary, g binary, docs binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one bucket at a time, from rows sorted by bucket (the first column)."""
    held: list[tuple] = []
    for b in batches:
        for row in _rows(b):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


#: What is known of a name: nothing repeats; a smaller document has the same segment; its bytes are asked for; its windows.
NOTHING, COPY, ASKED, WINDOWS = 0, 1, 2, 3
#: Added to a code: other chunks have the same segment.
SHARED = 8


def _judge(names: DataFrame) -> DataFrame:
    """(chunk, bucket, codes): a code for each name, in the order in which the chunk sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for rows in _by_bucket(batches):
            h = _long(b"".join(r[2] for r in rows))
            whole = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, DIGEST)
            g, rest = (whole[:, x].copy().view(t).ravel() for x, t in ((slice(8), "<u8"), (slice(8, DIGEST), "<u4")))
            docs = [np.cumsum(np.frombuffer(zstandard.decompress(r[4]), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()) for r in rows]
            sizes = [len(d) for d in docs]
            doc = np.concatenate(docs)
            order = np.lexsort((doc, rest, g, h))
            hs, gs, ts, ds = h[order], g[order], rest[order], doc[order]
            new_h = np.ones(len(order), bool)
            new_h[1:] = hs[1:] != hs[:-1]
            new = new_h.copy()
            new[1:] |= (gs[1:] != gs[:-1]) | (ts[1:] != ts[:-1])
            of = np.cumsum(new) - 1
            least = ds[new][of]
            group = np.cumsum(new_h) - 1
            contents = np.bincount(group[new], minlength=group[-1] + 1)[group]
            members = np.bincount(of)[of]
            code = np.where(members > 1, SHARED, 0) + np.where(ds > least, COPY, np.where(contents == 1, NOTHING, np.where(contents > SPLIT, WINDOWS, ASKED))).astype(np.uint8)
            back = np.empty(len(order), np.uint8)
            back[order] = code
            cut = np.cumsum([0, *sizes])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([press.compress(back[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["chunk", "bucket", "codes"]
            )

    return names.mapInArrow(run, "chunk long, bucket int, codes binary")


def _with(table: DataFrame, replies: DataFrame, *names: str) -> DataFrame:
    """Each chunk with its replies, in order of buckets."""
    got = replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", *names))).alias("_r"))  # a row a bucket, its size bounded by the chunk's
    return table.join(got.select("chunk", *(F.col(f"_r.{n}").alias(n) for n in names)), "chunk", "left")


def _codes(blobs: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.decompress(x) for x in blobs or []), np.uint8)


def _asked(table: DataFrame, length: int, n: int) -> DataFrame:
    """(bucket, chunk, h, doc, at, starts, pos, bytes): what the anchors ask for. at: name * 32, or name * 32 + 1 + window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, *blobs, codes in _rows(b):
                ids, at, data = open_chunk(*blobs)
                owner, start, runs, anchor, h, g = segments(data, at, length)
                _, first, doc = named(ids, data, owner, start, runs + length - 1, h, g)
                code = _codes(codes)
                x = np.flatnonzero(code % SHARED == ASKED)
                w = np.flatnonzero(code % SHARED == WINDOWS)
                # of equal windows, only the smallest document's is sent
                which, step, key, _, sent, _ = windows(data, start, runs, h, first, doc, w, length)
                which, step, key = which[sent], step[sent], key[sent]
                all_name = np.concatenate((x, which))
                rows = {
                    "h": np.concatenate((h[first[x]], key)), "doc": doc[all_name], "at": all_name * 32 + np.concatenate((np.zeros(len(x), np.int64), step + 1)),
                    "starts": np.concatenate((runs[first[x]], np.ones(len(which), np.int64))), "from": np.concatenate((start[first[x]], start[first[which]] + step)),
                }
                if not len(all_name):
                    continue
                pos = rows["from"] - at[owner[first[all_name]]]
                size = rows["starts"] + length - 1
                order = np.argsort(rows["h"], kind="stable")
                bucket = _buckets(rows["h"][order], n)
                cut = np.searchsorted(bucket, np.arange(n + 1))
                full = np.flatnonzero(np.diff(cut))
                cols: list[list[bytes]] = [[] for _ in range(6)]
                for i in full:
                    o = order[cut[i] : cut[i + 1]]
                    for c, v in zip(cols, (rows["h"][o], rows["doc"][o], rows["at"][o], rows["starts"][o].astype(np.uint8), pos[o])):
                        c.append(v.tobytes())
                    sz = size[o]
                    flat = np.repeat(rows["from"][o] - (np.cumsum(sz) - sz), sz) + np.arange(int(sz.sum()))
                    cols[5].append(data[flat].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "chunk", "h", "doc", "at", "starts", "pos", "bytes"])

    return table.mapInArrow(run, "bucket int, chunk long, h binary, doc binary, at binary, starts binary, pos binary, bytes binary")


class SuffixArray:
    """Enhanced suffix array of the window starts of segments; anchors (h) are kept apart as if they were the first letters."""

    def __init__(self, h: np.ndarray, starts: np.ndarray, data: np.ndarray, length: int):
        size = starts.astype(np.int64) + length - 1
        first = np.cumsum(size) - size
        n = starts.astype(np.int64)
        self.segment = np.repeat(np.arange(len(h)), n)
        self.step = np.arange(len(self.segment)) - np.repeat(np.cumsum(n) - n, n)
        at = first[self.segment] + self.step
        self.left = size[self.segment] - self.step
        width = -(-(length + RUN) // 8) * 8
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(width, np.uint8))), width)[at]
        wide = np.where(np.arange(width) < self.left[:, None], wide, 0).astype(np.uint8)
        words = wide.view(">u8").astype(U64)
        key = h[self.segment]
        self.order = np.lexsort((*words.T[::-1], key))
        o = self.order
        a, b = wide[o[1:]], wide[o[:-1]]
        differ = a != b
        common_bytes = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common_bytes = np.minimum(common_bytes, np.minimum(self.left[o[1:]], self.left[o[:-1]]))
        self.lcp = np.where(key[o[1:]] == key[o[:-1]], common_bytes, 0)
        before = np.where(self.step > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256 + self.segment)  # a segment's edge counts as a letter of its own
        self.before = before[o]

    def repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, bytes) of the maximal repeats."""
        return intervals(self.lcp, self.before, least)


def intervals(lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, bytes) of the intervals of the common-prefix tree of sorted suffixes that differ to the left.

    lcp: common prefixes of neighbours; before: the letter left of each suffix. A stack holds the open intervals (bytes,
    first); runs of common prefixes under least are not entered.
    """
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    gaps = np.flatnonzero(np.diff(deep) > 1)
    for lo, hi in zip(np.append(0, gaps + 1).tolist(), np.append(gaps + 1, len(deep)).tolist()):
        base, end = int(deep[lo]), int(deep[hi - 1]) + 1
        depth = lcp[base:end].tolist()
        change = changes[base : end + 1].tolist()
        stack = [(depth[0], 0)]
        for i, x in enumerate([*depth[1:], 0], 1):
            first = i
            while stack and stack[-1][0] > x:
                size, first = stack.pop()
                if change[first] != change[i]:
                    yield base + first, base + i, size
            if x and (not stack or stack[-1][0] < x):
                stack.append((x, first))


#: The letter left of a text's first byte; it differs from itself.
EDGE = 256


def _wide(table: DataFrame, length: int, level: int) -> DataFrame:
    """(h, c, doc, start, off, n, before, seen): segments at a level whose first windows may repeat, and what follows them.

    h names the anchor, which stands `off` bytes from the start, c the whole row of equal segments. seen has the n window
    starts and 2 * level bytes from the last of them, or up to the end of the text; before is the byte left of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, *blobs, codes in _rows(b):
                ids, at, data = open_chunk(*blobs)
                owner, start, runs, _, h, g = segments(data, at, length)
                name, _, _ = named(ids, data, owner, start, runs + length - 1, h, g)
                if not len(name):
                    continue
                # windows of the first level that occur again
                again = (_codes(codes)[name] != NOTHING) | (np.bincount(name)[name] > 1)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, start[again], 1)
                np.add.at(edge, (start + runs)[again], -1)
                sums = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
                size = level - length + 1
                whole = np.zeros(len(data) + 1, np.int64)
                whole[1 : max(1, len(data) - size + 2)] = np.cumsum(sums[size:] - sums[:-size] == size) if len(data) >= size else 0
                whole[max(1, len(data) - size + 2) :] = whole[max(0, len(data) - size + 1)]
                owner, start, runs, anchor, h, _ = segments(data, at, level, level // 2 + 6)
                keep = np.flatnonzero(whole[start + runs] > whole[start])
                cols: list[list] = [[] for _ in range(8)]
                for i in keep.tolist():
                    x, doc = int(start[i]), int(owner[i])
                    end = min(x + int(runs[i]) - 1 + 2 * level, int(at[doc + 1]))
                    seen = data[x:end].tobytes()
                    before = int(data[x - 1]) if x > at[doc] else EDGE
                    off, n = int(anchor[i]) - x, int(runs[i])
                    c = hashlib.blake2b(b"%d %d %d " % (off, n, before) + seen, digest_size=16).digest()
                    for col, v in zip(cols, (h[i].view(np.int64), c, int(ids[doc]), x - int(at[doc]), off, n, before, seen)):
                        col.append(v)
                    if len(cols[0]) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, _WIDE)], _WIDE_NAMES)
                        cols = [[] for _ in range(8)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, _WIDE)], _WIDE_NAMES)

    return table.mapInArrow(run, "h long, c binary, doc long, start long, off int, n int, before int, seen binary")


_WIDE = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_WIDE_NAMES = ["h", "c", "doc", "start", "off", "n", "before", "seen"]


def _shared(a: bytes, b: bytes) -> int:
    """Bytes of the common prefix."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    return int(differ.argmax()) if differ.any() else n


def _of_anchor(rows: list[tuple], level: int) -> Iterator[tuple[int, int, list[tuple[bytes, int]]]]:
    """(nth, bytes, [(c, step)]) of the maximal repeats under one anchor; bytes of 2 * level stand for that and more.

    rows: (h, c, off, n, before, seen, copies). Suffixes can only share their first bytes at one distance from the anchor,
    and only distances at which the letters to the left differ have a maximal repeat.
    """
    at: dict[int, list[tuple[int, int]]] = {}
    for i, (_, _, off, n, before, seen, copies) in enumerate(rows):
        for step in range(n):
            at.setdefault(off - step, []).append((i, step))
    nth = 0
    for places in at.values():
        letter = lambda i, step: rows[i][4] if not step else rows[i][5][step - 1]
        letters = [letter(i, step) for i, step in places]
        if len(set(letters)) == 1 and letters[0] != EDGE:
            continue
        suffixes = sorted((rows[i][5][step : step + 2 * level], i, step, x) for (i, step), x in zip(places, letters) for _ in range(min(2, rows[i][6])))
        if len(suffixes) < 2:
            continue
        lcp = np.array([_shared(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])])
        before = np.array([EDGE + k if x[3] == EDGE else x[3] for k, x in enumerate(suffixes)])
        for a, b, size in intervals(lcp, before, level):
            yield nth, size, sorted({(rows[i][1], step) for _, i, step, _ in suffixes[a : b + 1]})
            nth += 1


def _arrays(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Suffix arrays of a bucket's segments, a slice of whole anchors each, with (row, doc, at, h, pos) of the segments."""
    cols = [np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((2, U64), (3, np.int64), (4, np.int64), (5, np.uint8), (6, np.int64))]
    h, doc, at, starts, pos = cols
    source = np.repeat(np.arange(len(rows)), [len(r[5]) for r in rows])
    data = np.concatenate([np.frombuffer(r[7], np.uint8) for r in rows])
    size = starts.astype(np.int64) + length - 1
    first = np.cumsum(size) - size
    order = np.argsort(h, kind="stable")
    _, count = np.unique(h[order], return_counts=True)
    ends = np.cumsum(count)
    suffixes = np.concatenate(([0], np.cumsum(starts[order].astype(np.int64))))[np.concatenate(([0], ends))]
    bounds, lo = np.concatenate(([0], ends)), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(suffixes, suffixes[lo] + SLICE, side="right")) - 1)
        o = order[bounds[lo] : bounds[hi]]
        lo = hi
        flat = np.repeat(first[o] - (np.cumsum(size[o]) - size[o]), size[o]) + np.arange(int(size[o].sum()))
        yield SuffixArray(h[o], starts[o], data[flat], length), source[o], doc[o], at[o], h[o], pos[o]


def _masks(asked: DataFrame, length: int) -> DataFrame:
    """(chunk, bucket, at, masks): for each segment the window starts that a smaller document also has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            out: list[tuple] = []
            for sa, source, doc, at, _, _ in _arrays(rows, length):
                mask = np.zeros(len(at), np.uint32)
                docs = doc[sa.segment][sa.order]
                listed = docs.tolist()
                # an occurrence of n bytes covers the n - length + 1 window starts from its own on
                hit = np.zeros(len(docs), np.uint32)
                for a, b, n in sa.repeats(length):
                    if b == a + 1:
                        x, y = listed[a], listed[b]
                        if x != y:
                            i = b if x < y else a
                            hit[i] = max(hit[i], n - length + 1)
                    else:
                        part = docs[a : b + 1]
                        np.maximum(hit[a : b + 1], n - length + 1, out=hit[a : b + 1], where=part > part.min())
                some = np.flatnonzero(hit)
                found = sa.order[some]
                np.bitwise_or.at(mask, sa.segment[found], ((np.uint32(1) << hit[some]) - np.uint32(1)) << sa.step[found].astype(np.uint32))
                keep = np.flatnonzero(mask)
                out.append((source[keep], at[keep], mask[keep]))
            source, at, mask = (np.concatenate(x) for x in zip(*out))
            order = np.argsort(source, kind="stable")
            cut = np.searchsorted(source[order], np.arange(len(rows) + 1))
            full = np.flatnonzero(np.diff(cut))
            parts = [order[cut[i] : cut[i + 1]] for i in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in full], pa.int64()), pa.array([rows[i][0] for i in full], pa.int32()), pa.array([at[p].tobytes() for p in parts], pa.binary()), pa.array([mask[p].tobytes() for p in parts], pa.binary())],
                ["chunk", "bucket", "at", "masks"],
            )

    return asked.mapInArrow(run, "chunk long, bucket int, at binary, masks binary")


class Repeats:
    """The repeats of a table of documents: maximal groups, and what each text keeps."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, buckets: int | None = None):
        if length < RUN + 4:
            raise ValueError(f"length must be at least {RUN + 4} bytes")
        self.length = length
        spark = docs.sparkSession
        self.table = common.materialise(chunks(docs), "chunks")
        tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a task takes one bucket at a time, so these are as many as keep a bucket's share of the names small
        n = buckets or max(tasks, -(-self.table.count() * CHUNK // BUCKET))
        dealt = lambda df: df.repartition(min(n, tasks), "bucket").sortWithinPartitions("bucket", "chunk")
        self.codes = common.materialise(_judge(dealt(_names(self.table, length, n))), "codes")
        self.n, self.dealt = n, dealt
        self.asked = dealt(common.materialise(_asked(_with(self.table, self.codes, "codes"), length, n), "asked"))

    def groups(self) -> DataFrame:
        """(anchor, nth, n_bytes, n_occurrences, doc_id, start): a row for each occurrence of each maximal repeat.

        anchor, nth and n_bytes name the repeat, start is a byte of the document. A repeat has at least `length` bytes, two
        occurrences or more (in one document or in several), and letters to the left, and to the right, that are not all
        the same; the edges of a text differ from every letter. Equal surroundings of an anchor are compared once, different
        ones in one task. Texts that repeat a short word very often have very many maximal repeats, and all are listed.
        """
        chunked, level, out = _with(self.table, self.codes, "codes"), self.length, []
        while True:
            found, more = self._level(chunked, level)
            out.append(found)
            if not more:
                break
            level *= 2
        rows = out[0]
        for x in out[1:]:
            rows = rows.unionByName(x)
        named = ["anchor", "nth", "n_bytes"]
        counts = rows.groupBy(*named).agg(F.count(F.lit(1)).alias("n_occurrences"))
        return rows.join(counts, named).select(*named, "n_occurrences", "doc_id", "start")

    def _level(self, chunked: DataFrame, level: int) -> tuple[DataFrame, bool]:
        """(anchor, nth, n_bytes, doc_id, start) of the repeats of under 2 * level bytes, and whether there are longer ones."""
        rows = common.materialise(_wide(chunked, self.length, level), "wide")
        classes = rows.groupBy("h", "c").agg(*(F.first(x).alias(x) for x in ("off", "n", "before", "seen")), F.count(F.lit(1)).alias("copies"))
        shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > 1).select("h")
        dealt = classes.join(shared, "h", "left_semi").repartition("h").sortWithinPartitions("h")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def listed(held: list[tuple]) -> pa.RecordBatch:
                cols: list[list] = [[], [], [], [], []]
                for nth, size, places in _of_anchor(held, level):
                    if size >= 2 * level:
                        nth, places = -1, places[:1]  # only says that there is more
                    for c, step in places:
                        for col, v in zip(cols, (held[0][0], c, nth, size, step)):
                            col.append(v)
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["h", "c", "nth", "n_bytes", "step"])

            held: list[tuple] = []
            for b in batches:
                for row in _rows(b):
                    if held and held[0][0] != row[0]:
                        yield listed(held)
                        held = []
                    held.append(row)
            if held:
                yield listed(held)

        found = common.materialise(dealt.select("h", "c", "off", "n", "before", "seen", "copies").mapInArrow(run, "h long, c binary, nth long, n_bytes long, step long"), "found")
        places = found.filter("nth >= 0").join(rows.select("h", "c", "doc", "start"), ["h", "c"])
        doc = F.when(F.col("doc") != int(_LAST), F.col("doc"))
        out = places.select(F.col("h").alias("anchor"), "nth", "n_bytes", doc.alias("doc_id"), (F.col("start") + F.col("step")).alias("start"))
        return out, not found.filter("nth < 0").isEmpty()

    def copies(self) -> DataFrame:
        """(anchor, content, n_bytes, doc_id, start): a row for each occurrence of a whole segment that occurs again.

        anchor and content name the segment. It is a repeat as a whole, and its occurrences share all repeats that
        groups() has inside the one of the smallest document.
        """
        return self._segments(lambda code, name: (code >= SHARED)[name] | (np.bincount(name) > 1)[name])

    def _segments(self, which: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """(anchor, content, n_bytes, doc_id, start) of the segments that are chosen by the codes and the name of each."""
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, *blobs, codes in _rows(b):
                    ids, at, data = open_chunk(*blobs)
                    owner, start, runs, anchor, h, g = segments(data, at, length)
                    name, first, _ = named(ids, data, owner, start, runs + length - 1, h, g)
                    if not len(name):
                        continue
                    again = np.flatnonzero(which(_codes(codes), name))
                    doc = ids[owner[again]]
                    content = digests(data, start[again], runs[again] + length - 1, (anchor - start)[again])[:, :8].copy().view("<i8").ravel()
                    cols = (h[again].view(np.int64), content, runs[again] + length - 1, doc, start[again] - at[owner[again]])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=(doc == _LAST) if i == 3 else None) for i, c in enumerate(cols)], ["anchor", "content", "n_bytes", "doc_id", "start"])

        return _with(self.table, self.codes, "codes").mapInArrow(run, "anchor long, content long, n_bytes long, doc_id long, start long")

    def kept(self, texts: bool = True, characters: bool = False, digests: bool = False) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, text_sha256) of every row of docs.

        kept (binary) is null without texts, text_sha256 (of the input) without digests.

        A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id; with
        characters, one that only a part of a UTF-8 character would lose stays. Null
        and empty texts have nothing to lose; rows of one doc_id never remove from each other; rows without doc_id
        stand after all others; an empty table gives no rows.
        """
        length = self.length
        masks = common.materialise(_masks(self.asked, length), "masks")
        both = _with(_with(self.table, self.codes, "codes"), masks, "at", "masks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, *blobs, codes, names, bits in _rows(b):
                    ids, at, data = open_chunk(*blobs)
                    gone = covered(ids, at, data, _codes(codes), names, bits, length)
                    if characters and len(data):
                        first = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32 if len(data) < 1 << 31 else np.int64)
                        gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, first.dtype.type(len(data)))))
                    yield from _results(ids, at, data, gone, texts, digests)

        return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text_sha256 string")


def covered(ids: np.ndarray, at: np.ndarray, data: np.ndarray, code: np.ndarray, names: list[bytes] | None, bits: list[bytes] | None, length: int) -> np.ndarray:
    """Bytes that go."""
    owner, start, runs, _, h, g = segments(data, at, length)
    name, first, least = named(ids, data, owner, start, runs + length - 1, h, g)
    if not len(name):
        return np.zeros(len(data), bool)
    # copies of a segment that a smaller document has, in another chunk or in this one
    whole = (code[name] % SHARED == COPY) | (ids[owner] > least[name])
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, start[whole], 1)
    np.add.at(edge, (start + runs + length - 1)[whole], -1)
    of = np.zeros(len(least), np.uint32)
    key, mask = np.frombuffer(b"".join(names or []), np.int64), np.frombuffer(b"".join(bits or []), np.uint32)
    np.bitwise_or.at(of, key[key % 32 == 0] // 32, mask[key % 32 == 0])
    which, step, _, number, sent, lowest = windows(data, start, runs, h, first, least, np.flatnonzero(code % SHARED == WINDOWS), length)
    if len(which):
        hit = np.isin(which[sent] * 32 + step[sent] + 1, key)[number] | (least[which] > lowest[number])
        np.bitwise_or.at(of, which[hit], np.uint32(1) << step[hit].astype(np.uint32))
    mine = np.where(whole, 0, of[name]).astype(np.uint32)
    some = np.flatnonzero(mine)
    for i in range(RUN):
        s = start[some[(mine[some] >> np.uint32(i) & np.uint32(1)) == 1]] + i
        np.add.at(edge, s, 1)
        np.add.at(edge, s + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _results(ids: np.ndarray, at: np.ndarray, data: np.ndarray, gone: np.ndarray, texts: bool, digests: bool) -> Iterator[pa.RecordBatch]:
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    inner = at[:-1][np.diff(at) > 0]
    rise[inner] = gone[inner]  # runs never cross documents
    removed, spans = (np.append(0, np.add.reduceat(np.append(x, False), at[:-1], dtype=np.int64) * (np.diff(at) > 0)).cumsum() if len(at) > 1 else np.zeros(1, np.int64) for x in (gone, rise))
    stay = ~gone
    left = data[stay]
    cut = np.concatenate(([0], np.cumsum(stay)))[at]
    kept = [left[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(np.diff(spans), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept if texts else [None] * len(kept), pa.binary()),
            pa.array([hashlib.sha256(data[a:b]).hexdigest() if digests else None for a, b in zip(at[:-1], at[1:])], pa.string()),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text_sha256"],
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """See Repeats.kept."""
    return Repeats(docs, length).kept(texts)
