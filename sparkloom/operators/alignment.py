"""Alignment of two sequences: pages of two versions of a document, lines of two pages, characters of two lines.

The longest run of equal items (of equal ones the first in a, then the first in b) is an anchor; what stands before it and
after it is aligned in the same way. Pages of a document meet by a shuffle of their digests; lines and characters are in the row of their
pair of texts. Many pairs of sequences are aligned side by side.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T

#: Pairs of equal k-grams that are listed for segments together; those with the most beyond that have only their longest runs looked for.
CELLS = 1 << 21
#: Pairs of equal k-grams, and items, that are looked at together.
PAIRS = 1 << 19
#: Lengths of the k-grams by which runs are found, down to single items.
GRAMS = (16, 4, 1)
TAGS = ("equal", "replace", "delete", "insert")
#: All white space of Unicode. Trimming looks at the end of a line only, a pattern at every place of it.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _matches(x: np.ndarray, y: np.ndarray, segs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (seg, lo, hi, d) of k equal items or more inside of segments, by segment, and the segments whose pairs of equal k-grams are not listed, which give no runs."""
    grams = []
    with np.errstate(over="ignore"):
        for items, first, end in ((x, 0, 1), (y, 2, 3)):
            n = np.maximum(segs[:, end] - segs[:, first] - k + 1, 0)
            at, seg = _places(segs[:, first], n), np.repeat(np.arange(len(segs)), n)
            name = seg.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for t in range(k):
                name = (name ^ items[at + t].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                name ^= name >> np.uint64(32)
            grams.append((at, seg, name))
    (i, seg, name), (j, seg_b, name_b) = grams
    order = np.argsort(name_b)
    j, seg_b, name_b = j[order], seg_b[order], name_b[order]
    left = np.searchsorted(name_b, name)
    n = np.searchsorted(name_b, name, "right") - left
    count = np.bincount(seg, n, len(segs))
    few = np.argsort(count, kind="stable")
    large = np.zeros(len(segs), bool)
    large[few] = (np.cumsum(count[few]) > CELLS) & (count[few] > 0)
    some = (n > 0) & ~large[seg]
    i, seg, left, n = i[some], seg[some], left[some], n[some]
    ends: list[list[np.ndarray]] = [[], []]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(i)]):
        u, s, v = np.repeat(i[lo:hi], n[lo:hi]), np.repeat(seg[lo:hi], n[lo:hi]), _places(left[lo:hi], n[lo:hi])
        same = seg_b[v] == s
        v = j[v]
        for t in range(k):  # names of different k-grams may be the same
            same &= x[u + t] == y[v + t]
        u, s, v = u[same], s[same], v[same]
        a0, a1, b0, b1 = segs[s].T
        first = (u == a0) | (v == b0) | (x[u - 1] != y[v - 1])
        last = (u + k == a1) | (v + k == b1) | (x[np.minimum(u + k, len(x) - 1)] != y[np.minimum(v + k, len(y) - 1)])
        for out, at in zip(ends, (first, last)):
            out.append(np.stack([s[at], u[at] - v[at], u[at]]))
    starts, stops = (np.concatenate(e, axis=1) for e in ends)
    starts, stops = (e[:, np.lexsort(e[::-1])] for e in (starts, stops))
    return np.stack([starts[0], starts[2], stops[2] + k, starts[1]]), large


def _longest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """The longest runs of two sequences that become anchors one after the other.

    Their length is found by names of grams of doubled length; pairs of places are not listed, so memory goes with the sum of both sides.
    """

    def named(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, nth = np.unique(np.concatenate([u, v]), return_inverse=True)
        has = np.zeros((2, len(names)), bool)
        has[0, nth[: len(u)]] = has[1, nth[len(u) :]] = True
        return nth[: len(u)], nth[len(u) :], has[0] & has[1]

    def grams(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of n items of each side, and which both sides have; a gram is told by its first and last k items."""
        return named(*(z[: max(len(z) - n + k, 0)] * (len(x) + len(y)) + z[n - k :] for z in (u, v)))

    k, most = 1, min(len(x), len(y)) + 1
    u, v, shared = named(x, y)
    if not shared.any():
        return []
    while 2 * k < most:
        longer = grams(2 * k)
        if not longer[2].any():
            most = 2 * k
            break
        u, v, shared = longer
        k *= 2
    n = k
    while most - n > 1:
        mid = (n + most) // 2
        n, most = (mid, most) if grams(mid)[2].any() else (n, mid)
    names, names_b, shared = grams(n)
    places = np.argsort(names_b, kind="stable").tolist()
    ends = np.cumsum(np.bincount(names_b, minlength=len(shared)))
    some = np.flatnonzero(shared[names])
    last = ends[names[some]].tolist()
    first = np.append(0, ends)[names[some]].tolist()
    out, i0, j0 = [], 0, 0
    for i, lo, hi in zip(some.tolist(), first, last):
        if i >= i0 and (at := bisect_left(places, j0, lo, hi)) < hi:
            out.append((i, places[at], n))
            i0, j0 = i + n, places[at] + n
    return out


def _in_place(x: np.ndarray, y: np.ndarray, segs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j, n) of the anchors of segments where items were replaced in place by others, and the segments that are left to be looked at.

    Where both sides have the same length and no item of a that was replaced is anywhere in b, a run of equal items holds none that was replaced, so it
    also is in b at its own place. Thus the longest stretch between replaced ones is an anchor, and what is before and after it is such a segment again. Only b may have that
    stretch still earlier, and only where it has an item that others were replaced by; this is looked up.
    """
    size = segs[:, 1] - segs[:, 0]
    even = size == segs[:, 3] - segs[:, 2]
    mine, size = segs[even], size[even]
    nth = np.repeat(np.arange(len(mine)), size)
    at = _places(mine[:, 0], size)
    a, b = x[at].astype(np.int64), y[_places(mine[:, 2], size)].astype(np.int64)
    off = a != b
    width = int(max(a.max(initial=0), b.max(initial=0))) + 1

    def also(items: np.ndarray, replaced: np.ndarray) -> np.ndarray:
        """Which items are one of the replaced ones of their segment."""
        names = np.unique(nth[off] * width + replaced[off])
        keys = nth * width + items
        return names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys if len(names) else np.zeros(len(keys), bool)

    fit = np.ones(len(mine), bool)
    fit[nth[also(b, a)]] = False
    head = np.flatnonzero(~off & fit[nth] & ((np.diff(nth, prepend=-1) != 0) | np.append(True, off[:-1])))
    end = np.flatnonzero(~off & fit[nth] & ((np.diff(nth, append=-1) != 0) | np.append(off[1:], True))) + 1
    asked = np.unique(np.searchsorted(head, np.flatnonzero(~off & fit[nth] & also(a, b)), "right") - 1)
    first = np.cumsum(size) - size
    left = []  # squares of stretches that b has earlier, as places of a and b
    for seg, some in zip(*_split(asked, nth[head[asked]])):
        lo, hi = np.searchsorted(head, [first[seg], first[seg] + size[seg]])
        square = _squares(head[lo:hi].tolist(), end[lo:hi].tolist(), int(first[seg]), int(first[seg] + size[seg]))
        for t in some.tolist():
            if _earlier(b, *square[t - lo], int(head[t]), int(end[t])):
                left.append(square[t - lo])
    keep = np.ones(len(head), bool)
    more = []
    for lo, hi in sorted(left, key=lambda z: (z[0], -z[1])):
        if not more or lo >= more[-1][1]:  # of squares inside of each other the outermost
            more.append((lo, hi))
            keep[slice(*np.searchsorted(head, [lo, hi]))] = False
    head, end = head[keep], end[keep]
    to_b = mine[:, 2] - mine[:, 0]
    found = np.stack([at[head], at[head] + to_b[nth[head]], end - head], axis=1)
    lo, hi = np.array(more, np.int64).reshape(-1, 2).T
    a0 = at[lo]
    b0 = a0 + to_b[nth[lo]]
    return found, np.concatenate([segs[~even], mine[~fit], np.stack([a0, a0 + hi - lo, b0, b0 + hi - lo], axis=1)])


def _split(values: np.ndarray, keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The values of each of some ascending keys."""
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads].tolist(), np.split(values, heads[1:]) if len(heads) else []


def _squares(head: list[int], end: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """For each stretch what is left of its segment when it is the longest: from the last one before it that is as long to the next one that is longer."""
    lows, highs, stack = [], [last] * len(head), []
    for t, (lo, hi) in enumerate(zip(head, end)):
        while stack and end[stack[-1]] - head[stack[-1]] < hi - lo:
            highs[stack.pop()] = lo
        lows.append(end[stack[-1]] if stack else first)
        stack.append(t)
    return list(zip(lows, highs))


def _earlier(b: np.ndarray, low: int, high: int, head: int, end: int) -> bool:
    """Whether b[low:high] has b[head:end] at a place before head."""
    text, part, wide = b[low : end - 1].tobytes(), b[head:end].tobytes(), b.itemsize
    at = text.find(part)
    while at >= 0 and at % wide:
        at = text.find(part, at + 1)
    return at >= 0


def _chains(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, segs: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(seg, i, j, n): the longest runs of segments that become anchors one after the other, by place; all segments have runs, which stand by segment.

    The first of each is there; those after it may be left to be found among the runs that are left.
    """
    heads = np.flatnonzero(np.diff(s, prepend=-1))
    n = hi - lo
    most = np.maximum.reduceat(n, heads)
    best = np.flatnonzero(n == most[s])
    to = lo[best] - d[best]
    final = np.maximum.reduceat(to, np.flatnonzero(np.diff(s[best], prepend=-1)))
    key = np.sort(lo[best] * width + to)  # by place in a, then in b; segments lie one after the other in a
    seg = np.arange(len(segs))
    i, j = segs[:, 0], segs[:, 2]
    out = []
    for _ in range(4 + len(s) // 1024):  # many steps of a few segments cost more than another look at all runs
        at = np.searchsorted(key, i * width + j)
        some = (at < len(key)) & (j <= final[seg])
        seg, at, j = seg[some], at[some], j[some]
        i, found = np.divmod(key[at], width)
        some = i < segs[seg, 1]
        seg, i, j, found = seg[some], i[some], j[some], found[some]
        fits = found >= j
        out.append(np.stack([seg[fits], i[fits], found[fits], most[seg[fits]]]))
        step = np.where(fits, most[seg], 0)  # else the next place in a is looked at, from the same place in b
        i, j = i + step, np.where(fits, found, j) + step
        if not len(seg):
            break
    seg, i, j, n = np.concatenate(out, axis=1)
    order = np.argsort(i)
    return seg[order], i[order], j[order], n[order]


def _parts(segs: np.ndarray, seg: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What is left of segments before, between and after their anchors; a segment with m anchors has m + 1 parts."""
    count = np.bincount(seg, minlength=len(segs))
    last = np.arange(len(segs)) + np.cumsum(count)
    before = seg + np.arange(len(seg))
    out = np.empty((len(segs) + len(seg), 4), np.int64)
    out[last - count, 0], out[last - count, 2], out[last, 1], out[last, 3] = segs.T[[0, 2, 1, 3]]
    out[before, 1], out[before, 3], out[before + 1, 0], out[before + 1, 2] = i, j, i + n, j + n
    return out


def anchors(x: np.ndarray, y: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """(pair, i, j, n): the anchors of pairs of sequences, by pair and in order; x and y hold all sequences of a side one after the other.

    Anchors of at least k items come from the runs of at least k, found as equal k-grams; what then is left between them is looked at with a smaller k.
    """
    begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    segs = np.stack([begin_a, begin_a + size_a, begin_b, begin_b + size_b], axis=1)
    found = [np.zeros((0, 3), np.int64)]
    for k in GRAMS:
        segs, rest = _worth(segs, k)
        if len(segs):
            got, segs = _in_place(x, y, segs)
            found.append(got)
        while len(segs):
            segs = segs[np.argsort(segs[:, 0])]
            (s, lo, hi, d), large = _matches(x, y, segs, k)
            longest = [(q, a0 + i, b0 + j, n) for q, (a0, a1, b0, b1) in enumerate(segs[large].tolist()) for i, j, n in _longest(x[a0:a1], y[b0:b1])]
            seg, i, j, n = np.array(longest, np.int64).reshape(-1, 4).T
            found.append(np.stack([i, j, n], axis=1))
            mine, seg = np.unique(seg, return_inverse=True)
            again, short = _worth(_parts(segs[large][mine], seg, i, j, n), k)
            rest.extend(short)
            open_ = ~large
            while len(s):
                mine, s = np.unique(s, return_inverse=True)  # segments that have runs
                open_[mine] = False
                rest.append(segs[open_])
                segs = segs[mine]
                seg, i, j, n = _chains(s, lo, hi, d, segs, len(y) + 1)
                found.append(np.stack([i, j, n], axis=1))
                segs = _parts(segs, seg, i, j, n)
                s = s + np.searchsorted(i, lo, "right")  # no run is longer than its segment's anchors, so it reaches into one part at most
                a0, a1, b0, b1 = segs[s].T
                lo, hi = np.maximum(lo, np.maximum(a0, b0 + d)), np.minimum(hi, np.minimum(a1, b1 + d))
                open_ = np.ones(len(segs), bool)
                some = np.flatnonzero(hi - lo >= k)
                some = some[np.argsort(s[some], kind="stable")]
                s, lo, hi, d = s[some], lo[some], hi[some], d[some]
            rest.append(segs[open_])
            segs = again
        segs = np.concatenate(rest)
    i, j, n = np.concatenate(found).T
    order = np.argsort(i)
    i, j, n = i[order], j[order], n[order]
    pair = np.searchsorted(begin_a + size_a, i, "right")
    return np.stack([pair, i - begin_a[pair], j - begin_b[pair], n])


def _worth(segs: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segments in which runs of k are worth looking for, and the shorter ones."""
    fit = np.minimum(segs[:, 1] - segs[:, 0], segs[:, 3] - segs[:, 2])
    return segs[fit >= k * k], [segs[(fit > 0) & (fit < k * k)]]


def many_steps(x: np.ndarray, y: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, tag, i1, i2, j1, j2): the steps of pairs of sequences as arrays, tags as places in TAGS; anchors without anything between them are one stretch."""
    pair, i, j, n = anchors(x, y, size_a, size_b)
    every = np.arange(len(size_a))
    pair, i, j, n = np.concatenate([pair, every]), np.concatenate([i, size_a]), np.concatenate([j, size_b]), np.concatenate([n, np.zeros_like(every)])
    order = np.argsort(pair, kind="stable")  # the end of both as an empty anchor after the others
    pair, i, j, n = pair[order], i[order], j[order], n[order]
    new = np.diff(pair, prepend=-1) != 0
    u, v = (np.where(new, 0, np.roll(z + n, 1)) for z in (i, j))  # what is before an anchor begins here
    gap = np.where(u == i, np.where(v == j, -1, 3), np.where(v == j, 2, 1))
    out = np.stack([np.stack([pair, gap, u, i, v, j]), np.stack([pair, np.where(n > 0, 0, -1), i, i + n, j, j + n])], axis=2).reshape(6, -1)
    out = out[:, out[1] >= 0]
    head = np.flatnonzero((np.diff(out[0], prepend=-1) != 0) | (out[1] != 0) | (np.roll(out[1], 1) != 0))
    last = np.append(head[1:], out.shape[1])[: len(head)] - 1
    return out[0, head], out[1, head], out[2, head], out[3, last], out[4, head], out[5, last]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def text_steps(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """The steps of the characters of two texts."""
    (x, n), (y, m) = _codes([a]), _codes([b])
    _, tags, *places = many_steps(x, y, n, m)
    return list(zip((TAGS[t] for t in tags), *(p.tolist() for p in places)))


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Pairs of sequences in groups of about PAIRS items."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1
    yield from (slice(int(lo), int(hi)) for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]) if hi > lo)


def _changes(a: list[str], b: list[str]) -> np.ndarray:
    """(matched, added, removed, changed) characters of each pair of texts."""
    out = np.zeros((4, len(a)), np.int64)
    for part in _groups(np.array([len(u) + len(v) for u, v in zip(a, b)], np.int64)):
        (x, n), (y, m) = _codes(a[part]), _codes(b[part])
        pair, tag, i1, i2, j1, j2 = many_steps(x, y, n, m)
        for row, (t, chars) in enumerate(((0, i2 - i1), (3, j2 - j1), (2, i2 - i1), (1, np.maximum(i2 - i1, j2 - j1)))):
            out[row, part] = np.bincount(pair[tag == t], chars[tag == t], len(n))
    return out


def _met(a: DataFrame, b: DataFrame, key: str, at: str, item: str, *facts: str) -> DataFrame:
    """(key, _s): the items of both sequences of each key, with facts of theirs."""
    sides = [df.select(key, F.struct(F.lit(side).alias("side"), F.col(at).cast("long").alias("at"), F.col(item).alias("item"), *facts).alias("_s")) for side, df in ((False, a), (True, b))]
    return sides[0].unionByName(sides[1]).groupBy(key).agg(F.collect_list("_s").alias("_s"))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(keys, a, b) for groups of rows of _met; a and b: numbers of the items one after the other, how many each key has, and their facts."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        for part in _groups(sizes):
            rows = batch.slice(part.start, part.stop - part.start)
            side, at, items, *facts = rows.column(1).flatten().flatten()
            side, at = (z.to_numpy(zero_copy_only=False).astype(np.int64) for z in (side, at))
            items = items.dictionary_encode().indices.to_numpy()
            nth = np.repeat(np.arange(rows.num_rows), sizes[part])
            sequences = []
            for one in (0, 1):
                mine = np.flatnonzero(side == one)
                mine = mine[np.lexsort((at[mine], nth[mine]))]
                sequences.append((items[mine], np.bincount(nth[mine], minlength=rows.num_rows), [z.take(pa.array(mine)) for z in facts]))
            yield rows.column(0), *sequences


def opcodes(a: DataFrame, b: DataFrame, key: str, at: str = "at", item: str = "item") -> DataFrame:
    """(key, tag, i1, i2, j1, j2) for each pair of sequences; a: (key, at, item), at counts from 0 without gaps.

    A key that only one side has is all deleted or inserted. Keys and items are not null; items are short, as those of a pair of sequences
    meet in one row. No rows give no rows.
    """
    kind = a.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (x, n, _), (y, m, _) in _sequences(batches):
            pair, tag, *places = many_steps(x, y, n, m)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pair)), _tags(tag, TAGS), *map(pa.array, places)], [key, "tag", "i1", "i2", "j1", "j2"])

    return _met(a, b, key, at, item).mapInArrow(run, f"`{key}` {kind}, tag string, i1 long, i2 long, j1 long, j2 long")


def _tags(tag: np.ndarray, names: tuple[str, ...]) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(tag.astype(np.int8)), pa.array(names)).cast(pa.string())


def paired(codes: DataFrame) -> DataFrame:
    """codes with a row for each place: tag, a_at, b_at (null on the side that has none), nth of its pair of sequences.

    Replaced stretches are paired place by place; what the longer one has left over is deleted or inserted.
    """
    n_a, n_b = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    each = codes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n_a, n_b) - 1)))
    a_at, b_at = (F.when(F.col("k") < n, F.col(first) + F.col("k")) for n, first in ((n_a, "i1"), (n_b, "j1")))
    tag = F.when(F.col("tag") == "equal", "equal").when(b_at.isNull(), "delete").when(a_at.isNull(), "insert").otherwise("change")
    keys = [c for c in codes.columns if c not in ("tag", "i1", "i2", "j1", "j2")]
    # i1 + j1 + k ascends with the steps, and no two places of a pair of sequences have the same
    return each.select(*keys, tag.alias("tag"), a_at.alias("a_at"), b_at.alias("b_at"), (F.col("i1") + F.col("j1") + F.col("k")).alias("nth"))


def _digest(text: Column) -> Column:
    """What stands for a page or a line in an alignment: its SHA-256, so that texts themselves are not shuffled for it."""
    return F.unhex(F.sha2(text, 256))


def page_pairs(a: DataFrame, b: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """(key, a_page, b_page, tag): the pages of two versions of each document, paired; an inserted page leaves all others paired.

    Pages count from 0 without gaps; null texts are empty pages.
    """
    pages = [df.select(key, F.col(page).cast("long").alias("at"), _digest(F.coalesce(F.col(text), F.lit(""))).alias("item")) for df in (a, b)]
    return paired(opcodes(*pages, key)).select(key, F.col("a_at").alias("a_page"), F.col("b_at").alias("b_page"), "tag")


def _lines(text: Column) -> Column:
    return F.transform(T.split_lines(F.coalesce(text, F.lit(""))), lambda x: F.rtrim(x, F.lit(BLANKS)))


_LINE = [("tag", "string"), *((c, "long") for c in ("a_line", "b_line", "matched", "chars_added", "chars_removed", "chars_changed"))]


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The items of lists one after the other, and how many each has; null lists have none."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


#: What became of a place, by number.
PLACES = ("equal", "change", "delete", "insert")


def _each_place(pair: np.ndarray, tag: np.ndarray, i1: np.ndarray, i2: np.ndarray, j1: np.ndarray, j2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, place in PLACES, at_a, at_b, has_a, has_b) for each place of steps; replaced stretches are paired place by place."""
    k = np.maximum(i2 - i1, j2 - j1)
    pair, tag, at_a, at_b, end_a, end_b = (np.repeat(z, k) for z in (pair, tag, i1, j1, i2, j2))
    nth = _places(np.zeros_like(k), k)
    at_a, at_b = at_a + nth, at_b + nth
    has_a, has_b = at_a < end_a, at_b < end_b
    return pair, np.where(tag == 0, 0, np.where(~has_b, 2, np.where(~has_a, 3, 1))), at_a, at_b, has_a, has_b


@F.arrow_udf(ArrayType(reduce(lambda t, f: t.add(*f), _LINE, StructType())))
def _line_steps(a: pa.Array, b: pa.Array) -> pa.Array:
    """What became of each line of pairs of lists of lines."""
    parts = [pa.array([], pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in _LINE])))]
    for part in _groups(sum(_flat(x)[1] for x in (a, b))):
        (lines_a, n), (lines_b, m) = (_flat(x.slice(part.start, part.stop - part.start)) for x in (a, b))
        items = pa.concat_arrays([lines_a, lines_b]).dictionary_encode().indices.to_numpy()
        pair, tag, at_a, at_b, has_a, has_b = _each_place(*many_steps(items[: len(lines_a)], items[len(lines_a) :], n, m))
        u, v = at_a + (np.cumsum(n) - n)[pair], at_b + (np.cumsum(m) - m)[pair]
        chars = np.zeros((4, len(tag)), np.int64)
        both = tag == 1
        chars[:, both] = _changes(lines_a.take(pa.array(u[both])).to_pylist(), lines_b.take(pa.array(v[both])).to_pylist())
        for row, lines, at, t in ((1, lines_b, v, 3), (2, lines_a, u, 2)):
            chars[row, tag == t] = pc.utf8_length(lines.take(pa.array(at[tag == t]))).to_numpy(zero_copy_only=False)
        cols = [_tags(tag, PLACES), pa.array(at_a, mask=~has_a), pa.array(at_b, mask=~has_b), pa.array(chars[0], mask=~both), *map(pa.array, chars[1:])]
        ends = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=len(n)))])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(parts[0].type.value_type))))
    return pa.concat_arrays(parts)


def compared_lines(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, tag, a_line, b_line, a, b, matched, chars_added, chars_removed, chars_changed) of each line of two texts.

    pairs has a row for each key. Lines stand without white space at their end. matched: characters that the lines have in common (null unless they
    were changed); a changed line counts the characters of the steps inside it, one that is on one side only all of its.
    """
    lists = pairs.select(key, _lines(F.col(a)).alias("_a"), _lines(F.col(b)).alias("_b"))
    each = lists.withColumn("_s", F.explode(_line_steps("_a", "_b")))
    line = lambda side: F.get(f"_{side}", F.col(f"_s.{side}_line").cast("int")).alias(side)
    return each.select(key, "_s.tag", "_s.a_line", "_s.b_line", line("a"), line("b"), "_s.matched", "_s.chars_added", "_s.chars_removed", "_s.chars_changed")


def document_totals(a: DataFrame, b: DataFrame, key: str, page: str = "page", text: str = "text") -> DataFrame:
    """(key, a_page, b_page, added, removed, changed, chars_added, chars_removed, chars_changed, chars_a, chars_b) of each pair of pages.

    A page that only one side has is all added or removed, line by line. Pages meet by their digests, with which go their numbers of lines and characters; texts are
    only brought to pairs of changed pages.
    """
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    pages = []
    for df in (a, b):
        each = df.select(key, F.col(page).alias("at"), _digest(F.coalesce(F.col(text), F.lit(""))).alias("item"), _lines(F.col(text)).alias("_l"))
        pages.append(each.select(key, "at", "item", F.size("_l").cast("long").alias("lines"), size(F.col("_l")).alias("chars")))
    kind = a.schema[key].dataType.simpleString()
    numbers = ("a_page", "b_page", "_n_a", "chars_a", "_n_b", "chars_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (x, n, facts_a), (y, m, facts_b) in _sequences(batches):
            pair, tag, at_a, at_b, has_a, has_b = _each_place(*many_steps(x, y, n, m))
            cols = [keys.take(pa.array(pair)), _tags(tag, PLACES), pa.array(at_a, mask=~has_a), pa.array(at_b, mask=~has_b)]
            for at, has, count, facts in ((at_a, has_a, n, facts_a), (at_b, has_b, m, facts_b)):
                place = pa.array(at + (np.cumsum(count) - count)[pair], mask=~has)
                cols += [z.take(place) for z in facts]
            yield pa.RecordBatch.from_arrays(cols, [key, "tag", *numbers])

    found = _met(*pages, key, "at", "item", "lines", "chars").mapInArrow(run, ", ".join([f"`{key}` {kind}", "tag string", *(f"{c} long" for c in numbers)]))
    # only changed pages are looked at line by line
    some = F.col("tag") == "change"
    for side, df in (("a", a), ("b", b)):
        texts = df.select(key, F.col(page).cast("long").alias(f"_{side}_page"), F.col(text).alias(f"_{side}"))
        found = found.withColumn(f"_{side}_page", F.when(some, F.col(f"{side}_page"))).join(texts, [key, f"_{side}_page"], "left")
    steps = found.withColumn("_s", _line_steps(*(F.when(some, _lines(F.col(c))) for c in ("_a", "_b"))))
    of = lambda tag: F.size(F.filter("_s", lambda s: s["tag"] == tag))
    total = lambda c: F.aggregate("_s", F.lit(0).cast("long"), lambda n, s: n + s[c])
    whole = lambda tag, n: F.when(F.col("tag") == tag, F.col(n))
    facts = {
        "added": F.when(some, of("insert")).otherwise(whole("insert", "_n_b")), "removed": F.when(some, of("delete")).otherwise(whole("delete", "_n_a")), "changed": F.when(some, of("change")),
        "chars_added": F.when(some, total("chars_added")).otherwise(whole("insert", "chars_b")), "chars_removed": F.when(some, total("chars_removed")).otherwise(whole("delete", "chars_a")),
        "chars_changed": F.when(some, total("chars_changed")), "chars_a": F.col("chars_a"), "chars_b": F.col("chars_b"),
    }
    return steps.select(key, "a_page", "b_page", *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in facts.items()))
