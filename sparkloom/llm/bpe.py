"""BPE encoding and decoding with a contiguous rank array per word.

A word is an array of parts and an array of the ranks of adjacent parts. The lowest rank is found by a scan, the
boundary there is deleted (the arrays close up by one) and the two ranks beside it are looked up again, until no
adjacent pair has a rank. Words are short, so the scan beats a heap; many words run side by side as the rows of one
numpy array. Words repeat, so each task keeps the encodings of a bounded number of them.

Text rules are those of a vocabulary file of the tokenizers library with these parts: NFC, runs of white space as one
space, lower case; pieces by the file's pattern; bytes as printable characters; a suffix on a word's last symbol; no
decoder, so that decoding joins the tokens with one space. Added tokens are found in the raw text first. No rule looks
across white space, so a run without it is normalised and cut by itself: letters of LATIN, whose lower case and class
every Unicode version agrees on, here, and anything else by the library's own tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Entries of a task's cache of words; it is emptied when full, which only costs time.
CACHE_WORDS = 250_000
#: Words that are encoded side by side.
ROWS = 20_000
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in seen else next(spare)) for b in range(256)]


class Bpe:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        d = json.loads(spec)
        model, kinds = d["model"], [x["type"] for x in (d["normalizer"] or {}).get("normalizers", [])]
        split = d["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or d.get("decoder"):
            raise ValueError("this vocabulary file has parts that are not supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.names = {i: str(i) for i in self.tokens}
        library = Tokenizer.from_str(spec)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer  # its model goes
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        symbols = byte_symbols()
        self.byte_of = {c: i for i, c in enumerate(symbols)}
        self.first = np.array([self.vocab.get(s, -1) for s in symbols], np.int32)
        self.last = np.array([self.vocab.get(s + self.suffix, -1) for s in symbols], np.int32)
        self.cache: dict[str, tuple] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of adjacent parts; NONE where the vocabulary has no merge or a part is missing (-1)."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (not empty); -1 where a byte has no symbol."""
        out: list[list[int]] = [[]] * len(words)
        by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(by_length):
            hi = lo + 1
            while hi < len(by_length) and hi - lo < ROWS and (hi - lo) * len(words[by_length[hi]]) < 40 * ROWS:
                hi += 1
            self._side_by_side([words[i] for i in by_length[lo:hi]], by_length[lo:hi], out)
            lo = hi
        return out

    def _side_by_side(self, words: list[bytes], names: list[int], out: list[list[int]]) -> None:
        size = np.array([len(w) for w in words])
        width = int(size.max())
        part = np.full((len(words), width), -1, np.int32)
        inside = np.arange(width) < size[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        part[inside] = self.first[raw]
        part[np.arange(len(words)), size - 1] = self.last[raw[np.cumsum(size) - 1]]
        rank = self.ranks(part[:, :-1], part[:, 1:]) if width > 1 else np.zeros((len(words), 0), np.int32)
        live = np.arange(len(words))
        while rank.shape[1] and len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                ended = live[done]
                for i, ids, n in zip(ended.tolist(), part[done].tolist(), size[ended].tolist()):
                    out[names[i]] = ids[:n]
                go = ~done
                live, part, rank, at, best = live[go], part[go], rank[go], at[go], best[go]
                if not len(live):
                    return
                width = int(size[live].max())
                part, rank = part[:, :width], rank[:, : width - 1]
            row = np.arange(len(live))
            part[row, at] = self.merged[best]
            # delete the boundary: all that stands right of it moves one to the left
            n = part.shape[1]
            shift = np.arange(n - 1) > at[:, None]
            part[:, :-1] = np.where(shift, part[:, 1:], part[:, :-1])
            part[:, -1] = -1
            if n > 2:
                rank[:, :-1] = np.where(shift[:, : n - 2] | (np.arange(n - 2) == at[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            size[live] -= 1
            # refresh the two neighbours
            left = at > 0
            rank[row[left], at[left] - 1] = self.ranks(part[row[left], at[left] - 1], part[row[left], at[left]])
            right = at + 1 < size[live]
            rank[row[right], at[right]] = self.ranks(part[row[right], at[right]], part[row[right], at[right] + 1])
            rank[row[~right], np.minimum(at[~right], rank.shape[1] - 1)] = NONE
        for i, ids, n in zip(live.tolist(), part.tolist(), size[live].tolist()):
            out[names[i]] = ids[:n]

    def chunks(self, text: str) -> list[str]:
        """Runs without white space and added tokens, in order of the text."""
        if any(a in text for a in self.added):
            return [x for part in self.special.split(text) for x in ([part] if part in self.added else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        """str.split() also splits at U+001C to U+001F, the library does not. Texts of LATIN are in lower case from here on."""
        if text.isascii() or not BEYOND.search(text):
            low = text.lower()
            text = text if any(a in low for a in self.added) else low  # what only lower case makes an added token is none
        return [x for x in _GAP.split(text) if x] if _ODD.search(text) else text.split()

    def words_of(self, chunk: str) -> list[bytes]:
        """Pieces of a chunk; a run of letters, or one before a full stop or comma, needs no pattern."""
        if LETTERS.fullmatch(chunk):
            return [chunk.encode()]
        if chunk[-1] in ".," and LETTERS.fullmatch(chunk, 0, len(chunk) - 1):
            return [chunk[:-1].encode(), chunk[-1].encode()]
        cut = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in cut]

    def entry(self, ids: list[int]) -> tuple:
        return (len(ids), " ".join([self.names[i] for i in ids]), " ".join([self.tokens[i] for i in ids]))

    def fill(self, new: set[str]) -> None:
        """Puts (number of ids, ids as text, tokens as text) of chunks into the cache."""
        parts = {c: self.words_of(c) for c in new if c not in self.added}
        listed = list({w for ws in parts.values() for w in ws})
        know = {w: self.entry([i for i in ids if i >= 0]) for w, ids in zip(listed, self.encode_words(listed))}
        for c, ws in parts.items():
            es = [know[w] for w in ws]
            self.cache[c] = es[0] if len(es) == 1 else (sum([e[0] for e in es]), " ".join([e[1] for e in es if e[0]]), " ".join([e[2] for e in es if e[0]]))
        for c in new:
            if c in self.added:
                self.cache[c] = self.entry([self.added[c]])

    def encoded(self, texts: list[str]) -> Iterator[list[tuple]]:
        """For each text its chunks' cache entries, chunks without ids left out."""
        lo = 0
        while lo < len(texts):
            got, used = [], 0
            while lo < len(texts) and (not got or used < 1 << 20):
                got.append(self.chunks(texts[lo]))
                used += len(texts[lo])
                lo += 1
            seen = set().union(*got)
            if len(self.cache) + len(seen) > CACHE_WORDS:
                self.cache.clear()
            self.fill(seen.difference(self.cache))
            know = self.cache
            for g in got:
                yield [e for e in map(know.__getitem__, g) if e[0]]

    def encode(self, text: str) -> list[int]:
        return numbers(next(self.encoded([text]))).tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined with one space, added ones included; ids without a token are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def numbers(entries: list[tuple]) -> np.ndarray:
    """Ids of cache entries."""
    return np.array(" ".join([e[1] for e in entries]).split(), np.int32) if entries else np.zeros(0, np.int32)


#: Lower-case letters of the blocks up to Latin Extended-A, and what lies beyond these blocks or has no lower case of one character.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
BEYOND = re.compile("[^\x00-\u017f]|[\u0130\u0149]")
_ODD = re.compile(r"[\x1c-\x1f]")
_GAP = re.compile(r"[^\S\x1c-\x1f]+")
_loaded: dict[str, Bpe] = {}


def _bpe(key: str, spec: str) -> Bpe:
    """The worker's own copy: tables are built once for each Python worker."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def read_spec(path: str) -> str:
    """A vocabulary file's text, read on the driver; tasks get it as a broadcast of a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null and empty texts have no ids; repeated rows are all kept."""

    def rows(bpe: Bpe, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [numbers(entries) for entries in bpe.encoded(b.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _over(common.documents(docs), vocab_path, rows, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids decode to the empty text."""

    def rows(bpe: Bpe, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return _over(coded.select("doc_id", "ids"), vocab_path, rows, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) of every whole text, null and empty ones without ids."""

    def rows(bpe: Bpe, b: pa.RecordBatch) -> pa.RecordBatch:
        coded = [numbers(entries) for entries in bpe.encoded(b.column(1).to_pylist())]
        n = pa.array([len(x) for x in coded], pa.int64())
        decoded = pa.array([bpe.decode(x.tolist()) for x in coded], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), n, pa.array(coded, pa.list_(pa.int32())), decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    return _over(common.documents(docs), vocab_path, rows, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, with digests of both results."""

    def rows(bpe: Bpe, b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = [], [], []
        for entries in bpe.encoded(b.column(1).to_pylist()):
            n.append(sum([e[0] for e in entries]))
            ids.append(hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
            decoded.append(hashlib.sha256(" ".join([e[2] for e in entries]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over(common.documents(docs), vocab_path, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _over(df: DataFrame, vocab_path: str, rows, schema: str) -> DataFrame:
    common.small_batches(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(read_spec(vocab_path))  # the vocabulary file: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocab_path, spec.value)
        for b in common.parts(batches):
            yield rows(bpe, b)

    return df.mapInArrow(run, schema)
