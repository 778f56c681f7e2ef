"""A quality classifier by co-training of a text view and a page-metadata view.

The text view sees hashed words, word shapes, statistics of the text and which words of a lexicon it has: the LEXICON words
whose share differs most surely between labelled good and bad documents. The metadata view sees nothing of the text: the
source, the language, the host of the url where there is one, and the stored length. A document is good if its label says
so and does not call it toxic. Both views are logistic models, fitted on the driver to a sample of labelled documents
whose size is bounded (LABELLED). In each round both views score all unlabelled documents of the corpus, and each teaches
the other those of which it is most certain (co-training takes over so many a round, a share TEACH of the training labels). Of the
held-out labels one part calibrates each view and weighs the two, another sets the threshold. Every document is scored
on its whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, NumericType, StructField, StructType

from . import common

#: Labelled documents to fit on, about.
LABELLED = 6144
ROUNDS = 3
#: Pseudo-labels that a view gives in a round at most, as a share of the labels to train on, and the certainty that it needs.
TEACH = 0.15
CERTAIN = 0.95
#: Share of held-out good documents that the threshold must keep, and the score under which nothing is kept.
KEEP = 0.995
FLOOR = 0.2
#: Standard errors by which the share of a word of the lexicon differs at least.
SURE = 5.0
WORDS, SHAPES, STATS, LEXICON, NAMES, SIZES = 512, 7 * 4 * 4, 12, 256, 64, 32
TEXT, META = WORDS + SHAPES + 1 + STATS + LEXICON, 3 * NAMES + SIZES + 1
NEW = ("text_score", "meta_score", "score", "kept")

_KIND = np.full(256, 6, np.uint8)  # letters 0, digits 1, full stop 2, comma 3, exclamation mark 4, bar 5, other 6
for _c, _k in ((range(65, 91), 0), (range(97, 123), 0), (range(128, 256), 0), (range(48, 58), 1), ([46], 2), ([44], 3), ([33], 4), ([124], 5)):
    _KIND[list(_c)] = _k
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(texts: list[bytes], sources: list, langs: list, urls: list, sizes: list, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of whole texts, float32."""
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    text = [_of_texts(texts[lo:hi], lexicon) for lo, hi in common.text_chunks(at)]
    return np.concatenate(text) if text else np.zeros((0, TEXT), np.float32), _of_pages(sources, langs, urls, sizes)


def _of_pages(sources: list, langs: list, urls: list, sizes: list) -> np.ndarray:
    n = len(sources)
    meta = np.zeros((n, META), np.float32)
    hosts = [re.sub(r"^[^:]*://|[/?#].*", "", u, flags=re.S).lower() if u else None for u in urls]
    for base, names in enumerate((sources, langs, hosts)):
        place = [int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=4).digest(), "big") % NAMES for x in names]
        meta[np.arange(n), base * NAMES + np.array(place, np.int64)] = 1
    log = np.array([0 if x is None or not x >= 0 else min(SIZES - 1, int(2 * math.log2(x + 1))) for x in sizes], np.int64)
    meta[np.arange(n), 3 * NAMES + log] = 1
    meta[:, -1] = 1
    return meta


def _of_texts(texts: list[bytes], lexicon: np.ndarray) -> np.ndarray:
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    s, e, h = common.word_hashes(data)
    owner = np.searchsorted(begin, s, side="right") - 1
    upper = np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int32)))
    capitals, length = upper[e] - upper[s], e - s
    case = np.where(capitals == 0, 0, np.where((capitals == 1) & _UPPER[data[s]], 1, np.where(capitals * 2 > length, 2, 3)))
    shape = (_KIND[data[e - 1]].astype(np.int64) * 4 + case) * 4 + np.digitize(length, (2, 4, 8))
    repeat = np.zeros(len(s), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)[:, None]
    wide = WORDS + SHAPES + 1
    count = np.bincount(owner * wide + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * wide) + np.bincount(owner * wide + WORDS + shape, minlength=n * wide) + np.bincount(owner[repeat] * wide + wide - 1, minlength=n * wide)
    text = np.empty((n, TEXT), np.float32)
    text[:, :wide] = np.sqrt(count.reshape(n, wide) / some)
    kinds = np.zeros((n, 7))
    for k in range(7):
        kinds[:, k] = np.add.reduceat(_KIND[data] == k, begin, dtype=np.int64)
    kinds[:, 6] -= np.add.reduceat(common._SPACE[data], begin, dtype=np.int64)
    caps = np.add.reduceat(_UPPER[data], begin, dtype=np.int64)
    lines = np.add.reduceat(data == 10, begin, dtype=np.int64)
    order = np.lexsort((h, owner))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    distinct = np.bincount(owner[order[new]], minlength=n)
    seen = np.maximum(size, 1)
    stats = (np.log1p(size) / 8, np.log1p(words) / 8, np.log1p(lines) / 4, np.log1p(size / np.maximum(lines, 1)) / 6, *(np.sqrt(kinds[:, k] / seen) for k in (1, 2, 4, 5, 6)), np.sqrt(caps / seen), distinct / np.maximum(words, 1), np.ones(n))
    for i, x in enumerate(stats):
        text[:, wide + i] = x
    text[:, wide + STATS :] = 0
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        hit = lexicon[at] == h
        text[owner[hit], wide + STATS + at[hit]] = 0.5
    return text


@dataclass
class Model:
    """A logistic model and its calibration: the calibrated log-odds are slope * (x @ weights) + offset."""

    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64) + self.offset


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 200, ridge: float = 1e-4) -> Model:
    """Accelerated gradient descent on the mean log loss."""
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    rate = 4 / (float(np.einsum("ij,ij->i", x, x).max(initial=0)) + 1)
    ahead, last = w.copy(), w
    for i in range(steps):
        wrong = (_sigmoid(x @ ahead[:-1] + ahead[-1]) - y).astype(np.float32) / len(y)
        step = np.append(x.T @ wrong, wrong.sum()) + ridge * np.append(ahead[:-1], 0).astype(np.float32)
        w = (ahead - rate * step).astype(np.float32)
        ahead, last = w + np.float32(i / (i + 3)) * (w - last), w
    return Model(w)


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method for a few columns: weights and offset."""
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = _sigmoid(z @ w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class CoTrained:
    text: Model
    meta: Model
    blend: np.ndarray
    threshold: float
    lexicon: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.odds(text), self.meta.odds(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.blend[0] * np.clip(a, -30, 30) + self.blend[1] * np.clip(b, -30, 30) + self.blend[2])


def calibrated(models: list[Model], views: tuple[np.ndarray, np.ndarray], label: np.ndarray, calibrate: np.ndarray, check: np.ndarray, lexicon: np.ndarray) -> CoTrained:
    y = label[calibrate]
    for v, m in zip(views, models):
        m.slope, m.offset = _line(m.odds(v[calibrate])[:, None], y)
    odds = np.column_stack([np.clip(m.odds(v[calibrate]), -30, 30) for v, m in zip(views, models)])
    blend = _line(odds, y)
    for i in np.flatnonzero(blend[:2] < 0)[:1]:  # a view never counts against itself
        own = _line(odds[:, [1 - i]], y)
        blend = np.array([0.0, 0.0, own[1]])
        blend[1 - i] = own[0]
    out = CoTrained(*models, blend, 0.5, lexicon)
    good = check[label[check] == 1]
    if len(good):
        score = np.sort(out.scores(*(v[good] for v in views))[2])
        out.threshold = min(0.5, max(FLOOR, float(score[min(len(score) - 1, math.ceil((1 - KEEP) * len(score)))])))
    return out


#: Columns that the views read, if the documents have them.
READ = ("text", "source", "lang", "url", "n_chars")


def _read(df: DataFrame) -> list[Column]:
    """READ as strings and a number, null where df lacks one or it is of another kind."""
    have = {f.name: f.dataType for f in df.schema.fields}
    kind = lambda c: "double" if c == "n_chars" else "string"
    fits = lambda c: c in have and (c != "n_chars" or isinstance(have[c], NumericType))
    return [(F.col(c).cast(kind(c)) if fits(c) else F.lit(None).cast(kind(c))).alias(f"_{c}") for c in READ]


def _views(b: pa.RecordBatch, first: int, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose columns from first on are those of _read."""
    text, *page = (b.column(first + i).to_pylist() for i in range(len(READ)))
    return features([(t or "").encode() for t in text], *page, lexicon)


def _lexicon(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the LEXICON words of five labelled documents or more whose share differs most surely by label."""
    rows = docs.join(F.broadcast(sample.select(F.col("doc_id").alias("_id"), "label")), F.col("doc_id") == F.col("_id")).select("label", F.coalesce("text", F.lit("")).alias("text"))  # about LABELLED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.parts(batches):
            words = [np.unique(common.word_hashes(np.frombuffer(t.encode(), np.uint8))[2]) for t in b.column(1).to_pylist()]
            n = [len(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n), pa.int32()), pa.array(np.concatenate(words).view(np.int64))], ["label", "word"])

    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    counts = rows.mapInArrow(run, "label int, word long").groupBy("word").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    good, bad, all_ = max(1, n.get(1, 0)), max(1, n.get(0, 0)), sum(n.values())
    p = F.col("n") / all_
    z = F.abs(F.col("good") / good - (F.col("n") - F.col("good")) / bad) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / good + 1 / bad))
    return np.sort(np.array([r[0] for r in counts.filter(z >= SURE).orderBy(z.desc(), "word").limit(LEXICON).select("word").collect()], np.int64).view(np.uint64))


def _vectors(rows: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """(doc_id, t, m): both views of each row, as half-size floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.parts(batches):
            views = ([x.tobytes() for x in v.astype(np.float16)] for v in _views(b, 1, lexicon))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.binary()) for v in views)], ["doc_id", "t", "m"])

    return rows.mapInArrow(run, "doc_id long, t binary, m binary")


def _halves(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch of _vectors."""
    return tuple(np.frombuffer(b"".join(b.column(i).to_pylist()), np.float16).reshape(b.num_rows, -1).astype(np.float32) for i in (1, 2))


def _collected(vectors: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ids, text view, metadata view) of a bounded number of documents, whose ids are distinct."""
    got = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # LABELLED, or what a round teaches
    text, meta = np.empty((len(got), TEXT), np.float32), np.empty((len(got), META), np.float32)
    for i, r in enumerate(got):
        text[i], meta[i] = np.frombuffer(r[1], np.float16), np.frombuffer(r[2], np.float16)
    return [r[0] for r in got], text, meta


def _labelled(docs: DataFrame, ids: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """_vectors of the documents with a bounded list of ids, one text of each id."""
    rows = docs.join(F.broadcast(ids.select(F.col("doc_id").alias("_id")).distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    rows = rows.select("doc_id", F.struct(*_read(rows)).alias("r")).groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.*")
    return _vectors(rows, lexicon)


def _surest(vectors: DataFrame, marks: DataFrame, models: list[Model], most: float, share: float, taught: list[set[int]]) -> list[tuple[int, int, int]]:
    """(view, doc_id, label): of all unlabelled documents those that each view is most certain of, `most` of a view.

    All of them are scored in tasks; four top-k reports of numbers come to the driver.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(models)  # two weight vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.parts(batches):
            odds = (m.odds(v) for m, v in zip(sent.value, _halves(b)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in odds)], ["doc_id", "o0", "o1"])

    scored = vectors.mapInArrow(run, "doc_id long, o0 double, o1 double")
    free = common.materialise(scored.join(marks.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("o0").alias("o0"), F.min("o1").alias("o1")), "odds")
    sure, out = math.log(CERTAIN / (1 - CERTAIN)), []
    spark = vectors.sparkSession
    for view in (0, 1):
        known = spark.createDataFrame([(x,) for x in taught[1 - view]], "doc_id long")
        new = free.join(F.broadcast(known), "doc_id", "left_anti")  # ROUNDS x TEACH x LABELLED ids at most
        for label in (0, 1):
            odds = F.col(f"o{view}") * (1 if label else -1)
            top = new.filter(odds >= sure).orderBy(odds.desc(), F.xxhash64("doc_id"), "doc_id").limit(max(1, round(most * (share if label else 1 - share))))
            out += [(view, r[0], label) for r in top.select("doc_id").collect()]
    common.drop_scratch(free)
    return out


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """The two views, co-trained; None if the labelled sample lacks either class."""
    bad = F.coalesce(F.col("toxic").cast("int"), F.lit(0)) > 0 if "toxic" in labels.columns else F.lit(False)
    good = F.when(bad, 0).otherwise((F.col("quality").cast("int") > 0).cast("int"))
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("label"))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    share = min(1.0, LABELLED / max(1, marks.count()))
    sample = marks.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))  # about LABELLED labels
    label_of = {r[0]: r[1] for r in sample.collect()}
    # words are chosen by labels that neither calibrate nor set the threshold
    fifth = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5))
    lexicon = _lexicon(docs, sample.filter(fifth > 1))
    ids, text, meta = _collected(_labelled(docs, sample, lexicon))
    rest = {r[0]: r[1] for r in sample.select("doc_id", fifth).collect()}
    label, views = np.array([label_of[i] for i in ids], np.int64), (text, meta)
    parts = [np.flatnonzero(np.isin([rest[i] for i in ids], x)) for x in ([2, 3, 4], [0], [1])]  # train, calibrate, set the threshold
    if any(len(np.unique(label[x])) < 2 for x in parts[:2]):
        return None
    own = parts[0]
    # texts are read once for all rounds
    vectors = common.materialise(_vectors(docs.filter("doc_id is not null").select("doc_id", *_read(docs)), lexicon), "views")
    models = [fit(v[own], label[own]) for v in views]
    taught: list[set[int]] = [set(), set()]
    more: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for _ in range(ROUNDS):
        for v, m in zip(views, models):  # a view's certainty is that of its calibrated odds
            m.slope, m.offset = _line(m.odds(v[parts[1]])[:, None], label[parts[1]])
        new = _surest(vectors, marks, models, TEACH * len(own), float(label[own].mean()), taught)
        if not new:
            break
        told = docs.sparkSession.createDataFrame([(d,) for d in {d for _, d, _ in new}], "doc_id long")
        one = vectors.join(F.broadcast(told), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("t", "m")).alias("v"))
        got, t, m = _collected(one.select("doc_id", "v.*"))
        place = {d: i for i, d in enumerate(got)}
        for view in (0, 1):
            lesson = [(place[d], y) for v, d, y in new if v == view]
            rows = np.array([i for i, _ in lesson], np.int64)
            more[1 - view].append(((t, m)[1 - view][rows], np.array([y for _, y in lesson], np.int64)))
            taught[1 - view].update(d for v, d, _ in new if v == view)
        for i in (0, 1):
            x, y = np.concatenate([views[i][own], *(a for a, _ in more[i])]), np.concatenate([label[own], *(b for _, b in more[i])])
            models[i] = fit(x, y, models[i].weights, 100)
    common.drop_scratch(vectors)
    return calibrated(models, views, label, *parts[1:], lexicon)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with text_score, meta_score, score (probabilities of good quality) and kept; columns of these names are replaced.

    docs: doc_id, text and, if there are such, source, lang, url and n_chars; labels: doc_id, quality (1 good, 0 bad) and,
    if there is one, toxic (1: not good). A document with several labels has the lowest, one with several texts the first
    in their order. Null and empty texts are scored as texts without words; repeated rows get equal scores; rows without
    doc_id are scored, but teach nothing; an empty table gives no rows. If the labels lack either class, scores are null
    and everything is kept.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.drop(*NEW)
    model = train(rows, labels)
    if model is None:
        return rows.select("*", *(F.lit(None).cast("double").alias(c) for c in NEW[:3]), F.lit(True).alias(NEW[3]))
    n = len(rows.columns)
    schema = StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in NEW[:3]), StructField(NEW[3], BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in common.parts(batches):
            found = m.scores(*_views(b, n, m.lexicon))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(x, pa.float64()) for x in found), pa.array(found[2] >= m.threshold, pa.bool_())], [*b.schema.names[:n], *NEW])

    return rows.select("*", *_read(rows)).mapInArrow(run, schema)
