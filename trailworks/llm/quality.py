"""Quality classifier: hashed word n-gram logistic regression with FTRL-proximal updates.

A text becomes words; each word gives its hash and a coarse shape (case, digits, symbols and which
symbol ends it, whether it repeats the word before or one seen shortly before). Unigrams and bigrams
of words and of shapes are hashed into ``DIM`` buckets, each family weighted by its relative
frequency, so long and short texts have the same scale. Training follows the regularised leader on a
bounded sample of labelled rows; scoring is a sparse dot product, vectorised over many texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, ints, mix, pieces, words_of

DIM = 1 << 18
#: Most labelled rows used for training; beyond it the rows with the smallest hashed ids are taken.
MAX_TRAINING_ROWS = 6000
ACCEPT = 0.7

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT[48:58] = 1
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = 1
#: How far back a word counts as repeated, apart from the word just before.
_NEAR = (2, 3, 4)


def _shapes(w: Words, h: np.ndarray) -> np.ndarray:
    upper, letter, digit, symbol = (w.total(t) for t in (_UPPER, _LETTER, _DIGIT, _SYMBOL))
    case = np.where(letter == 0, 0, np.where(upper == 0, 1, np.where((upper == letter) & (letter > 1), 3, 2)))
    last = np.where(symbol > 0, w.raw[np.maximum(w.end - 1, 0)] if len(w.end) else 0, 0)
    last = np.where(_SYMBOL[last] > 0, last, 0)
    size = np.minimum((w.end - w.start) // 8, 7)
    again = np.zeros(len(h), np.int64)
    again[1:] += (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    for k in _NEAR:
        if len(h) > k:
            again[k:] |= 2 * ((h[k:] == h[:-k]) & (w.doc[k:] == w.doc[:-k]))
    shape = ((((case * 3 + np.minimum(digit, 2)) * 4 + np.minimum(symbol, 3)) * 256 + last) * 8 + size) * 4 + again
    return mix(shape.astype(np.uint64) + np.uint64(0x51ED270B))


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed indices and values of the features of a piece; entries of one row may repeat an index."""
    h = w.hashes()
    s = _shapes(w, h)
    same = w.doc[1:] == w.doc[:-1]
    n = np.maximum(w.counts, 1)
    rows, index, value = [w.doc, w.doc], [h, mix(s + np.uint64(1))], [1.0 / n[w.doc], 1.0 / n[w.doc]]
    pair_rows = w.doc[1:][same]
    pairs = 1.0 / np.maximum(n - 1, 1)[pair_rows]
    for x, salt in ((h, 2), (s, 3)):
        rows.append(pair_rows)
        index.append(mix(x[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + x[1:][same] + np.uint64(salt)))
        value.append(pairs)
    return np.concatenate(rows), (np.concatenate(index) & np.uint64(DIM - 1)).astype(np.int64), np.concatenate(value)


@dataclass
class Ftrl:
    """Follow the regularised leader, one adaptive rate per coordinate."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.1
    dim: int = DIM

    def __post_init__(self):
        self.z, self.n = np.zeros(self.dim + 1), np.zeros(self.dim + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example; ``index`` has no repeats. The last coordinate is the bias."""
        index, value = np.append(index, self.dim), np.append(value, 1.0)
        w = self.weights(index)
        g = (_sigmoid(float(w @ value)) - label) * value
        after = self.n[index] + g * g
        self.z[index] += g - (np.sqrt(after) - np.sqrt(self.n[index])) / self.alpha * w
        self.n[index] = after


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out() -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(order, label, text) of at most ``limit`` labelled rows, chosen by the hash of their id.

    The choice is made on ids alone, so only ``limit`` rows meet the texts. A doc_id labelled
    several times uses its largest label row; rows with null labels or ids are not used.
    """
    chosen = (
        labels.where(~held_out() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
        .withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("ord", "label", "text")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS, epochs: int = 3) -> np.ndarray:
    """Weights (DIM + 1 floats, bias last). Without usable labels all weights are 0 (every score 0.5).

    Hashed features are made where the texts are; one task then learns from the bounded sample.
    """
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = words_of(part)
                rows, index, value = features(w)
                key, at = np.unique(rows * DIM + index, return_inverse=True)
                value = np.bincount(at, value, minlength=len(key))
                ends = np.searchsorted(key, np.arange(w.n_docs + 1) * DIM).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array((key % DIM).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32)))], names=["ord", "label", "i", "v"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            order, label = ints(b, "ord"), ints(b, "label")
            rows += [(order[k], int(label[k]), b.column(2)[k].values.to_numpy(), b.column(3)[k].values.to_numpy()) for k in range(b.num_rows)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        model = Ftrl()
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.update(rows[k][2].astype(np.int64), rows[k][3].astype(np.float64), rows[k][1])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["w"])

    made = training_rows(docs, labels, limit).mapInArrow(sparse, "ord long, label int, i array<int>, v array<float>")
    found = made.repartition(1).mapInArrow(learn, "w binary").first()
    return np.frombuffer(found.w, np.float32) if found else np.zeros(DIM + 1, np.float32)


def _scores(part: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    rows, index, value = features(words_of(part))
    return _sigmoid(np.bincount(rows, w[index] * value, minlength=part.num_rows) + w[-1])


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Rows (doc_id, score), one for each row of ``docs``; texts without words have the bias alone."""
    spread = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = spread.value.astype(np.float64)
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(part, w))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS, accept: float = ACCEPT) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Null and empty texts are scored like any text. Only doc_id and quality of ``labels`` are read, only
    doc_id (for the split) and text of ``docs``; further columns are ignored. Equal texts get equal scores.
    """
    return scored(docs, train(docs, labels, limit)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``accept``. Nothing is shuffled."""
    spread = docs.sparkSession.sparkContext.broadcast(train(docs, labels, limit))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = spread.value.astype(np.float64)
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array(_scores(part, w) >= accept))

    return docs.mapInArrow(work, docs.schema)
