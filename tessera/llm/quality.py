"""Quality classifier: a linear SVM on Naive Bayes features.

n-gram indicators (words, word pairs, and 1- to 3-grams of word shapes, hashed) are scaled
by the classes' log-count ratios; a linear hinge-loss model is fitted to them by dual
coordinate descent, and its margin becomes a probability by a logistic fit on rows
that the model didn't see.  The fit uses a bounded sample of labelled rows
(``per_class`` of each label, by hash order); every whole text is scored.

Null or empty texts have no indicator and get the score of the intercept.  With no
labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, cache_of, map_arrow, mix, rolling, slices, starts, use
from .sampling import held_out, labelled_sample

BITS = 18
PER_CLASS = 3000
THRESHOLD = 0.3


class Vocabulary(dict):
    """word -> number; for each number, the hashes of the word and of its shape."""

    LIMIT = 150_000
    _RUNS = re.compile(rb"(.)\1+")
    #: lower case and everything beyond ASCII is 'a', upper case 'A', digits '0', the rest itself
    _SHAPE = bytes(0x61 if b >= 0x80 or 0x61 <= b <= 0x7A else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))

    def __init__(self):
        super().__init__()
        self.word, self.shape = array("Q"), array("Q")

    def __missing__(self, w: bytes) -> int:
        k = self[w] = len(self.word)
        self.word.append(xxhash.xxh3_64_intdigest(w.lower()))
        self.shape.append(xxhash.xxh3_64_intdigest(self._RUNS.sub(rb"\1", w.translate(self._SHAPE)), seed=1))
        return k

    def empty(self) -> None:
        self.clear()
        self.word, self.shape = array("Q"), array("Q")

    def tidy(self) -> None:
        if len(self.word) > self.LIMIT:
            self.empty()


_vocabulary = Vocabulary()
cache_of("quality", _vocabulary.empty)


def indicators(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct n-gram of every text, sorted."""
    v = _vocabulary
    v.tidy()
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    at = starts(n)
    ids = np.fromiter(map(v.__getitem__, chain.from_iterable(words)), np.int64, int(at[-1]))
    row = np.repeat(np.arange(len(texts)), n)
    word, shape = np.array(v.word)[ids], np.array(v.shape)[ids]
    left = np.repeat(at[1:], n) - np.arange(len(ids))  # words from here to the text's end
    keys = []
    for h, sizes, salt in ((word, (1, 2), 0), (shape, (1, 2, 3), 7)):
        for size in sizes:
            r = rolling(h, size, 0x9E3779B97F4A7C15 + 2 * salt) if size > 1 else mix(h)
            ok = left[: len(r)] >= size
            bucket = (r[ok] >> np.uint64(64 - bits)).astype(np.int64)
            keys.append((row[: len(r)][ok] << bits) | bucket)
    k = np.sort(np.concatenate(keys))
    k = k[np.diff(k, prepend=-1) > 0]
    return k >> bits, k & ((1 << bits) - 1)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 20, seed: int = 1) -> np.ndarray:
    """Weights of a linear model under L2 regularisation and hinge loss; y is -1 or 1, the last feature is the intercept."""
    w, a = np.zeros(dim), np.zeros(len(rows))
    q = np.array([max(float(v @ v), 1e-12) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * float(w[r] @ v) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if new != a[i]:
                w[r] += (new - a[i]) * y[i] * v
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_fit(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of P(y = 1 | x), by bounded Newton steps with a prior that keeps the slope near 1."""
    a, b = 1.0, 0.0
    t = (y * (y.sum() + 1) + (1 - y)) / (np.where(y > 0, y.sum(), len(y) - y.sum()) + 2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[s @ (x * x) + 1.0, s @ x], [s @ x, s.sum() + 1e-3]])
        d = np.linalg.solve(h, np.array([g @ x + (a - 1), g.sum()]))
        d = np.clip(d, -1, 1)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass(frozen=True)
class QualityModel:
    scale: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # of the scaled features
    intercept: float
    slope: float
    shift: float
    bits: int = BITS

    def scores(self, texts: list[bytes]) -> np.ndarray:
        row, f = indicators(texts, self.bits)
        s = self.scale[f].astype(np.float64)
        top = np.bincount(row, self.weight[f] * s, len(texts))
        norm = np.sqrt(np.bincount(row, s * s, len(texts)))
        margin = top / np.maximum(norm, 1e-12) * (norm > 0) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, cost: float = 1.0) -> QualityModel:
    """rows: the features of each text; labels: 0 or 1."""
    dim = 1 << bits
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(dim), np.zeros(dim), 0.0, 1.0, 0.0, bits)
    # a quarter of the rows is kept for the probabilities: neither ratios nor weights see it
    fold = np.arange(len(rows)) % 4
    seen = [np.ones(dim), np.ones(dim)]
    for k in np.flatnonzero(fold > 0):
        seen[labels[k]][rows[k]] += 1
    scale = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())

    def values(r):
        s = scale[r]
        return np.append(s / max(np.sqrt(s @ s), 1e-12), 1.0)

    def model(part):
        own = np.flatnonzero(part)
        y = labels[own] * 2.0 - 1
        c = cost * np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1))
        # one array each: the memory of many small ones stays with the driver
        at = starts(np.array([len(rows[i]) + 1 for i in own]))
        flat, value = np.empty(at[-1], np.int32), np.empty(at[-1])
        for i, lo, hi in zip(own, at[:-1], at[1:], strict=True):
            flat[lo : hi - 1], flat[hi - 1], value[lo:hi] = rows[i], dim, values(rows[i])
        return dual_coordinate_descent(np.split(flat, at[1:-1]), np.split(value, at[1:-1]), y, c, dim + 1)

    w = model(fold > 0)
    unseen = np.flatnonzero(fold == 0)
    margins = np.array([w[np.append(rows[i], dim)] @ values(rows[i]) for i in unseen])
    slope, shift = logistic_fit(margins, labels[unseen].astype(float)) if len(unseen) else (1.0, 0.0)
    return QualityModel(scale, w[:-1], float(w[-1]), slope, shift, bits)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, per_class: int = PER_CLASS, bits: int = BITS) -> QualityModel:
    """Fits on at most `per_class` labelled rows of each class, outside the held-out fold."""

    def run(batches):
        use("quality")
        for b in (x for y in batches for x in slices(y)):
            row, f = indicators(binaries(b.column(1)), bits)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield batch(doc_id=b.column(0), label=b.column(2), features=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32())))

    sample = labelled_sample(docs, labels, "quality", folds, fold, per_class)
    # as Arrow: as Python numbers, the features take many times their size in the driver
    found = map_arrow(sample.select("doc_id", "text", "label"), run, "doc_id long, label int, features array<int>").toArrow().combine_chunks()
    features = [x.values.to_numpy() for x in found.column("features")]
    ids, own = found.column("doc_id").to_pylist(), found.column("label").to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(features[i])))
    return fit([features[i] for i in order], own[order].astype(np.int64), bits)


def score(docs: DataFrame, model: QualityModel, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: two arrays of 2**bits

    def run(batches):
        use("quality")
        for b in (x for y in batches for x in slices(y)):
            s = shared.value.scores(binaries(b.column(1)))
            yield batch(doc_id=b.column(0), held_out=b.column(2), score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(folds, fold).alias("held_out"))
    return map_arrow(cols, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        use("quality")
        for b in (x for y in batches for x in slices(y, at)):
            yield b.filter(pa.array(shared.value.scores(binaries(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
