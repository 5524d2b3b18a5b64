"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a learned vector of its hash and the mean of the learned vectors of its
character trigrams (words lower-cased, with edge marks).  A recurrent network with update and reset
gates reads each window of words in both directions; attention pools its states into one logit.  Windows of
48 words overlap by 12 and cover the whole text; a text's logit is the largest of its
windows', turned into a probability by a logistic fit on rows that training didn't see.

Training uses a bounded sample of labelled rows (``per_class`` of each label by hash order; of a text of more
than ``max_windows`` windows, so many spread evenly over all of it), learns from all windows of a text at once (weighted by
the softmax of their logits), by Adam.  Each step also learns from a few texts that say one word of
a clean text over and over, as clean, since such texts drive a recurrent state where no other does.  Null and empty texts are one empty window.
With no labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, map_arrow, mix, slices, starts, use, word_hashes
from .quality import logistic_fit
from .sampling import held_out, labelled_sample

SPAN, STEP, HIDDEN, WIDTH = 48, 36, 8, 8
WORD_BITS, CHAR_BITS = 14, 12
PER_CLASS = (2500, 1200)
THRESHOLD = 0.7
#: windows of one text that training sees
MAX_WINDOWS = 80


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all trigrams of ' word ', and where each word's begin."""
    own = (word_hashes(words) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    raw = np.frombuffer(b"".join(b" %b " % w for w in words), np.uint8).astype(np.uint64)
    n = np.array([len(w) for w in words], np.int64)
    at = starts(n + 2)
    tri = raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:] if len(raw) > 2 else raw[:0]
    bucket = (mix(tri) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    inside = np.ones(len(raw), bool)
    inside[at[1:] - 1] = inside[at[1:] - 2] = False
    return own, bucket[inside[: len(bucket)]], starts(n)


def cut_windows(lengths: np.ndarray, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (counted over all texts) and length of each overlapping window."""
    n = 1 + np.maximum(0, -(-(lengths - span) // step))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(starts(n)[:-1], n)
    return doc, starts(lengths)[:-1][doc] + step * k, np.minimum(span, lengths[doc] - step * k)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _init(seed: int = 5) -> dict:
    r = np.random.default_rng(seed)
    f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
    p = {"word": f(1 << WORD_BITS, WIDTH, k=0.1), "char": f(1 << CHAR_BITS, WIDTH, k=0.3), "a": f(2 * HIDDEN, k=0.3), "o": f(2 * HIDDEN, k=0.3), "c": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": f(2 * WIDTH, 3 * HIDDEN, k=0.25), f"u{d}": f(HIDDEN, 3 * HIDDEN, k=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def _gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step. x: (steps, batch, 3 hidden) inputs of update, reset and candidate; masked steps keep the state."""
    h, out = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((len(x), x.shape[1], HIDDEN), np.float32)
    ug, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    for t in range(len(x)):
        g = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ ug)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ uc)
        z = z * mask[t]
        new = h + z * (n - h)
        if keep is not None:
            keep.append((h, z, r, n, g))
        out[t] = h = new
    return out


def _inputs(p: dict, feats: tuple) -> np.ndarray:
    own, bucket, at = feats
    n = np.maximum(np.diff(at), 1)[:, None]
    chars = np.add.reduceat(np.concatenate([p["char"][bucket], np.zeros((1, WIDTH), np.float32)]), np.minimum(at[:-1], len(bucket)), axis=0) * (np.diff(at) > 0)[:, None] / n
    return np.concatenate([p["word"][own], chars.astype(np.float32)], axis=1)


def _pool(p: dict, h: np.ndarray, mask: np.ndarray) -> tuple:
    """Attention over steps; the logit of each window."""
    e = h @ p["a"] + np.where(mask[..., 0] > 0, np.float32(0), np.float32(-30))
    e -= e.max(0)
    a = np.exp(e)
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, h)
    return a, pooled, pooled @ p["o"] + p["c"][0]


def forward(p: dict, vectors: dict, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; index: (steps, batch) numbers of words, vectors: their inputs by direction."""
    kf, kb = ([], []) if keep is not None else (None, None)
    f = _gru(vectors["f"][index], mask, p["uf"], kf)
    b = _gru(vectors["b"][index[::-1]], mask[::-1], p["ub"], kb)[::-1]
    h = np.concatenate([f, b], axis=2)
    a, pooled, logit = _pool(p, h, mask)
    if keep is not None:
        keep.update(f=kf, b=kb, h=h, a=a, pooled=pooled)
    return logit


def _gru_back(dh_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the step inputs and of u."""
    ug, uc = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
    du, dx, dh = np.zeros_like(u), np.empty((len(kept), dh_out.shape[1], 3 * HIDDEN), np.float32), np.zeros(dh_out.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, g = kept[t]
        d = dh + dh_out[t]
        dn = d * z * (1 - n * n)
        full = g[:, :HIDDEN]
        dz = d * (n - h) * (z > 0) * full * (1 - full)
        rh = dn @ uc.T
        dr = rh * h * r * (1 - r)
        dg = np.concatenate([dz, dr], axis=1)
        dx[t] = np.concatenate([dg, dn], axis=1)
        du[:, : 2 * HIDDEN] += h.T @ dg
        du[:, 2 * HIDDEN :] += (r * h).T @ dn
        dh = d * (1 - z) + dg @ ug.T + rh * r
    return dx, du


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict | None
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: list[bytes], size: int = 2048) -> np.ndarray:
        p = self.weights
        words = [t.lower().split() for t in texts]
        number: dict[bytes, int] = {}
        index = np.array([number.setdefault(w, len(number)) for own in words for w in own] + [0], np.int64)
        x = _inputs(p, word_features(list(number) or [b""]))
        vectors = {d: x @ p[f"w{d}"] + p[f"b{d}"] for d in "fb"}
        doc, first, n = cut_windows(np.array([len(w) for w in words], np.int64))
        out = np.full(len(texts), -np.inf)
        order = np.argsort(n, kind="stable")
        for lo in range(0, len(order), size):
            own = order[lo : lo + size]
            span = max(1, int(n[own].max()))
            step = np.arange(span)[:, None]
            mask = (step < n[own]).astype(np.float32)[..., None]
            at = np.minimum(first[own] + np.minimum(step, np.maximum(n[own] - 1, 0)), len(index) - 1)
            np.maximum.at(out, doc[own], forward(p, vectors, index[at], mask).astype(np.float64))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -35, 35)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 5, size: int = 64, rate: float = 0.01, seed: int = 5) -> ToxicityModel:
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(None)
    rng, p = np.random.default_rng(seed), _init(seed)
    order = rng.permutation(len(texts))
    unseen, seen = order[: len(order) // 5], order[len(order) // 5 :]
    words = [t.lower().split() for t in texts]
    number: dict[bytes, int] = {}
    index = [np.array([number.setdefault(w, len(number)) for w in own], np.int64) for own in words]
    own_b, tri_b, tri_at = word_features(list(number) or [b""])
    weight = np.where(labels > 0, len(labels) / (2 * max(labels.sum(), 1)), len(labels) / (2 * max((1 - labels).sum(), 1)))
    clean = [d for d in seen.tolist() if not labels[d] and len(index[d])]
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    total = epochs * -(-len(seen) // size)
    for _ in range(epochs):
        for lo in range(0, len(seen), size):
            docs = seen[rng.integers(len(seen), size=size)] if lo + size > len(seen) else seen[lo : lo + size]
            again = [np.repeat(rng.choice(index[d]), int(rng.integers(8, SPAN))) for d in rng.choice(clean, 8)] if len(clean) else []
            own = [*(index[d] for d in docs), *again]
            y = np.append(labels[docs], np.zeros(len(again), np.int64))
            heavy = np.append(weight[docs], np.full(len(again), 1.0))
            used, flat = np.unique(np.concatenate([np.zeros(1, np.int64), *own]), return_inverse=True)
            flat = np.append(flat[1:], 0)
            cut = np.concatenate([np.arange(tri_at[k], tri_at[k + 1]) for k in used])
            feats = (own_b[used], tri_b[cut], starts(np.diff(tri_at)[used]))
            x = _inputs(p, feats)
            vectors = {d: x @ p[f"w{d}"] + p[f"b{d}"] for d in "fb"}
            doc, first, n = cut_windows(np.array([len(x) for x in own], np.int64))
            step = np.arange(SPAN)[:, None]
            mask = (step < n).astype(np.float32)[..., None]
            at = flat[np.minimum(first + np.minimum(step, np.maximum(n - 1, 0)), len(flat) - 1)]
            keep: dict = {}
            logit = forward(p, vectors, at, mask, keep)
            # a text's logit is the mean of its windows' under their softmax, which is held fixed
            top = np.full(len(own), -np.inf, np.float32)
            np.maximum.at(top, doc, logit)
            share = np.exp(2 * (logit - top[doc]))
            share /= np.bincount(doc, share)[doc]
            whole = np.bincount(doc, share * logit)
            error = (1 / (1 + np.exp(-whole)) - y) * heavy / len(own)
            dl = (error[doc] * share).astype(np.float32)
            g = {"c": np.array([dl.sum()], np.float32), "o": keep["pooled"].T @ dl}
            dp = dl[:, None] * p["o"]
            h, a = keep["h"], keep["a"]
            da = np.einsum("tbh,bh->tb", h, dp)
            de = a * (da - (a * da).sum(0))
            g["a"] = np.einsum("tb,tbh->h", de, h)
            dh = a[..., None] * dp + de[..., None] * p["a"]
            dxs = np.zeros_like(x)
            for d, half in (("f", dh[..., :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
                dx, g[f"u{d}"] = _gru_back(half, keep[d], p[f"u{d}"])
                where = (at if d == "f" else at[::-1]).reshape(-1)
                dv = np.stack([np.bincount(where, c, len(used)) for c in dx.reshape(-1, 3 * HIDDEN).T], axis=1).astype(np.float32)
                g[f"w{d}"], g[f"b{d}"] = x.T @ dv, dv.sum(0)
                dxs += dv @ p[f"w{d}"].T
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], feats[0], dxs[:, :WIDTH])
            n_tri = np.diff(feats[2])
            np.add.at(g["char"], feats[1], np.repeat(dxs[:, WIDTH:] / np.maximum(n_tri, 1)[:, None], n_tri, axis=0))
            t += 1
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                lr = rate * min(1.0, 1.5 * (1 - t / (total + 1)))
                p[k] = (p[k] - lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    model = ToxicityModel(p)
    if len(set(labels[unseen].tolist())) < 2:
        return model
    return ToxicityModel(p, *logistic_fit(model.logits([texts[k] for k in unseen]), labels[unseen].astype(float)))


def spread_windows(text: bytes, most: int) -> bytes:
    """The text, or of a long one the words of at most `most` windows, evenly spread from its first to its last."""
    words = text.lower().split()
    _, first, n = cut_windows(np.array([len(words)], np.int64))
    if len(first) <= most:
        return b" ".join(words)
    at = np.unique(np.linspace(0, len(first) - 1, most).astype(np.int64))
    return b" ".join(w for k in at.tolist() for w in words[int(first[k]) : int(first[k] + n[k])])


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_class: tuple[int, int] = PER_CLASS, max_windows: int = MAX_WINDOWS) -> ToxicityModel:
    """Fits on a bounded sample of labelled rows outside the held-out fold."""

    def run(batches):
        for b in (x for y in batches for x in slices(y)):
            yield batch(doc_id=b.column(0), label=b.column(2), text=pa.array([spread_windows(t, max_windows) for t in binaries(b.column(1))], pa.binary()))

    sample = labelled_sample(docs, labels, "toxic", folds, fold, per_class)
    rows = sorted(map_arrow(sample, run, "doc_id long, label int, text binary").collect(), key=lambda r: (r[0], r[2]))
    return fit([bytes(r[2]) for r in rows], np.array([r[1] for r in rows], np.int64))


def score(docs: DataFrame, model: ToxicityModel, folds: int = 3, fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        use("toxicity")
        for b in (x for y in batches for x in slices(y)):
            s = shared.value.scores(binaries(b.column(1)))
            yield batch(doc_id=b.column(0), held_out=b.column(2), score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(folds, fold).alias("held_out"))
    return map_arrow(cols, run, "doc_id long, held_out boolean, score double, predicted int")
