"""Language-model scoring: a small causal self-attention model on subword ids.

Base: every word (lower-cased A-Z, split at ASCII white space) and one end of the text, under add-one
smoothed counts of all training documents.

Model: the subword ids of the lower-cased text and one end.  The commonest ids of the training documents are classes of
their own; all others share one class, within which an id has its smoothed share of the training
tokens.  Classes lie in groups of equal size, found by splitting along principal components of
what they follow.  P(id | left context) is P(group) * P(class | group, previous class) * share: the group's
probability is a softmax over the attention's logits plus the log of the smoothed counts of groups
after the previous class, the class's are smoothed counts.  Counts of ids, of classes and of pairs of classes come from all training
documents.  So do the attention's weights: they are trained in numpy, by Adam, in rounds over all units of documents.
Every token of every training document is learnt once: its windows for training follow each other without a gap or an overlap, and each
is learnt in one of the rounds.  Buckets of documents make their steps from the round's common weights, and the
buckets' weights are averaged by their steps; the work grows with the documents, the weights don't.

Long texts are scored in overlapping
windows: each token is scored once, by the window that gives it the most left context
(at least 6 tokens after the first window), in masked batches.

Rows with a null doc_id are not held out.  Null and empty texts are one token, the end.  Repeated rows are scored, and learnt from, each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks_for, expand, expand_sorted, filled_blocks, group_arrow, map_arrow, ragged, settle, squeeze, squeeze_sorted, starts, string_hashes, use
from .packing import word_tokens

GROUPS, MEMBERS = 32, 64
SPAN, STEP, WIDTH = 24, 18, 16
#: rounds of training, over which every document's windows are dealt; least steps of a bucket in a round; windows of a step, of a bucket
ROUNDS, LEAST_STEPS, STEP_WINDOWS, BUCKET_WINDOWS = 2, 60, 256, 32768
#: keys that are counted together
COUNTED = 1 << 22
MOST_TASKS = 4096
RATE = 1e-2
UNIT_BYTES = 4 << 20
#: tables of tasks that are added up together
FAN_IN = 64
END_HASH = string_hashes(pa.array(["\n"]))  # no word holds a line break


def is_held_out(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


# --- the model ---------------------------------------------------------------------


@dataclass
class Model:
    """Fixed-size arrays: class of each id, log share of each id within its class, tables of groups and members, weights."""

    klass: np.ndarray
    share: np.ndarray
    first: np.ndarray  # log P(group | previous class)
    second: np.ndarray  # log P(member | previous class, group)
    weights: dict

    @property
    def classes(self) -> int:
        return self.second.shape[1] * self.second.shape[2]

    def fused(self) -> tuple:
        """Tables that scoring looks up: a class's and a place's share in states and in queries (on states: q and k act by their product only),
        what attention adds to a state (v and o, too), and P(group | previous class)."""
        w = self.weights
        qk = w["q"] @ w["k"].T * np.float32(1 / np.sqrt(w["q"].shape[0]))
        return w["e"], w["p"], w["e"] @ qk, w["p"] @ qk, w["v"] @ w["o"], np.exp(self.first)


def group_classes(pairs: np.ndarray, groups: int) -> np.ndarray:
    """The classes (columns of pair counts) in an order whose equal parts are groups of alike classes."""
    x = np.log1p(pairs.T.astype(np.float32))
    parts = [np.arange(len(x))]
    while len(parts) < groups:
        halves = []
        for own in parts:
            c = x[own] - x[own].mean(0)
            v = c[np.abs(c).sum(1).argmax()]
            for _ in range(8):
                v = c.T @ (c @ v)
                v /= np.linalg.norm(v) + 1e-9
            own = own[np.argsort(c @ v, kind="stable")]
            halves += [own[: len(own) // 2], own[len(own) // 2 :]]
        parts = halves
    return np.concatenate(parts)


def tables(pairs: np.ndarray, groups: int, prior: float = 20) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of groups, and of classes within groups, after each class and at the start."""
    p = pairs.reshape(len(pairs), groups, -1).astype(np.float32)
    one = p.sum(0) + np.float32(0.01)
    by = p.sum(2)
    first = np.log((by + prior * one.sum(1) / one.sum()) / (by.sum(1, keepdims=True) + prior))
    second = np.log((p + prior * (one / one.sum(1, keepdims=True))) / (by + prior)[..., None])
    return first.astype(np.float32), second.astype(np.float32)


def windows(lengths: np.ndarray, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: first place, length and number of tokens already scored of each window."""
    n = 1 + np.maximum(0, -(-(lengths - span) // step))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(starts(n)[:-1], n)
    first = starts(lengths)[:-1][doc] + step * k
    return first, np.minimum(span, lengths[doc] - step * k), np.where(k > 0, span - step, 0)


def init_weights(classes: int, groups: int, width: int = WIDTH, span: int = SPAN, seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    m = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0])).astype(np.float32)
    return {"e": (r.standard_normal((classes + 1, width)) * 0.3).astype(np.float32), "p": (r.standard_normal((span, width)) * 0.1).astype(np.float32), "q": m(width, width), "k": m(width, width), "v": m(width, width), "o": m(width, width), "w1": m(width, groups) * np.float32(0.1)}


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)
    return z


def _attend(w: dict, x: np.ndarray) -> tuple:
    """x: classes of the previous tokens, (batch, span). The plain form, which training differentiates."""
    span, scale = x.shape[1], np.float32(1 / np.sqrt(w["q"].shape[0]))
    h = w["e"][x] + w["p"][:span]
    q, k, v = h @ w["q"], h @ w["k"], h @ w["v"]
    a = _softmax(q @ k.transpose(0, 2, 1) * scale + np.where(np.tril(np.ones((span, span), bool)), np.float32(0), np.float32(-1e9)))
    c = a @ v
    return h, q, k, v, a, c, h + c @ w["o"]


def group_log_probs(model: Model, x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Natural logs of P(group | left context) at every place of windows (batch, span), in the plain form."""
    z = _attend(model.weights, x)[-1] @ model.weights["w1"] + model.first[x]
    z -= z.max(2, keepdims=True)
    return np.take_along_axis(z, g[..., None], 2)[..., 0] - np.log(np.exp(z).sum(2))


def _fused_log_probs(model: Model, tables: tuple, x: np.ndarray, g: np.ndarray, off: int) -> np.ndarray:
    """The same from place `off` on, in few passes over memory: looked-up projections, no shifts by the maximum, which
    the plain form does where a number gets too large."""
    state, state_place, query, query_place, vo, first = tables
    (n, span), w, groups = x.shape, vo.shape[0], first.shape[1]
    asked = np.ascontiguousarray(x[:, off:])
    h = np.take(state, x, axis=0, mode="clip")
    h += state_place[:span]
    u = np.take(query, asked, axis=0, mode="clip")
    u += query_place[off:span]
    a = u @ h.transpose(0, 2, 1)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        np.exp(a, out=a)
        a *= np.tril(np.ones((span, span), np.float32))[off:]
        c = a @ h
        c /= a @ np.ones((span, 1), np.float32)
        o = c.reshape(-1, w) @ vo
        o += h[:, off:].reshape(-1, w)
        e = o @ model.weights["w1"]
        np.exp(e, out=e)
        e *= np.take(first, asked.reshape(-1), axis=0, mode="clip")
        at = np.arange(0, e.size, groups) + g[:, off:].reshape(-1)
        out = np.log(e.reshape(-1)[at] / (e @ np.ones(groups, np.float32))).reshape(n, span - off)
    return out if np.isfinite(out).all() else group_log_probs(model, x, g)[:, off:]


def _row_sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers, the sum of the rows that `at` gives it."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")  # a radix sort for short integers
    ordered = at[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    out[ordered[first]] = np.add.reduceat(np.take(rows, order, axis=0), first)
    return out


def train_steps(w: dict, first_table: np.ndarray, x: np.ndarray, g: np.ndarray, real: np.ndarray, steps: int, size: int = STEP_WINDOWS, rate: float = RATE, seed: int = 7) -> dict:
    """Adam on the groups' cross entropy, over windows in a shuffled order; x, g, real: (windows, span). The table is fixed.

    The passes of `_attend` and their gradients, in fewer operations: q and k, and v and o, only act by their products, so their gradients follow from
    those of two matrices; the sums of softmaxes act on narrow arrays and never on the attention's; logits are bounded instead of shifted. What stands
    right in a product is turned first where that is smaller: BLAS takes small turned matrices at less than half the speed.
    """
    names, kind = list(w), w["e"].dtype
    cut = np.cumsum([0, *(w[k].size for k in names)])
    every, slope = np.concatenate([w[k].reshape(-1) for k in names]), np.zeros(cut[-1], kind)
    w, d = ({k: v[lo:hi].reshape(w[k].shape) for k, lo, hi in zip(names, cut[:-1], cut[1:], strict=True)} for v in (every, slope))  # parts of one array each
    m1, m2 = np.zeros_like(every), np.zeros_like(every)
    width, span, groups = w["q"].shape[0], x.shape[1], w["w1"].shape[1]
    rng, scale, most, least = np.random.default_rng(seed), kind.type(1 / np.sqrt(width)), kind.type(80), kind.type(1e-30)
    prior, past = np.exp(first_table).astype(kind, copy=False), np.tril(np.ones((span, span), kind))
    sums, at = {n: np.ones((n, m), kind) for n, m in ((span, width), (groups, 1), (width, width))}, np.arange(size * span) * groups  # sums of rows, in as many columns as they act on
    turned, order = lambda m: np.ascontiguousarray(m.swapaxes(-1, -2)), np.zeros(0, np.int64)
    bounded = lambda z: np.minimum(z, most, out=z) if z.max() > most else z
    for t in range(1, steps + 1):
        if len(order) < size:
            order = np.concatenate([order, *[rng.permutation(len(x)) for _ in range(-(-size // len(x)))]])
        own, order = order[:size], order[size:]
        flat, mask = x[own].reshape(-1), real[own].reshape(-1)
        share = (mask / kind.type(max(mask.sum(), 1))).astype(kind, copy=False)
        qk, vo = w["q"] @ w["k"].T * scale, w["v"] @ w["o"]
        h = np.take(w["e"], flat, axis=0).reshape(size, span, width)
        h += w["p"][:span]
        hf = h.reshape(-1, width)
        ht, u = turned(h), (hf @ qk).reshape(h.shape)
        a = bounded(u @ ht)
        np.exp(a, out=a)
        a *= past
        mixed, total = (a @ h).reshape(-1, width), (a @ sums[span]).reshape(-1, width)
        total += least
        c = mixed / total
        out = c @ vo
        out += hf
        z = out @ w["w1"]
        np.exp(bounded(z), out=z)
        z *= np.take(prior, flat, axis=0)
        z *= share[:, None] / (z @ sums[groups] + least)
        z.reshape(-1)[at + g[own].reshape(-1)] -= share
        d_out = z @ turned(w["w1"])
        np.matmul(out.T, z, out=d["w1"])
        d_vo = c.T @ d_out
        d["v"][:], d["o"][:] = d_vo @ w["o"].T, w["v"].T @ d_vo
        d_c = d_out @ turned(vo)
        d_c /= total
        shift = (d_c * c) @ sums[width]
        d_s = d_c.reshape(h.shape) @ ht
        d_s *= a
        d_u = (d_s @ h).reshape(-1, width)
        d_u -= mixed * shift
        d_c -= u.reshape(-1, width) * shift
        d_qk = hf.T @ d_u * scale
        d["q"][:], d["k"][:] = d_qk @ w["k"], d_qk.T @ w["q"]
        d_h = d_u @ turned(qk)
        d_h += (a.transpose(0, 2, 1) @ d_c.reshape(h.shape)).reshape(-1, width)
        d_h += (d_s.transpose(0, 2, 1) @ u).reshape(-1, width)
        d_h += d_out
        d["p"][:span] = d_h.reshape(size, -1).sum(0).reshape(span, width)
        d["e"][:] = _row_sums(d_h, flat, len(w["e"]))
        m1 += kind.type(0.1) * (slope - m1)
        m2 += kind.type(0.01) * (slope * slope - m2)
        every -= kind.type(rate / (1 - 0.9**t)) * m1 / (np.sqrt(m2 * kind.type(1 / (1 - 0.99**t))) + kind.type(1e-8))
    return {k: v.astype(np.float32) for k, v in w.items()}


def laid_out(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ids laid end to end: ids, classes, and previous classes."""
    ids = np.concatenate(texts)
    y = model.klass[ids]
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[starts(np.array([len(t) for t in texts]))[:-1]] = model.classes
    return ids, y, x


def score_texts(model: Model, texts: list[np.ndarray], tables: tuple | None = None, chunk: int = 256) -> np.ndarray:
    """log10 probability of each text of ids (the end included as the last id)."""
    if not texts:
        return np.zeros(0)
    tables = tables or model.fused()
    lengths = np.array([len(t) for t in texts])
    ids, y, x = laid_out(model, texts)
    group, member = np.divmod(y, model.second.shape[2])
    first, n, done = windows(lengths)
    per = model.share[ids].astype(np.float64)
    per += model.second[x, group, member]
    # a window may read on into the next text: attention looks back only, and what it gives there is left out
    x, group = (sliding_window_view(np.append(v, np.zeros(SPAN, v.dtype)), SPAN) for v in (x, group))
    for off in (0, SPAN - STEP):
        scored = sliding_window_view(per, SPAN - off, writeable=True) if len(per) >= SPAN else None
        for whole in (True, False):
            own = (done == off) & ((n == SPAN) == whole)
            f, m = first[own], n[own]
            for lo in range(0, len(f), chunk):
                at = f[lo : lo + chunk]
                got = _fused_log_probs(model, tables, x[at], group[at], off)
                if whole:  # these score places of their own
                    scored[at + off] += got
                else:
                    real = np.arange(off, SPAN) < m[lo : lo + chunk, None]
                    per[(at[:, None] + np.arange(off, SPAN))[real]] += got[real]
    return np.add.reduceat(per, starts(lengths)[:-1]) / np.log(10)


# --- passes over the corpus --------------------------------------------------------------


def common_classes(single: np.ndarray, classes: int) -> np.ndarray:
    """The class of each id: the commonest have their own, the others share one, and the end (the last id) has one."""
    klass = np.full(len(single), classes - 2, np.int64)
    common = np.argsort(-single[:-1], kind="stable")[: classes - 2]
    klass[common] = np.arange(len(common))
    klass[-1] = classes - 1
    return klass


_KINDS = "kind string, unit long, block int, a binary, b binary"


def _kinds(rows: list) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "unit", "block", "a", "b"])


def _sparse(kind: str, slot: int, total: np.ndarray, parts: int) -> list:
    """A table's entries that are not 0, in ranges of places."""
    at = np.flatnonzero(total)
    cut = np.searchsorted(at, np.arange(parts + 1) * -(-len(total) // parts))
    return [(kind, slot, j, squeeze_sorted(at[a:b].astype(np.uint32)), squeeze(total[at[a:b]].astype(np.int64))) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]


def _totals(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of the tasks' sparse tables of `size` numbers (unit: the task), added up on executors, FAN_IN at a time."""

    def add(key, t):
        total = np.zeros(size, np.int64)
        for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
            total[expand_sorted(a, np.uint32)] += expand(b, np.int64)
        at = np.flatnonzero(total)
        return batch(unit=pa.array([key[0].as_py()]), block=pa.array([key[1].as_py()], pa.int32()), a=pa.array([squeeze_sorted(at.astype(np.uint32))], pa.binary()), b=pa.array([squeeze(total[at])], pa.binary()))

    slots = 1 + (rows.agg(F.max("unit")).first()[0] or 0)
    while slots > 1:
        rows = group_arrow(rows.withColumn("unit", F.floor(F.col("unit") / FAN_IN)), ["unit", "block"], add, "unit long, block int, a binary, b binary")
        slots = -(-slots // FAN_IN)
    out = np.zeros(size, np.int64)
    for r in rows.select("a", "b").collect():  # one table of a fixed size
        out[expand_sorted(r[0], np.uint32)] += expand(r[1], np.int64)
    return out


def _tokens_of(packed: bytes, kind: type) -> list[np.ndarray]:
    """The ids of a unit's texts, without ends."""
    m = int.from_bytes(packed[:4], "little")
    cut = starts(np.frombuffer(packed[4 : 4 + 4 * m], np.uint32).astype(np.int64))
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[4 + 4 * m :]), kind).astype(np.int64)
    return [small[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _about(packed: bytes) -> tuple[list, np.ndarray, bytes]:
    """Ids and numbers of words of a unit's documents, and, squeezed, each word's number among the unit's distinct ones."""
    cut = 4 + int.from_bytes(packed[:4], "little")
    about = pa.ipc.read_record_batch(pa.py_buffer(packed[4:cut]), pa.schema([("id", pa.int64()), ("n", pa.int64())]))
    return about.column(0).to_pylist(), about.column(1).to_numpy(), packed[cut:]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words (A-Z; split at ASCII white space) of texts without nulls, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    real = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty part
    if not real.all():
        n = np.diff(starts(real)[starts(n)])
        words = words.filter(pa.array(real))
    return words, n


def _passed(docs: DataFrame, tokenizer_path: str, n_ids: int, folds: int, fold: int, n_blocks: int) -> DataFrame:
    """The pass over the texts: units of documents with their ids; each unit's words by ranges of hashes; each task's counts of ids."""
    kind = np.uint16 if n_ids <= 1 << 16 else np.uint32

    def rows_of(unit, ids, texts, tok, single):
        words, n = _words(texts)
        n = n + 1  # the end
        coded = words.dictionary_encode()  # what a unit repeats is looked up once
        number, last = coded.dictionary, len(coded.dictionary)
        place = np.full(n.sum(), last)
        inner = np.ones(len(place), bool)
        inner[starts(n)[1:] - 1] = False
        place[inner] = coded.indices.to_numpy()
        distinct, same = np.unique(np.append(string_hashes(number), END_HASH), return_inverse=True)
        train = np.repeat(np.array([not is_held_out(i, folds, fold) for i in ids]), n)
        learnt = np.bincount(place[train], minlength=last + 1)
        count = np.bincount(same, learnt, len(distinct)).astype(np.uint32)
        small, long = tok.ids_of(number)
        small, long = small.astype(kind), np.append(long, 0)
        single += np.bincount(small, np.repeat(learnt, long), n_ids).astype(np.int64)
        single[-1] += learnt[last]
        per = long[place]
        lengths = np.add.reduceat(per, starts(n)[:-1]).astype(np.uint32)
        small = small[ragged(starts(long)[:-1][place], per)]
        about = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"]).serialize().to_pybytes()
        # each word as its number among the unit's distinct words, so that later passes need no text
        yield "unit", unit, None, len(about).to_bytes(4, "little") + about + squeeze(same[place].astype(np.uint32)), len(lengths).to_bytes(4, "little") + lengths.tobytes() + zstandard.ZstdCompressor(level=3).compress(small.tobytes())
        block, cut = filled_blocks(distinct, 64, n_blocks)
        for k, lo, hi in zip(block.tolist(), cut[:-1], cut[1:], strict=True):
            yield "words", unit, k, squeeze_sorted(distinct[lo:hi]), squeeze(count[lo:hi])

    def run(batches):
        from pyspark import TaskContext

        use("lm")
        part, k = TaskContext.get().partitionId(), 0
        tok, single = word_tokens(tokenizer_path), np.zeros(n_ids, np.int64)
        ids, texts, size = [], [], 0

        def flush():
            nonlocal ids, texts, size, k
            rows = list(rows_of((part << 24) + k, ids, pa.concat_arrays(texts), tok, single))
            k, ids, texts, size = k + 1, [], [], 0
            return _kinds(rows)

        for b in batches:
            own, at = pc.fill_null(b.column(1), ""), 0
            for m, n in enumerate(pc.binary_length(own).to_pylist(), 1):
                size += n + 16
                if size >= UNIT_BYTES:
                    ids += b.column(0).slice(at, m - at).to_pylist()
                    texts.append(own.slice(at, m - at))
                    at = m
                    yield flush()
            if at < len(own):
                ids += b.column(0).slice(at).to_pylist()
                texts.append(own.slice(at))
        if ids:
            yield flush()
        tok.rest()
        if single.any():
            yield _kinds(_sparse("single", part, single, 1))

    return map_arrow(docs, run, _KINDS)


def _training(units: DataFrame, f, schema: str, n_ids: int, folds: int, fold: int) -> DataFrame:
    """Runs f(task, texts of a unit's training documents, one unit after the other) for each task; texts are ids with their end."""
    kind = np.uint16 if n_ids <= 1 << 16 else np.uint32

    def run(batches):
        from pyspark import TaskContext

        def texts():
            for b in batches:
                for packed, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = _about(packed)[0]
                    if own := [np.append(t, n_ids - 1) for i, t in zip(ids, _tokens_of(tokens, kind), strict=True) if not is_held_out(i, folds, fold)]:
                        yield own

        use("lm")
        yield from f(TaskContext.get().partitionId(), texts())

    return units.select("a", "b").mapInArrow(run, schema)


def _pairs(units: DataFrame, klass: np.ndarray, classes: int, folds: int, fold: int) -> np.ndarray:
    """Counts of (previous class, class) over all training documents; the previous class of a first token is `classes`."""
    to_class, n_ids = units.sparkSession.sparkContext.broadcast(klass), len(klass)

    def count(part, units_texts):
        total, held = np.zeros((classes + 1) * classes, np.int32), []
        for own in units_texts:
            y = to_class.value[np.concatenate(own)]
            x = np.append(classes, y[:-1])
            x[starts(np.array([len(t) for t in own]))[:-1]] = classes
            held.append((x * classes + y).astype(np.int32))
            if sum(map(len, held)) >= COUNTED:  # the table is large, so units are counted together
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        if total.any():
            yield _kinds(_sparse("pair", part, total, 8))

    rows = settle(_training(units, count, _KINDS, n_ids, folds, fold))
    return _totals(rows.select("unit", "block", "a", "b"), (classes + 1) * classes).reshape(classes + 1, classes)


def _dealt_windows(own: list[np.ndarray], x: np.ndarray, y: np.ndarray, number: int, of: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of round `number` of `of`: each window's bucket, and the windows as rows of the class before them, their classes and their number of tokens.

    Windows lie end to end, so each token is in one; a document's windows go to its rounds in turn, from one that its checksum gives.
    """
    lengths = np.array([len(t) for t in own])
    first, n, _ = windows(lengths, SPAN, SPAN)
    per = -(-lengths // SPAN)
    doc = np.repeat(np.arange(len(per)), per)
    sums = np.array([zlib.crc32(np.asarray(t, "<u4").tobytes()) for t in own])
    mine = (np.arange(len(first)) - starts(per)[:-1][doc] + (sums // buckets)[doc]) % of == number
    first, n = first[mine], n[mine]
    rows = np.empty((len(first), SPAN + 2), "<u2")
    rows[:, 0], rows[:, -1] = x[first], n
    rows[:, 1:-1] = sliding_window_view(np.append(y.astype("<u2"), np.zeros(SPAN, "<u2")), SPAN)[first]
    short = np.flatnonzero(n < SPAN)  # these end with their text, whose last class fills them
    rows[short, 1:-1] = y[first[short, None] + np.minimum(np.arange(SPAN), n[short, None] - 1)]
    return (sums % buckets)[doc[mine]], rows


def _unpacked_windows(rows: np.ndarray, members: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous classes, groups and which places are real."""
    rows = rows.astype(np.int32)
    return rows[:, :SPAN], rows[:, 1 : SPAN + 1] // members, np.arange(SPAN) < rows[:, SPAN + 1 :]


def _round(units: DataFrame, model: Model, number: int, folds: int, fold: int, of: int, least: int, buckets: int) -> dict:
    """The weights after one of `of` rounds over all units: each bucket's steps from the same weights, averaged by their number.

    A document's windows go to the bucket of its tokens' checksum, and a bucket learns them in the order of their content, so the
    weights follow from the table alone and not from how Spark deals it, or from what it runs again.
    """
    share, n_ids = units.sparkSession.sparkContext.broadcast(model), len(model.klass)
    names = list(model.weights)
    shapes = [model.weights[k].shape for k in names]

    def pick(part, units_texts):
        m = share.value
        for own in units_texts:
            _, y, x = laid_out(m, own)
            bucket, rows = _dealt_windows(own, x, y, number, of, buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            parts = np.split(rows[order], at[1:]) if len(order) else []
            yield batch(bucket=pa.array(bucket[order][at], pa.int64()), rows=pa.array([r.tobytes() for r in parts], pa.binary()))

    def train(key, t):
        use("lm")
        m = share.value
        rows = np.frombuffer(b"".join(t.column("rows").to_pylist()), "<u2").reshape(-1, SPAN + 2)
        x, g, real = _unpacked_windows(rows[np.lexsort(rows.T[::-1])], m.second.shape[2])
        steps = max(least, -(-len(x) // STEP_WINDOWS))
        w = train_steps(m.weights, m.first, x, g, real, steps, seed=number, rate=RATE / (1 + number))
        flat = np.concatenate([w[k].reshape(-1) for k in names]).astype(np.float64)
        return batch(slot=pa.array([key[0].as_py()], pa.int64()), steps=pa.array([steps], pa.int64()), total=pa.array([(flat * steps).tobytes()], pa.binary()))

    def add(key, t):
        order = np.argsort(t.column("was").to_numpy())
        every_total = t.column("total").to_pylist()
        total = np.sum([np.frombuffer(every_total[i], np.float64) for i in order], axis=0)
        return batch(slot=pa.array([key[0].as_py()], pa.int64()), steps=pa.array([sum(t.column("steps").to_pylist())], pa.int64()), total=pa.array([total.tobytes()], pa.binary()))

    schema = "slot long, steps long, total binary"
    # a bucket is little to send and much to learn, so its number of tasks is said and not found from sizes
    dealt = _training(units, pick, "bucket long, rows binary", n_ids, folds, fold).repartition(min(buckets, MOST_TASKS), "bucket")
    rows = settle(group_arrow(dealt, ["bucket"], train, schema))
    slots = buckets
    while slots > 1:
        rows = group_arrow(rows.select(F.floor(F.col("slot") / FAN_IN).alias("slot"), F.col("slot").alias("was"), "steps", "total"), ["slot"], add, schema)
        slots = -(-slots // FAN_IN)
    got = rows.collect()  # one row
    if not got:
        return model.weights
    flat = (np.sum([np.frombuffer(r.total, np.float64) for r in got], axis=0) / sum(r.steps for r in got)).astype(np.float32)
    cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return {k: v.reshape(s) for k, v, s in zip(names, np.split(flat, cut), shapes, strict=True)}


def _merge_words(key, t: pa.Table) -> pa.RecordBatch:
    """Total training count of each word of a range, sent back to every unit in the order it was sent."""
    keys = [expand_sorted(x, np.uint64) for x in t.column("a").to_pylist()]
    counts = [expand(x, np.uint32) for x in t.column("b").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    at, n = starts(np.array([len(k) for k in keys])), t.num_rows
    back = [squeeze(total[place[at[k] : at[k + 1]]]) for k in range(n)]
    first = [1] + [0] * (n - 1)
    return batch(unit=t.column("unit").combine_chunks(), block=pa.array([key[0].as_py()] * n, pa.int32()), counts=pa.array(back, pa.binary()), tokens=pa.array([int(total.sum()) * f for f in first], pa.int64()), types=pa.array([int((total > 0).sum()) * f for f in first], pa.int64()))


def fit(units: DataFrame, single: np.ndarray, groups: int, members: int, folds: int, fold: int, rounds: int = ROUNDS, every: int = 1, least: int = LEAST_STEPS) -> Model:
    """The model of the units' training documents; single: how often they hold each id."""
    classes = groups * members
    klass = common_classes(single, classes)
    pairs = _pairs(units, klass, classes, folds, fold)
    place = np.empty(classes, np.int64)
    order = group_classes(pairs, groups)
    place[order] = np.arange(classes)
    klass, pairs = place[klass], pairs[np.append(order, classes)][:, order]
    first, second = tables(pairs, groups)
    smooth = single + 1.0
    model = Model(klass, np.log(smooth / np.bincount(klass, smooth, classes)[klass]).astype(np.float32), first, second, init_weights(classes, groups))
    # so many that one has about BUCKET_WINDOWS windows in a round: a number that the table alone decides
    buckets = max(1, round(int(single.sum()) / (SPAN * max(rounds, 1) * every * BUCKET_WINDOWS)))
    for number in range(rounds):
        model.weights = _round(units, model, number, folds, fold, rounds * every, least, buckets)
    return model


def score_documents(docs: DataFrame, tokenizer_path: str, folds: int = 7, fold: int = 2, groups: int = GROUPS, members: int = MEMBERS, rounds: int = ROUNDS, every: int = 1, least: int = LEAST_STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`; with rounds = 0, the tables alone; with every > 1, attention learnt from a part of the windows only."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_ids = word_tokens(tokenizer_path).tok.get_vocab_size() + 1  # the last number is the end
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = blocks_for(int(size) // 20, 1 << 20)
    rows = settle(_passed(docs, tokenizer_path, n_ids, folds, fold, n_blocks))
    units = rows.where("kind = 'unit'").select("unit", "a", "b")
    single = _totals(rows.where("kind = 'single'").select("unit", "block", "a", "b"), n_ids)
    # only arrays of fixed sizes
    model = docs.sparkSession.sparkContext.broadcast(fit(units, single, groups, members, folds, fold, rounds, every, least))
    kind = np.uint16 if n_ids <= 1 << 16 else np.uint32

    answers = settle(group_arrow(rows.where("kind = 'words'").select("unit", "block", "a", "b"), ["block"], _merge_words, "unit long, block int, counts binary, tokens long, types long"))
    sums = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(sums[0] or 0), int(sums[1] or 0)

    def score(batches):
        use("lm")
        for b in batches:
            scores = [score_texts(model.value, [np.append(t, n_ids - 1) for t in _tokens_of(x, kind)]).tobytes() for x in b.column(2).to_pylist()]
            yield batch(unit=b.column(0), a=b.column(1), scores=pa.array(scores, pa.binary()))

    def finish(key, left, right):
        ids, n, place = _about(left.column("a")[0].as_py())
        place = expand(place, np.uint32)
        back = dict(zip(right.column("block").to_pylist(), right.column("counts").to_pylist(), strict=True))
        c = np.concatenate([expand(back[k], np.int64) for k in sorted(back)])[place]
        doc = np.repeat(np.arange(len(ids)), n)
        base = np.bincount(doc, np.log10(c + 1.0), len(ids)) - n * np.log10(tokens + types + 1.0)
        score = np.frombuffer(left.column("scores")[0].as_py())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([is_held_out(i, folds, fold) for i in ids], pa.bool_()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.bincount(doc, c > 0, len(ids)).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = map_arrow(units, score, "unit long, a binary, scores binary")  # before the shuffle, so that no ids are sent
    return scored.groupBy("unit").cogroup(answers.select("unit", "block", "counts").groupBy("unit")).applyInArrow(finish, schema)
