"""Substring dedup with a count-min prefilter.

A window is 35 consecutive words (runs ``[^\\x20\\x09-\\x0D]+``, unchanged) of one document.  Every word
covered by a window whose word sequence also starts anywhere else goes, in all places.

First pass: each unit of documents makes a sketch of its windows, two rows of counters;
the sketches are merged by ranges of counters.  The smaller of a window's two counters never
underestimates its count, so a window that the sketch counts once occurs once.  Second pass:
only windows that the sketch counts more often are grouped, by 96 bits of hash, and counted
exactly.  Third pass: words under repeated windows are removed.

The counters are as many as twice the words, so the share of windows that pass wrongly stays
the same at any size (about 5 %).  Sketches and groups are dealt by ranges of hashes; a unit sends
each range one compressed row, and gets back one bit for each counter or window sent.  A
window that is very frequent counts once for each unit.

Null and empty texts have no words; texts under 35 words lose none.  Rows count by their own text,
so a row that stands twice loses all words that windows cover, in both rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, blocks_for, expand_sorted, filled_blocks, group_arrow, pack_units, rolling, settle, squeeze_sorted, starts, unpack_units, use, word_hashes

WINDOW = 35
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK_BITS = 22


class Windows:
    """The windows of a unit's documents: two 64-bit hashes and the first word of each."""

    def __init__(self, texts: list[bytes], width: int):
        self.words = [t.split() for t in texts]
        n = np.array([len(w) for w in self.words], np.int64)
        self.at = starts(n)
        h = word_hashes([w for own in self.words for w in own])
        left = np.repeat(self.at[1:], n) - np.arange(len(h))
        self.first = np.flatnonzero(left >= width)
        self.hashes = [rolling(h, width, f)[self.first] if len(h) >= width else h[:0] for f in FACTORS]


def _local(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, whether each stands more than once, and each value's place among them."""
    order = np.argsort(values)
    s = values[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    edge = np.flatnonzero(new)
    return s[edge], np.diff(edge, append=len(s)) > 1, place


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    c = hashes >> np.uint64(64 - bits)
    return c.astype(np.uint32) if bits <= 32 else c


_SENT = "sketch int, block long, unit long, once binary, more binary"
_BACK = "unit long, sketch int, block long, bits binary"


def _sent(rows: list) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["sketch", "block", "unit", "once", "more"])


def _filled(ordered: np.ndarray, bits: int, n_blocks: int):
    """(block, begin, end) of the blocks that hold any of these sorted numbers."""
    block, at = filled_blocks(ordered.astype(np.uint64), bits, n_blocks)
    return zip(block.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)


def _sketch_rows(unit: int, w: Windows, bits: int):
    per = min(bits, BLOCK_BITS)
    for k, h in enumerate(w.hashes):
        c, many, _ = _local(_cells(h, bits))
        low = (c & c.dtype.type((1 << per) - 1)).astype(np.uint32)
        for b, lo, hi in _filled(c, bits, 1 << (bits - per)):
            own, m = low[lo:hi], many[lo:hi]
            yield k, b, unit, squeeze_sorted(own[~m]), squeeze_sorted(own[m])


def _merge_sketches(key, rows: pa.Table) -> pa.RecordBatch:
    """Adds up a range of counters and answers each unit which of its counters exceed 1."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    once = [expand_sorted(x, np.uint32) for x in rows.column("once").to_pylist()]
    for c in once:
        count[c] = np.minimum(count[c] + 1, 2)
    for x in rows.column("more").to_pylist():
        count[expand_sorted(x, np.uint32)] = 2
    n = rows.num_rows
    return batch(unit=rows.column("unit").combine_chunks(), sketch=pa.array([key[0].as_py()] * n, pa.int32()), block=pa.array([key[1].as_py()] * n, pa.int64()), bits=pa.array([np.packbits(count[c] > 1).tobytes() for c in once], pa.binary()))


def _candidates(w: Windows, answers: dict, bits: int) -> np.ndarray:
    """Which windows the merged sketch counts more than once: the smaller of two counters decides."""
    per, ok = min(bits, BLOCK_BITS), np.ones(len(w.first), bool)
    for k, h in enumerate(w.hashes):
        c, flags, place = _local(_cells(h, bits))
        for b, lo, hi in _filled(c, bits, 1 << (bits - per)):
            m = flags[lo:hi]
            one = np.flatnonzero(~m)
            m[one] = np.unpackbits(np.frombuffer(answers[k, b], np.uint8), count=len(one)).astype(bool)
        ok &= flags[place]
    return np.flatnonzero(ok)


def _pairs(w: Windows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, hash) of these windows in order, whether each stands more than once, and each window's place."""
    a, b = w.hashes[0][at], (w.hashes[1][at] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]) if len(sa) else np.zeros(0, bool)
    place = np.empty(len(sa), np.int64)
    place[order] = np.cumsum(new) - 1
    edge = np.flatnonzero(new)
    return sa[edge], sb[edge], np.diff(edge, append=len(sa)) > 1, place


def _exact_rows(unit: int, w: Windows, at: np.ndarray, n_blocks: int):
    a, b, many, _ = _pairs(w, at)
    for k, lo, hi in _filled(a, 64, n_blocks):
        m = many[lo:hi]
        pack = lambda own: squeeze_sorted(a[lo:hi][own]) + b[lo:hi][own].tobytes()  # noqa: B023, E731
        yield 2, k, unit, int((~m).sum()).to_bytes(4, "little") + pack(~m), int(m.sum()).to_bytes(4, "little") + pack(m)


def _unpair(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(x[:4], "little")
    return expand_sorted(x[4 : len(x) - 4 * n], np.uint64), np.frombuffer(x[len(x) - 4 * n :], np.uint32)


def _count_exactly(key, rows: pa.Table) -> pa.RecordBatch:
    """Counts a range of windows over all units and answers which of those that a unit has once stand elsewhere."""
    once = [_unpair(x) for x in rows.column("once").to_pylist()]
    more = [_unpair(x) for x in rows.column("more").to_pylist()]
    a, b = (np.concatenate([x[i] for x in [*once, *more]]) for i in (0, 1))
    sure = sum(len(x[0]) for x in once)
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
    edge = np.flatnonzero(new)
    repeated = (np.diff(edge, append=len(sa)) > 1) | np.maximum.reduceat(order >= sure, edge)
    flags = np.empty(len(a), bool)
    flags[order] = repeated[np.cumsum(new) - 1]
    at, n = starts(np.array([len(x[0]) for x in once])), rows.num_rows
    return batch(unit=rows.column("unit").combine_chunks(), sketch=pa.array([2] * n, pa.int32()), block=pa.array([key[1].as_py()] * n, pa.int64()), bits=pa.array([np.packbits(flags[at[k] : at[k + 1]]).tobytes() for k in range(n)], pa.binary()))


def _answers(table: pa.Table) -> dict:
    return {(k, b): x for k, b, x in zip(table.column("sketch").to_pylist(), table.column("block").to_pylist(), table.column("bits").to_pylist(), strict=True)}


def _repeated(w: Windows, answers: dict, bits: int, n_blocks: int) -> np.ndarray:
    """The first words of the repeated windows."""
    at = _candidates(w, answers, bits)
    a, _, flags, place = _pairs(w, at)
    for k, lo, hi in _filled(a, 64, n_blocks):
        m = flags[lo:hi]
        one = np.flatnonzero(~m)
        m[one] = np.unpackbits(np.frombuffer(answers[2, k], np.uint8), count=len(one)).astype(bool)
    return w.first[at[flags[place]]]


def dedup_substrings(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of `docs`."""
    units = settle(pack_units(docs))
    words = int(units.agg(F.sum("n")).first()[0] or 0) // 6
    bits = max(20, math.ceil(math.log2(2 * words + 1)))
    n_blocks = blocks_for(words // 3, 1 << 21)

    def sketch(batches):
        use("substring")
        for b in batches:
            for unit, blob in zip(b.column("unit").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if rows := list(_sketch_rows(unit, Windows(unpack_units(blob)[1], width), bits)):
                    yield _sent(rows)

    back = settle(group_arrow(units.mapInArrow(sketch, _SENT), ["sketch", "block"], _merge_sketches, _BACK))

    def exact(key, left, right):
        use("substring")
        unit, w = key[0].as_py(), Windows(unpack_units(left.column("blob")[0].as_py())[1], width)
        return pa.Table.from_batches([_sent(list(_exact_rows(unit, w, _candidates(w, _answers(right), bits), n_blocks)))])

    def cogroup(f, answers, schema):
        return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(f, schema)

    sure = settle(group_arrow(cogroup(exact, back, _SENT), ["sketch", "block"], _count_exactly, _BACK))

    def remove(key, left, right):
        use("substring")
        ids, texts = unpack_units(left.column("blob")[0].as_py())
        w = Windows(texts, width)
        step = np.zeros(int(w.at[-1]) + width + 1, np.int32)
        first = _repeated(w, _answers(right), bits, n_blocks)
        np.add.at(step, first, 1)
        np.add.at(step, first + width, -1)
        gone = np.cumsum(step)[: int(w.at[-1])] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.at[:-1]) * (np.diff(w.at) > 0)
        kept = []
        for k, own in enumerate(w.words):
            if removed[k]:
                g = gone[w.at[k] : w.at[k + 1]]
                own = [own[i] for i in np.flatnonzero(~g).tolist()]
            kept.append(b" ".join(own))
        out = batch(doc_id=pa.array(ids, pa.int64()), n_words=pa.array(np.diff(w.at)), n_removed=pa.array(removed), kept=pa.array(kept, pa.binary()).cast(pa.string()))
        return pa.Table.from_batches([out])

    return cogroup(remove, back.unionByName(sure), "doc_id long, n_words long, n_removed long, kept string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
