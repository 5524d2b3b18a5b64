"""Benchmark decontamination with one Aho-Corasick automaton.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased (letters, digits and everything beyond ASCII).  An item's windows are
its runs of 13 words, or all its words if it has fewer.  All windows go into one
automaton; each document is normalised (its words between single spaces) and
scanned once, and matches are mapped back to the original text.

Null or empty texts have no words: such documents are never hit, such items have no
window.  Items that share a window all count; an item without item_id hits documents
like any other, but has no name in their lists of items.  A benchmark of more than
``max_broadcast_bytes`` of text is broadcast in parts of about that size.  Each task scans its
rows with one part's automaton after the other and unites the hits of each row, so every row is judged
alone, by its own text, at every size.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, map_arrow, use

WINDOW = 13
#: bytes of text that a task holds while the parts of a benchmark of several parts are loaded in turn
ROUND = 64 << 20
#: bytes of a part's text; its automaton takes about 13 windows of 13 words for a word, some hundred times as much
PART = 8 << 20
#: every ASCII byte that is no letter or digit becomes a space, A-Z become a-z
_NORM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def norm_words(text: bytes) -> list[bytes]:
    return text.translate(_NORM).split()


def item_windows(text: bytes, width: int = WINDOW) -> list[bytes]:
    w = norm_words(text)
    if not w:
        return []
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


def build_automaton(items: list[tuple], width: int = WINDOW):
    """An automaton whose values are (number of words, numbers of the items)."""
    import ahocorasick

    owners: dict[str, set] = {}
    for k, (_, text) in enumerate(items):
        for w in item_windows(text, width):
            owners.setdefault(w.decode("utf-8", "replace"), set()).add(k)
    auto = ahocorasick.Automaton()
    for w, own in owners.items():
        auto.add_word(f" {w} ", (w.count(" ") + 1, tuple(own)))
    if owners:
        auto.make_automaton()
    return auto if owners else None


def scan(auto, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """The matches as runs of words [first, last), united, and the numbers of the items."""
    if auto is None or not words:
        return [], set()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    found = list(auto.iter(line))
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    items: set[int] = set()
    runs: list[list[int]] = []
    # a match ends on the space that follows its last word; the k-th space follows k words
    for end, (n, own) in found:
        last = int(np.searchsorted(spaces, end))
        items.update(own)
        runs.append([last - n, last])
    return unite(runs), items


def unite(runs: list) -> list[tuple[int, int]]:
    """Runs [first, last), sorted; those that overlap or touch are one."""
    joined: list[list[int]] = []
    for a, b in sorted(runs):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined]


def char_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as [start, end) in characters of the original text."""
    if not runs:
        return []
    raw = np.frombuffer(b" " + text.translate(_NORM) + b" ", np.uint8) != 32
    edge = np.diff(raw.astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[first[a]]), int(chars[last[b - 1]])) for a, b in runs]


_SCHEMA = "doc_id long, n_words long, runs array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rounds(batches, at: int, limit: int):
    """Batches in lists of at least `limit` bytes of text, but for the last."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanned(batches, shares: list, at: int, width: int):
    """Each batch with, for each of its rows, the text, its number of words, runs and items; `at` is the column of texts."""
    use("decontaminate")
    now, auto, names = None, None, []
    for held in _rounds(batches, at, ROUND if len(shares) > 1 else 0):
        texts = [binaries(b.column(at)) for b in held]
        found = [[(len(norm_words(t)), [], set()) for t in own] for own in texts]
        for k, share in enumerate(shares):
            if now != k:
                auto = None  # the one before goes before the next is built
                items = pickle.loads(zstandard.ZstdDecompressor().decompress(share.value))
                now, auto, names = k, build_automaton(items, width), [None if i is None else str(i) for i, _ in items]
            for own, rows in zip(texts, found, strict=True):
                for t, (_, runs, hit) in zip(own, rows, strict=True):
                    more, which = scan(auto, norm_words(t))
                    runs += more
                    hit.update(names[j] for j in which if names[j] is not None)
        for b, own, rows in zip(held, texts, found, strict=True):
            yield b, [(t, n, unite(runs), sorted(hit)) for t, (n, runs, hit) in zip(own, rows, strict=True)]


def _shares(benchmark: DataFrame, limit: int) -> list:
    """The benchmark broadcast in compressed parts of at most about `limit` bytes of text; the size is checked before anything is fetched."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    shares = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        own = sorted({(r[0], r[1].encode()) for r in part.collect()}, key=lambda x: (str(x[0]), x[1]))
        shares.append(benchmark.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(pickle.dumps(own))))
    return shares


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_broadcast_bytes: int = PART) -> DataFrame:
    """doc_id, n_words, the hit runs of words, their spans in the text, and the items found; one row for each row of `docs`."""
    shares = _shares(benchmark, max_broadcast_bytes)

    def run(batches):
        for b, rows in _scanned(batches, shares, 1, width):
            n = pa.array([n for _, n, _, _ in rows], pa.int64())
            runs = pa.array([[{"first": x, "last": y} for x, y in r] for _, _, r, _ in rows], _RUNS)
            spans = pa.array([[{"start": x, "end": y} for x, y in char_spans(t, r)] for t, _, r, _ in rows], _SPANS)
            yield batch(doc_id=b.column(0), n_words=n, runs=runs, spans=spans, items=pa.array([i for *_, i in rows], pa.list_(pa.string())))

    out = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, _SCHEMA)
    return out.withColumn("n_hit", F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"]))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_broadcast_bytes: int = PART) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not contaminated; row by row, without a shuffle."""
    shares = _shares(benchmark, max_broadcast_bytes)
    at = docs.columns.index("text")

    def keep(batches):
        for b, rows in _scanned(batches, shares, at, width):
            hits = [sum(y - x for x, y in r) for _, _, r, _ in rows]
            yield b.filter(pa.array([not (hit > 0 and 20 * hit >= n) for hit, (_, n, _, _) in zip(hits, rows, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
