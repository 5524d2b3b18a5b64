"""Spelling variants: words one inserted, deleted or replaced letter apart, each led to its most frequent form.

A word's vector holds how often it uses the letters of each group.  One edit changes a vector by at most one
surplus and one deficit, so the words, arranged in a trie by the successive counts, are searched depth first with
a budget of one surplus and one deficit; what a leaf holds is compared letter by letter.  Of a pair, only the word
that sees a surplus first finds the other (of equal vectors the smaller word), so each pair is found once.

The trie is spread over the cluster.  Counts of the first groups, held at CAP, give at most (CAP + 1) ** ROUTE
cells, whatever the number of words; the number of words in each cell decides on the driver how deep the upper
trie is split, until a shard has SHARD words.  A word goes to its own shard and, as a query, to each that the same
search reaches in the upper trie.  A shard reads its own words first and then streams the queries, which leave
with their number of near words and their best one, never with pairs.

Defined cases: null texts have no words, a null id counts as an empty one, repeated rows count each; a table
without words gives no rows; other columns are not taken, so their names can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, map_arrow, settle, slices

#: maximal runs of A-Z, a-z and U+00C0 to U+00FF, as UTF-8
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
MODULUS, LENGTH, SEEN, RATIO = 31, 7, 2, 10
#: letters by level of the trie; of letters beyond A-Z, those up to U+00DF are one group and the rest another
GROUPS = ("e", "t", "n", "a", "o", "i", "r", "s", "hd", "lu", "cm", "pg", "fbwy", "vkjxqz")
ROUTE, CAP, SHARD, LEAF = 6, 7, 20_000, 24
#: words of a task that are held before they are sent on, queries that search together, letters compared at once
HELD, TOGETHER, WIDE = 200_000, 40_000, 40

_GROUP_OF = np.zeros(256, np.int64)
for _g, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP_OF[ord(_c)] = _g
_GROUP_OF[0xC0:0xE0], _GROUP_OF[0xE0:] = len(GROUPS), len(GROUPS) + 1
LEVELS = len(GROUPS) + 2


def damaged(run: bytes, seed: int) -> bytes:
    """The lower-cased run, without one letter where the modulus divides its checksum."""
    h = zlib.crc32(run, seed)
    if h % MODULUS:
        return run
    word = run.decode()
    k = h % len(word)
    return (word[:k] + word[k + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: how often each word of at least LENGTH letters occurs, if at least SEEN times."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            words = list(held)
            out = batch(word=pa.array(words, pa.binary()).cast(pa.string()), n=pa.array([held[w] for w in words], pa.int64()))
            held.clear()
            return out

        for whole in batches:
            for b in slices(whole):
                for i, text in zip(b.column(0).to_pylist(), binaries(b.column(1)), strict=True):
                    seed = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                    for w, n in Counter(RUN.findall(text.lower())).items():
                        if len(w) >= LENGTH:
                            w = damaged(w, seed)
                            if len(w) - w.count(b"\xc3") >= LENGTH:
                                held[w] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    counts = map_arrow(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)


def vectors(words: list[bytes]) -> np.ndarray:
    """How often each word (in Latin-1) uses the letters of each group."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    group = _GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    place = np.repeat(np.arange(len(words)) * LEVELS, sizes) + group
    return np.bincount(place, minlength=len(words) * LEVELS).reshape(len(words), LEVELS).astype(np.int32)


def _within(d: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, orderly: bool) -> np.ndarray:
    """Whether a step by d = (target - query) keeps the budgets; an orderly search meets its surplus first."""
    return (d == 0) | ((d == 1) & ~surplus) | ((d == -1) & ~deficit & (surplus if orderly else True))


# --- the upper trie


class Upper:
    """Shards by the first counts: a shard is a prefix of them, split further where it would hold too many words."""

    def __init__(self, cells: dict[int, int], shard: int = SHARD):
        codes = np.array(sorted(cells), np.int64)
        self.sizes = np.array([cells[c] for c in codes.tolist()], np.int64)
        digits = (codes[:, None] >> (3 * np.arange(ROUTE - 1, -1, -1))) & CAP
        self.parts: list[int] = []  # of each shard
        self.root = self._node(digits, np.arange(len(codes)), 0, shard) if len(codes) else None

    def _node(self, digits: np.ndarray, own: np.ndarray, level: int, shard: int):
        total = int(self.sizes[own].sum())
        if total <= shard or level == ROUTE:
            self.parts.append(-(-total // shard))
            return len(self.parts) - 1
        at = digits[own, level]
        return {int(v): self._node(digits, own[at == v], level + 1, shard) for v in np.unique(at)}

    def reach(self, counts: np.ndarray, exact: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, words that look there); exact: words that live there.

        A count at the cap hides a difference, so a deficit may seem to come first there: both orders are followed.
        """
        n = len(counts)
        no = np.zeros(n, bool)
        stack = [(self.root, 0, np.arange(n), no, no)] if n and self.root is not None else []
        while stack:
            node, level, own, surplus, deficit = stack.pop()
            if isinstance(node, int):
                yield node, own
                continue
            here = counts[own, level]
            for v, below in node.items():
                d = v - here
                hidden = surplus | (counts[own, :level] == CAP).any(axis=1)
                ok = d == 0 if exact else (d == 0) | ((d == 1) & ~surplus) | ((d == -1) & ~deficit & hidden)
                if ok.any():
                    stack.append((below, level + 1, own[ok], surplus[ok] | (d[ok] == 1), deficit[ok] | (d[ok] == -1)))


def _code(counts: np.ndarray) -> np.ndarray:
    return (np.minimum(counts[:, :ROUTE], CAP).astype(np.int64) << (3 * np.arange(ROUTE - 1, -1, -1))).sum(axis=1)


def _latin(col: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in col.to_pylist()]


def cells(counts: DataFrame) -> dict[int, int]:
    """Words in each cell; at most (CAP + 1) ** ROUTE numbers reach the driver, however many words there are."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                code, n = np.unique(_code(vectors(_latin(b.column(0)))), return_counts=True)
                yield batch(code=pa.array(code), n=pa.array(n.astype(np.int64)))

    found = map_arrow(counts.select("word"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code: r.n for r in found.collect()}


# --- a shard


class Trie:
    """Words in the order of their vectors: a node is a range of words that agree on the first counts."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1])
        self.counts, self.n = counts[order], n[order]
        self.words = [words[i] for i in order.tolist()]
        self.letters, self.sizes = _letters(self.words)
        self.near = np.zeros(len(words), np.int64)
        self.best: list[tuple[int, bytes] | None] = [None] * len(words)

    def search(self, words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes] | None]]:
        """For each query the number of words found and the best (-n, word); the words found take note of it too."""
        counts = vectors(words)
        letters, sizes = _letters(words)
        near, best = np.zeros(len(words), np.int64), [None] * len(words)
        for q, t, same in self._candidates(counts):
            ok = one_apart(letters, sizes, words, q, self.letters, self.sizes, self.words, t)
            for k in np.flatnonzero(ok & same).tolist():
                ok[k] = words[q[k]] < self.words[t[k]]
            q, t = q[ok], t[ok]
            near += np.bincount(q, minlength=len(near))
            self.near += np.bincount(t, minlength=len(self.near))
            for a, b in zip(q.tolist(), t.tolist(), strict=True):
                there, here = (-int(self.n[b]), self.words[b]), (-int(n[a]), words[a])
                if best[a] is None or there < best[a]:
                    best[a] = there
                if self.best[b] is None or here < self.best[b]:
                    self.best[b] = here
        return near, best

    def _candidates(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (query, word) whose vectors keep the budgets, and whether they are the same: depth first, all queries that reach a node at once."""
        no = np.zeros(len(counts), bool)
        stack = [(0, 0, len(self.words), np.arange(len(counts)), no, no)]
        while stack:
            level, lo, hi, own, surplus, deficit = stack.pop()
            if hi - lo <= LEAF or level == LEVELS:
                step = max(1, 200_000 // max(1, hi - lo))
                for k in range(0, len(own), step):
                    yield from self._leaf(counts, lo, hi, own[k : k + step])
                continue
            column = self.counts[lo:hi, level]
            values = np.unique(column)
            edges = lo + np.append(np.searchsorted(column, values), hi - lo)
            here = counts[own, level]
            for v, a, b in zip(values.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                d = v - here
                ok = _within(d, surplus, deficit, orderly=True)
                if ok.any():
                    d = d[ok]
                    stack.append((level + 1, a, b, own[ok], surplus[ok] | (d == 1), deficit[ok] | (d == -1)))

    def _leaf(self, counts: np.ndarray, lo: int, hi: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, t = np.repeat(own, hi - lo), np.tile(np.arange(lo, hi), len(own))
        surplus = deficit = np.zeros(len(q), bool)
        for level in range(LEVELS):
            d = self.counts[t, level] - counts[q, level]
            ok = _within(d, surplus, deficit, orderly=True)
            q, t, d = q[ok], t[ok], d[ok]
            surplus, deficit = surplus[ok] | (d == 1), deficit[ok] | (d == -1)
        if len(q):
            yield q, t, ~surplus


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of WIDE + 1 letters, zeros behind them; longer words are cut here and compared elsewhere."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    padded = b"".join(w[: WIDE + 1].ljust(WIDE + 1, b"\0") for w in words)
    return np.frombuffer(padded, np.uint8).reshape(len(words), WIDE + 1), sizes


def one_apart(a_letters, a_sizes, a_words, a, b_letters, b_sizes, b_words, b) -> np.ndarray:
    """Whether the words a[k] and b[k] differ by exactly one edit; b is as long as a, or one letter longer."""
    ok = np.zeros(len(a), bool)
    longer = b_sizes[b] - a_sizes[a]
    short = b_sizes[b] <= WIDE
    for k in np.flatnonzero(~short).tolist():
        ok[k] = plainly_near(a_words[a[k]], b_words[b[k]])
    x, y = a_letters[a], b_letters[b]
    differ = x != y
    ok |= short & (longer == 0) & (differ.sum(axis=1) == 1)
    shifted = x[:, :-1] != y[:, 1:]
    last = np.where(shifted.any(axis=1), WIDE - 1 - shifted[:, ::-1].argmax(axis=1), -1)
    ok |= short & (longer == 1) & (last < differ.argmax(axis=1))
    return ok


def plainly_near(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


# --- queries


def near_words(counts: DataFrame, shard: int = SHARD) -> DataFrame:
    """Of distinct words with counts: word, n, n_near, form and form_n; `counts` is read several times, so it should be settled."""
    upper = Upper(cells(counts), shard)
    base = np.concatenate([[0], np.cumsum(upper.parts)]).astype(np.int64)

    def route(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                words, n = b.column(0).slice(lo, 4096), b.column(1).slice(lo, 4096).to_numpy()
                counted = np.minimum(vectors(_latin(words))[:, :ROUTE], CAP)
                for exact in (True, False):
                    for k, own in upper.reach(counted, exact):
                        parts = upper.parts[k]
                        if exact:
                            slot = base[k] + np.array([zlib.crc32(w.encode()) % parts for w in words.take(pa.array(own)).to_pylist()], np.int64)
                        else:
                            own, slot = np.repeat(own, parts), base[k] + np.tile(np.arange(parts), len(own))
                        yield batch(slot=pa.array(slot, pa.int64()), query=pa.array(np.full(len(own), not exact)), word=words.take(pa.array(own)), n=pa.array(n[own]))

    def search(batches):
        now, words, sizes, asked, asked_n, trie = None, [], [], [], [], None

        def results(of: list[bytes], near: np.ndarray, best: list):
            some = np.flatnonzero(near).tolist()
            return batch(
                word=pa.array([of[i].decode("latin-1") for i in some], pa.string()),
                n=pa.nulls(len(some), pa.int64()),
                n_near=pa.array(near[some], pa.int64()),
                best=pa.array([{"less": best[i][0], "word": best[i][1].decode("latin-1")} for i in some], pa.struct([("less", pa.int64()), ("word", pa.string())])),
            )

        def ask():
            nonlocal trie, asked, asked_n
            if words and asked:
                trie = trie or Trie(words, np.array(sizes, np.int64))
                yield results(asked, *trie.search(asked, np.array(asked_n, np.int64)))
            asked, asked_n = [], []

        def close():
            yield from ask()
            if trie:
                yield results(trie.words, trie.near, trie.best)

        for b in batches:
            slots, is_query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            latin, n = _latin(b.column(2)), b.column(3).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(slots) | np.diff(is_query)) + 1).tolist(), len(slots)] if len(slots) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if slots[lo] != now:
                    yield from close()
                    now, words, sizes, trie = slots[lo], [], [], None
                mine, mine_n = (asked, asked_n) if is_query[lo] else (words, sizes)
                mine.extend(latin[lo:hi])
                mine_n.extend(n[lo:hi])
                if len(asked) >= TOGETHER:
                    yield from ask()
        yield from close()

    schema = "word string, n long, n_near long, best struct<less: long, word: string>"
    routed = map_arrow(counts.select("word", "n"), route, "slot long, query boolean, word string, n long")
    dealt = routed.repartition(max(1, int(base[-1])), "slot").sortWithinPartitions("slot", "query")
    every = counts.select("word", "n", F.lit(None).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, word: string>").alias("best"))
    found = map_arrow(dealt, search, schema).unionByName(every)
    one = found.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), F.min("best").alias("best"))
    better = (-F.col("best.less")) >= F.col("n") * RATIO
    return one.select("word", "n", "n_near", F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n"))


def follow(words: DataFrame) -> DataFrame:
    """Adds `root`: the last word that forms lead to.  Counts grow by RATIO at each step, so there are at most 18 of them."""
    steps = words.where(F.col("form").isNotNull())
    roots = steps.select("word", F.col("form").alias("root"))
    further = steps.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        moved = settle(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        roots = moved.select("word", "root")
        if moved.where("on").isEmpty():
            break
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    return follow(settle(near_words(settle(count_words(docs, id_col, text_col)), shard)))
