"""Best-fit packing of tokenised documents into sequences.

Bounded-space online best fit: each packing task keeps a fixed number of open bins,
found through a bitset keyed by free space.  A piece goes to the open bin with the
least free space that holds it; when none holds it and all bins are open, the fullest
closes first.  A document's tokens are its text's ids and then id 0; documents longer
than a sequence are cut into full pieces and a rest.

A null or empty text is the single id 0.  Rows are packed one by one, so repeated
doc_ids give repeated pieces.  Only (doc_id, piece, start, length, crc) are shuffled;
tasks tokenise, then a number of packing shards that grows with the tokens packs, so
that open bins waste next to nothing at any size.
"""

from __future__ import annotations

import codecs
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, byte_strings, cache_of, map_arrow, ragged, settle, starts, use

CAPACITY = 2048
OPEN_BINS = 512
#: tokens of one packing shard; about 8,000 sequences
SHARD_TOKENS = 1 << 24


def _keep_first(known: dict, n: int) -> None:
    """Leaves the n entries that came first: common words come early."""
    if len(known) > n:
        first = list(islice(known.items(), n))
        known.clear()
        known.update(first)


class _Words(dict):
    """What `make` gives for a key, kept for at most `limit` keys."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            _keep_first(self, self.limit // 4)
        value = self[key] = self.make(key)
        return value


class WordTokens:
    """Token ids of texts, word by word, with bounded caches; the same ids as the tokenizer's on the whole text.

    The tokenizer drops white space and never joins tokens across it, so a word between
    ASCII white space can be encoded alone.  A word of letters, digits and plain
    punctuation splits further where the tokenizer splits, and a piece needs only the
    normaliser and the merges.  All other words go to the tokenizer whole.
    """

    WORDS, PIECES = 150_000, 600_000
    #: entries of either cache that a worker without a task holds: all of an executor's workers have been used in turn, and few have a task
    IDLE = 100_000
    #: the same of the cores of `ids_of`, whose keys and ids are short bytes; who asks for these fills neither of the others
    IDLE_CORES = 300_000
    _SPLIT = regex.compile(r"\p{L}+|\p{N}|[\p{P}\p{S}]+")
    _SPECIAL = regex.compile(r"[^\p{L}\p{N}\p{P}\p{S}]|['İ]|<\|")
    _ENDS = ".,;:!?#$%&*"

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model, self.normalize = self.tok.model, self.tok.normalizer.normalize_str
        self.words = _Words(self._word, self.WORDS)
        self.pieces: dict[str, bytes] = {}
        self.cores = _Words(self._core, self.PIECES)
        self.tails = _Words(lambda tail: self._made(tail.decode()), 10_000)
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        at = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.alphabet = "".join(at.get(b, chr(b)) for b in range(256))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            if len(self.pieces) >= self.PIECES:
                _keep_first(self.pieces, self.PIECES // 4)
            ids = self.pieces[p] = self._made(p)
        return ids

    def _made(self, p: str) -> bytes:
        if p.isascii():
            shown = p.lower()
        else:  # the normaliser composes and lower-cases
            plain = p.islower() and unicodedata.is_normalized("NFC", p)
            shown = codecs.charmap_decode((p if plain else self.normalize(p)).encode(), "strict", self.alphabet)[0]
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _core(self, core: bytes) -> bytes | None:
        """The ids of a word without the marks it ends in, if it is of letters only."""
        s = core.decode("utf-8", "replace")
        return self._made(s) if s.isalpha() and "İ" not in s else None

    def _word(self, word: bytes) -> bytes:
        s = word.decode("utf-8", "replace")
        core = s.rstrip(self._ENDS)
        if core.isalpha() and "İ" not in core:
            return self._piece(core) + self._piece(s[len(core) :]) if len(core) < len(s) else self._piece(core)
        if self._SPECIAL.search(s):
            return self._whole(s)
        return b"".join(map(self._piece, self._SPLIT.findall(s)))

    def ids(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.words.__getitem__, text.split()))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many different words, end to end, and how many each has: words that differ in the marks they end in are looked up once."""
        core = pc.ascii_rtrim(words, characters=self._ENDS)
        coded = core.dictionary_encode()
        known, first = list(map(self.cores.__getitem__, byte_strings(coded.dictionary))), coded.indices.to_numpy().astype(np.int64)
        whole = np.fromiter((k is None for k in known), bool, len(known))[first]
        marked = ~whole & (pc.binary_length(words).to_numpy() > pc.binary_length(core).to_numpy())
        short = pc.binary_length(core).to_numpy()[marked]
        table = [k or b"" for k in known]
        table += map(self.words.__getitem__, byte_strings(words.filter(pa.array(whole))))
        first[whole] = len(known) + np.arange(whole.sum())
        second = np.full(len(first), len(table) + marked.sum())  # no ids
        second[marked] = len(table) + np.arange(marked.sum())
        table += [self.tails[w[n:]] for w, n in zip(byte_strings(words.filter(pa.array(marked))), short.tolist(), strict=True)]
        table.append(b"")
        long, part = np.fromiter(map(len, table), np.int64, len(table)) // 4, np.stack([first, second], axis=1).reshape(-1)
        return np.frombuffer(b"".join(table), "<u4")[ragged(starts(long)[:-1][part], long[part])], long[part].reshape(-1, 2).sum(1)

    def rest(self) -> None:
        """At the end of a task."""
        _keep_first(self.words, self.IDLE)
        _keep_first(self.pieces, self.IDLE)
        _keep_first(self.cores, self.IDLE_CORES)


_loaded: dict[str, WordTokens] = {}
cache_of("tokens", _loaded.clear)


def word_tokens(path: str) -> WordTokens:
    """One tokenizer and its caches for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        use("packing")
        tok = word_tokens(tokenizer_path)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), binaries(b.column(1)), strict=True):
                ids = memoryview(tok.ids(t) + tail)
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at : 4 * min(n, at + capacity)]
                    for c, v in zip(cols, (i, k, at, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield batch(doc_id=pa.array(cols[0], pa.int64()), piece=pa.array(cols[1], pa.int32()), start=pa.array(cols[2], pa.int64()), length=pa.array(cols[3], pa.int64()), ids_crc32=pa.array(cols[4], pa.int64()))
        tok.rest()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """At most `limit` open bins; bit f of `bits` is set while some open bin has f free places."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset for a piece."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            own = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits &= ~(1 << free)
            self.count -= 1
        else:
            if length < self.capacity and self.count >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits &= ~(1 << fullest)
                self.count -= 1
            free, own = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(own)
            self.bits |= 1 << left
            self.count += 1
        return own, self.capacity - free


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (which carry a `length`).

    The pieces are settled first, since the number of shards follows from their tokens.
    Rows are dealt by a hash of the piece and not by its doc_id, so that one key with
    very many rows spreads.
    """
    found = settle(found)
    total = found.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            at = [bins.place(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    dealt = found.repartition(shards, "ids_crc32", "doc_id", "piece").sortWithinPartitions("ids_crc32", "doc_id", "piece")
    return dealt.mapInArrow(run, f"{cols}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity), capacity, open_bins)
