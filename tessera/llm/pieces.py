"""SentencePiece encoding with offsets, and decoding.

A model file of the byte-pair kind with byte fallback gives three things: a compiled character map
(a double-array trie over UTF-8), the pieces with their scores, and a few switches.

* Normalisation takes, at each place, the longest key of the map that starts there and writes its replacement;
  beside the text it records for each byte from which byte of the original it came.
* Merging joins the neighbouring pair with the best score, ties at the left, until none is left.  No piece
  holds a space sign after another sign, so a text falls into words that merge each for themselves.
* A piece's place in the normalised text is then projected to a span of bytes of the original.

Defined cases: a null text is an empty one; an empty text gives the begin and end ids alone; bytes that are not
UTF-8 become U+FFFD, each for itself; repeated rows and rows without an id stay rows of their own; other columns
are not taken, so their names can't clash.  Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, cache_of, map_arrow, slices, use

SPACE = "▁"
_UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 2, 3, 4, 6, 5
#: characters that one step of the merging takes at most, if a word ends there
_STRETCH = 1 << 18


class CharacterMap:
    """Longest-prefix replacement through a compiled map: a double-array trie, then its replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        self._starts: dict[str, bool] = {}

    def _walk(self, node: int, byte: int) -> tuple[int, int] | None:
        """The node below `node` along `byte`, and the place of the replacement of the key that ends there (or -1)."""
        at = node ^ byte
        unit = self.units[at] if at < len(self.units) else 0
        if unit & 0x800000FF != byte:
            return None
        below = at ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        return below, self.units[below] & 0x7FFFFFFF if unit >> 8 & 1 else -1

    def _root(self) -> int:
        return (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)

    def starts(self, char: str) -> bool:
        """True if a key may begin with this character."""
        found = self._starts.get(char)
        if found is None:
            if len(self._starts) >= 100_000:
                self._starts.clear()
            step: tuple[int, int] | None = (self._root(), -1) if self.units else None
            for byte in char.encode("utf-8", "surrogatepass"):
                step = step and self._walk(step[0], byte)
            found = self._starts[char] = step is not None
        return found

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this byte, and its replacement."""
        node, best, place = self._root(), 0, 0
        for k in range(at, len(text)):
            step = self._walk(node, text[k])
            if step is None:
                break
            node, value = step
            if value >= 0:
                best, place = k + 1 - at, value
        return (best, self.texts[place : self.texts.index(b"\0", place)]) if best else None


class Encoder:
    """A model: encode(text) gives ids with spans of original bytes, decode(ids) a text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        with open(path, "rb") as f:
            self._load(schema.ModelProto.FromString(f.read()))

    @classmethod
    def of(cls, model: bytes) -> Encoder:
        from sentencepiece import sentencepiece_model_pb2 as schema

        own = cls.__new__(cls)
        own._load(schema.ModelProto.FromString(model))
        return own

    def _load(self, model) -> None:
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or _USER in kinds or _UNUSED in kinds:
            raise ValueError("needs a byte-pair model with byte fallback, space signs first, and neither user-defined nor unused pieces")
        if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
            raise ValueError("a piece holds a space sign after another sign, so texts can't be cut into words")
        spec = model.normalizer_spec
        if not spec.escape_whitespaces:
            raise ValueError("needs a model that escapes spaces")
        self.dummy, self.strip = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == s) for s in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        #: bytes of normalised text under an id; a control id has none
        self.width = np.array([1 if k == _BYTE else len(p.piece.encode()) if k == 1 else 0 for k, p in zip(kinds, model.pieces, strict=True)], np.int64)
        unknown = model.trainer_spec.unk_surface.encode()
        self.surface = [b"" if k == _CONTROL else unknown if k == _UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if k == _BYTE else p.piece.replace(SPACE, " ").encode() for k, p in zip(kinds, model.pieces, strict=True)]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self._is_byte = np.array([k == _BYTE for k in kinds])
        self.words = _Words(self)

    # --- normalisation

    def normalise(self, raw: bytes) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of `raw` where its source begins."""
        text = raw.decode("utf-8", "surrogateescape")  # a bad byte becomes a lone surrogate, each for itself
        odd = {c for c in set(text) if "\ud800" <= c <= "\udfff" or self.map.starts(c)}
        if not odd:
            return self._spaces(raw, _characters(raw), len(raw))
        special = re.compile("[" + re.escape("".join(sorted(odd))) + "]")
        parts: list[bytes] = []
        origin: list[np.ndarray] = []
        char = byte = 0
        while char < len(text):
            found = special.search(text, char)
            stop = found.start() if found else len(text)
            if stop > char:
                plain = text[char:stop].encode()
                parts.append(plain)
                origin.append(_characters(plain) + byte)
                char, byte = stop, byte + len(plain)
            if found:
                c = text[char]
                if "\ud800" <= c <= "\udfff":
                    taken, new = 1, b"\xef\xbf\xbd"
                else:
                    taken, new = self.map.longest(raw, byte) or (len(c.encode()), c.encode())
                parts.append(new)
                origin.append(np.full(len(new), byte))
                char += len(raw[byte : byte + taken].decode("utf-8", "surrogateescape"))
                byte += taken
        return self._spaces(b"".join(parts), np.concatenate(origin), len(raw))

    def _spaces(self, text: bytes, origin: np.ndarray, end: int) -> tuple[str, np.ndarray]:
        """Spaces become space signs, with one put first; a model that asks for it loses repeated and outer ones."""
        sign = SPACE.encode()
        if self.strip and text:
            at = np.frombuffer(text, np.uint8)
            keep = (at != 32) | np.concatenate([[False], at[:-1] != 32])
            text, origin = at[keep].tobytes(), origin[keep]
        if not text:
            return "", np.full(1, end)
        blank = np.frombuffer(text, np.uint8) == 32
        origin = np.repeat(origin, np.where(blank, len(sign), 1))
        text = text.replace(b" ", sign)
        if self.dummy:
            text, origin = sign + text, np.concatenate([np.full(len(sign), origin[0]), origin])
        while self.strip and text.endswith(sign):
            text, end = text[: -len(sign)], int(origin[len(text) - len(sign)])
        return text.decode(), np.append(origin[: len(text)], end)

    # --- merging

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the best pair is joined first, the left one among equals; a sign without a piece becomes its bytes."""
        signs: list[str] = list(word)
        before, after = list(range(-1, len(signs) - 1)), [*range(1, len(signs)), -1]
        rank, heap = self.rank, []
        for left in range(len(signs) - 1):
            if found := rank.get(signs[left] + signs[left + 1]):
                heap.append((found[0], left, left + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not signs[left] or not signs[right] or len(signs[left]) + len(signs[right]) != size:
                continue
            signs[left], signs[right] = signs[left] + signs[right], ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            for one, two in ((before[left], left), (left, after[left])):
                if one >= 0 and two >= 0 and (found := rank.get(signs[one] + signs[two])):
                    heapq.heappush(heap, (found[0], one, two, len(signs[one]) + len(signs[two])))
        ids: list[int] = []
        for s in signs:
            if s in rank:
                ids.append(rank[s][1])
            else:
                ids.extend(self.bytes[b] for b in s.encode())
        return ids

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the begin and end ids, and for each the span of bytes of `raw` that it stands for."""
        return next(self.encode_all([raw]))

    def encode_all(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each; new words of the texts merge together, those of long texts a stretch at a time."""
        normal = [self.normalise(raw) for raw in raws]
        cut = [_WORD.findall(text) if len(text) <= _STRETCH else None for text, _ in normal]
        self.words.learn(w for c in cut if c for w in c)
        for raw, (text, origin), known in zip(raws, normal, cut, strict=True):
            found = [b""]
            if known is not None:
                found.extend(map(self.words.__getitem__, known))
            else:
                at = 0
                while at < len(text):
                    border = _BORDER.search(text, at + _STRETCH)
                    stop = border.start() if border else len(text)
                    some = _WORD.findall(text, at, stop)
                    self.words.learn(some)
                    found.extend(map(self.words.__getitem__, some))
                    at = stop
            ids = np.frombuffer(b"".join(found), np.uint32)
            edges = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.width[ids], out=edges[1:])
            edges = origin[edges]
            end = len(raw)
            yield np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32), np.concatenate([[0], edges[:-1], [end]]), np.concatenate([[0], edges[1:], [end]])

    # --- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, bytes that make no character become U+FFFD, the space put first goes."""
        parts = [self.surface[i] for i in ids.tolist()]
        if self.dummy or self.strip:
            for k, (i, s) in enumerate(zip(ids.tolist(), parts, strict=True)):
                if i in self.byte_of:
                    break
                if s.startswith(b" ") and self.width[i]:
                    parts[k] = s[1:]
                    if not self.strip:
                        break
                if parts[k]:
                    break
        text = b"".join(parts)
        try:
            return text.decode()
        except UnicodeDecodeError:
            return "".join(_lenient(b"".join(g)) for g in _runs(ids, parts, self._is_byte))


#: a word: space signs and what follows up to the next; and where one begins
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def _characters(text: bytes) -> np.ndarray:
    """For each byte, where its character begins."""
    at = np.arange(len(text))
    return np.maximum.accumulate(np.where(np.frombuffer(text, np.uint8) & 0xC0 == 0x80, 0, at)) if text else at


def _lenient(run: bytes) -> str:
    return re.sub("[\ud800-\udfff]", "\ufffd", run.decode("utf-8", "surrogateescape"))


def _runs(ids: np.ndarray, parts: list[bytes], is_byte: np.ndarray):
    """Parts in runs that are all bytes or hold none."""
    flags = is_byte[ids]
    edges = [0, *(np.flatnonzero(np.diff(flags)) + 1).tolist(), len(parts)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield parts[lo:hi]


class _Pairs:
    """Which two neighbours join into which piece, for many words at once.

    A sign is the id of its piece, or, for a character that is no piece, a number behind the ids; a character that
    no piece holds is the negative of its code, and joins nothing.
    """

    def __init__(self, rank: dict[str, tuple[float, int]], n_pieces: int):
        self.n_pieces = n_pieces
        self.sign = {piece: i for piece, (_, i) in rank.items()}
        for c in sorted({c for piece in rank for c in piece} - self.sign.keys()):
            self.sign[c] = n_pieces + len(self.sign)
        self.wide = max(self.sign.values()) + 1
        order = {score: k for k, score in enumerate(sorted({score for score, _ in rank.values()}))}
        found = sorted((self.sign[p[:k]] * self.wide + self.sign[p[k:]], i, order[score]) for p, (score, i) in rank.items() for k in range(1, len(p)) if p[:k] in self.sign and p[k:] in self.sign)
        self.keys, self.into, self.order = (np.array([f[k] for f in found], np.int64) for k in range(3))
        self.code = {s: c for c, s in self.sign.items() if len(c) == 1}
        self.of_code = -np.arange(0x110000, dtype=np.int32) - 1
        for c, sign in self.sign.items():
            if len(c) == 1:
                self.of_code[ord(c)] = sign

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.wide + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The signs of all words in order, and where each word's signs begin (and the end).

        In each round every word joins its best pair, the left one among equals; words without one are done.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = self.of_code[codes].astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        none = np.int64(1) << 62
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def weigh(where: np.ndarray) -> np.ndarray:
            """The order of the pair that begins at each place, smaller first; its place in the table is found again when it joins."""
            right = np.minimum(where + 1, len(signs) - 1)
            pair = np.where(word[right] == word[where], self.look(signs[where], signs[right]), -1)
            pair[where == len(signs) - 1] = -1
            return np.where(pair < 0, none, self.order[pair])

        weight = weigh(np.arange(len(signs)))
        while len(signs):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(weight, first)
            sizes = np.diff(np.append(first, len(signs)))
            best = np.repeat(least, sizes)
            over = best == none
            if over.any():
                done.append((word[over], signs[over]))
                signs, word, weight, best = signs[~over], word[~over], weight[~over], best[~over]
                if not len(signs):
                    break
            hit = np.flatnonzero(weight == best)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the left one of each word
            signs[hit] = self.into[self.look(signs[hit], signs[hit + 1])]
            keep = np.ones(len(signs), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one sign fell out before each later one
            signs, word, weight = signs[keep], word[keep], weight[keep]
            touched = np.zeros(len(signs), bool)
            touched[hit] = touched[np.maximum(hit - 1, 0)] = True
            near = np.flatnonzero(touched)
            weight[near] = weigh(near)
        word, signs = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return signs[order], np.searchsorted(word[order], np.arange(len(words) + 1))


class _Words(dict):
    """word -> its ids as bytes; a cache of bounded size that keeps short words alone."""

    LIMIT, LONGEST = 300_000, 40

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner
        self.pairs = _Pairs(owner.rank, len(owner.width))

    def learn(self, words: Iterable[str]) -> None:
        """Words that are not known merge together; other words may be forgotten for them."""
        every = set(words)
        new = [w for w in every if w not in self and len(w) <= self.LONGEST]
        if len(self) + len(new) > self.LIMIT:
            self.clear()
            new = [w for w in every if len(w) <= self.LONGEST]
        if len(new) < 20:
            return
        signs, at = self.pairs.merge(new)
        plain = (signs >= 0) & (signs < self.pairs.n_pieces)
        odd = np.add.reduceat(~plain, at[:-1]) > 0
        raw, edges = signs.astype(np.uint32).tobytes(), (4 * at).tolist()
        for k, w in enumerate(new):
            self[w] = raw[edges[k] : edges[k + 1]]
        for k in np.flatnonzero(odd).tolist():
            ids: list[int] = []
            for sign in signs[at[k] : at[k + 1]].tolist():
                if 0 <= sign < self.pairs.n_pieces:
                    ids.append(sign)
                else:
                    c = chr(-sign - 1) if sign < 0 else self.pairs.code[sign]
                    ids.extend(self.owner.bytes[b] for b in c.encode())
            self[new[k]] = np.array(ids, np.uint32).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.owner.merge(word), np.uint32).tobytes()
        if len(word) <= self.LONGEST:
            self[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}
cache_of("pieces", _encoders.clear)


def encoder(path: str) -> Encoder:
    use("pieces")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the begin and end ids), and the span of original bytes of each: starts, ends."""

    def run(batches):
        own = encoder(model)
        for b in batches:
            for part in slices(b):
                found = list(own.encode_all(binaries(part.column(1))))
                yield batch(doc_id=part.column(0), ids=_lists([f[0] for f in found], pa.int32()), starts=_lists([f[1] for f in found], pa.int32()), ends=_lists([f[2] for f in found], pa.int32()))

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and the decoded text."""

    def run(batches):
        own = encoder(model)
        for b in batches:
            every = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            ids = [x.values.to_numpy().astype("<u4") if x.is_valid else np.zeros(0, "<u4") for x in every]
            for lo in range(0, len(ids), 100):
                some = ids[lo : lo + 100]
                yield batch(
                    doc_id=b.column(0).slice(lo, len(some)),
                    n_tokens=pa.array([len(x) for x in some], pa.int64()),
                    ids_sha256=pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in some], pa.string()),
                    decoded=pa.array([own.decode(x) for x in some], pa.string()),
                )

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
