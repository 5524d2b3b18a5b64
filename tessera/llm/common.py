"""Helpers shared by the training-data operators.

Rules that hold for every operator here:

* a null text counts as an empty one and a null key stays a row of its own;
* texts are handled as UTF-8 bytes, so that ``bytes.lower`` (A-Z only) and
  ``bytes.split`` (space and \\x09-\\x0D only) are exactly the word rules of
  the operators;
* per-row work runs in Arrow batches on the executors; Spark deals the rows.
"""

from __future__ import annotations

import gc
import math
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Python workers give freed memory back at once, as an executor's memory is shared by all its workers and its heap
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: texts are long, so a batch of Spark's 10,000 rows would hold tens of megabytes, several times over
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; workers that the session starts from then on are lean, and Arrow batches have BATCH_ROWS rows, unless the session says otherwise."""
    for k, v in LEAN.items():
        spark.sparkContext.environment.setdefault(k, v)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may do without: its executors are this machine, so a temporary folder will do.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's own setting: a query's shuffle files go when it ends; read when its frame is made
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage once its heap has taken half of what it may: Spark deletes shuffle files, broadcasts and checkpoints
    that nothing holds only then, and the heap of a driver that plans many small jobs else grows to its limit first."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        gc.collect()
        jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the pass's shuffle files go with it."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame that is made under the setting
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
        let_go(spark)


def free_name(columns: list[str], base: str) -> str:
    """A column name that none of `columns` has."""
    taken = {c.lower() for c in columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


_caches: dict[str, list[Callable[[], None]]] = {}
_user: list[str] = [""]


def cache_of(owner: str, clear: Callable[[], None]) -> None:
    """Registers a cache of the worker process that only `owner` fills."""
    _caches.setdefault(owner, []).append(clear)


def use(owner: str) -> None:
    """Called by a task: workers are used again by other operators, whose caches go first."""
    if _user[0] != owner:
        for name, clears in _caches.items():
            if name != owner:
                for clear in clears:
                    clear()
        _user[0] = owner


def binaries(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def byte_strings(col: pa.Array) -> list[bytes]:
    """The bytes of a column of strings without nulls, cut from its buffer: many short ones take a fraction of to_pylist's time."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return []
    _, places, data = col.buffers()
    at = np.frombuffer(places, np.int64)[col.offset : col.offset + len(col) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def group_arrow(df: DataFrame, keys: list[str], f: Callable[[tuple, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One call for each group of rows; None gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(key, table):
        out = f(key, table)
        return arrow.empty_table() if out is None else pa.Table.from_arrays(out.columns, schema=arrow)

    return df.groupBy(*keys).applyInArrow(run, schema)


def batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def slices(b: pa.RecordBatch, col: int = 1, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `limit` bytes of text, at least one row each, so that work on words has bounded memory."""
    size = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size + 16) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield b.slice(lo, hi - lo)


class WordHashes(dict):
    """word bytes -> 64-bit hash; a cache of bounded size."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
cache_of("hashes", _hashes.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """For each start, a hash of `width` consecutive values (Horner, modulo 2**64)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    f = np.uint64(factor)
    with np.errstate(over="ignore"):
        # doubling: hashes of 1, 2, 4 ... values, joined to the width by its binary digits
        power, span, block = f, 1, h
        done, out = 0, None
        while True:
            if width & span:
                if out is None:
                    out, done = block, span
                else:  # out covers [i, i+done), block covers the next `span` values
                    m = min(len(out), len(block) - done)
                    out = out[:m] * power + block[done : done + m]
                    done += span
            if span * 2 > width:
                break
            m = len(block) - span
            block = block[:m] * power + block[span : span + m]
            power, span = power * power, span * 2
        return mix(out[:n])


def starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def string_hashes(col: pa.Array, most: int = 256) -> np.ndarray:
    """64-bit hashes of a column of strings without nulls, eight bytes of each at a time; long ones (over `most` bytes) one by one."""
    col = col.cast(pa.large_binary())
    n = pc.binary_length(col).to_numpy().astype(np.int64)
    h = mix(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not n.any():
        return h
    _, places, data = col.buffers()
    at = np.frombuffer(places, np.int64)[col.offset : col.offset + len(col)]
    raw = data.to_pybytes() + bytes(8)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # from every byte on
    for k in np.flatnonzero(n > most).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[at[k] : at[k] + n[k]])
    own = np.flatnonzero((n > 0) & (n <= most))
    for done in range(0, most, 8):
        left = n[own] - done
        h[own] = mix(h[own] ^ (eights[at[own] + done] & (M64 >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64))))
        own = own[left > 8]
        if not len(own):
            break
    return h


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ..., n of them, for each of many runs."""
    return np.repeat(first - starts(n)[:-1], n) + np.arange(n.sum())


# --- documents packed into units -------------------------------------------------
#
# Some operators need several passes in which each document's many keys (words,
# windows) are looked up in statistics of the whole corpus.  One row for each key
# would cost far more than the keys, so documents are packed into units of a few
# megabytes, and a unit sends the statistics' blocks (ranges of hashes) one packed
# row each.  Rows stay bounded: a unit's size and a block's range are fixed.

UNIT_BYTES = 6 << 20
UNIT_SCHEMA = "unit long, n long, blob binary"


def pack_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """One row for each unit: its number, its words (upper bound) and its compressed documents."""

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush():
            nonlocal k, ids, texts, size
            inner = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, inner.schema) as w:
                w.write_batch(inner)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            out = batch(unit=pa.array([(part << 24) + k], pa.int64()), n=pa.array([size], pa.int64()), blob=pa.array([blob], pa.binary()))
            k, ids, texts, size = k + 1, [], [], 0
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), binaries(b.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t) + 16
                if size >= unit_bytes:
                    yield flush()
        if ids:
            yield flush()

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, UNIT_SCHEMA)


def pack_texts(texts: list[bytes]) -> bytes:
    """Texts as one compressed row."""
    inner = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, inner.schema) as w:
        w.write_batch(inner)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack(blob: bytes) -> list[bytes]:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().column("text").to_pylist()


def unpack_units(blob: bytes) -> tuple[list, list[bytes]]:
    inner = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return inner.column("id").to_pylist(), inner.column("text").to_pylist()


def squeeze(a: np.ndarray) -> bytes:
    """Compress an array byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Compress sorted unsigned integers by their differences."""
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(expand(b, dtype), dtype=dtype)


def blocks_for(total: int, per_block: int = 1 << 22) -> int:
    """A power of two of hash ranges, so that one holds about `per_block` of `total` keys."""
    return 1 << max(3, math.ceil(math.log2(max(total, 1) / per_block))) if total > per_block else 8


def filled_blocks(ordered: np.ndarray, bits: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted numbers of `bits` bits: the ranges that hold any, and where each begins (and the end)."""
    block = (ordered >> np.uint64(bits - int(math.log2(n_blocks)))).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    return block[at], np.append(at, len(block))
