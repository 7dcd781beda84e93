"""Helpers shared by the training-data operators.

Identity of a row. Operators that come back to a document's text join on
`(doc_id, text_key)`, `text_key` being a 64-bit hash of the text: a null or
repeated `doc_id` is no problem, and rows equal in both are interchangeable.

Hashes. `Windows` gives 64-bit polynomial hashes of any byte range of a block
of texts in O(1) from prefix sums, so all windows or words of a block are
hashed in a few vectorised numpy steps.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text handled at a time inside a task; one longer text is a block of its own.
BLOCK_BYTES = 1 << 19
# A text longer than this is split into words piece by piece, which bounds the arrays in memory.
PIECE_BYTES = 1 << 22
# Bytes of one Arrow batch between Spark and its Python workers, in `bounded_batches`.
BATCH_BYTES = "4m"

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared folder, `spark.checkpoint.dir`.

    Where that setting is absent, a session in one local process (tests) gets
    a temporary folder; a session with executors of its own must name one.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loanlens-llm-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps neither
    recompute it nor depend on one executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by `staged`; only once everything made from them
    has been written as well."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def in_parts(df: DataFrame, rows: int, per_part: int = 100_000) -> DataFrame:
    """`df` in about rows / per_part tasks (8 at least), for steps over small
    tables on sessions with many shuffle partitions."""
    return df.coalesce(max(8, -(-rows // per_part)))


def occurring_again(df: DataFrame, by: str, least: int = 2) -> DataFrame:
    """The values of column `by` with `least` rows or more, written down: a join
    with them then reads two plain shuffles, so a hot value can be split."""
    return staged(df.groupBy(by).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= least).select(by))


def bounded_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by BATCH_BYTES (one row is never cut), where the session
    says nothing of its own: by default it may take 64 MB, some times over in each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def give_back() -> None:
    """Return a worker's freed memory to the system, Arrow's and the allocator's.
    Workers live on after a task, and idle ones would keep their highest mark."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A partition function that gives back its memory at the end."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def text_key(text: str | Column = "text") -> Column:
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the text's UTF-8 bytes; a null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"),
    )


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def blocks(batch: pa.RecordBatch, column: str = "body") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about BLOCK_BYTES."""
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_binary(array.type):
        array = array.cast(pa.binary())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
    start = 0
    while start < len(array):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, side="right")) - 1)
        end = min(end, len(array))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_remembered_powers = lru_cache(maxsize=6)(_powers_of)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of `base`. A worker remembers them for usual blocks only, in one size
    (6 arrays of 16 * BLOCK_BYTES bytes at most), not for longer texts."""
    usual = 2 * BLOCK_BYTES
    return _remembered_powers(base, usual)[:n] if n <= usual else _powers_of(base, n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """64-bit hashes of byte ranges of one block: equal bytes, equal hash."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = (_BASE * (2 * seed + 1) | 1) & _MASK
        size = 1 << max(16, int(len(data) + 1).bit_length())
        self._inverse = _powers(pow(base, -1, 1 << 64), size)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values(seed)[data] * _powers(base, size)[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def sliding(self, width: int) -> np.ndarray:
        """The hash of every window of `width` bytes, by its start."""
        n = len(self._sums) - width
        return mixed((self._sums[width:] - self._sums[:n]) * self._inverse[:n])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word `[^\\x20\\x09-\\x0D]+` of a block, A-Z lower-cased: its 64-bit
    hash, and its document's number within the block (ascending)."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(offsets) == 2 and len(data) > PIECE_BYTES:  # one very long text: in pieces that end between words
        found, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE_BYTES)
            gap = _SPACE[data[end:]]
            end = end + int(np.argmax(gap)) if gap.any() else len(data)
            found.append(_words(data[at:end], np.array([0, end - at]))[0])
            at = end
        value = np.concatenate(found)
        return value, np.zeros(len(value), dtype=np.int64)
    return _words(data, offsets)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Windows(low).hashes(starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(word_hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every `width`-word shingle; an owner with fewer words
    gives its whole sequence as one shingle. Ordered by owner, not distinct."""
    n = len(word_hashes)
    if not n:
        return word_hashes, owner
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[first, n])
    value = np.zeros(n, dtype=np.uint64)
    used = np.zeros(n, dtype=np.uint64)
    end = np.repeat(first + count, count)
    at = np.arange(n)
    for j in range(width):
        here = at + j < end
        source = np.minimum(at + j, n - 1)
        factor = np.uint64((_BASE * (2 * j + 3) | 1) & _MASK)
        value += np.where(here, (word_hashes[source] | np.uint64(1)) * factor + (word_hashes[source] >> np.uint64(7)), np.uint64(0))
        used += here.astype(np.uint64)
    keep = (at + width <= end) | ((np.repeat(count, count) < width) & (at == np.repeat(first, count)))
    return mixed(value + used)[keep], owner[keep]


def distinct_pairs(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, ordered by owner, then value."""
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]
