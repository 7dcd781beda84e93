"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item leaks into a document if at least `threshold` of the item's
distinct five-word shingles occur in it. Items are short and documents long,
so Jaccard similarity says nothing; containment does. Items are partitioned
by size (powers of two), and each partition keeps per item the m smallest
shingle hashes, its bottom-m MinHash sketch, with m from the partition's size
bound: m = u - ceil(threshold * l) + 1 for sizes l..u, so by counting an item
with enough of its shingles in a document has one of the m there. Unlike
banded signatures this loses no pair. A document is probed with all its
shingles against the sketches, and each (document, item) candidate is
verified by exact shingle containment.

Scale: documents are only scanned. The benchmark's shingles go to the tasks
as sorted arrays; their number is counted first, and a benchmark above
`slice_shingles` is cut by item into slices of at most about that many, each
sent and probed in turn, so what a task holds is bounded and nothing is left
out. Documents found in several slices simply have several rows.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; an item of fewer than five
words is one shingle, matched in a document as that run of words only if the
document is that short itself. Defined results: null or empty texts match
nothing, on either side; repeated documents and repeated items give a row for
each pair; a null id is carried; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import blocks, distinct_pairs, documents, giving_back, shingle_hashes, words

SHINGLE = 5
THRESHOLD = 0.75
HITS = "doc_id long, item_id long, item_shingles int, shared int, containment double, doc_shingles int"
_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int32()), ("shared", pa.int32()),
                   ("containment", pa.float64()), ("doc_shingles", pa.int32())])
_ITEMS = "item_id long, shingles array<long>"


def distinct_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return distinct_pairs(*shingle_hashes(*words(data, offsets), SHINGLE))


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in blocks(batch):
            value, owner = distinct_shingles(data, offsets)
            cuts = np.searchsorted(owner, np.arange(end - start + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[start:end], pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.view(np.int64)))],
                schema=pa.schema([("item_id", pa.int64()), ("shingles", pa.list_(pa.int64()))]),
            )


class SketchIndex:
    """Shingles of a slice of items, and which of them are sketch entries."""

    def __init__(self, items: list[tuple], threshold: float):
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(s) for _, s in items], dtype=np.int64)
        self.needed = np.array([max(1, math.ceil(threshold * n - 1e-9)) for n in self.sizes], dtype=np.int64)
        values, owners, sketched = [], [], []
        for i, (_, shingles) in enumerate(items):
            v = np.sort(np.array(shingles, dtype=np.int64).view(np.uint64))
            upper = 1 << max(0, (len(v) - 1).bit_length())  # size partition (upper / 2, upper]
            lower = upper // 2 + 1
            minima = min(len(v), upper - math.ceil(threshold * lower - 1e-9) + 1)
            values.append(v)
            owners.append(np.full(len(v), i))
            sketched.append(np.arange(len(v)) < minima)
        value = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        sketch = np.concatenate(sketched) if sketched else np.zeros(0, dtype=bool)
        order = np.argsort(value, kind="stable")
        self.value, self.owner, self.sketch = value[order], owner[order], sketch[order]
        self.probe = np.unique(self.value[self.sketch])

    def candidates(self, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Documents (numbers) that hold a sketch entry of some item."""
        if not len(self.probe):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.probe, value), len(self.probe) - 1)
        return np.unique(owner[self.probe[at] == value])

    def contained(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """(item number, shared shingles) for the items that a document's sorted
        distinct shingles hold far enough."""
        at = np.searchsorted(shingles, self.value)
        here = shingles[np.minimum(at, len(shingles) - 1)] == self.value
        sketched = np.zeros(len(self.ids), dtype=bool)
        sketched[self.owner[here & self.sketch]] = True  # candidates by the sketch
        shared = np.bincount(self.owner[here], minlength=len(self.ids))
        return [(int(i), int(shared[i])) for i in np.flatnonzero(sketched & (shared >= self.needed))]


def _probe(sent, threshold: float):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SketchIndex(sent.value, threshold)
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for start, end, data, offsets in blocks(batch):
                value, owner = shingle_hashes(*words(data, offsets), SHINGLE)
                for d in index.candidates(value, owner):
                    lo, hi = np.searchsorted(owner, [d, d + 1])
                    own = np.unique(value[lo:hi])
                    for i, shared in index.contained(own):
                        size = int(index.sizes[i])
                        rows.append((ids[start + int(d)].as_py(), index.ids[i], size, shared, shared / size, len(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(_HITS)], schema=_HITS)

    return run


def _sent_slices(benchmark: DataFrame, slice_shingles: int) -> Iterator:
    """Broadcast lists of (item_id, shingles), each of about `slice_shingles`."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"),
    ).mapInArrow(_item_shingles, _ITEMS).where(F.size("shingles") > 0)
    total = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first().n
    slices = -(-total // slice_shingles) or 1
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(slices)) == s)
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.shingles) for r in part.toLocalIterator()])


def _checked(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, slice_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment, doc_shingles for every
    document and item with containment of at least `threshold`."""
    _checked(threshold)
    body = documents(docs).select("doc_id", "body")
    found = None
    for sent in _sent_slices(benchmark, slice_shingles):
        hits = body.mapInArrow(_probe(sent, threshold), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def _without_leaks(sent, threshold: float, text: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SketchIndex(sent.value, threshold)
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            body = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.binary()).fill_null(b"")], names=["body"])
            for start, _, data, offsets in blocks(body):
                value, owner = shingle_hashes(*words(data, offsets), SHINGLE)
                for d in index.candidates(value, owner):
                    lo, hi = np.searchsorted(owner, [d, d + 1])
                    clean[start + int(d)] = not index.contained(np.unique(value[lo:hi]))
            yield batch.filter(pa.array(clean))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, slice_shingles: int = 2_000_000) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no test item: one scan
    per slice of the benchmark, no shuffle."""
    _checked(threshold)
    for sent in _sent_slices(benchmark, slice_shingles):
        docs = docs.mapInArrow(_without_leaks(sent, threshold, docs.columns.index("text")), docs.schema)
    return docs
