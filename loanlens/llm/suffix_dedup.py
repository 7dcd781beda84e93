"""Removal of repeated byte strings by sparse distributed prefix doubling.

A byte goes if some `length`-byte string covering it also starts anywhere
else. Ranking the suffix of every byte position would shuffle more than a
dozen times the input per round, so doubling starts from a sparse but
complete set of positions and only survivors are ranked further:

1. Rank at h = length / 2. Every window of `length` bytes has an anchor, the
   h-byte string in it with the least hash. Runs of consecutive window starts
   with one anchor position form a row (about one per length / 4 bytes): the
   anchor's rank (hash), the first start, the number of starts, and the hash
   of the row's hull, all bytes its windows cover. Equal windows have equal
   anchors at the same offset, so a row whose anchor rank is unique has no
   repeated window and is dropped here ("until unique").
2. Hulls. Rows with one hull are equal as a whole: if there are two or more,
   all their windows repeat. One row stands for them from here on.
3. Anchors with several hulls. The pair of ranks at offsets 0 and h names each
   window (h + h = length, "past the threshold"): per anchor the distinct
   hulls come together, their windows are ranked by these pairs, and windows
   whose rank occurs twice are repeats. An anchor with more than `group_rows`
   hulls is not gathered: its rows are cut in two by distance to the anchor,
   re-ranked by the longer string that all windows of a half share, and go
   round again; at a single distance a count is the whole answer.

Ranks are 64-bit hashes where they only sieve, and 128 bits where they decide.
Rows, candidates and spans are written to the shared folder between steps, so
a lost executor costs a task, not the job. A window's copies are counted by
partial aggregation: a passage in a third of all documents is one row per task.

Texts are their UTF-8 bytes. Defined results: a null text is empty; texts
shorter than `length` lose nothing; equal rows are documents of their own, so
copies of a long enough text lose everything; a null or repeated doc_id is
carried; an empty table gives an empty result. Rows equal in doc_id and text
share one list of distinct spans, however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import Windows, blocks, documents, occurring_again, staged

LENGTH = 400
# Starts of one text looked at together; longer texts are cut, each part with the bytes its windows need.
PART_STARTS = 1 << 22

_KEY = [("doc_id", pa.int64()), ("text_key", pa.int64())]
_ROWS = pa.schema([*_KEY, ("rank", pa.int64()), ("hull_a", pa.int64()), ("hull_b", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("lead", pa.int32())])
ROWS = "doc_id long, text_key long, rank long, hull_a long, hull_b long, start long, n int, lead int"
_HULLS = pa.schema([*_KEY, ("rank", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("done", pa.bool_()),
                    ("lo", pa.int32()), ("hi", pa.int32()), ("hull", pa.binary())])
HULLS = "doc_id long, text_key long, rank long, start long, n int, lead int, done boolean, lo int, hi int, hull binary"
SPANS = "doc_id long, text_key long, start long, n int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values (block prefix/suffix minima)."""
    n = len(value)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = value
    grid = padded.reshape(rows, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchored_rows(data: np.ndarray, offsets: np.ndarray, length: int):
    """Rows of a block: document number, rank, hull hash, first start in the
    block, number of starts, and how far the anchor is from the first start."""
    h = length // 2
    if len(data) < length:
        return None
    windows = Windows(data)
    rank = windows.sliding(h)
    position = np.arange(len(rank), dtype=np.uint64)
    least = sliding_least((rank & ~np.uint64(0xFFFFFF)) | position, length - h + 1)
    starts = np.arange(len(least))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + length <= offsets[doc + 1]
    starts, doc, least = starts[valid], doc[valid], least[valid]
    if not len(starts):
        return None
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    n = np.diff(np.r_[first, len(starts)])
    at = starts[first]
    anchor = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    return doc[first], rank[anchor], windows.hashes(at, at + n - 1 + length), at, n, anchor - at


def _anchor(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for start, end, data, offsets in blocks(batch):
                parts = [(0, data, offsets)]
                if end == start + 1 and len(data) > PART_STARTS + length:
                    parts = [(at, (x := data[at : at + PART_STARTS + length - 1]), np.array([0, len(x)]))
                             for at in range(0, len(data) - length + 1, PART_STARTS)]
                for base, part, cuts in parts:
                    found = anchored_rows(part, cuts, length)
                    if found is None:
                        continue
                    doc, rank, hull, at, n, lead = found
                    raw = memoryview(part)
                    second = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(at.tolist(), (at + n - 1 + length).tolist())),
                                         dtype=np.uint64, count=len(at))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(start + doc)), keys.take(pa.array(start + doc)), pa.array(rank.view(np.int64)),
                        pa.array(hull.view(np.int64)), pa.array(second.view(np.int64)), pa.array(base + at - cuts[doc]),
                        pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)),
                    ], schema=_ROWS)

    return run


def _cut_hulls(length: int):
    """The bytes of each row's hull, from its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, body, rows in zip(*(batch.column(i) for i in range(4))):
                raw = body.as_buffer()
                for r in rows.as_py():
                    out.append((doc_id.as_py(), key.as_py(), r["rank"], r["start"], r["n"], r["lead"], r["done"], 0, length - length // 2,
                                raw[r["start"] : r["start"] + r["n"] - 1 + length].to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], type=f.type) for k, f in enumerate(_HULLS)], schema=_HULLS)

    return run


def _window_ranks(hulls: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank pairs (at offsets 0 and length / 2) of all windows of the hulls, and
    the hull that each belongs to."""
    h = length // 2
    data = np.frombuffer(b"".join(hulls), dtype=np.uint8)
    size = np.array([len(x) for x in hulls])
    n = size - length + 1
    owner = np.repeat(np.arange(len(hulls)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
    return Windows(data, 2).hashes(starts, starts + h), Windows(data, 3).hashes(starts + h, starts + length), owner


def _repeats(length: int):
    """One anchor's distinct hulls: the starts whose window's rank pair occurs again."""

    schema = pa.schema([*_KEY, ("start", pa.int64()), ("n", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        first, second, owner = _window_ranks(group.column("hull").to_pylist(), length)
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        again = np.zeros(len(order), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= ~group.column("done").to_numpy()[owner]
        at = np.flatnonzero(again)
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])][: len(at)])
        rows = owner[at[cut]]
        start = group.column("start").to_numpy()[rows] + at[cut] - np.searchsorted(owner, rows)
        return pa.Table.from_arrays([
            group.column("doc_id").take(pa.array(rows)), group.column("text_key").take(pa.array(rows)), pa.array(start),
            pa.array(np.diff(np.r_[cut, len(at)]).astype(np.int32))], schema=schema)

    return run


def _halves(length: int):
    """Each row as up to two, one per half of the distances lo..hi between a
    window's start and the anchor; ranked by the bytes that every window of
    that half has, a longer string around the anchor than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                lead, last, middle = r["lead"], r["lead"] - r["n"] + 1, (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                    far, near = min(hi, lead), max(lo, last)
                    if near > far:
                        continue
                    core = r["hull"][lead - lo : lead + length - hi]
                    rank = xxhash.xxh3_64_intdigest(core, seed=lo * length + hi)
                    at, n = lead - far, far - near + 1
                    out.append((r["doc_id"], r["text_key"], rank - (1 << 63), r["start"] + at, n, far, r["done"], lo, hi,
                                r["hull"][at : at + n - 1 + length]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], type=f.type) for k, f in enumerate(_HULLS)], schema=_HULLS)

    return run


def _by_document(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row per document with rows: its key and the list of its rows."""
    return rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct(*columns)).alias(name))


def _windows_in_hot_groups(hulls: DataFrame, length: int, group_rows: int) -> list[DataFrame]:
    """Spans found in groups by rank; larger groups are halved and ranked again."""
    spans = []
    while True:
        sizes = hulls.groupBy("rank").agg(F.count("*").alias("rows"))
        large = sizes.where(F.col("rows") > group_rows).select("rank")
        small = sizes.where(F.col("rows").between(2, group_rows)).select("rank")
        spans.append(staged(
            hulls.join(small, "rank", "left_semi").groupBy("rank").applyInArrow(_repeats(length), SPANS)))
        if large.isEmpty():
            return spans
        hot = hulls.join(large, "rank", "left_semi")
        split = staged(hot.mapInArrow(_halves(length), HULLS).withColumn("hull_key", F.sha2("hull", 256)))
        # rows with one hull again count as one; at one distance, that is the whole answer
        counted = split.groupBy("rank", "hull_key").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "start")).alias("kept"))
        counted = split.join(counted, ["rank", "hull_key"])
        repeated = counted.where((F.col("copies") > 1) & ~F.col("done"))
        spans.append(staged(repeated.select("doc_id", "text_key", "start", "n")))
        hulls = staged(
            counted.where((F.col("lo") < F.col("hi")) & F.struct("doc_id", "text_key", "start").eqNullSafe(F.col("kept")))
            .select("doc_id", "text_key", "rank", "start", "n", "lead", (F.col("done") | (F.col("copies") > 1)).alias("done"), "lo", "hi", "hull"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_rows: int = 20_000) -> DataFrame:
    """doc_id, text_key, start, n: the starts start..start+n-1 of windows of
    `length` bytes that also start elsewhere. Rows are distinct, so N equal rows
    of the table have the spans of one; one document's rows may overlap."""
    if length < 2 or group_rows < 2:
        raise ValueError("length and group_rows must be at least 2")
    body = documents(docs)
    rows = staged(body.where(F.octet_length("body") >= length).mapInArrow(_anchor(length), ROWS))
    candidates = staged(rows.join(occurring_again(rows, "rank"), "rank", "left_semi"))
    hulls = staged(candidates.groupBy("rank", "hull_a", "hull_b").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "start", "n", "lead")).alias("kept")))
    copied = staged(hulls.where("copies > 1").select("rank", "hull_a", "hull_b"))
    whole = candidates.join(copied, ["rank", "hull_a", "hull_b"], "left_semi")
    kept = hulls.join(occurring_again(hulls, "rank"), "rank", "left_semi").select("kept.*", "rank", (F.col("copies") > 1).alias("done"))
    wanted = _by_document(kept, "rows", ["rank", "start", "n", "lead", "done"])
    cut = body.join(wanted, body["doc_id"].eqNullSafe(wanted["_id"]) & (body["text_key"] == wanted["_key"]))
    # equal rows of the table give the same hulls: one of them stands for all
    cut = staged(cut.select("doc_id", "text_key", "body", "rows").mapInArrow(_cut_hulls(length), HULLS)
                 .dropDuplicates(["doc_id", "text_key", "start"]))
    spans = whole.select("doc_id", "text_key", "start", "n")
    for found in _windows_in_hot_groups(cut, length, group_rows):
        spans = spans.unionByName(found)
    return spans.dropDuplicates(["doc_id", "text_key", "start", "n"])


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by [start, end) spans; touching spans join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[new].tolist(), ends[np.r_[new[1:] - 1, len(ends) - 1]].tolist()))


def kept_and_removed(body: bytes, spans: list[dict] | None, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    if not spans:
        return body, []
    starts = np.array([s["start"] for s in spans], dtype=np.int64)
    removed = merged_spans(starts, starts + np.array([s["n"] for s in spans], dtype=np.int64) - 1 + length)
    kept, at = [], 0
    for a, b in removed:
        kept.append(body[at:a])
        at = b
    return b"".join([*kept, body[at:]]), removed


def _digest(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, digest = [], [], [], []
            for body, spans in zip(batch.column(1), batch.column(2)):
                body = body.as_py()
                kept, removed = kept_and_removed(body, spans.as_py(), length)
                size.append(len(body))
                gone.append(len(body) - len(kept))
                runs.append(len(removed))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (size, gone, runs)), pa.array(digest, type=pa.string())], schema=schema)

    return run


def _with_spans(docs: DataFrame, length: int, group_rows: int) -> DataFrame:
    spans = repeated_spans(docs, length, group_rows)
    body = documents(docs)
    found = _by_document(spans, "spans", ["start", "n"])
    return body.join(found, body["doc_id"].eqNullSafe(found["_id"]) & (body["text_key"] == found["_key"]), "left").select(
        "doc_id", "body", "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_rows: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    return _with_spans(docs, length, group_rows).mapInArrow(_digest(length), RESULT)
