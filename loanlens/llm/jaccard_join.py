"""N-gram Jaccard join with prefix filters under several global orders.

Documents are sets of five-word shingles (64-bit hashes); two link when
100 * |A and B| >= 75 * |A or B|. A similar pair shares at least ceil(0.75 n)
of either set's n shingles, so under any global order of shingles the first c
common ones are among the first n - ceil(0.75 n) + c of both sets. Three orders
are used, each on what the one before has left:

1. By hash, c about n / 8. Only whether a document shares enough prefix
   shingles with any other document is asked, not with which. Each batch of
   documents packs its prefixes into one binary value per hash slice, a shingle
   once per batch; a slice finds the shingles of two or more batches and
   answers with counts per document. The number of slices follows the input's
   bytes, so a slice's size doesn't. A very common shingle costs one entry
   per batch of documents. The documents left are picked in a second scan by
   a fixed-size bit table of their keys; texts are never shuffled.
2. By document frequency among the remaining distinct sets, rarest first,
   c = 1. Sets with fewer than ceil(0.75 n) shingles that other sets have are
   dropped first (counted as in 1, over whole sets), then shingles of one set;
   the rest are posting lists of (shingle, set).
3. By hash from the other end, c = 1, checked per candidate pair together with
   the first order, before the exact intersection.

Hot lists. A posting list never yields all its pairs. First every set is compared
with one other only, the least of its lists' first sets; links become components,
and only pairs of sets that are still in different components go on, with about
1, 4, 16, ... further first sets per list and round until every set of a list was
first. Sets are named by hash, so a set's name gives its place in a list and no
list is sorted or gathered. So a group of thousands of near copies costs about
as many comparisons as it has members, and no pair of unlinked sets is skipped.
A shingle common to two sets counts only where it can be their first common one:
behind it both must hold enough shingles for a link. Sets equal as a whole are
one set from step 2 on. Components are kept as names (set, label); each round
joins labels, not the sets linked before.

Defined results: null or empty texts and texts without words have no shingles
and link with nothing; a text of fewer than five words is one shingle; equal
rows are copies of each other; a null doc_id takes part, and a component's id
is its smallest non-null doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import blocks, discard, distinct_pairs, documents, give_back, giving_back, in_parts, shingle_hashes, staged, text_key, words
from loanlens.llm.components import components

SHINGLE = 5
# Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
# Bytes of text per hash slice of the first filter.
SLICE_BYTES = 32 << 20
# Size of the bit table that picks the documents left by the first filter.
KEY_BITS = 1 << 24
_SEVERAL = 0xFFFF  # entry of a shingle that several documents of the batch have
_DOCS_PER_BATCH = 60_000

_SIEVE = pa.schema([("batch", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
                    ("n", pa.int32()), ("own", pa.int32()), ("slice", pa.int32()), ("entries", pa.binary())])
SIEVE = "batch long, number int, doc_id long, text_key long, n int, own int, slice int, entries binary"
CREDITS = "batch long, number int, credit int"
_SETS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("set", pa.int64()), ("shingles", pa.list_(pa.int64()))])
SETS = "doc_id long, text_key long, n int, set long, shingles array<long>"


def at_least(n):
    """Shingles that a set of n must share with any similar set."""
    return -(-PERCENT * n // 100)


def common(n):
    """Prefix shingles asked for by the first filter, for a set of n."""
    return np.maximum(1, n // 8)


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return distinct_pairs(*shingle_hashes(*words(data, offsets), SHINGLE))


_ENTRY = np.dtype([("shingle", "<u4"), ("high", "u1"), ("number", "<u2")])


def _sieve(slices: int, read):

    def emit(batch: int, ids, keys, n: np.ndarray, value: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        del order
        at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
        times = np.diff(np.r_[at, len(value)])
        several = times > 1
        own = np.bincount(owner[np.repeat(several, times)], minlength=len(n))
        value, owner = value[at], owner[at]
        del at, times
        none = pa.nulls(len(n), pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(n), batch)), pa.array(np.arange(len(n), dtype=np.int32)), ids, keys, pa.array(n.astype(np.int32)),
            pa.array(own.astype(np.int32)), none, pa.nulls(len(n), pa.binary())], schema=_SIEVE)
        entries = np.zeros(len(value), dtype=_ENTRY)
        entries["shingle"] = value & np.uint64(0xFFFFFFFF)
        value >>= np.uint64(32)
        entries["high"] = value & np.uint64(0xFF)
        entries["number"] = np.where(several, np.uint16(_SEVERAL), owner)
        value >>= np.uint64(8)
        value *= np.uint64(slices)
        value >>= np.uint64(24)  # the slice, ascending
        cuts = np.searchsorted(value, np.arange(slices + 1).astype(np.uint64))
        del value, owner, several
        raw = [entries[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        del entries
        k = [s for s in range(slices) if raw[s]]
        no = lambda t: pa.nulls(len(k), t)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(k), batch)), no(pa.int32()), no(pa.int64()), no(pa.int64()), no(pa.int32()), no(pa.int32()),
            pa.array(k, type=pa.int32()), pa.array([raw[s] for s in k], type=pa.binary())], schema=_SIEVE)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), _DOCS_PER_BATCH):
                batch = whole.slice(at, _DOCS_PER_BATCH)
                yield from emit(number, batch.column(0), batch.column(1), *read(batch))
                number += 1

    return run


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of a batch of texts, and the shingles (with owners) of their
    prefixes by hash."""
    n = np.zeros(batch.num_rows, dtype=np.int64)
    values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]  # at most _DOCS_PER_BATCH documents
    for start, end, data, offsets in blocks(batch):
        value, owner = sets(data, offsets)
        size = np.bincount(owner, minlength=end - start)
        n[start:end] = size
        place = np.arange(len(value)) - (np.cumsum(size) - size)[owner]
        keep = place < (size - at_least(size) + common(size))[owner]
        values.append(value[keep])
        owners.append((owner[keep] + start).astype(np.uint16))
    return n, np.concatenate(values), np.concatenate(owners)


def _whole_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of a batch of sets, all shingles."""
    column = batch.column(2)
    n = np.diff(np.asarray(column.offsets)).astype(np.int64)
    return n, np.asarray(column.flatten()).view(np.uint64), np.repeat(np.arange(len(n), dtype=np.uint16), n)


def _credits(group: pd.DataFrame) -> pd.DataFrame:
    """How many shingles of a slice each document shares with other batches."""
    parts = [np.frombuffer(e, dtype=_ENTRY) for e in group["entries"]]
    whole = np.concatenate(parts)
    batch = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    value = whole["high"].astype(np.uint64)
    value <<= np.uint64(32)
    value |= whole["shingle"]
    order = np.argsort(value, kind="stable")
    value = value[order]
    same = value[1:] == value[:-1]
    shared = np.zeros(len(value), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    hit = order[shared]
    hit = hit[whole["number"][hit] != _SEVERAL]
    key, credit = np.unique(batch[hit].astype(np.int64) << 16 | whole["number"][hit], return_counts=True)
    del whole, value, order, same, shared, hit, batch
    give_back()
    return pd.DataFrame({"batch": group["batch"].to_numpy()[key >> 16], "number": (key & 0xFFFF).astype(np.int32),
                         "credit": credit.astype(np.int32)})


def _shared(rows: DataFrame, read, size: int) -> DataFrame:
    """Per row (doc_id, text_key): n, its set's size, and how many of the
    shingles read are in another row as well."""
    table = staged(rows.mapInArrow(_sieve(max(8, -(-size // SLICE_BYTES)), read), SIEVE))
    members = table.where("number is not null").select("batch", "number", "doc_id", "text_key", "n", "own")
    found = (
        table.where("slice is not null").select("slice", "batch", "entries").groupBy("slice").applyInPandas(_credits, CREDITS)
        .groupBy("batch", "number").agg(F.sum("credit").alias("credit"))
    )
    out = staged(members.join(found, ["batch", "number"], "left").select(
        "doc_id", "text_key", "n", (F.col("own") + F.coalesce("credit", F.lit(0))).alias("shared")))
    discard(table)
    return out


def sieve(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n of every document; doc_id, text_key of those that
    share enough prefix shingles to have a similar document)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    every = _shared(documents(docs), _prefixes, size)
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / 8))
    left = every.where((F.col("n") > 0) & (F.col("shared") >= needed)).select("doc_id", "text_key").distinct()
    return every.select("doc_id", "text_key", "n"), left


def _key_bits(keys: DataFrame) -> bytes:
    """A fixed-size bit table of text keys, two bits a key: at most 512 rows of
    4 KB come to the driver, however many keys there are."""
    places = F.array(F.col("text_key").bitwiseAND(KEY_BITS - 1), F.shiftrightunsigned("text_key", 32).bitwiseAND(KEY_BITS - 1))
    place = F.col("place")
    rows = keys.select(F.explode(places).alias("place")).groupBy(F.shiftright(place, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits"))
    out = bytearray(KEY_BITS // 8)
    for r in rows.collect():
        out[4096 * r.bucket : 4096 * (r.bucket + 1)] = r.bits
    return bytes(out)


def _as_sets(sent):
    """Sets of the documents whose key the bit table has; the few others that it
    lets through do no harm."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        for whole in batches:
            key = whole.column(1).to_numpy().view(np.uint64)
            known = np.ones(len(key), dtype=bool)
            for place in (key & np.uint64(KEY_BITS - 1), (key >> np.uint64(32)) & np.uint64(KEY_BITS - 1)):
                known &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            batch = whole.filter(pa.array(known))
            for start, end, data, offsets in blocks(batch):
                value, owner = sets(data, offsets)
                cuts = np.searchsorted(owner, np.arange(end - start + 1)).astype(np.int32)
                raw = memoryview(value).cast("B") if len(value) else memoryview(b"")
                name = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) - (1 << 63) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[start:end], batch.column(1)[start:end], pa.array(np.diff(cuts)), pa.array(name, type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.view(np.int64))),
                ], schema=_SETS)

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted distinct uint64) link: both prefix filters by
    hash, from either end, then the exact intersection."""
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    p, q = len(a) - at_least(len(a)) + 1, len(b) - at_least(len(b)) + 1
    for x, y in ((a[:p], b[:q]), (a[-p:], b[-q:])):
        if not np.isin(x, y, assume_unique=True).any():
            return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


@giving_back
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        keep = [similar(np.asarray(x[i].values).view(np.uint64), np.asarray(y[i].values).view(np.uint64)) for i in range(batch.num_rows)]
        yield batch.select(["la", "lb"]).filter(pa.array(keep, type=pa.bool_()))


def _posting_lists(unique: DataFrame) -> DataFrame:
    """shingle, set, n, at (the shingle's place in the set), size (of the list): the
    prefixes of sets by document frequency, lists of two or more."""
    size = 8 * (unique.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)
    shared = _shared(unique.select(F.col("set").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), "shingles"), _whole_sets, size)
    enough = staged(shared.where(F.col("shared") >= F.ceil(F.col("n") * PERCENT / 100)).select(F.col("doc_id").alias("set")))
    rows = unique.join(enough, "set", "left_semi").select("set", "n", F.explode("shingles").alias("shingle"))
    df = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(df, "shingle")
    by_set = shared.groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shingles"))
    # dropped shingles are the rarest: they come first, so they shorten the prefix
    dropped = F.col("n") - F.size("shingles")
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - dropped
    kept = by_set.where(F.size("shingles") >= F.ceil(F.col("n") * PERCENT / 100)).select(
        "set", "n", dropped.alias("dropped"), F.posexplode(F.slice("shingles", F.lit(1), prefix.cast("int"))).alias("at", "s"))
    lists = staged(kept.select("set", "n", F.col("s.shingle").alias("shingle"), (F.col("dropped") + F.col("at")).cast("int").alias("at")))
    sizes = staged(lists.groupBy("shingle").agg(F.count("*").alias("size")).where("size > 1"))
    return staged(lists.join(sizes, "shingle"))


def _may_link(n: str, at: str, other_n: str, other_at: str) -> Column:
    """Whether sets with a first common shingle at these places can link: sizes
    near enough, and shingles enough from there on in both."""
    n, at, other_n, other_at = (F.col(c) for c in (n, at, other_n, other_at))
    return (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * PERCENT) & (
        F.least(n - at, other_n - other_at) * (100 + PERCENT) >= (n + other_n) * PERCENT)


def _links(lists: DataFrame, unique: DataFrame) -> DataFrame:
    """set, label: components of sets linked by similarity (roots left out)."""
    spark = lists.sparkSession
    spans = staged(unique.select("set", "shingles").join(lists.select("set").distinct(), "set", "left_semi"))
    labels = spark.createDataFrame([], "set long, label long")
    # about how many sets of the list come before: names are hashes, hence evenly spread
    place = (F.col("set") / 2.0**64 + 0.5) * F.col("size")
    lists = lists.select("shingle", "set", "n", "at", F.col("set").alias("label"), place.alias("place"))
    rows = lists.count()
    written = None

    def linked(pairs: DataFrame) -> DataFrame:
        """Labels of the pairs (a, la, b, lb) that link."""
        pairs = staged(in_parts(pairs, rows))
        sided = pairs.join(spans.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
        checked = sided.join(spans.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").select("la", "lb", "x", "y")
        found = staged(in_parts(checked.mapInArrow(_verify, "la long, lb long"), rows).distinct())
        discard(pairs)
        return found

    def every_first(first: float, end: float) -> DataFrame:
        heads = lists.where(F.col("place") < end).select(
            "shingle", F.col("set").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), F.col("label").alias("la"))
        rest = lists.select("shingle", F.col("set").alias("b"), "n", "at", F.col("label").alias("lb"))
        return rest.join(heads, "shingle").where((F.col("b") > F.col("a")) & (F.col("la") != F.col("lb")) & _may_link("n", "at", "na", "ata")).select(
            "a", "la", "b", "lb").distinct()

    def least_first() -> DataFrame:
        heads = lists.groupBy("shingle").agg(F.min(F.struct("set", "n", "at")).alias("h")).select(
            "shingle", F.col("h.set").alias("a"), F.col("h.n").alias("na"), F.col("h.at").alias("ata"))
        rest = lists.select("shingle", F.col("set").alias("b"), "n", "at")
        met = rest.join(heads, "shingle").where((F.col("b") > F.col("a")) & _may_link("n", "at", "na", "ata"))
        return met.groupBy("b").agg(F.min("a").alias("a")).select("a", F.col("a").alias("la"), "b", F.col("b").alias("lb"))

    first, end = 0.0, 0.0  # sets at a place below `first` have met their whole list
    while True:
        found = linked(every_first(first, end) if end else least_first())
        first, end = end, 4 * end or 1.0
        if not found.isEmpty():
            renamed = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), "root")
            old = labels.join(renamed, "label", "left").select("set", F.coalesce("root", "label").alias("label"))
            labels = staged(in_parts(old.unionByName(renamed.select(F.col("label").alias("set"), F.col("root").alias("label"))), rows))
            lists = in_parts(lists.join(renamed, "label", "left"), rows).withColumn("label", F.coalesce("root", "label")).drop("root")
        mixed = lists.where(F.col("place") >= first).groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("shingle")
        before, lists = written, staged(in_parts(lists.where(F.col("place") >= first).join(mixed, "shingle", "left_semi"), rows))
        discard(before)
        written = lists
        rows = lists.count()
        if not rows:
            return labels


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component (a name of the
    document's component that is set even where its ids are null) per document."""
    every, left = sieve(docs)
    sent = docs.sparkSession.sparkContext.broadcast(_key_bits(left))  # KEY_BITS / 8 bytes
    with_sets = staged(documents(docs).mapInArrow(_as_sets(sent), SETS).where("n > 0"))
    unique = staged(with_sets.groupBy("set").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles")))
    labels = _links(_posting_lists(unique), unique)
    members = with_sets.select("doc_id", "text_key", "set").join(labels, "set", "left").withColumn("component", F.coalesce("label", "set"))
    members = staged(members.select("doc_id", "text_key", "component"))
    discard(with_sets, unique)
    ids = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = members.distinct().join(ids, "component").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "component", "component_id")
    joined = every.join(found, every["doc_id"].eqNullSafe(found["_id"]) & (every["text_key"] == found["_key"]), "left")
    return joined.select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    return linked_documents(docs).select("doc_id", "n_shingles", "component_id")


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, but of every group of linked documents
    only one row, the smallest by (doc_id, text_key)."""
    found = staged(linked_documents(docs)).where(F.col("component").isNotNull()).select("component", F.struct("doc_id", "text_key").alias("key"))
    kept = found.groupBy("component").agg(F.min("key").alias("kept"))
    state = found.groupBy("component", "key").agg(F.count("*").alias("rows")).join(kept, "component").select(
        F.col("key").alias("_key"), F.when(F.col("key") != F.col("kept"), "goes").when(F.col("rows") > 1, "repeated").otherwise("stays").alias("_state"))
    state = staged(state.where("_state <> 'stays'"))
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"))
    if state.where("_state = 'repeated'").isEmpty():
        return docs.join(state, key == F.col("_key"), "left_anti").select(*docs.columns)
    marked = docs.join(state, key == F.col("_key"), "left")
    return marked.where("_state is null").drop("_key", "_state").unionByName(
        marked.where("_state = 'repeated'").dropDuplicates(["_key"]).drop("_key", "_state"))
