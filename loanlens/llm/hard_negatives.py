"""Hard-negative mining over STR-packed R-trees.

Vectors are dealt to shards by a hash of the whole row; equal rows are one row
with a count, so neither a common vector nor a common id or label fills a shard.
Each shard is packed once into an R-tree: rows are cut into slabs by label, each
slab sorted and tiled along its widest coordinates in turn (sort-tile-recursive)
until a tile fits a leaf, and runs of `fanout` neighbours become the nodes above.
A node keeps its minimum bounding box and its least and greatest label. The
leaves are written to the shared folder as rows of their own.

A box bounds each coordinate's product with a query, q_i * [lo_i, hi_i], so the
sum of these intervals bounds the inner product from both sides. A search pops
boxes best bound first and drops those that lie outside every score window still
wanted, strictly below that window's k-th score, or whose labels can't serve.
Ties at the k-th score are kept for the smaller vec_id.

An anchor's positives are the best `positives` rows of its label; each gives a
window of scores, and the best `negatives` rows of other labels inside it are its
hard negatives. Both searches run first in the anchor's own shard, whose k-th
scores are then the floor in all others. A task reads the leaves of one shard,
then streams the anchors past them, so it holds one tree and one batch whatever
the number of anchors. All windows of an anchor share one walk.

Components are floor(256 * x); scores are integer inner products, exact below
2^62. Defined results: rows with a null vec_id, label or vector, an empty vector
or a null or non-finite component take no part; rows with the anchor's vec_id are
neither its positives nor its negatives; an anchor row that occurs again counts
once, any other row as often as it occurs; vectors of another dimension are no
candidates; a positive without rows in its window has no rows; an empty table
gives an empty result.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import staged

LEAVES = "dim int, shard int, leaf int, ids binary, labels binary, counts binary, vectors binary"
HITS = "aid long, want long, vec_id long, score long"
_LEAVES = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("leaf", pa.int32())]
                    + [(c, pa.binary()) for c in ("ids", "labels", "counts", "vectors")])
_HITS = pa.schema([("aid", pa.int64()), ("want", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NO_FLOOR = -(1 << 62)


def tiles(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of every leaf, in packing order."""
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    slabs, start = [], 0
    for cut in [*cuts, len(order)]:  # whole labels, one leaf's worth at least
        if cut - start >= leaf or cut == len(order):
            slabs.append(order[start:cut])
            start = cut
    out: list[np.ndarray] = []
    for slab in slabs:
        own = vectors[slab]
        widest = np.argsort(own.min(axis=0) - own.max(axis=0), kind="stable")
        todo = [(slab, 0)]
        while todo:
            rows, depth = todo.pop()
            pages = -(-len(rows) // leaf)
            if pages <= 1:
                out.append(rows)
                continue
            left = max(1, min(len(widest), math.ceil(math.log2(pages))) - depth)  # coordinates still to tile
            cut = max(2, math.ceil(pages ** (1 / left)))
            rows = rows[np.argsort(vectors[rows, widest[depth % len(widest)]], kind="stable")]
            size = -(-pages // cut) * leaf
            todo += [(rows[at:at + size], depth + 1) for at in range(0, len(rows), size)][::-1]
    return out


class RTree:
    """Leaves with their rows, and boxes of all nodes: leaves first, the root last."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], fanout: int = 8):
        self.leaves = leaves  # ids, labels, counts, vectors
        self.low = [v.min(axis=0) for _, _, _, v in leaves]
        self.high = [v.max(axis=0) for _, _, _, v in leaves]
        self.labels = [(int(own.min()), int(own.max())) for _, own, _, _ in leaves]
        self.children: list[list[int]] = [[] for _ in leaves]
        level = list(range(len(leaves)))
        while len(level) > 1:
            above = []
            for at in range(0, len(level), fanout):
                own = level[at:at + fanout]
                above.append(len(self.children))
                self.children.append(own)
                self.low.append(np.min([self.low[c] for c in own], axis=0))
                self.high.append(np.max([self.high[c] for c in own], axis=0))
                self.labels.append((min(self.labels[c][0] for c in own), max(self.labels[c][1] for c in own)))
            level = above
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.largest = max(float(np.abs(self.low).max(initial=0)), float(np.abs(self.high).max(initial=0)))
        self._floating: RTree | None = None

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of `q` with any point of each box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return self.low @ up + self.high @ down, self.high @ up + self.low @ down

    def floating(self) -> RTree:
        """The same tree with floating-point boxes and vectors, which multiply faster."""
        if self._floating is None:
            other = copy.copy(self)
            other.low, other.high = self.low.astype(np.float64), self.high.astype(np.float64)
            other.leaves = [(*rest, v.astype(np.float64)) for *rest, v in self.leaves]
            self._floating = other
        return self._floating


def search(tree: RTree, q: np.ndarray, own_id: int, label: int, same: bool, windows: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(window number, vec_id, score): in each window [least, greatest], the k
    best rows with the label (`same`) or with another one."""
    if float(np.abs(q).max(initial=0)) * tree.largest * len(q) < 2.0**52:  # exact in floating point
        tree, q = tree.floating(), q.astype(np.float64)
    least, greatest = tree.intervals(q)
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    floors = [lo for lo, _ in windows]
    tops = [hi for _, hi in windows]

    def serves(node: int) -> bool:
        lo, hi = tree.labels[node]
        if not (lo <= label <= hi) if same else lo == hi == label:
            return False
        return any(greatest[node] >= floor and least[node] <= top for floor, top in zip(floors, tops) if floor <= top)

    cap = max(tops, default=0)
    root = len(tree.children) - 1
    boxes = [(-min(greatest[root], cap), root)] if serves(root) else []
    while boxes:
        _, node = heapq.heappop(boxes)
        if not serves(node):  # floors have risen since
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                if serves(child):
                    heapq.heappush(boxes, (-min(greatest[child], cap), child))
            continue
        ids, labels, counts, vectors = tree.leaves[node]
        scores = vectors @ q
        fits = ((labels == label) if same else (labels != label)) & (ids != own_id)
        for w, heap in enumerate(best):
            at = np.flatnonzero(fits & (scores >= floors[w]) & (scores <= tops[w]))
            if len(at) > 4 * k:  # no more than the best few of the leaf can enter
                kth = np.partition(scores[at], len(at) - k)[len(at) - k]
                at = at[scores[at] >= kth]
            for i in at:
                entry = (int(scores[i]), -int(ids[i]))
                for _ in range(min(k, int(counts[i]))):
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            if len(heap) == k:
                floors[w] = max(floors[w], heap[0][0])
    return [(w, -vec, score) for w, heap in enumerate(best) for score, vec in heap]


def _pack(leaf: int):
    def run(part: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if part.num_rows:
            dim, shard = part.column("dim")[0].as_py(), part.column("shard")[0].as_py()
            values = part.column("vector").combine_chunks()
            vectors = (values.flatten() if isinstance(values, pa.ListArray) else pa.concat_arrays([c.flatten() for c in values.chunks])).to_numpy(
                zero_copy_only=False).reshape(part.num_rows, -1)
            ids, labels, counts = (part.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label", "n"))
            rows = [(dim, shard, i, *(np.ascontiguousarray(x[at], dtype=np.int64).tobytes() for x in (ids, labels, counts, vectors)))
                    for i, at in enumerate(tiles(vectors, labels, leaf))]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(_LEAVES)], schema=_LEAVES)

    return run


def _loaded(leaves: list[tuple], dim: int) -> RTree:
    out = []
    for ids, labels, counts, vectors in leaves:
        out.append((*(np.frombuffer(x, dtype=np.int64) for x in (ids, labels, counts)), np.frombuffer(vectors, dtype=np.int64).reshape(-1, dim)))
    return RTree(out)


def _stream(k: int, same: bool):
    """Per shard: leaf rows first, then anchors, in any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves, tree = None, [], None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            where = list(zip(col["dim"].to_pylist(), col["shard"].to_pylist()))
            asked = col["aid"].to_pylist()
            for at, key in enumerate(where):
                if key != now:
                    now, leaves, tree = key, [], None
                if asked[at] is None:
                    leaves.append(tuple(col[c][at].as_py() for c in ("ids", "labels", "counts", "vectors")))
                    continue
                if leaves:
                    tree, leaves = _loaded(leaves, key[0]), []
                if tree is None:
                    continue
                q = col["wanted"][at].values.to_numpy(zero_copy_only=False).astype(np.int64)
                wants = col["wants"][at].as_py()
                windows = [[max(w["least"], w["floor"]), w["greatest"]] for w in wants]
                found = search(tree, q, col["anchor_id"][at].as_py(), col["own_label"][at].as_py(), same, windows, k)
                out += [(asked[at], wants[w]["want"], vec, score) for w, vec, score in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=pa.int64()) for i in range(4)], schema=_HITS)

    return run


_LEAF_COLUMNS = ["leaf", "ids", "labels", "counts", "vectors"]
_ANCHOR_COLUMNS = ["aid", "anchor_id", "own_label", "wanted", "wants"]


def _searched(leaves: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """Hits of `anchors` (dim, shard, and _ANCHOR_COLUMNS) in their shards."""
    both = leaves.unionByName(anchors, allowMissingColumns=True)
    ordered = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("leaf").asc_nulls_last())
    return ordered.select("dim", "shard", *_LEAF_COLUMNS, *_ANCHOR_COLUMNS).mapInArrow(_stream(k, same), HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("aid", "want").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _everywhere(leaves: DataFrame, anchors: DataFrame, shards: int, k: int, same: bool) -> DataFrame:
    """The k best of every (anchor, window): its own shard first, then the
    others with the k-th score found there as floor. `wants` holds structs of
    want, least, greatest, floor."""
    first = staged(_searched(leaves, anchors.withColumnRenamed("home", "shard"), k, same))
    if shards == 1:
        return _best(first, k)
    kth = first.groupBy("aid", "want").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("found")).where(F.col("found") == k)
    floors = kth.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("want", "kth"))).alias("kths"))  # one entry per window
    raised = anchors.join(floors, "aid", "left").withColumn("wants", F.transform("wants", lambda w: F.struct(
        w["want"].alias("want"), w["least"].alias("least"), w["greatest"].alias("greatest"),
        F.coalesce(F.element_at("kths", w["want"]), F.lit(NO_FLOOR)).alias("floor")))).drop("kths")
    others = raised.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home").drop("home")
    return _best(first.unionByName(_searched(leaves, others, k, same)), k)


def mine(vectors: DataFrame, is_anchor: Column, label: str | Column = "label", positives: int = 5, negatives: int = 3,
         least: int = 50, greatest: int = 95, shard_rows: int = 4096, leaf: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, embedding and a label; `is_anchor` is a condition on
    vec_id. A negative's score is at least `least` and at most `greatest` percent
    of its positive's.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    own = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(F.col("vec_id").isNotNull() & own.isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), own.cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    rows = staged(rows.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("vector")))
    shards = -(-rows.count() // shard_rows) or 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(shards)).cast("int"))
    leaves = staged(dealt.groupBy("dim", "shard").applyInArrow(_pack(leaf), LEAVES))
    anchors = staged(dealt.where(is_anchor).select(
        "dim", F.col("shard").alias("home"), F.monotonically_increasing_id().alias("aid"), F.col("vec_id").alias("anchor_id"),
        F.col("label").alias("own_label"), F.col("vector").alias("wanted")))

    def window(want: Column, lo: Column, hi: Column) -> Column:
        return F.struct(want.cast("long").alias("want"), lo.cast("long").alias("least"), hi.cast("long").alias("greatest"), F.lit(NO_FLOOR).alias("floor"))

    any_score = F.array(window(F.lit(0), F.lit(NO_FLOOR), F.lit(-NO_FLOOR)))
    found = staged(_everywhere(leaves, anchors.withColumn("wants", any_score), shards, positives, same=True).select(
        "aid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    # ceil and floor of whole percentages; equal scores share a window
    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(score * least / 100), F.floor(score * greatest / 100)
    asked = found.select("aid", window(F.col("positive_score"), low, high).alias("w")).where("w.least <= w.greatest")
    asked = asked.groupBy("aid").agg(F.collect_set("w").alias("wants"))  # at most `positives` windows
    hits = _everywhere(leaves, anchors.join(asked, "aid"), shards, negatives, same=False)
    return (
        found.join(hits.select("aid", F.col("want").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"),
                   ["aid", "positive_score"])
        .join(anchors.select("aid", "anchor_id"), "aid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def relabelled() -> Column:
    """The label with every seventh row's moved to the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
