"""Exact top-k inner-product search: one KD-tree per shard of vectors.

Vectors are dealt to shards of about `shard_rows` rows by a hash of their id.
A shard's tree splits at the median of the widest dimension and keeps tight
bounding boxes. For a query q, no vector in a box scores more than the sum of
max(q_i * lo_i, q_i * hi_i); a search opens boxes best bound first and stops
when the best bound left is below the k-th score found so far.

The k-th score is propagated: every query is first searched in one home shard,
and starts in all other shards with that k-th score as its floor, so their
boxes are pruned from the outset. Queries meet shards in blocks of
`query_block`: a task holds one shard and one block, whatever their numbers.
The best k of a query are merged from at most k rows per shard.

Components are floor(256 * x); scores are integer inner products, exact in 64
bits. Defined results: a null vector, one with a null or non-finite component,
and a null vec_id take no part; rows with the query's vec_id are no candidates
for it; a repeated query row counts once, a repeated candidate row as often as
it occurs; vectors of another dimension are no candidates; a query without
candidates has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import staged

HITS = "query_id long, vec_id long, score long"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Tree:
    """KD-tree over integer vectors, as arrays of nodes in heap-free preorder."""

    def __init__(self, vectors: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            node = len(self.span)
            own = vectors[self.order[start:end]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            self.span.append((start, end))
            self.children.append(None)
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            widest = int(np.argmax(hi - lo))
            if end - start > leaf and hi[widest] > lo[widest]:
                middle = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, widest], middle)]
                todo += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the score of every (query, node)."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query number, vec_id, score): the best k at or above the query's floor.

    Ties at the k-th score are kept for the smaller vec_id, so a box is opened
    as long as its bound reaches the k-th score.
    """
    ids = ids[tree.order]
    bounds = tree.bounds(queries)
    for number, (query, own, floor) in enumerate(zip(queries, query_ids, floors)):
        reach = bounds[number]
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
        boxes = [(-reach[0], 0)]
        while boxes and -boxes[0][0] >= floor:
            _, node = heapq.heappop(boxes)
            pair = tree.children[node]
            if pair:
                for child in pair:
                    if reach[child] >= floor:
                        heapq.heappush(boxes, (-reach[child], child))
                continue
            start, end = tree.span[node]
            scores = tree.vectors[start:end] @ query
            at = np.flatnonzero(scores >= floor)
            if len(at) > 4 * k:  # no more than the best few of the leaf can enter
                kth = np.partition(scores[at], len(at) - k - 1)[len(at) - k - 1]
                at = at[scores[at] >= kth]
            for i in at:
                vec = int(ids[start + i])
                if vec == own:
                    continue
                entry = (int(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    floor = max(floor, best[0][0])
        for score, vec in best:
            yield number, -vec, score


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten() if isinstance(values, pa.ListArray) else pa.concat_arrays([c.flatten() for c in values.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _search_shard(k: int, leaf: int):
    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if points.num_rows and asked.num_rows:
            vectors, queries = _matrix(points.column("vector"), points.num_rows), _matrix(asked.column("wanted"), asked.num_rows)
            ids, query_ids, floors = (points.column("vec_id").to_numpy(), asked.column("query_id").to_numpy(), asked.column("floor").to_numpy())
            largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
            if largest < 2.0**52:  # exact in floating point, and faster
                vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
            out = [(int(query_ids[q]), vec, int(score)) for q, vec, score in search(Tree(vectors, leaf), ids, query_ids, queries, floors, k)]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], type=pa.int64()) for i in range(3)], schema=_HITS)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integers(vector: str | Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 8192, query_block: int = 4096, leaf: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query.

    `vectors` has vec_id and embedding; `is_query` is a condition on vec_id.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    rows = staged(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding").alias("vector"))
        .select("vec_id", "vector", F.size("vector").alias("dim"))
    )
    shards = -(-rows.count() // shard_rows) or 1
    queries = rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), F.col("vector").alias("wanted"), F.col("dim").alias("query_dim"))
    blocks = -(-queries.count() // query_block) or 1
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    points = rows.withColumn("shard", shard)
    # a salted home, so that queries repeated under one id spread as well
    asked = queries.withColumn("home", F.pmod(F.xxhash64("query_id", "wanted"), F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("wanted", "query_id"), F.lit(blocks)).cast("int"))
    first = staged(
        points.groupBy("dim", "shard")
        .cogroup(asked.withColumn("floor", F.lit(-(1 << 62))).groupBy("query_dim", "home"))
        .applyInArrow(_search_shard(k, leaf), HITS)
    )
    if shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    found = _best(first, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    others = (
        asked.join(found.select("query_id", "kth"), "query_id", "left")
        .withColumn("floor", F.coalesce("kth", F.lit(-(1 << 62))))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("other <> home")
        .select("query_dim", "other", "block", "query_id", "wanted", "floor")
    )
    in_blocks = points.withColumn("meets", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    second = in_blocks.groupBy("dim", "shard", "meets").cogroup(others.groupBy("query_dim", "other", "block")).applyInArrow(_search_shard(k, leaf), HITS)
    return _best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")
