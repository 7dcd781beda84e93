"""KD-tree search against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm.topk_search import Tree, top_k


def brute(rows, k, every):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("shard_rows,block", [(10_000, 4096), (40, 7)])
def test_equals_all_products(spark, shard_rows, block):
    rng = random.Random(shard_rows)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[i % 5][1]) for i in range(40)]  # ties
    rows += [(500, None), (505, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (510, [float("nan")] * 6), (515, [float("inf")] * 6), (520, []), (525, [1.0, 2.0]), (None, rows[0][1])]
    rows += [(1, rows[7][1]), (10, rows[10][1])]
    got = {tuple(r) for r in top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, 4, shard_rows, block, leaf=8).collect()}
    want = brute(rows, 4, 5)
    assert got == want


def test_fewer_candidates_and_empty_table(spark):
    got = top_k(frame(spark, [(0, [1.0]), (1, [0.5])]), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 256 * 128)]
    assert top_k(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_boxes_bound_their_scores():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-50, 50, (200, 4)), rng.integers(-50, 50, (10, 4))
    tree = Tree(v, 16)
    reach = tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        assert ((tree.vectors[a:b] @ q.T).max(axis=0) <= reach[:, node]).all()
