"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm.hard_negatives import RTree, mine, relabelled, search, tiles


def brute(rows, every, positives=5, negatives=3):
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * float(x)) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, q in {g for g in good if g[0] % every == 0}:
        ranked = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in good if i != a and len(v) == len(q))
        for s, p, _ in [r for r in ranked if r[2] == lab][:positives]:
            fits = [(-n, i) for n, i, other in ranked if other != lab and -50 * s <= -100 * n <= -95 * s][:negatives]
            out += [(a, p, r + 1, i, -s, n) for r, (n, i) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def made(n, seed):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0.3, 1))) for _ in range(6)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, rows[i % 5][1], i % 3) for i in range(60)]  # ties
    rows += rows[:20]  # repeated rows
    rows += [(2000, None, 1), (2005, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (2010, [float("nan")] * 6, 1), (2015, [float("inf")] * 6, 1),
             (2020, [], 1), (2025, [1.0, 2.0], 1), (2030, [1.5, 2.0], 1), (2031, [1.0, 1.0], 2), (None, rows[0][1], 1), (2035, rows[0][1], None)]
    return rows + [(5, rows[7][1], 2), (10, rows[10][1], 3)]


@pytest.mark.parametrize("shard_rows,leaf", [(10_000, 256), (60, 8)])
def test_equals_all_products(spark, shard_rows, leaf):
    rows = made(300, shard_rows)
    got = mine(frame(spark, rows).repartition(3), F.col("vec_id") % 5 == 0, relabelled(), shard_rows=shard_rows, leaf=leaf)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.random())) for _ in range(4)], i % 2) for i in range(200)]
    rows += [(300 + i, rows[4][1], 1) for i in range(150)] + [rows[8]] * 150
    got = mine(frame(spark, rows), F.col("vec_id") % 50 == 0, relabelled(), shard_rows=50, leaf=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 50)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0], 9), (50, [0.5], 0), (1, [0.9], 0), (2, [0.4], 3)]
    got = mine(frame(spark, rows), F.col("vec_id") % 50 == 0, relabelled())
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 50)
    assert mine(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_boxes_and_tiles():
    """Every row lies in one leaf; a box's interval holds its rows' scores; label slabs."""
    rng = np.random.default_rng(3)
    v, labels = rng.integers(-50, 50, (500, 6)), rng.integers(0, 3, 500)
    at = tiles(v, labels, 16)
    assert sorted(np.concatenate(at)) == list(range(500)) and max(map(len, at)) <= 16
    assert sum(len(set(labels[a])) > 1 for a in at) == 0
    tree = RTree([(a, labels[a], np.ones(len(a)), v[a]) for a in at], fanout=4)
    for q in rng.integers(-50, 50, (20, 6)):
        least, greatest = tree.intervals(q)
        for node, own in enumerate(at):
            assert least[node] <= (v[own] @ q).min() and (v[own] @ q).max() <= greatest[node]
        assert least[-1] <= (v @ q).min() and (v @ q).max() <= greatest[-1]
        scores = sorted(((int(v[i] @ q), -i) for i in range(500) if labels[i] != 1 and -500 <= v[i] @ q <= 900), reverse=True)[:4]
        assert sorted(((s, -i) for _, i, s in search(tree, q, -1, 1, False, [[-500, 900]], 4)), reverse=True) == scores


def test_large_components_stay_exact(spark):
    rows = [(i, [float(3 * 10**6 + i), float(2**20 + 7 * i)], i % 2) for i in range(0, 120)]
    got = mine(frame(spark, rows), F.col("vec_id") % 10 == 0, relabelled(), least=0, greatest=1000, shard_rows=40, leaf=4)
    good = [(a, p, r, i, s, n) for a, p, r, i, s, n in (tuple(x) for x in got.collect())]
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    assert good and all(sum(x * y for x, y in zip(ints[a], ints[i])) == n and sum(x * y for x, y in zip(ints[a], ints[p])) == s for a, p, r, i, s, n in good)
