"""As-of by tagged union, bucketed interval slices and heavy-hitter joins,
each with one key in a third of all rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loanlens.operators.relational import asof_tagged, heavy_join, slice_buckets, slice_window


def _key(rng, i):
    return 1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5])


def _brute_asof(left, right):
    out = []
    for k, t, i in left:
        fits = [(rt, n) for rk, rt, n in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        if fits:
            out.append((k, t, i, *max(fits)))
    return sorted(out)


def test_asof_tagged(spark):
    rng = random.Random(2)
    right = [(_key(rng, i), rng.choice([None, *range(300)]), i) for i in range(1500)]
    left = [(_key(rng, i), rng.choice([None, *range(-5, 300)]), i) for i in range(300)]
    a = spark.createDataFrame(left, "k long, t int, id long").repartition(3)
    b = spark.createDataFrame(right, "k long, rt int, n long").repartition(4)
    got = [tuple(r) for r in asof_tagged(a, b, "k", "t", "rt", ["n"], parts=9).select("k", "t", "id", "rt", "n").collect()]
    assert sorted(got) == _brute_asof(left, right)


def test_asof_borders_without_right_rows(spark):
    """One early right row serves many partitions of later left rows; the next
    key must not inherit it."""
    left = [(1, t, t) for t in range(10, 400)] + [(2, t, t) for t in range(50)]
    right = [(1, 0, 7), (2, 25, 9)]
    a, b = spark.createDataFrame(left, "k long, t int, id long"), spark.createDataFrame(right, "k long, rt int, n long")
    got = [tuple(r) for r in asof_tagged(a, b, "k", "t", "rt", parts=8).select("k", "t", "id", "rt", "n").collect()]
    assert sorted(got) == _brute_asof(left, right)
    assert asof_tagged(a.where("k > 5"), b, "k", "t", "rt").collect() == []
    assert asof_tagged(a, b.where("k > 5"), "k", "t", "rt").collect() == []


def test_slice_buckets(spark):
    rng = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    rows = [(_key(rng, i), day + dt.timedelta(days=rng.randrange(-200, 900), hours=rng.randrange(24)), i) for i in range(1500)]
    wins = [(k, day + dt.timedelta(days=a), day + dt.timedelta(days=a + n)) for k, a, n in ((1, -100, 700), (2, 0, 0), (3, 50, -3), (4, 31, 31))]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, id long")
    w = spark.createDataFrame(wins, "k long, lo timestamp_ntz, hi timestamp_ntz")
    want = sorted(r.id for r in slice_window(df, w, "k", "t", "lo", "hi").collect())
    for days in (1, 31, 4000):
        assert sorted(r.id for r in slice_buckets(df, w, "k", "t", "lo", "hi", days).collect()) == want
    hot = df.where("k = 1").withColumn("b", F.floor(F.datediff("t", F.lit("1970-01-01").cast("date")) / 31))
    assert hot.select("b").distinct().count() > 20  # join keys that the hot key is dealt over


def test_heavy_join(spark):
    """One text in a third of both sides: equal rows, and its matches in many tasks."""
    rng = random.Random(6)
    left = [("" if i % 3 == 0 else rng.choice([None, "a", "b", f"x{i}"]), i) for i in range(900)]
    right = [("" if i % 3 == 0 else rng.choice([None, "a", "c", f"x{i}"]), -i) for i in range(600)]
    a, b = spark.createDataFrame(left, "s string, i long").repartition(3), spark.createDataFrame(right, "t string, j long").repartition(3)
    want = sorted((i, j) for s, i in left for t, j in right if s is not None and s == t)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = heavy_join(a, b, "s", "t", heavy=2000, salts=32)
        assert sorted((r.i, r.j) for r in got.collect()) == want
        shares = got.where("s = ''").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in shares) <= 0.5 * 300 * 200 and len(shares) >= 4
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted((r.i, r.j) for r in heavy_join(a, b, "s", "t").collect()) == want  # nothing heavy
