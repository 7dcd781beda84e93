"""Distributed positions and ranks against windows and plain Python."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loanlens.operators.ordering import position_in, ranked_in, with_position


def _frame(spark, n=3000, seed=5):
    """One key has a third of all rows; ties, null keys and null values."""
    rng = random.Random(seed)
    rows = [(1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5]), rng.choice([None, *range(40)]), i) for i in range(n)]
    return spark.createDataFrame(rows, "k long, v long, id long").repartition(5)


def test_global_position(spark):
    df = _frame(spark)
    got = with_position(df, [F.col("v").desc_nulls_last(), "id"], parts=7).collect()
    want = sorted(got, key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert [r.position for r in want] == list(range(len(got)))


def test_global_position_of_equal_rows_and_empty(spark):
    same = spark.range(500).select(F.lit(1).alias("v"))
    assert sorted(r.position for r in with_position(same, ["v"], parts=6).collect()) == list(range(500))
    assert with_position(same.where("v > 1"), ["v"]).collect() == []


def test_hot_key_is_spread(spark):
    """A key with a third of all rows lies in several partitions."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.lit(0).alias("v"))
    parts = df.withColumn("s", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(9, "k", "v", "s")
    assert parts.where("k = -1").select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    got = position_in(df, ["k"], ["v"], parts=9)
    assert sorted(r.position for r in got.where("k = -1").collect()) == list(range(3000))


def test_position_in_key(spark):
    df = _frame(spark)
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_first(), "id")
    want = {(r.id, r.p) for r in df.withColumn("p", F.row_number().over(w) - 1).collect()}
    got = {(r.id, r.position) for r in position_in(df, ["k"], ["v", "id"], parts=6).collect()}
    assert got == want


def test_ranks(spark):
    df = _frame(spark)
    w = Window.partitionBy("k").orderBy("v")
    want = {(r.id, r.a, r.b) for r in df.select("id", F.rank().over(w).alias("a"), F.dense_rank().over(w).alias("b")).collect()}
    got = {(r.id, r["rank"], r.dense_rank) for r in ranked_in(df, ["k"], ["v"], parts=6).collect()}
    assert got == want


def test_ranks_past_one_block(spark):
    """More distinct values in one key than a block holds."""
    df = spark.range(10_000).select(F.lit(7).alias("k"), (F.col("id") / 2).cast("long").alias("v"))
    got = ranked_in(df, ["k"], ["v"], parts=5)
    assert got.where("rank <> 2 * v + 1 or dense_rank <> v + 1").count() == 0 and got.count() == 10_000
