import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanlens.functions import exprs as X
from loanlens.operators import relational as R


def test_conditional_aggregates_and_pivot(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, None), (2, 1, 5.0)], "k int, pos int, v double")
    r = {row.k: row for row in df.groupBy("k").agg(
        X.sum_if(F.col("pos") >= 2).alias("n"), X.sum_if(F.col("pos") >= 2, "v").alias("vol"),
        X.min_if(F.col("pos") > 5, "v").alias("none"), X.max_if(F.col("pos") < 3, "v").alias("mx"),
        X.any_flag(F.col("v").isNull()).alias("anynull"), *X.pivot_nth("pos", "v", 3, "v")).collect()}
    assert (r[1].n, r[1].vol, r[1].none, r[1].mx, r[1].anynull) == (2, 20.0, None, 20.0, 1)
    assert (r[1].v_1, r[1].v_2, r[1].v_3, r[2].v_2) == (10.0, 20.0, None, None)


def test_parsing(spark):
    df = spark.createDataFrame([("2025-01-31", "1.5"), ("bad", "x")], "d string, n string")
    got = df.select(X.parse_date("d").alias("d"), X.parse_number("n").alias("n")).collect()
    assert [(r.d, r.n) for r in got] == [(dt.date(2025, 1, 31), 1.5), (None, None)]
    with pytest.raises(Exception):
        df.select(X.parse_number("n", strict=True)).collect()


def test_first_by_join_as_string_and_slice(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 1, "b"), (2, None, "z")], "k int, o int, p string")
    first = {r.k: r.p for r in R.first_by(df, ["k"], ["o"], ["p"]).collect()}
    assert first == {1: "a", 2: "z"}
    ids = spark.createDataFrame([(123,)], "id bigint")
    txt = spark.createDataFrame([("123",), ("123.0",)], "sid string")
    assert R.join_as_string(ids, "id", txt, "sid").count() == 1
    rows = spark.createDataFrame([(1, 5), (1, 10), (1, 11), (2, 1)], "k int, t int")
    win = spark.createDataFrame([(1, 5, 10)], "k int, lo int, hi int")
    assert sorted(r.t for r in R.slice_window(rows, win, "k", "t", "lo", "hi").collect()) == [5, 10]


def test_asof_latest_and_keys(spark):
    left = spark.createDataFrame([(1, 10), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 9, "b"), (1, 11, "c"), (2, 6, "d")], "k int, rt int, v string")
    got = {r.k: r.v for r in R.asof_latest(left, right, "k", "t", "rt").collect()}
    assert got == {1: "b"}
    keys = spark.createDataFrame([(1,), (1,)], "k int")
    assert R.in_keys(left, keys, "k").count() == 1
    assert [r.k for r in R.not_in_keys(left, keys, "k").collect()] == [2]
