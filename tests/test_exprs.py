import datetime as dt

from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.functions import exprs as X


def _one_col(spark, values, ddl):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_loose_date(spark):
    df = _one_col(spark, ["2020-1", "2020-11", "2020-11-05", "2020", "2020-13", None], "s string")
    got = [r[0] for r in df.select(X.loose_date("s")).collect()]
    assert got == [dt.date(2020, 1, 1), dt.date(2020, 11, 1), dt.date(2020, 11, 5), None, None, None]


def test_scorecards(spark):
    df = _one_col(spark, [0.54, 0.55, 3.85, None], "t double")
    assert [r[0] for r in df.select(X.score_card("t", K.EMPLOYER_TIME_CARD)).collect()] == [98, 123, 183, 119]
    df = _one_col(spark, [-1.0, 21200.0, 33050.0, None], "i double")
    assert [r[0] for r in df.select(X.score_card("i", K.DECLARED_INCOME_CARD)).collect()] == [119, 110, 146, 119]
    df = _one_col(spark, ["Separated", None, "Single", "Widowed"], "c string")
    assert [r[0] for r in df.select(X.score_card("c", K.CIVIL_STATUS_CARD)).collect()] == [119, 127, 117, 127]
    df = _one_col(spark, ["Female", "Male", "not specified", "x", None], "g string")
    assert [r[0] for r in df.select(X.score_card("g", K.GENDER_CARD)).collect()] == [120, 118, 118, 119, 119]


def test_rating(spark):
    df = _one_col(spark, [533, 532, 452, None], "s int")
    assert [r[0] for r in df.select(X.rating("s")).collect()] == ["A", "B", "F", None]


def test_income_midpoint(spark):
    df = _one_col(spark, ["0-10000", "50000+", "1234.5", "abc", None], "s string")
    got = [None if r[0] is None else float(r[0]) for r in df.select(X.income_midpoint("s")).collect()]
    assert got == [5000.0, 50000.0, 1234.5, None, None]


def test_reference_cleaning(spark):
    uuid = "0123abcd-0123-4567-89ab-0123456789ab"
    df = _one_col(spark, ["#12:" + uuid, uuid, "##:", "abc"], "r string")
    strict = [r[0] for r in df.select(X.clean_reference("r", "strict")).collect()]
    lenient = [r[0] for r in df.select(X.clean_reference("r", "lenient")).collect()]
    assert strict == [uuid, None, None, None]
    assert lenient == [uuid, uuid, "", "abc"]


def test_device_prefix_and_manila(spark):
    df = spark.createDataFrame([("#3:abc", dt.datetime(2025, 9, 14, 20, 0))], "d string, t timestamp_ntz")
    r = df.select(X.strip_device_prefix("d").alias("d"), X.to_manila("t").alias("m")).first()
    assert r.d == "abc" and r.m == dt.datetime(2025, 9, 15, 4, 0)


def test_json_scalar(spark):
    df = _one_col(spark, ['{"max_debt_income_ratio":"0.3"}', '{"max_debt_income_ratio":{"a":1}}', "bad {"],
                  "o string")
    assert [r[0] for r in df.select(X.json_scalar("o", K.DEBT_INCOME_KEY)).collect()] == ["0.3", None, None]


def test_months_and_floor(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 31, 13, 5), dt.datetime(2025, 6, 15))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(X.add_months("a", 1).alias("p"), X.month_floor_prev("b").alias("f")).first()
    assert r.p == dt.datetime(2025, 2, 28, 13, 5)
    assert r.f == dt.datetime(2025, 5, 1)


def test_other_vendor_and_flag(spark):
    df = _one_col(spark, ["TPSD", "TPFP", "OTHER", None], "v string")
    got = [r[0] for r in df.select(X.flag(X.is_other_vendor("v"))).collect()]
    assert got == [0, 0, 1, 1]
    df = _one_col(spark, [True, False, None], "b boolean")
    assert [r[0] for r in df.select(X.flag(F.col("b"))).collect()] == [1, 0, 0]


def test_strict_modes_raise(spark):
    import pytest

    df = spark.createDataFrame([("2020-13", "abc", "bad {")], "d string, i string, j string")
    with pytest.raises(Exception):
        df.select(X.loose_date("d", strict=True)).collect()
    with pytest.raises(Exception):
        df.select(X.income_midpoint("i", strict=True)).collect()
    with pytest.raises(Exception):
        df.select(X.json_scalar("j", K.DEBT_INCOME_KEY, strict=True)).collect()
    ok = df.select(X.loose_date("d"), X.income_midpoint("i"), X.json_scalar("j", K.DEBT_INCOME_KEY)).first()
    assert tuple(ok) == (None, None, None)
