"""Results don't depend on the session's time zone, also for zoned timestamps."""

import datetime as dt

import pytest

from loanlens.functions.exprs import to_manila
from loanlens.operators import prep, targets
from loanlens.sources import Sources
from loanlens.sources.catalog import utc_ntz


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Manila"])
def zoned(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


INSTANTS = "timestamp_micros(cast(t as bigint)) as at"


def test_timestamps_become_utc_wall_times(zoned):
    at = [dt.datetime(2025, 9, 14, 20), dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 5)]
    micros = [(int((x - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)),) for x in at] + [(None,)]
    df = zoned.createDataFrame(micros, "t bigint").selectExpr("t", INSTANTS)
    src = Sources({"x": df})
    assert dict(src["x"].dtypes)["at"] == "timestamp_ntz"
    got = src["x"].select("at", to_manila("at").alias("m"), "t").collect()
    assert [r["at"] for r in got] == at + [None]
    assert got[0].m == dt.datetime(2025, 9, 15, 4)
    assert utc_ntz(src["x"]) is src["x"]


def test_prep_and_targets_take_instants(zoned):
    t = int((dt.datetime(2025, 3, 1, 1) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    df = zoned.createDataFrame([(1, t)], "ee_customer_id bigint, t bigint").selectExpr(
        "ee_customer_id", "1L as ln_loan_id", "cast(5 as decimal(18,2)) as ln_original_principal", "'employer' as ee_product_type",
        INSTANTS.replace("as at", "as ee_onboarding_date"), "date'2020-01-01' as ee_employment_date",
        "cast(null as date) as ee_resignation_date", INSTANTS.replace("as at", "as ee_permanent_freeze_date"))
    row = prep.employee_frame(df).first()
    assert row.ee_onboarding_date == row.ee_resignation_date_correct == dt.datetime(2025, 3, 1, 1)


def test_text_inputs(spark):
    reps = spark.createDataFrame([("7", 1, 1, "TPSD", "2025-01-10", "2025-01-09", "99.5"), ("7", 1, 2, "OTHER", "2025-02-10", "2025-02-09", "bad")],
                                 "user_id string, loan_id bigint, installment_number int, vendor_id string, repaid_date string, due_date string, osbal_after string")
    emp = spark.createDataFrame([(7, dt.datetime(2025, 1, 20))], "ee_customer_id bigint, ee_resignation_date_correct timestamp_ntz")
    got = targets.user_targets(reps, emp, current_date="2025-12-31", balance_threshold=10.0).first()
    assert (got.target, got.target_type, got.last_tpsd_date) == (1, "leave", dt.datetime(2025, 1, 10))
    bad = reps.replace("2025-02-10", "10.02.2025", "repaid_date")
    with pytest.raises(Exception):
        targets.user_targets(bad, emp, current_date="2025-12-31").collect()
