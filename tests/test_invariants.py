"""Invariants on the test data."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators import delinquency as dq
from loanlens.sources.testdata import adapter_sources

SF = "/root/testdata/sf0.001"
AS_OF = "2001-07-01"


@pytest.fixture(scope="module")
def src(spark):
    return adapter_sources(spark, SF)


def test_default_flags_are_nested(src):
    c = dq.customer_default_flags(src, AS_OF)
    bad = c.where((F.col("cl_fpd30_flag") > F.col("cl_fspd30_flag")) | (F.col("cl_fspd30_flag") > F.col("cl_fstpd30_flag"))
                  | (F.col("cl_fstpd30_flag") > F.col("cl_fstfpd30_flag")))
    assert bad.count() == 0
    f = dq.payment_default_flags(src, AS_OF)
    for k in ("fpd30", "spd30", "tpd30", "fstfpd30"):
        assert f.where(F.col(f"def_{k}") > F.col(f"obs_{k}")).count() == 0


def test_one_rank_one_per_loan(src):
    d = dq.delinquency(src, AS_OF)
    loans = d.select("loan_id").distinct().count()
    assert d.where(F.col("installment_number") == 1).select("loan_id").distinct().count() == loans


def test_targets_one_row_per_user(spark):
    from __spark_entry__ import queries

    t = queries()["user_targets"](spark, SF)
    assert t.count() == t.select("user_id").distinct().count()
    assert t.count() > 0


def test_permuted_input_gives_same_flags(spark, src):
    base = sorted(dq.payment_default_flags(src, AS_OF).collect())
    shuffled = src.with_tables(
        split_purchases=src["split_purchases"].repartition(7).orderBy(F.rand(3)),
        repayment_schedules=src["repayment_schedules"].repartition(5),
    )
    assert sorted(dq.payment_default_flags(shuffled, AS_OF).collect()) == base


def test_feature_table_width(src):
    from loanlens.plans.features import loan_features

    v2 = loan_features(src, AS_OF)
    v1 = loan_features(src, AS_OF, region="v1")
    assert len(v2.columns) == 100 and len(set(v2.columns)) == 100
    assert len(v1.columns) == 101 and "ee_region_name_V2" in v1.columns
    # every user appears: users without loans keep one row with null loan columns
    users = src["users"].count()
    assert v2.select("ee_customer_id").distinct().count() == users


def test_on_duplicate_error(src):
    from loanlens.plans.features import loan_features

    assert loan_features(src, AS_OF, on_duplicate="error").count() > 0
    doubled = src.with_tables(income_info=src["income_info"].unionByName(src["income_info"]))
    with pytest.raises(ValueError, match="income_info"):
        loan_features(doubled, AS_OF, on_duplicate="error")
    # default keeps the fan-out: every income row repeats the user's rows
    assert loan_features(doubled, AS_OF).count() > loan_features(src, AS_OF).count()
