"""The feature table from bucketed inputs: same rows, no shuffle in the user-keyed chain."""

import re

from loanlens.plans.features import bucket_inputs, loan_features
from loanlens.plans.registry import AS_OF
from loanlens.sources.testdata import adapter_sources


def _exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_bucketed_inputs_need_no_shuffle(spark):
    src = adapter_sources(spark, "/root/testdata/sf0.001")
    spark.sql("CREATE SCHEMA IF NOT EXISTS bucket_test")
    assert bucket_inputs(src, AS_OF, "bucket_test", 4) == "bucket_test"
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # dimensions are broadcast, user-keyed tables are not
        bucketed, plain = loan_features(src, AS_OF, bucketed="bucket_test"), loan_features(src, AS_OF)
        assert _exchanges(bucketed) <= 8 < _exchanges(plain)
        assert bucketed.exceptAll(plain).count() == 0 and plain.exceptAll(bucketed).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
