"""Every registered query against its DuckDB oracle on the smallest test data."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"
KEYS = sorted(k for k in queries() if not k.startswith("op") and k != "pipeline")


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    res = compare(spark, SF, [key], verbose=False)[key]
    assert "error" not in res, res.get("error")
    if key in oracle_sql():
        assert res["columns_match"], res
        assert res["values_match"], res


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_oracle_keys_are_registered():
    qs, sqls = set(queries()), set(oracle_sql())
    assert sqls <= qs
    own = {k for k in qs if not k.startswith("op") and k != "pipeline"}
    assert own - sqls == {"data_quality_report_approx"}
