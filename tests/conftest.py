import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loanlens.session import get_session

    warehouse = tempfile.mkdtemp(prefix="loanlens-test-warehouse-")
    s = get_session("local[4]", shuffle_partitions=4, app_name="loanlens-tests",
                    extra_conf={"spark.sql.warehouse.dir": warehouse,
                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="loanlens-test-ckpt-")})
    yield s


def rows(df, order=None):
    """Collect as a list of dicts (optionally sorted by a column)."""
    out = [r.asDict() for r in df.collect()]
    if order:
        out.sort(key=lambda r: (r[order] is None, r[order]))
    return out
