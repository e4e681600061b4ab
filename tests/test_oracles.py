"""Every query that has SQL returns the same rows; the others return some."""

import pytest

from atrium.plans import file_queries, geometry_queries, hvac_queries, label_queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
CASES = [(m, name) for m in (hvac_queries, geometry_queries, label_queries, file_queries) for name in m.QUERIES]


@pytest.mark.parametrize("module, name", CASES, ids=[n for _, n in CASES])
def test_query(spark, module, name):
    df = module.QUERIES[name](spark, SF)
    if name in module.ORACLES:
        assert_same(df, module.ORACLES[name], SF)
    else:
        assert df.count() > 0
