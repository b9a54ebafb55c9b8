"""Every registered query against its DuckDB oracle on sf0.001 (the driver repeats this at sf0.01)."""

import pytest

from paths import SF_SMALL
from finlake.registry import QUERIES, load_all
from oracle_harness import compare

load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] in ("ok", "no-oracle"), res
