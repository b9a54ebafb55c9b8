"""Physical-plan checks: no cartesian products and no Python UDF nodes in any registered query."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from finlake.registry import QUERIES, load_all

load_all()

STREAMING = {"stream_daily_event_flow", "stream_file_dedupe"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_plan_has_no_cartesian_or_python(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
