"""Plan shape: no query may fall back to a nested-loop or cartesian join, and filters and columns reach the scan."""

import re

import pytest

import __spark_entry__ as entry
from timbrel.sources.views import Inputs

QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
EAGER = ("score", "agg25", "agg27", "set1_", "set6", "set15", "join19", "join38", "join40", "win7", "win27", "str1_provider_health_stream", "agg46", "join25", "set16")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_nested_loops(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    plan = plan_of(Inputs(spark, sf_dir).faces.select("job_id", "t", "x"))
    assert "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = plan_of(QUERIES["agg29_warnings"](spark, sf_dir))
    assert "EqualTo(event_type,error)" in plan


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(QUERIES["topk4_top_regions"](spark, sf_dir))
