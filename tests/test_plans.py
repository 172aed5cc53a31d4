"""The physical plans of pattern and aggregate queries keep the shape they were written for."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [
    "match_two_edge_path", "match_same_nation_supply_without_return", "match_anchored", "match_variable_unification", "rewrite_occurrences",
    "rewrite_delta", "effects_fidelity", "claims_score_table", "triples_shape_check", "admission_classify", "eventlog_path_likelihood",
])
def test_no_products_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan, word


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = plan_of(QUERIES["match_same_nation_supply_without_return"](spark, SF))
    assert "l_tax" not in plan and "l_discount" not in plan and "o_totalprice" not in plan
    assert "EqualTo(l_returnflag,R)" in plan
    plan = plan_of(QUERIES["match_literals_any_and_variables"](spark, SF))
    assert "EqualTo(p_size,7)" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_runs_are_shuffled_once_for_all_estimands(spark):
    from hyperlake.operators import effects as fx
    from hyperlake.plans.data import METRICS, runs

    plan = plan_of(fx.scenario_effects(runs(spark, SF), METRICS))
    # one exchange builds the run table, one the effects of all three estimands
    assert plan.split("\n\n\n")[0].count("Exchange") == 2
