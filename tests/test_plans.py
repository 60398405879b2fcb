"""The physical plans stay what they should be at scale."""

import re

import pytest

from numerale.catalog.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"rejected_observations"}))
def test_no_products_python_or_forced_broadcast(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    plan = plan_of(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan
    assert "strategy=broadcast" not in df._jdf.queryExecution().analyzed().toString()
    # a window without a key would pull everything into one task
    assert "Exchange SinglePartition" not in plan


@pytest.mark.parametrize("name", ["prepare", "requests", "truncate_budget", "grid_scores_gaps", "param_grid", "series_string"])
def test_two_shuffles_and_one_scan_per_table(spark, tiny, name):
    plan = final_plan_of(QUERIES[name](spark, tiny))
    assert len(re.findall(r"Exchange hashpartitioning\(series_id", plan)) == 2
    paths = re.findall(r"Location: \S+ ?\S*\[file:(\S+?)[\],]", plan)
    assert len(paths) == len(set(paths))


@pytest.mark.parametrize("name", ["scale_gaussian", "mae_by_model", "forecast", "forecast_tuned"])
def test_branches_share_the_scan(spark, sf, name):
    plan = final_plan_of(QUERIES[name](spark, sf))
    assert "ReusedExchange" in plan
    assert plan.count("orders.parquet") == 1


def test_a_wide_grid_is_dealt_out_where_asked_for(spark, tiny):
    plan = final_plan_of(QUERIES["grid_scores_spread"](spark, tiny))
    assert len(re.findall(r"Exchange hashpartitioning\(series_id#\w+, pid#\w+, \d+\), REBALANCE", plan)) == 1


def test_scan_reads_three_columns(spark, tiny):
    plan = plan_of(QUERIES["weekly_spine"](spark, tiny))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {f.split(":")[0] for f in schema.split(",")} == {"l_suppkey", "l_shipdate", "l_extendedprice"}
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_suppkey)]" in plan


def test_scored_tokens_do_not_move(spark, tiny):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = final_plan_of(QUERIES["score_tokens"](spark, tiny))
    finally:
        spark.conf.set(key, before)
    kinds = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert all("p1" not in k and "p2" not in k for k in kinds)
    assert {re.sub(r"#\d+L?", "", k).rsplit(",", 1)[0] for k in kinds} <= {"series_id", "series_id, wk", "series_id, _groupingexpression"}


def above_the_grid(plan):
    """The steps of a plan that work on rows the grid has multiplied."""
    lines = plan.splitlines()
    grid = next(k for k, line in enumerate(lines) if re.search(r"Generate explode\(.*\[_p#", line))
    return "\n".join(lines[:grid])


@pytest.mark.parametrize("name", ["grid_scores_gaps", "grid_scores_spread", "scoring_requests"])
def test_the_rows_of_a_grid_are_not_sorted(spark, tiny, name):
    above = above_the_grid(final_plan_of(QUERIES[name](spark, tiny)))
    assert "Window" not in above and "Sort" not in above
    # only the scores of a point's contexts are summed: no token is a row
    assert set(re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", above)) == set(re.findall(r"HashAggregate\(keys=\[(series_id#\w+, pid#\w+)\]", above))


def test_a_forecast_makes_no_row_per_token(spark, tiny):
    plan = final_plan_of(QUERIES["forecast_status"](spark, tiny))
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*\btok#", plan) and "Generate explode(sequence((length" not in plan
