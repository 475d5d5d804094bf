"""Plan checks: pushdown, pruning, no Python in the hot path, no unbounded single-task work."""

import pytest

from conftest import SF01
from tidemark.plans.catalog import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_or_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF01))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_range_filter_reaches_scan(spark):
    plan = _plan(QUERIES["lapsed"](spark, SF01))
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(o_orderdate,1997-04-01T00:00)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_rank_is_range_partitioned_not_single_partition(spark):
    from pyspark.sql import functions as F
    from tidemark.operators.ranking import user_totals
    from tidemark.sources.views import orders_view

    totals = user_totals(orders_view(spark, SF01), "total_spent", "sum")
    ranked_plan = totals.repartitionByRange(8, F.col("total_spent").desc())._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in ranked_plan
    # the only single-partition window in the rank runs over per-partition counts
    plan = _plan(QUERIES["rank_users"](spark, SF01))
    assert "Window [" in plan and "_n" in plan


def _composed_existing_activity(spark, sf_dir):
    from tidemark.operators import acquisition
    from tidemark.plans import params as P
    from tidemark.sources.views import orders_view

    o = orders_view(spark, sf_dir)
    new = acquisition.new_customers(acquisition.first_orders(o, P.FIRST_SPAN), P.NEW_SINCE)
    return acquisition.existing_activity(o, new, P.ACTIVITY_SPAN)


def _composed_active_periods(spark, sf_dir):
    from tidemark.operators import lapse
    from tidemark.plans import params as P
    from tidemark.sources.views import orders_view

    o = orders_view(spark, sf_dir)
    return lapse.active_periods(o, P.PATTERN_SPAN, lapse.lapsed(o, P.LAPSE_ACTIVE, P.LAPSE_SILENT), P.PATTERN_GRAIN)


def _composed_cohort_trend(spark, sf_dir):
    from tidemark.operators import lapse
    from tidemark.plans import params as P
    from tidemark.sources.views import orders_view

    o = orders_view(spark, sf_dir)
    cohort = lapse.consistent_counts(o, P.CONSISTENT_SPAN, P.CONSISTENT_GRAIN, P.CONSISTENT_K)
    return lapse.cohort_trend(o, cohort, P.TREND_SINCE)


PLAN_BUILDERS = {**QUERIES, "existing_activity_composed": _composed_existing_activity,
                 "active_periods_composed": _composed_active_periods, "cohort_trend_composed": _composed_cohort_trend}


@pytest.mark.parametrize("name,join", [("existing_activity_composed", "SortMergeJoin LeftAnti"),
                                       ("cohort_trend_composed", "SortMergeJoin LeftSemi"),
                                       ("active_periods_composed", "SortMergeJoin LeftSemi")])
def test_join_on_user_sees_aggregated_rows_when_not_broadcast(spark, name, join):
    """At scale the cohort side is too big to broadcast; the orders side must
    then reach the join already reduced to (period, user) rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = PLAN_BUILDERS[name](spark, SF01)
        tree = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("\n\n\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = tree.splitlines()
    i = next(k for k, line in enumerate(lines) if join in line)
    left = [line.strip(" :+-") for line in lines[i + 1:i + 4]]
    assert left[0].startswith("Sort") and left[1].startswith("Exchange") and left[2].startswith("HashAggregate"), tree


@pytest.mark.parametrize("name", ["existing_activity", "existing_outside_window", "still_lapsed", "lapse_counts",
                                  "lapsed", "active_periods", "consistent_buyers", "acquisition_report", "new_customer_rate",
                                  "month_text_to_date", "cohort_trend"])
def test_one_pass_queries_scan_orders_once_without_joins(spark, name):
    df = QUERIES[name](spark, SF01)
    tree = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("\n\n\n")[0]
    assert tree.count("Scan parquet") == 1 and "Join" not in tree, tree


@pytest.mark.parametrize("name,joins", [("profile", 0), ("volume_before_after", 0), ("mean_before_after", 0),
                                        ("size_price_points", 1), ("trim_extremes", 2), ("category_counts", 1),
                                        ("top_companies", 1), ("top_artist_company", 2), ("top_artists", 1)])
def test_sales_queries_join_only_the_tables_they_use(spark, name, joins):
    plan = QUERIES[name](spark, SF01)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == joins, plan


@pytest.mark.parametrize("name", ["category_counts", "compare_before_after", "top_companies",
                                  "top_artist_company", "top_artists", "money_text", "profile_of_top", "mean_by_birth",
                                  "mean_by_activity", "mean_by_both"])
def test_sales_lines_are_summed_before_they_move(spark, name):
    """Broadcasting off: above the scan of the lines stands an aggregate before any exchange or join."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES[name](spark, SF01)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and ("l_partkey" in line or "l_suppkey" in line)]
    assert scans
    for at in scans:
        here, above = depth(plan[at]), []
        for line in reversed(plan[:at]):
            if depth(line) < here:
                here = depth(line)
                above.append(line)
        first = next(x for x in above if any(w in x for w in ("Aggregate", "Exchange", "Join")))
        assert "Aggregate" in first, "\n".join(plan)


def test_bucketed_tables_need_no_shuffle_on_the_user(spark):
    """Broadcasting off: aggregates and joins by user over bucketed orders and grades move nothing."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["status_bucketed"](spark, SF01)
        df.collect()
        plan = _plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning" not in plan and "SortMergeJoin" in plan, plan


def test_a_written_cohort_filters_the_scan(spark):
    """Broadcasting off: a Bloom filter of a 1 % cohort stands under the partial aggregate, and few rows are shuffled."""
    import re

    from pyspark.sql import functions as F

    from tidemark.operators import lapse
    from tidemark.operators.relational import filtering, materialize
    from tidemark.sources.views import orders_view

    o = orders_view(spark, SF01)
    cohort = materialize(o.filter(F.pmod(F.hash("user_id"), F.lit(100)) == 0).select("user_id").distinct(), "cohort")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        seen = {}
        for name, side in (("plain", cohort), ("filtered", filtering(cohort))):
            df = lapse.cohort_trend(o, side, "1997-01-01")
            rows = sorted(map(tuple, df.collect()))
            text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            moved = max(float(x) for x in re.findall(r"rowCount=([0-9.E+]+)", text.split("Initial Plan")[0]))
            seen[name] = rows, moved, _plan(df).split("Initial Plan")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert seen["plain"][0] == seen["filtered"][0] and seen["plain"][0]
    assert "might_contain" not in seen["plain"][2]
    plan = seen["filtered"][2].splitlines()
    at = next(i for i, line in enumerate(plan) if "might_contain" in line)
    assert any("partial_count(order_id" in line for line in plan[:at]) and "FileScan" in "".join(plan[at:])
    assert seen["filtered"][1] < 0.1 * seen["plain"][1], (seen["filtered"][1], seen["plain"][1])
