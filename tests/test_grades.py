import random

import pytest
from pyspark.sql import functions as F

from conftest import ORDERS_SCHEMA, ts
from tidemark.operators import grades, ranking


def _orders(spark, amounts):
    rows = [(u, i, float(a), ts("2024-01-01")) for i, (u, a) in enumerate(amounts)]
    return spark.createDataFrame(rows, ORDERS_SCHEMA)


def test_global_row_number_equals_full_sort(spark):
    rnd = random.Random(7)
    rows = [(u, float(rnd.randint(0, 50))) for u in range(500)]  # many ties
    df = spark.createDataFrame(rows, "user_id long, m double").repartition(7)
    out = ranking.global_row_number(df, [F.col("m").desc(), F.col("user_id").asc()], "rank", "total",
                                    num_partitions=5)
    got = {r.user_id: (r.rank, r.total) for r in out.collect()}
    expect = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {u: (i + 1, 500) for i, (u, _) in enumerate(expect)} == got


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fewer_than_four_users_have_null_thresholds_and_bronze(spark, n):
    o = _orders(spark, [(u, 10 * (u + 1)) for u in range(n)])
    thr = ranking.quartile_thresholds(ranking.rank_users(o), "total_spent").collect()[0]
    assert (thr.p75, thr.p50, thr.p25) == (None, None, None) if n < 2 else thr.p75 is None
    g = {r.user_id: r.spending_grade for r in grades.grade_by_spend(o).collect()}
    if n == 1:
        assert g == {0: "Bronze"}


def test_seven_users_floor_ranks(spark):
    # ranks from the top: floor(7*.25)=1, floor(7*.5)=3, floor(7*.75)=5
    o = _orders(spark, [(u, 100 - 10 * u) for u in range(7)])  # 100,90,...,40
    thr = ranking.quartile_thresholds(ranking.rank_users(o), "total_spent").collect()[0]
    assert (thr.p75, thr.p50, thr.p25) == (100.0, 80.0, 60.0)
    g = {r.user_id: r.spending_grade for r in grades.grade_by_spend(o).collect()}
    assert g == {0: "VIP", 1: "Gold", 2: "Gold", 3: "Silver", 4: "Silver", 5: "Bronze", 6: "Bronze"}


def test_ties_at_threshold_take_upper_grade(spark):
    o = _orders(spark, [(0, 50), (1, 50), (2, 50), (3, 50), (4, 10), (5, 10), (6, 10), (7, 5)])
    g = {r.user_id: r.spending_grade for r in grades.grade_by_spend(o).collect()}
    assert all(g[u] == "VIP" for u in range(4))
    assert g[7] == "Bronze"


def test_count_histogram_thresholds_equal_rank_thresholds(spark):
    rnd = random.Random(3)
    rows = []
    oid = 0
    for u in range(300):
        for _ in range(rnd.choice([1, 1, 2, 3, 3, 5, 8])):
            rows.append((u, oid, 1.0, ts("2024-01-01")))
            oid += 1
    o = spark.createDataFrame(rows, ORDERS_SCHEMA)
    by_rank = ranking.quartile_thresholds(ranking.rank_users(o, "total_orders", "count"), "total_orders").collect()[0]
    by_hist = ranking.thresholds_from_histogram(ranking.user_totals(o, "total_orders", "count"),
                                                "total_orders").collect()[0]
    assert by_rank.asDict() == by_hist.asDict()


def test_clean_materialized(spark):
    from tidemark.session import clean_materialized

    o = _orders(spark, [(0, 5), (1, 7)])
    ranking.rank_users(o).collect()
    assert clean_materialized(spark) is True
    assert clean_materialized(spark) is False


def test_range_partitions_balanced_when_a_third_of_users_tie(spark):
    rows = [(u, 5.0 if u % 3 == 0 else float(u)) for u in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, m double")
    tagged = ranking.range_tagged(df, [F.col("m").desc(), F.col("user_id").asc()], num_partitions=6)
    sizes = [r["count"] for r in tagged.groupBy("_part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 2 * (3000 / len(sizes))
    ranks = {r.user_id: r.rank for r in ranking.with_rank(tagged).collect()}
    expect = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert ranks == {u: i + 1 for i, (u, _) in enumerate(expect)}


@pytest.mark.parametrize("kept,accuracy", [(1, 10), (7, 20), (50, 100), (100_000, 1000)])
def test_selected_values_equal_a_sort(spark, kept, accuracy):
    """Ties of a third of all rows, runs of near values, NULLs last, ranks that do not exist."""
    rnd = random.Random(kept)
    values = [5.0] * 130 + [round(rnd.gauss(0, 3), 3) for _ in range(250)] + [1e300, -1e300] + [None] * 17
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "m double").repartition(5).cache()
    order = sorted((v for v in values if v is not None), reverse=True)
    ranks = {f"r{k}": k for k in (0, 1, 2, 50, 131, 200, 201, len(order) - 1, len(order), len(order) + 1)}
    got = ranking.values_at_ranks(df, "m", ranks, accuracy, kept)
    assert got == {name: order[k - 1] if 1 <= k <= len(order) else None for name, k in ranks.items()}


def test_selection_of_other_types_and_empty_tables(spark):
    df = spark.range(1000).selectExpr("id % 37 AS m", "cast(id AS string) AS t", "cast(null AS double) AS none")
    assert ranking.values_at_ranks(df, "m", {"a": 1, "b": 500, "c": 1000}, 20, 3) == {"a": 36, "b": 18, "c": 0}
    assert ranking.values_at_ranks(df, "none", {"a": 1}) == {"a": None}
    assert ranking.values_at_ranks(df.limit(0), "m", {"a": 1}) == {"a": None}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 40])
def test_selected_thresholds_equal_ranked_ones(spark, n):
    rnd = random.Random(n)
    o = _orders(spark, [(u, rnd.choice([10, 20, 30, rnd.randint(0, 99)])) for u in range(n)]) if n else _orders(spark, [(0, 1)]).limit(0)
    ranked = ranking.quartile_thresholds(ranking.rank_users(o), "total_spent").collect()
    assert ranking.thresholds_by_selection(ranking.written_totals(o)).collect() == ranked


def test_grades_need_no_range_shuffle(spark):
    o = _orders(spark, [(u % 50, u) for u in range(200)])
    for df in (ranking.user_totals(o), grades.grade_by_spend(o), ranking.thresholds_by_selection(ranking.written_totals(o))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Window" not in plan
