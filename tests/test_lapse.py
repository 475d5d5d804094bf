
from conftest import ORDERS_SCHEMA, ts
from tidemark.functions.periods import Span
from tidemark.operators import lapse
from tidemark.operators.relational import not_in
from tidemark.sources import sinks

ACTIVE = Span("2024-06-01", "2024-06-30")
SILENT = Span("2024-07-01", "2024-09-30")


def _o(spark, rows):
    return spark.createDataFrame([(u, i, 1.0, ts(t)) for i, (u, t) in enumerate(rows)], ORDERS_SCHEMA)


def _users(df):
    return sorted(r[0] for r in df.collect())


def test_lapsed_basic_and_closed_at_midnight(spark):
    o = _o(spark, [(1, "2024-06-05"), (2, "2024-06-05"), (2, "2024-07-02"),
                   (3, "2024-06-30 00:00:00"), (4, "2024-06-30 10:00:00"), (5, "2024-06-10"), (5, "2024-09-30 10:00:00")])
    # 4 ordered after midnight on the last day: outside the closed window
    # 5 ordered on Sep 30 after midnight: outside the silent window, so still lapsed
    assert _users(lapse.lapsed(o, ACTIVE, SILENT)) == [1, 3, 5]


def test_not_in_null_on_right_empties_result(spark):
    o = _o(spark, [(1, "2024-06-05"), (None, "2024-07-05")])
    assert lapse.lapsed(o, ACTIVE, SILENT).count() == 0
    left = spark.createDataFrame([(1,), (2,), (None,)], "user_id long")
    right = spark.createDataFrame([(2,), (None,)], "user_id long")
    assert not_in(left, right).count() == 0


def test_not_in_empty_right_keeps_null_left(spark):
    o = _o(spark, [(1, "2024-06-05"), (None, "2024-06-06")])
    got = [r[0] for r in lapse.lapsed(o, ACTIVE, SILENT).collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == [1, None]
    left = spark.createDataFrame([(1,), (None,)], "user_id long")
    empty = spark.createDataFrame([], "user_id long")
    assert not_in(left, empty).count() == 2
    right = spark.createDataFrame([(3,)], "user_id long")
    assert _users(not_in(left, right)) == [1]


def test_still_lapsed_and_counts(spark):
    o = _o(spark, [(1, "2024-06-05"), (2, "2024-06-05"), (2, "2024-11-01")])
    lap = lapse.lapsed(o, ACTIVE, SILENT)
    still = lapse.still_lapsed(lap, o, Span("2024-10-01", "2025-01-31"))
    assert _users(still) == [1]
    c = lapse.lapse_counts(lap, still).collect()[0]
    assert (c.lapsed_count, c.still_lapsed_count) == (2, 1)


def _status_inputs(spark):
    o = _o(spark, [(1, "2024-03-03"), (1, "2024-04-03"), (1, "2024-05-03"), (1, "2024-06-03"),
                   (2, "2024-03-03"), (2, "2024-04-03"), (2, "2024-05-03"), (2, "2024-06-03"), (2, "2024-10-03"),
                   (3, "2024-03-03"), (3, "2024-06-03"), (4, "2024-11-11")])
    cohort = lapse.lapsed(o, ACTIVE, SILENT)
    periods = lapse.active_periods(o, Span("2024-03-01", "2024-05-31"), cohort, "month")
    cons = lapse.consistent_buyers(periods, 3)
    recent = lapse.recent_buyers(o, Span("2024-10-01", "2025-01-31"))
    g = spark.createDataFrame([(1, "VIP"), (2, "Gold"), (3, "Silver"), (4, "Bronze")], "user_id long, spending_grade string")
    return o, periods, cons, recent, g


def test_pattern_and_activity_status(spark):
    o, periods, cons, recent, g = _status_inputs(spark)
    pat = {r.user_id: r.purchase_pattern for r in lapse.purchase_pattern(periods, 3).collect()}
    assert pat == {1: "Consistent Buyer", 2: "Consistent Buyer", 3: "Irregular Buyer"}
    churned = lapse.churned_consistent(cons, recent, g)
    assert [(r.user_id, r.spending_grade) for r in churned.collect()] == [(1, "VIP")]
    status = sorted(tuple(r) for r in lapse.activity_status(churned, recent, g).collect())
    assert status == [(1, "VIP", "Inactive"), (2, "Gold", "Active"), (4, "Bronze", "Active")]


def test_two_writes_equal_union(spark):
    o, periods, cons, recent, g = _status_inputs(spark)
    churned = lapse.churned_consistent(cons, recent, g)
    union = sorted(tuple(r) for r in lapse.activity_status(churned, recent, g).collect())
    table = sinks.activity_status_two_writes(spark, "status_two_writes", churned, recent, g)
    assert sorted(tuple(r) for r in table.collect()) == union


def test_with_last_order_nulls_for_missing_user(spark):
    o = _o(spark, [(1, "2024-03-03 10:11:12"), (1, "2024-05-03 23:59:59")])
    status = spark.createDataFrame([(1, "VIP", "Active"), (9, "Gold", "Inactive")],
                                   "user_id long, spending_grade string, activity_status string")
    got = {r.user_id: r.last_order_date for r in lapse.with_last_order(status, o).collect()}
    assert got == {1: ts("2024-05-03 23:59:59"), 9: None}


def test_consistent_counts_and_trend(spark):
    o = _o(spark, [(1, "2024-03-03"), (1, "2024-04-03"), (1, "2024-05-03"), (1, "2024-05-04"),
                   (2, "2024-03-03"), (2, "2024-05-03"), (1, "2024-07-01")])
    cc = lapse.consistent_counts(o, Span("2024-03-01", "2024-06-01", closed=False), "month", 3)
    assert [tuple(r) for r in cc.collect()] == [(1, 4)]
    trend = sorted(tuple(r) for r in lapse.cohort_trend(o, cc, "2024-03-01").collect())
    assert trend == [("2024-03", 1, 1), ("2024-04", 1, 1), ("2024-05", 1, 2), ("2024-07", 1, 1)]


def test_ts_format_audit(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01 10:00:00")), (2, ts("2024-01-01 10:00:00.250000")), (3, None)],
                               "id long, ts timestamp_ntz")
    assert [r.id for r in lapse.ts_format_audit(df).collect()] == [2]


def test_funnel_equals_lapsed_and_still_lapsed(spark):
    later = Span("2024-10-01", "2025-01-31")
    cases = [
        [(1, "2024-06-05"), (2, "2024-06-05"), (2, "2024-11-01"), (3, "2024-06-06"), (3, "2024-07-06")],
        [(1, "2024-06-05"), (None, "2024-11-01"), (2, "2024-06-07")],          # NULL user in the later window
        [(1, "2024-06-05"), (None, "2024-07-01"), (2, "2024-11-01")],          # NULL user in the silent window
        [(None, "2024-06-05"), (1, "2024-06-06")],                             # silent and later empty
        [(None, "2024-06-05"), (1, "2024-06-06"), (1, "2024-12-01")],          # later without NULL
    ]
    for rows in cases:
        o = _o(spark, rows)
        lap = lapse.lapsed(o, ACTIVE, SILENT)
        funnel = lapse.lapse_funnel(o, ACTIVE, SILENT, later)
        key = lambda x: (x is None, x)
        assert sorted([r[0] for r in funnel.collect()], key=key) == sorted([r[0] for r in lap.collect()], key=key)
        still = lapse.still_lapsed(lap, o, later)
        assert sorted([r[0] for r in funnel.filter("still").collect()], key=key) == \
            sorted([r[0] for r in still.collect()], key=key)
        assert tuple(lapse.funnel_counts(funnel).collect()[0]) == tuple(lapse.lapse_counts(lap, still).collect()[0])


def test_activity_flags_equal_composed_operators(spark):
    pattern, recent = Span("2024-03-01", "2024-05-31"), Span("2024-10-01", "2025-01-31")
    cases = [
        [(1, "2024-03-03"), (1, "2024-04-03"), (1, "2024-05-03"), (1, "2024-06-03"),
         (2, "2024-03-03"), (2, "2024-04-03"), (2, "2024-05-03"), (2, "2024-06-03"), (2, "2024-10-03"),
         (3, "2024-03-03"), (3, "2024-06-03"), (4, "2024-11-11"), (5, "2024-06-04"), (None, "2024-10-05")],
        [(1, "2024-06-03"), (1, "2024-04-01"), (None, "2024-08-01"), (2, "2024-06-09")],   # NULL in silent
        [(None, "2024-06-03"), (None, "2024-04-01"), (1, "2024-06-09"), (1, "2024-03-09")],  # silent empty
    ]
    key = lambda x: (x[0] is None, x)
    for rows in cases:
        o = _o(spark, rows)
        flags = lapse.activity_flags(o, ACTIVE, SILENT, pattern, recent, "month")
        composed = lapse.active_periods(o, pattern, lapse.lapsed(o, ACTIVE, SILENT), "month")
        assert sorted((tuple(r) for r in lapse.cohort_periods(flags).collect()), key=key) == \
            sorted((tuple(r) for r in composed.collect()), key=key), rows
        assert sorted((tuple(r) for r in lapse.recent_from_flags(flags).collect()), key=key) == \
            sorted((tuple(r) for r in lapse.recent_buyers(o, recent).collect()), key=key)
        lapsed_users = sorted((r[0] for r in flags.filter("lapsed").collect()), key=lambda x: (x is None, x))
        assert lapsed_users == sorted((r[0] for r in lapse.lapsed(o, ACTIVE, SILENT).collect()),
                                      key=lambda x: (x is None, x))


def test_last_order_from_the_grades_pass(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import grades
    o = _o(spark, [(1, "2024-03-03 10:11:12.5"), (1, "2024-05-03 23:59:59"), (2, "2024-01-01"), (None, "2024-02-02")])
    g = grades.grade_by_spend(o, extra={"_last": F.max("ts")})
    assert set(g.columns) == {"user_id", "total_spent", "spending_grade", "_last"}
    via_grades = sorted((r.user_id, r.d) for r in g.select("user_id", lapse.to_second("_last").alias("d"))
                        .filter("user_id is not null").collect())
    direct = sorted((r.user_id, r.last_order_date) for r in lapse.last_order(o).filter("user_id is not null").collect())
    assert via_grades == direct == [(1, ts("2024-05-03 23:59:59")), (2, ts("2024-01-01"))]


def test_cohort_trend_one_pass_equals_the_composed_one(spark):
    import random

    import pytest

    rng = random.Random(6)
    span = Span("2023-01-15", "2023-10-01", closed=False)
    rows = [(rng.choice([1, 2, 3, 4, None]), i, 1.0, ts(f"2023-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}")) for i in range(60)]
    o = spark.createDataFrame(rows, ORDERS_SCHEMA)
    for since in ("2022-12-01", "2023-05-10"):
        for k in (2, 3):
            composed = lapse.cohort_trend(o, lapse.consistent_counts(o, span, "quarter", k), since)
            one = lapse.cohort_trend_one_pass(o, span, "quarter", k, since)
            assert [tuple(r) for r in one.collect()] == sorted(tuple(r) for r in composed.collect())
    with pytest.raises(ValueError):
        lapse.cohort_trend_one_pass(o, span, "month", 2, "2023-01-01", "quarter")
