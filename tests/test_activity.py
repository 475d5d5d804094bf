"""The activity state against the operators that count rows, and its merge against the whole."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import ORDERS_SCHEMA, ts
from tidemark.functions.periods import Span
from tidemark.operators import acquisition, activity, churn, gaps, lapse


def _orders(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = rng.choice([None, *[1] * 30, *range(2, 400)])  # a hot user, NULL users
        day = rng.choice(["2023-%02d-%02d" % (rng.randint(1, 12), rng.randint(1, 28)), "2024-%02d-%02d" % (rng.randint(1, 12), rng.randint(1, 28))])
        rows.append((user, i, 1.0, None if rng.random() < 0.03 else ts(day + rng.choice([" 00:00:00", " 13:14:15"]))))
    return spark.createDataFrame(rows, ORDERS_SCHEMA).repartition(5).cache()


def _same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.count() > 0


@pytest.fixture(scope="module")
def orders(spark):
    return _orders(spark)


def test_calendars():
    months = activity.Calendar.covering(Span("2023-11-05", "2024-02-01"))
    assert months.labels() == ["2023-11", "2023-12", "2024-01", "2024-02"] and months.place("2024-01") == 2
    assert activity.Calendar.covering(Span("2023-11-05", "2024-02-01", closed=False)).periods == 3
    assert activity.Calendar.covering(Span("2023-12-31", "2024-01-01"), "day").labels() == ["2023-12-31", "2024-01-01"]
    assert activity.Calendar.covering(Span("2023-05-01", "2024-02-01"), "quarter").labels() == ["2023-Q2", "2023-Q3", "2023-Q4", "2024-Q1"]
    assert activity.Calendar.covering(Span("2023-05-01", "2024-02-01"), "year").labels() == ["2023", "2024"]
    assert activity.Calendar("2023-01-01", 125, "day").words == 3
    with pytest.raises(ValueError):
        months.place("2024-03")
    with pytest.raises(ValueError):
        activity.Calendar.covering(Span("2023-01-01", None))


@pytest.mark.parametrize("grain,first,periods", [("day", "2023-03-01", 200), ("month", "2023-02", 20), ("quarter", "2022-Q4", 9), ("year", "2023", 2)])
def test_state_equals_its_definition(spark, orders, grain, first, periods):
    calendar = activity.Calendar(first, periods, grain)
    span, first_span = Span("2023-02-10", "2024-10-31"), Span("2023-06-01", "2024-03-01", closed=False)
    state = activity.activity_state(orders, calendar, span, first_span)
    want = {}
    for r in orders.collect():
        w = want.setdefault(r["user_id"], [None, None, 0, set()])
        if r["ts"] is None:
            continue
        if ts("2023-06-01") <= r["ts"] < ts("2024-03-01"):
            w[0] = min(filter(None, (w[0], r["ts"])))
        if ts("2023-02-10") <= r["ts"] <= ts("2024-10-31"):
            w[1], w[2] = max(filter(None, (w[1], r["ts"]))), w[2] + 1
            at = activity._number(r["ts"].date(), grain) - calendar.origin
            if 0 <= at < periods:
                w[3].add(at)
    got = {}
    for r in state.collect():
        bits = {62 * i + b for i in range(calendar.words) for b in range(62) if r[f"bits_{i}"] >> b & 1}
        got[r["user_id"]] = [r["first_ts"], r["last_ts"], r["n_orders"], bits]
    assert got == {k: v for k, v in want.items() if v[0] or v[2]}
    pairs = activity.period_rows(state, calendar).collect()
    assert sorted(map(tuple, pairs), key=str) == sorted(((u, calendar.labels()[b]) for u, v in got.items() for b in v[3]), key=str)


def test_merged_halves_equal_the_whole(orders):
    calendar, span, first_span = activity.Calendar("2023-01-01", 400, "day"), Span("2023-02-01", "2024-08-01"), Span("2023-04-01", "2024-02-01")
    parts = [activity.activity_state(orders.filter(F.col("order_id") % 3 == i), calendar, span, first_span) for i in range(3)]
    whole = activity.activity_state(orders, calendar, span, first_span)
    _same(activity.merge_states(*parts), whole)
    _same(activity.merge_states(parts[0], activity.merge_states(parts[1], parts[2])), whole)


def test_answers_equal_the_counting_operators(spark, orders):
    span, first_span = Span("2023-07-01", "2024-09-30"), Span("2023-01-01", "2024-09-30")
    months = activity.Calendar.covering(span)
    state = activity.activity_state(orders, months, span, first_span)
    _same(activity.new_customer_rate(state, months, "2023-03"), acquisition.new_customer_rate(orders, first_span, "2023-03", span))
    later = activity.activity_state(orders, months, span, Span("2023-01-01", "2024-12-31"))
    _same(activity.new_customer_rate(later, months, "2023-03"), acquisition.new_customer_rate(orders, Span("2023-01-01", "2024-12-31"), "2023-03", span))

    half = Span("2023-01-01", "2023-07-01", closed=False)
    months = activity.Calendar.covering(half)
    state = activity.activity_state(orders, months, half, half)
    on, off = ["2023-01", "2023-02"], ["2023-03", "2023-04", "2023-05"]
    _same(activity.churn_curve(state, months, on, off), churn.churn_curve(orders, half, on, off))
    grades = spark.createDataFrame([(i, "VIP" if i % 2 else "Gold") for i in range(1, 300)], "user_id long, spending_grade string")
    _same(activity.churn_by_grade(state, months, grades, on[:1], off[:1]), churn.churn_by_grade(orders, grades, half, on[:1], off[:1]))
    two = Span("2023-01-01", "2023-03-01", closed=False)
    short = activity.activity_state(orders, activity.Calendar.covering(two), two, two)
    _same(activity.consistent(short, activity.Calendar.covering(two), on), lapse.consistent_counts(orders, two, "month", 2))
    _same(activity.lapsed(state, months, on, off).filter("user_id IS NOT NULL"), lapse.lapsed(
        orders.filter("user_id IS NOT NULL"), Span("2023-01-01", "2023-03-01", closed=False), Span("2023-03-01", "2023-06-01", closed=False)))

    year, window = Span("2023-01-01", "2023-12-31"), Span("2024-01-01", "2024-07-01", closed=False)
    months = activity.Calendar.covering(window)
    state = activity.activity_state(orders, months, window, year)
    targets = months.labels()
    first = acquisition.first_orders(orders, year)
    _same(activity.first_gap(state, months, targets), gaps.first_gap(first, orders, window, targets))
    born = first.filter("user_id IS NOT NULL").first()["first_order_month"]
    _same(activity.first_gap(state, months, targets, born), gaps.first_gap_one_pass(orders, year, window, targets, first_period=born))


def test_one_shuffle_and_no_window(spark):
    from conftest import SF001
    from tidemark.plans.catalog import QUERIES

    for name, exchanges in (("new_customer_rate", 3), ("churn_curve", 2), ("first_gap_window", 1)):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan, name
        assert plan.count("Exchange") <= exchanges and plan.count("FileScan") == 1, (name, plan)
