import pytest

from conftest import ORDERS_SCHEMA, SF01, ts
from tidemark.functions.periods import Span
from tidemark.operators import churn
from tidemark.sources.views import orders_view


def _o(spark, rows):
    return spark.createDataFrame([(u, i, 1.0, ts(t)) for i, (u, t) in enumerate(rows)], ORDERS_SCHEMA)


def test_periods_and_span(spark):
    o = _o(spark, [(1, "2024-01-05"), (1, "2024-01-20"), (1, "2024-03-01"), (2, "2023-12-31")])
    assert sorted(tuple(r) for r in churn.user_periods(o).collect()) == [(1, "2024-01"), (1, "2024-03"), (2, "2023-12")]
    assert sorted(tuple(r) for r in churn.order_span(o).collect()) == [(1, "2024-01", "2024-03"), (2, "2023-12", "2023-12")]
    assert [tuple(r) for r in churn.user_periods(o, "quarter", cut="2024-01-01").collect()] == [(2, "2023-Q4")]


def test_potential_churners_always_true_and_check_agrees(spark):
    o = orders_view(spark, SF01)
    fast = churn.potential_churners(o, 3, cut="1998-01-01", quiet_after_last=2)
    checked = churn.potential_churners(o, 3, cut="1998-01-01", quiet_after_last=2, check=True)
    a = sorted(tuple(r) for r in fast.collect())
    assert a == sorted(tuple(r) for r in checked.collect())
    users = [r[0] for r in a]
    assert len(users) == len(set(users))  # each user once
    assert len(users) == o.filter("ts < '1998-01-01'").select("user_id").distinct().count()


def test_potential_churners_dates_and_as_of(spark):
    o = _o(spark, [(1, "2024-11-05"), (2, "2024-05-05"), (None, "2024-05-05")])
    rows = {r.user_id: (r.last_order_month, str(r.churn_start_month)) for r in churn.potential_churners(o).collect()}
    assert rows == {1: ("2024-11", "2025-02-01"), 2: ("2024-05", "2024-08-01")}
    as_of = churn.potential_churners(o, as_of="2024-12-31")
    assert [r.user_id for r in as_of.collect()] == [2]


def test_pivot_zero_fill_and_churn_curve(spark):
    o = _o(spark, [(1, "2024-06-01"), (1, "2024-07-01"), (1, "2024-08-01"),
                   (2, "2024-06-01"), (2, "2024-07-01"), (2, "2024-08-01"), (2, "2024-09-09"),
                   (3, "2024-06-01"), (3, "2024-07-01"), (3, "2024-08-01"), (3, "2024-09-09"), (3, "2024-10-10"),
                   (4, "2024-06-01")])
    span = Span("2024-06-01", "2024-11-01", closed=False)
    months = ["2024-06", "2024-07", "2024-08", "2024-09", "2024-10"]
    piv = {r.user_id: r for r in churn.period_pivot(o, span, months).collect()}
    assert piv[4].orders_2024_07 == 0 and piv[4].orders_2024_06 == 1
    curve = {r.churned_month: r.churned_customer_count
             for r in churn.churn_curve(o, span, months[:3], months[3:]).collect()}
    assert curve == {"2024-09": 1, "2024-10": 1, "Still Active": 1}
    assert sum(curve.values()) == 3  # every active-cohort user is counted once


def test_churn_by_grade(spark):
    o = _o(spark, [(1, "2024-03-01"), (1, "2024-04-01"), (1, "2024-05-01"),
                   (2, "2024-03-01"), (2, "2024-04-01"), (2, "2024-05-01"), (2, "2024-06-01"),
                   (3, "2024-03-01"), (3, "2024-04-01"), (3, "2024-05-01")])
    g = spark.createDataFrame([(1, "VIP"), (2, "VIP"), (3, "Gold")], "user_id long, spending_grade string")
    got = {r.spending_grade: r.churned_customer_count for r in churn.churn_by_grade(
        o, g, Span("2024-03-01", "2024-07-01", closed=False), ["2024-03", "2024-04", "2024-05"], ["2024-06"]).collect()}
    assert got == {"VIP": 1, "Gold": 1}


def test_aliases(spark):
    from tidemark.operators import gaps, lapse, sales
    o = _o(spark, [(1, "2024-11-05"), (2, "2024-05-05")])
    assert churn.potential_churners_2m(o).count() == 2
    assert callable(gaps.first_gap_graded) and callable(lapse.churned_consistent_by_grade)
    a = spark.createDataFrame([(ts("2020-01-05"), 1.0), (ts("2021-01-05"), 3.0)], "d timestamp_ntz, p double")
    ys = sales.yearly_summary_multi({"A": (a, "d", "p")}, Span("2019-01-01", "2024-12-31"))
    assert sorted((r.year, r.avg_price_change_pct) for r in ys.collect()) == [(2020, None), (2021, 200.0)]


def test_next_at_or_after_equals_brute_force(spark):
    import datetime as dt
    import random

    from tidemark.operators.relational import next_at_or_after

    rng = random.Random(2)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    events = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, day(rng.randint(0, 40))])) for _ in range(300)]
    probes = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, day(rng.randint(-5, 50))]), i) for i in range(120)]
    got = next_at_or_after(spark.createDataFrame(events, "k long, at date").repartition(4), spark.createDataFrame(probes, "k long, at date, tag int"), "k", "at")
    want = {i: (k, a, min((e for u, e in events if e and a and u == k and k is not None and e >= a), default=None)) for k, a, i in probes}
    assert {r["tag"]: (r["k"], r["at"], r["next_at"]) for r in got.collect()} == want
    assert got.columns == ["k", "at", "tag", "next_at"] and len(want) == 120


@pytest.mark.parametrize("grain,gap,quiet_after", [("month", 3, None), ("month", 2, 2), ("quarter", 1, 2)])
def test_churners_as_of_a_date_inside_the_data(spark, grain, gap, quiet_after):
    import random

    rng = random.Random(gap)
    rows = [(rng.choice([None, 1, 1, *range(2, 60)]), i, 1.0, ts(f"202{rng.randint(2, 4)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}")) for i in range(220)]
    o = spark.createDataFrame(rows, ORDERS_SCHEMA)
    size = 3 if grain == "quarter" else 1
    number = lambda t: (t.year * 12 + t.month - 1) // size
    want = {}
    for u in {r[0] for r in rows} - {None}:
        before = [number(r[3]) for r in rows if r[0] == u and r[3] < ts("2023-07-01")]
        if before:
            last, seen = max(before), {number(r[3]) for r in rows if r[0] == u}
            quiet = not any(last + gap <= p < last + 2 * gap for p in seen)
            want[u] = quiet and not any(last < p < last + quiet_after for p in seen) if quiet_after else quiet
    got = {r["user_id"]: r["quiet"] for r in churn.churners_as_of(o, "2023-07-01", gap, grain, quiet_after).collect()}
    assert got == want and set(got.values()) == {True, False}
