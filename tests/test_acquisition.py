from conftest import ORDERS_SCHEMA, SF01, ts
from tidemark.functions.periods import Span
from tidemark.operators import acquisition
from tidemark.plans import params as P
from tidemark.sources.views import orders_view


def _o(spark, rows):
    return spark.createDataFrame([(u, i, 1.0, ts(t)) for i, (u, t) in enumerate(rows)], ORDERS_SCHEMA)


def test_first_orders_left_censored_and_new(spark):
    o = _o(spark, [(1, "2023-07-15"), (1, "2023-09-01"), (2, "2024-03-02"), (3, "2024-04-09"), (3, "2024-12-01")])
    first = acquisition.first_orders(o, Span("2023-08-01", "2024-11-30"))
    got = {r.user_id: r.first_order_month for r in first.collect()}
    assert got == {1: "2023-09", 2: "2024-03", 3: "2024-04"}  # the July order is outside the span
    assert sorted(r.user_id for r in acquisition.new_customers(first, "2024-03").collect()) == [2, 3]


def test_acquisition_report_inner_joins_and_rate(spark):
    o = _o(spark, [(1, "2023-09-01"), (1, "2024-03-05"), (1, "2024-04-05"),
                   (2, "2024-03-02"), (2, "2024-04-02"),
                   (3, "2024-05-09")])
    span = Span("2024-03-01", "2024-11-30")
    first = acquisition.first_orders(o, Span("2023-08-01", "2024-11-30"))
    new = acquisition.new_customers(first, "2024-03")
    existing = acquisition.existing_activity(o, new, span)
    monthly = acquisition.monthly_totals(o, span)
    rep = {r.month: r for r in acquisition.acquisition_report(new, existing, monthly).collect()}
    # May has a new user but no existing-user activity: dropped by the inner join
    assert set(rep) == {"2024-03"}
    r = rep["2024-03"]
    assert (r.new_customers, r.existing_customers, r.total_customers) == (1, 1, 2)
    assert r.new_customer_rate == 50.0
    # user 2's April order counts in neither new (first month only) nor existing
    ex = {x.order_month: x.active_customers for x in existing.collect()}
    assert ex == {"2024-03": 1, "2024-04": 1}


def test_existing_outside_window_is_empty(spark):
    o = orders_view(spark, SF01)
    first = acquisition.first_orders(o, P.FIRST_SPAN)
    assert acquisition.existing_outside_window(o, first, P.ACTIVITY_SPAN).count() == 0


def test_new_customer_rate(spark):
    o = _o(spark, [(1, "2024-06-03"), (2, "2024-06-04"), (3, "2024-05-01"), (3, "2024-06-09"), (4, "2024-07-01")])
    rate = {r.month: (r.new_customers, r.total_customers, r.new_customer_rate) for r in acquisition.new_customer_rate(
        o, Span("2023-08-01", "2025-01-31"), "2024-06", Span("2024-06-01", "2025-01-31")).collect()}
    assert rate == {"2024-06": (2, 3, 2 / 3 * 100), "2024-07": (1, 1, 100.0)}


def test_approx_monthly_totals_close_to_exact(spark):
    o = orders_view(spark, SF01)
    exact = {r.order_month: (r.total_customers, r.total_orders)
             for r in acquisition.monthly_totals(o, P.ACTIVITY_SPAN).collect()}
    approx = {r.order_month: (r.total_customers, r.total_orders)
              for r in acquisition.monthly_totals(o, P.ACTIVITY_SPAN, approx_rsd=0.01).collect()}
    assert set(exact) == set(approx)
    for m, (users, orders) in exact.items():
        assert approx[m][1] == orders
        assert abs(approx[m][0] - users) <= max(3, 0.05 * users)


def test_approx_profile(spark):
    from tidemark.operators import sales
    o = orders_view(spark, SF01)
    exact = sales.profile(o, "amount").collect()[0]
    approx = sales.profile(o, "amount", approx_rsd=0.02).collect()[0]
    assert approx.row_count == exact.row_count and abs(approx.distinct_count - exact.distinct_count) < 0.1 * exact.distinct_count


def test_one_pass_existing_activity_equals_composed(spark):
    first_span, since, span = Span("2023-08-01", "2024-11-30"), "2024-03", Span("2024-03-01", "2024-11-30")
    cases = [
        [(1, "2023-09-01"), (1, "2024-03-05"), (1, "2024-04-05"), (2, "2024-03-02"), (2, "2024-04-02"),
         (3, "2024-05-09"), (4, "2024-06-01 10:00:00"), (4, "2023-07-01")],
        [(1, "2023-09-01"), (1, "2024-03-05"), (None, "2024-04-01")],       # NULL user is new: NOT IN empties
        [(1, "2023-09-01"), (1, "2024-03-05"), (None, "2023-10-01"), (None, "2024-04-01")],  # NULL user not new
        [(1, "2023-09-01"), (1, "2024-03-05"), (None, "2024-04-01"), (None, "2023-09-09")],
    ]
    for rows in cases:
        o = _o(spark, rows)
        composed = acquisition.existing_activity(
            o, acquisition.new_customers(acquisition.first_orders(o, first_span), since), span)
        one = acquisition.existing_activity_one_pass(o, first_span, since, span)
        assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in composed.collect()), rows


def test_one_pass_outside_window_equals_composed(spark):
    o = orders_view(spark, SF01)
    composed = acquisition.existing_outside_window(o, acquisition.first_orders(o, P.FIRST_SPAN), P.ACTIVITY_SPAN)
    one = acquisition.existing_activity_one_pass(o, P.FIRST_SPAN, None, P.ACTIVITY_SPAN)
    assert one.count() == composed.count() == 0
    wide = Span("1995-01-01", "2001-12-31")   # activity outside the first-order span: rows remain
    composed = acquisition.existing_outside_window(o, acquisition.first_orders(o, P.FIRST_SPAN), wide)
    one = acquisition.existing_activity_one_pass(o, P.FIRST_SPAN, None, wide)
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in composed.collect())
    assert one.count() > 0


def test_one_pass_report_and_rate_equal_the_composed_ones(spark):
    """Random small order tables, NULL users among them."""
    import random

    rng = random.Random(5)
    first, span = Span("2023-02-01", "2023-09-30"), Span("2023-04-01", "2023-12-31")
    for case in range(4):
        users = [1, 2, 3, 4, 5, 6] + ([None] if case == 3 else [])
        rows = [(rng.choice(users), f"2023-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}") for _ in range(20 + 10 * case)]
        o = _o(spark, rows)
        for since in ("2023-03", "2023-06"):
            born = acquisition.new_customers(acquisition.first_orders(o, first), since)
            totals = acquisition.monthly_totals(o, span)
            composed = acquisition.acquisition_report(born, acquisition.existing_activity(o, born, span), totals)
            one = acquisition.acquisition_report_one_pass(o, first, since, span)
            assert one.columns == composed.columns
            assert [tuple(r) for r in one.collect()] == sorted(tuple(r) for r in composed.collect())
            born_by_month = {}
            for r in born.collect():
                born_by_month.setdefault(r.first_order_month, set()).add(r.user_id)
            expected = [(r.order_month, len(born_by_month[r.order_month] - {None}), r.total_customers)
                        for r in sorted(totals.collect()) if r.order_month in born_by_month]
            rate = acquisition.new_customer_rate(o, first, since, span).collect()
            assert [(r.month, r.new_customers, r.total_customers) for r in rate] == expected
