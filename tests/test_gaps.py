from pyspark.sql import functions as F

from conftest import ORDERS_SCHEMA, SF01, ts
from tidemark.functions.periods import Span
from tidemark.operators import acquisition, gaps
from tidemark.plans import params as P
from tidemark.sources.views import events_view

TARGETS = ["2024-07", "2024-08", "2024-09"]
SPAN = Span("2024-07-01", "2024-09-30")


def _o(spark, rows):
    return spark.createDataFrame([(u, i, 1.0, ts(t)) for i, (u, t) in enumerate(rows)], ORDERS_SCHEMA)


def _fixture(spark):
    o = _o(spark, [(1, "2024-06-02"), (1, "2024-07-02"), (1, "2024-07-03"), (1, "2024-08-02"), (1, "2024-09-02"),
                   (2, "2024-06-02"), (2, "2024-07-02"), (2, "2024-07-09"), (2, "2024-09-02"),
                   (3, "2024-06-02")])
    first = acquisition.first_orders(o, Span("2024-06-01", "2024-06-30"))
    return o, first


def test_first_gap_labels(spark):
    o, first = _fixture(spark)
    got = {r.user_id: r.churned_month for r in gaps.first_gap(first, o, SPAN, TARGETS).collect()}
    assert got == {1: None, 2: "2024-08", 3: "2024-07"}


def test_fanout_copies_match_left_join_rows(spark):
    o, first = _fixture(spark)
    fan = {r.user_id: r.copies for r in gaps.first_gap_fanout(first, o, SPAN, TARGETS).collect()}
    # brute force: one left join per target month on the un-deduplicated orders
    mo = SPAN.apply(o, "ts").select("user_id", F.date_format("ts", "yyyy-MM").alias("m"))
    j = first
    for i, t in enumerate(TARGETS):
        mi = mo.filter(F.col("m") == t).select(F.col("user_id").alias(f"u{i}"), F.col("m").alias(f"m{i}"))
        j = j.join(mi, j.user_id == mi[f"u{i}"], "left")
    brute = {r.user_id: r["count"] for r in j.groupBy("user_id").count().collect()}
    assert fan == brute == {1: 2, 2: 2, 3: 1}
    rebuilt = gaps.first_gap_fanout(first, o, SPAN, TARGETS).select(
        "user_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    assert rebuilt.count() == 5


def test_spine_equals_aggregate_and_drops_no_gap(spark):
    o, first = _fixture(spark)
    a = sorted(tuple(r) for r in gaps.first_gap_spine(first, o, SPAN, TARGETS).collect())
    b = sorted(tuple(r) for r in gaps.first_gap_spine(first, o, SPAN, TARGETS, method="spine").collect())
    assert a == b == [(2, "2024-06", "2024-08"), (3, "2024-06", "2024-07")]


def test_properties_on_purchase_events(spark):
    ep = events_view(spark, SF01, "purchase")
    first = acquisition.first_orders(ep, P.GAP_WINDOW_FIRST_SPAN, "day")
    g = gaps.first_gap(first, ep, P.GAP_WINDOW_SPAN, P.GAP_WINDOW_TARGETS, "day")
    spine = gaps.first_gap_spine(first, ep, P.GAP_WINDOW_SPAN, P.GAP_WINDOW_TARGETS, "day", method="spine")
    assert sorted(tuple(r) for r in g.filter("churned_month is not null").collect()) == \
        sorted(tuple(r) for r in spine.collect())
    fan = gaps.first_gap_fanout(first, ep, P.GAP_WINDOW_SPAN, P.GAP_WINDOW_TARGETS, "day")
    assert sorted(tuple(r) for r in fan.drop("copies").collect()) == sorted(tuple(r) for r in g.collect())
    assert fan.agg(F.sum("copies")).collect()[0][0] == 183  # the source's fan-out row count at sf0.01
    counts = {r.month: r.churned_customers for r in gaps.gap_counts(g).collect()}
    assert sum(counts.values()) == g.filter("churned_month is not null").count()


def test_month_text_to_date(spark):
    df = spark.createDataFrame([("2024-06",), (None,), ("bad",)], "m string")
    got = [r.m for r in gaps.month_text_to_date(df, ["m"]).collect()]
    assert [str(x) if x else x for x in got] == ["2024-06-01", None, None]


def test_one_pass_equals_the_joined_form(spark):
    import numpy as np

    from tidemark.functions.periods import Span
    from tidemark.operators import acquisition

    rng = np.random.default_rng(8)
    rows = [(None if rng.random() < 0.05 else int(rng.integers(1, 30)), i, 1.0, ts(f"2024-0{rng.integers(1, 8)}-{rng.integers(1, 28):02d}"))
            for i in range(200)]
    orders = spark.createDataFrame(rows, ORDERS_SCHEMA)
    first_span, span = Span("2024-01-01", "2024-03-01", closed=False), Span("2024-02-01", "2024-07-01", closed=False)
    targets = ["2024-03", "2024-04", "2024-05"]
    first = acquisition.first_orders(orders, first_span)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(gaps.first_gap_one_pass(orders, first_span, span, targets), gaps.first_gap(first, orders, span, targets))
    assert same(gaps.first_gap_fanout_one_pass(orders, first_span, span, targets),
                gaps.first_gap_fanout(first, orders, span, targets))
    some = first.filter("first_order_month = '2024-02' AND user_id IS NOT NULL")
    assert same(gaps.first_gap_one_pass(orders, first_span, span, targets, first_period="2024-02"),
                gaps.first_gap(some, orders, span, targets))
    plan = gaps.first_gap_one_pass(orders, first_span, span, targets)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
