"""Bitmap counts against sets."""

import random

from pyspark.sql import functions as F

from conftest import ORDERS_SCHEMA, ts
from tidemark.operators import distinct, relational


def _orders(spark, seed=0, n=3000):
    rng = random.Random(seed)
    ids = [None, 0, -1, -40_000, 1, 32_768, 32_769, 100_000, *range(2, 400)]
    rows = [(rng.choice(ids), None if rng.random() < 0.02 else i, 1.0, ts(f"2024-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d} 10:00:00")) for i in range(n)]
    rows += [(7, 10_000 + i, 1.0, ts("2024-02-03")) for i in range(n // 2)]  # a hot user and day
    return spark.createDataFrame(rows, ORDERS_SCHEMA).repartition(6)


def _want(rows, label):
    users, orders = {}, {}
    for r in rows:
        p = label(r["ts"])
        users.setdefault(p, set()).update([] if r["user_id"] is None else [r["user_id"]])
        orders[p] = orders.get(p, 0) + (r["order_id"] is not None)
    return {p: (len(users[p]), orders[p]) for p in users}


def test_counts_at_every_grain_from_the_same_bitmaps(spark):
    orders = _orders(spark).cache()
    rows = orders.collect()
    days = distinct.period_bitmaps(orders).cache()
    months = distinct.roll_up(days, "month").cache()
    grains = [(days, "day", lambda t: t.strftime("%Y-%m-%d")), (months, "month", lambda t: t.strftime("%Y-%m")),
              (distinct.roll_up(months, "quarter"), "quarter", lambda t: f"{t.year}-Q{(t.month + 2) // 3}"),
              (distinct.roll_up(days, "year"), "year", lambda t: str(t.year))]
    for maps, grain, label in grains:
        got = {r[0]: (r[1], r[2]) for r in distinct.period_counts(maps, grain).collect()}
        assert got == _want(rows, label), grain
    assert days.groupBy("_bucket").count().count() > 4  # several buckets, below and above 0, and the NULL one
    plain = relational.period_activity(orders, "month", "order_month", "total_customers").collect()
    assert sorted(plain) == sorted(distinct.period_counts(months, "month").collect())


def test_merged_parts_equal_the_whole(spark):
    orders = _orders(spark, 1).cache()
    parts = [distinct.period_bitmaps(orders.filter(F.pmod(F.col("order_id"), F.lit(3)) == i)) for i in range(3)]
    rest = distinct.period_bitmaps(orders.filter("order_id IS NULL"))
    merged, whole = distinct.merge(*parts, rest), distinct.period_bitmaps(orders)
    assert sorted(map(str, distinct.counts(merged).collect())) == sorted(map(str, distinct.counts(whole).collect()))
    assert sorted(map(str, merged.select(*sorted(merged.columns)).collect())) == sorted(map(str, whole.select(*sorted(whole.columns)).collect()))


def test_cohort_in_each_period(spark):
    orders = _orders(spark, 2).cache()
    rows = orders.collect()
    cohort = {r["user_id"] for r in rows if r["ts"].month == 1 and r["user_id"] is not None}
    among = distinct.unite(distinct.period_bitmaps(orders.filter("ts < '2024-02-01'")), [])
    got = {r["start"].strftime("%m"): r["customers"] for r in distinct.in_set(distinct.period_bitmaps(orders, "month"), among).collect()}
    want = {}
    for r in rows:
        if r["user_id"] in cohort:
            want.setdefault(r["ts"].strftime("%m"), set()).add(r["user_id"])
    assert got == {m: len(u) for m, u in want.items()}


def test_empty(spark):
    assert distinct.period_counts(distinct.roll_up(distinct.period_bitmaps(_orders(spark).limit(0)), "month"), "month").collect() == []
