"""Order periods, potential churners, period pivots, churn by grade and churn curves (OP19-OP26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import (Span, in_period, label_of_start, period_key, period_start,
                                        period_trunc, shift_period)
from tidemark.operators.relational import next_at_or_after

# Fixed value: label of a user with no zero period in the follow-up.
STILL_ACTIVE = "Still Active"


def _before(orders: DataFrame, cut: str | None) -> DataFrame:
    return orders if cut is None else Span(None, cut, closed=False).apply(orders, "ts")


def user_periods(orders: DataFrame, grain: str = "month", cut: str | None = None,
                 key: str = "user_id", name: str = "order_month") -> DataFrame:
    """OP19: distinct (user, period) pairs, optionally only orders before ``cut``."""
    pairs = _before(orders, cut).select(key, period_trunc("ts", grain).alias("_start")).distinct()
    return pairs.select(key, label_of_start("_start", grain).alias(name))


def order_span(orders: DataFrame, grain: str = "month", cut: str | None = None, key: str = "user_id") -> DataFrame:
    """OP20: first and last period with an order per user.

    The label is monotone in time, so it is computed once per user from
    ``min(ts)`` / ``max(ts)`` rather than per order.
    """
    agg = _before(orders, cut).groupBy(key).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    return agg.select(key, period_key("_lo", grain).alias("start_month"), period_key("_hi", grain).alias("end_month"))


def potential_churners(orders: DataFrame, gap: int = 3, cut: str | None = None, grain: str = "month",
                       quiet_after_last: int | None = None, as_of: str | None = None,
                       check: bool = False, key: str = "user_id") -> DataFrame:
    """OP21 / OP22: ``user_id, last_order_month, churn_start_month``.

    ``churn_start_month`` = start of the last period + ``gap`` periods. The
    source keeps users with no order in [churn_start, churn_start + gap)
    (and, for OP22, none strictly between the last period and last + 2).
    Nothing follows a user's last order, so both tests are always true and
    every non-NULL user is returned; by default the plan therefore skips
    the anti joins. ``check=True`` runs them (as range anti joins) to prove
    it; ``as_of`` adds the useful condition churn_start <= as_of.
    """
    span = order_span(orders, grain, cut, key).filter(F.col(key).isNotNull())
    last_start = period_start("end_month", grain)
    out = span.select(key, F.col("end_month").alias("last_order_month"),
                      shift_period(last_start, gap, grain).alias("churn_start_month"))
    if check:
        periods = user_periods(orders, grain, cut, key, "_p").withColumnRenamed(key, "_u")
        start_label = period_key(F.col("churn_start_month"), grain)
        end_label = period_key(shift_period(F.col("churn_start_month"), gap, grain), grain)
        out = out.join(periods, (out[key] == periods["_u"]) & (periods["_p"] >= start_label)
                       & (periods["_p"] < end_label), "left_anti")
        if quiet_after_last is not None:
            stop = period_key(shift_period(period_start(F.col("last_order_month"), grain), quiet_after_last, grain),
                              grain)
            out = out.join(periods, (out[key] == periods["_u"]) & (periods["_p"] > F.col("last_order_month"))
                           & (periods["_p"] < stop), "left_anti")
    if as_of is not None:
        out = out.filter(F.col("churn_start_month") <= F.lit(as_of).cast("date"))
    return out


def churners_as_of(orders: DataFrame, as_of: str, gap: int = 3, grain: str = "month", quiet_after_last: int | None = None,
                   key: str = "user_id") -> DataFrame:
    """OP21 / OP22 as of a date inside the data: ``user_id, last_order_month, churn_start_month, quiet``.

    The last period is that of the orders before ``as_of``; ``quiet`` says that no order of any time, later ones included,
    lies in [churn_start, churn_start + gap) nor, with ``quiet_after_last``, strictly between the last period and so many
    periods after it. Here both tests can fail. Each test is one as-of pass over the users' periods
    (``next_at_or_after``), so nobody's orders are joined by range.
    """
    periods = orders.select(key, period_trunc("ts", grain).alias("_at"))
    last = _before(orders, as_of).filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("ts").alias("_hi"))
    start = period_trunc("_hi", grain)
    out = last.select(key, start.alias("_last"), shift_period(start, gap, grain).alias("_at"))
    out = next_at_or_after(periods, out, key, "_at", "_next").withColumnRenamed("_at", "churn_start_month")
    quiet = F.col("_next").isNull() | (F.col("_next") >= shift_period(F.col("churn_start_month"), gap, grain))
    if quiet_after_last is not None:
        out = out.withColumn("_at", shift_period(F.col("_last"), 1, grain))
        out = next_at_or_after(periods, out, key, "_at", "_soon").drop("_at")
        quiet = quiet & (F.col("_soon").isNull() | (F.col("_soon") >= shift_period(F.col("_last"), quiet_after_last, grain)))
    return out.select(key, label_of_start("_last", grain).alias("last_order_month"), "churn_start_month", quiet.alias("quiet"))


def user_period_counts(orders: DataFrame, span: Span, grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP23: ``user_id, order_month, order_count`` (orders per user and period in ``span``)."""
    per = (span.apply(orders, "ts")
           .groupBy(key, period_trunc("ts", grain).alias("_start"))
           .agg(F.count("order_id").alias("order_count")))
    return per.select(key, label_of_start("_start", grain).alias("order_month"), "order_count")


def pivot_column(label: str) -> str:
    return "orders_" + label.replace("-", "_")


def period_pivot(orders: DataFrame, span: Span, periods: Sequence[str], grain: str = "month",
                 key: str = "user_id") -> DataFrame:
    """OP24: one row per user with an order in ``span``; one count column per period (0 when none).

    Conditional counts straight from the orders: one shuffle on the user,
    with map-side partial aggregation, instead of group-then-pivot. Each
    period test is two comparisons of the timestamp with literal bounds.
    """
    rows = span.apply(orders, "ts")
    return (rows.groupBy(key)
            .agg(*[F.count(F.when(in_period(rows, "ts", p, grain), F.col("order_id"))).alias(pivot_column(p))
                   for p in periods]))


def _all(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


def churn_by_grade(orders: DataFrame, grades: DataFrame, span: Span, active: Sequence[str],
                   silent: Sequence[str], grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP25: ``spending_grade, churned_customer_count``: users with orders in every ``active``
    period and none in any ``silent`` period, counted by grade (inner join)."""
    piv = period_pivot(orders, span, list(active) + list(silent), grain, key)
    cond = _all([F.col(pivot_column(p)) > 0 for p in active] + [F.col(pivot_column(p)) == 0 for p in silent])
    churned = piv.filter(cond).select(key)
    return (churned.join(grades.select(key, "spending_grade"), key)
            .groupBy("spending_grade")
            .agg(F.count_distinct(key).alias("churned_customer_count")))


def churn_curve(orders: DataFrame, span: Span, active: Sequence[str], follow: Sequence[str],
                grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP26: ``churned_month, churned_customer_count``.

    Users active in every ``active`` period are labelled with the first
    ``follow`` period in which they have no order, else 'Still Active'.
    """
    piv = period_pivot(orders, span, list(active) + list(follow), grain, key)
    initial = piv.filter(F.col(key).isNotNull() & _all([F.col(pivot_column(p)) > 0 for p in active]))
    label = F.coalesce(*[F.when(F.col(pivot_column(p)) == 0, F.lit(p)) for p in follow], F.lit(STILL_ACTIVE))
    # the pivot has one row per user, so a plain count is the distinct count
    return (initial.select(key, label.alias("churned_month"))
            .groupBy("churned_month")
            .agg(F.count(key).alias("churned_customer_count")))


def potential_churners_2m(orders: DataFrame, gap: int = 3, cut: str | None = None, quiet: int = 2,
                          grain: str = "month", **kw) -> DataFrame:
    """OP22: potential churners that also have no order in the ``quiet`` periods after the last one."""
    return potential_churners(orders, gap, cut, grain, quiet_after_last=quiet, **kw)
