"""First missing period after a first order (OP34-OP39).

"churned_month" keeps the source column name, but it means the first
*gap* -- the first target period without an order -- not a final departure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import Span, in_period, label_of_start, period_key, period_start, period_trunc


def _target_counts(orders: DataFrame, span: Span, targets: Sequence[str], grain: str, key: str) -> DataFrame:
    """One row per user: order count in each target period (one shuffle, partial aggregation)."""
    rows = span.apply(orders, "ts")
    return (rows.groupBy(key)
            .agg(*[F.count(F.when(in_period(rows, "ts", t, grain), F.lit(1))).alias(f"_n{i}")
                   for i, t in enumerate(targets)]))


def _first_missing(targets: Sequence[str]):
    return F.coalesce(*[F.when(F.coalesce(F.col(f"_n{i}"), F.lit(0)) == 0, F.lit(t)) for i, t in enumerate(targets)])


def first_gap(first: DataFrame, orders: DataFrame, span: Span, targets: Sequence[str], grain: str = "month",
              key: str = "user_id") -> DataFrame:
    """OP35: ``user_id, first_order_month, churned_month`` for every user of ``first``.

    ``churned_month`` is the first of ``targets`` with no order in ``span``,
    NULL when the user ordered in all of them. One conditional aggregate
    replaces the source's per-target existence subqueries.
    """
    counts = _target_counts(orders, span, targets, grain, key)
    return (first.select(key, "first_order_month").join(counts, key, "left")
            .select(key, "first_order_month", _first_missing(targets).alias("churned_month")))


def _one_pass(orders: DataFrame, first_span: Span, span: Span, targets: Sequence[str], grain: str,
              key: str) -> DataFrame:
    """``first_orders`` and the target counts in one aggregate: one scan, one shuffle, no join."""
    first, inside = first_span.predicate(orders, "ts"), span.predicate(orders, "ts")
    # a NULL key matches no order of its own in the joined form, so its targets count none
    counted = inside & F.col(key).isNotNull()
    per = (orders.filter(first | inside).groupBy(key)
           .agg(F.min(F.when(first, F.col("ts"))).alias("_first"),
                *[F.count(F.when(counted & in_period(orders, "ts", t, grain), F.lit(1))).alias(f"_n{i}")
                  for i, t in enumerate(targets)]))
    return per.filter(F.col("_first").isNotNull()).withColumn("first_order_month", period_key("_first", grain))


def first_gap_one_pass(orders: DataFrame, first_span: Span, span: Span, targets: Sequence[str],
                       grain: str = "month", key: str = "user_id", first_period: str | None = None) -> DataFrame:
    """OP27 -> OP35 in one scan: equal to ``first_gap(first_orders(orders, first_span), ...)``.
    ``first_period`` keeps the (known) users whose first period it is."""
    per = _one_pass(orders, first_span, span, targets, grain, key)
    if first_period is not None:
        per = per.filter((F.col("first_order_month") == first_period) & F.col(key).isNotNull())
    return per.select(key, "first_order_month", _first_missing(targets).alias("churned_month"))


def first_gap_fanout_one_pass(orders: DataFrame, first_span: Span, span: Span, targets: Sequence[str],
                              grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP27 -> OP34 in one scan: equal to ``first_gap_fanout(first_orders(orders, first_span), ...)``."""
    return (_one_pass(orders, first_span, span, targets, grain, key)
            .select(key, "first_order_month", _first_missing(targets).alias("churned_month"),
                    _copies(targets).alias("copies")))


def _copies(targets: Sequence[str]):
    copies = F.lit(1).cast("long")
    for i in range(len(targets)):
        copies = F.try_multiply(copies, F.greatest(F.coalesce(F.col(f"_n{i}"), F.lit(0)), F.lit(1)).cast("long"))
    return F.coalesce(copies, F.raise_error(F.lit("a user's copies exceed 2^63 - 1")).cast("long"))


def first_gap_fanout(first: DataFrame, orders: DataFrame, span: Span, targets: Sequence[str],
                     grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP34: the source's one-left-join-per-target form, as a row multiplicity.

    That form joins each user to every order row of each target period, so
    a user appears prod(max(1, orders in target)) times. The product grows
    multiplicatively with a heavy user's orders, so the copies are not
    materialised: each user comes once with ``copies`` (an error if it does not
    fit in a long, never a lost count). ``explode(sequence(1, copies))`` rebuilds the rows.
    """
    counts = _target_counts(orders, span, targets, grain, key)
    return (first.select(key, "first_order_month").join(counts, key, "left")
            .select(key, "first_order_month", _first_missing(targets).alias("churned_month"),
                    _copies(targets).alias("copies")))


def fanout_rows(fanout: DataFrame) -> DataFrame:
    """JN7: the rows of the source's one-left-join-per-target form: each row of ``first_gap_fanout`` as
    often as its ``copies`` say. They are made one by one where they are read, never collected."""
    rest = [c for c in fanout.columns if c != "copies"]
    return fanout.select(*rest, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")


def gap_counts(gaps: DataFrame) -> DataFrame:
    """OP36: ``month, churned_customers`` = users per first gap; users without a gap are not counted."""
    return (gaps.filter(F.col("churned_month").isNotNull())
            .groupBy(F.col("churned_month").alias("month"))
            .agg(F.count(F.lit(1)).alias("churned_customers")))


def with_grade(gaps: DataFrame, grades: DataFrame, key: str = "user_id") -> DataFrame:
    """OP37: gaps joined (inner) to ``spending_grade``."""
    return gaps.join(grades.select(key, "spending_grade"), key)


def first_gap_spine(first: DataFrame, orders: DataFrame, span: Span, targets: Sequence[str],
                    grain: str = "month", key: str = "user_id", method: str = "aggregate") -> DataFrame:
    """OP38: the earliest missing target per user; users with no gap are dropped.

    ``method="aggregate"`` is OP35 without its NULL rows. ``method="spine"``
    is the source's own form -- users times target periods, anti join the
    orders, take the minimum -- kept as an independent check. The spine has
    ``len(targets)`` rows per user, a fixed small factor.
    """
    if method == "aggregate":
        return first_gap(first, orders, span, targets, grain, key).filter(F.col("churned_month").isNotNull())
    spine = first.select(key, "first_order_month", F.explode(F.array(*[F.lit(t) for t in targets])).alias("_t"))
    pairs = span.apply(orders, "ts").select(F.col(key).alias("_u"), period_trunc("ts", grain).alias("_s")).distinct()
    have = pairs.select("_u", label_of_start("_s", grain).alias("_p"))
    missing = spine.join(have, (spine[key] == have._u) & (spine._t == have._p), "left_anti")
    return missing.groupBy(key, "first_order_month").agg(F.min("_t").alias("churned_month"))


def month_text_to_date(df: DataFrame, columns: Sequence[str], grain: str = "month") -> DataFrame:
    """OP39: period text ('YYYY-MM') to the first-of-period DATE; NULL and bad text give NULL.

    Returns a new DataFrame; to change a stored table, write it to a new
    table and swap (see ``tidemark.sources.sinks.replace_table``).
    """
    out = df
    for c in columns:
        out = out.withColumn(c, period_start(F.col(c), grain))
    return out


def first_gap_graded(gaps: DataFrame, grades: DataFrame, key: str = "user_id") -> DataFrame:
    """OP37: ``user_id, first_order_month, churned_month, spending_grade``."""
    return with_grade(gaps, grades, key)
