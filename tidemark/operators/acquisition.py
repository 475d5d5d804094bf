"""New and existing customers, monthly totals and new-customer rate (OP27-OP33)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.periods import Span, label_of_start, period_key, period_trunc
from tidemark.operators.relational import not_in, per_user_period, period_activity, roll_up_periods


def first_orders(orders: DataFrame, span: Span, grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP27: ``user_id, first_order_month`` = first period with an order inside ``span``.

    Left-censored at ``span.start``: an earlier order is not seen.
    """
    return (span.apply(orders, "ts").groupBy(key).agg(F.min("ts").alias("_first"))
            .select(key, period_key("_first", grain).alias("first_order_month")))


def new_customers(first: DataFrame, since: str) -> DataFrame:
    """OP28: users whose first period is ``>= since`` (label comparison)."""
    return first.filter(F.col("first_order_month") >= since)


def existing_activity(orders: DataFrame, new: DataFrame, span: Span, grain: str = "month",
                      key: str = "user_id") -> DataFrame:
    """OP29: ``order_month, active_customers, total_orders`` of users NOT IN ``new``.

    Orders are reduced to (month, user) rows before the anti join, so the
    join moves at most one row per user and month, whatever a user's volume.
    """
    per_user = not_in(per_user_period(span.apply(orders, "ts"), grain, key=key), new.select(key), key)
    return roll_up_periods(per_user, key=key)


def existing_activity_one_pass(orders: DataFrame, first_span: Span, since: str | None, span: Span,
                               grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP27 -> OP28 -> OP29 in one scan: ``order_month, active_customers, total_orders``
    of the users that are NOT IN the new customers.

    The first-order span and the activity span are read by one scan and
    reduced to one row per (user, period) holding the earliest first-span
    order and the activity-span order count. A window per user (a handful
    of rows each, whatever the user's volume) finds the first order month;
    the ``NOT IN`` NULL rules come from one scalar subquery over those same
    rows. Equal to ``existing_activity(orders, new_customers(first_orders(...)), ...)``;
    with ``since=None`` every user with a first-span order is excluded, which
    is ``existing_outside_window`` (OP32).
    """
    rows = _flagged(orders, first_span, since, span, grain, key).filter("_rows > 0 AND _existing")
    return (rows.groupBy(label_of_start("_start", grain).alias("order_month"))
            .agg(F.count(key).alias("active_customers"), F.sum("_n").cast("long").alias("total_orders")))


def _per_period(orders: DataFrame, first_span: Span, since: str | None, span: Span, grain: str, key: str) -> DataFrame:
    """One scan of both spans, one row per (user, period): ``_first`` (earliest first-span
    order), ``_n`` and ``_rows`` (activity-span orders), ``_new`` (a new customer) and
    ``_born`` (a new customer's first period is this one)."""
    f, a = first_span.predicate(orders, "ts"), span.predicate(orders, "ts")
    per = (orders.filter(f | a)
           .groupBy(key, period_trunc("ts", grain).alias("_start"))
           .agg(F.min(F.when(f, F.col("ts"))).alias("_first"),
                F.count(F.when(a, F.col("order_id"))).alias("_n"),
                F.count(F.when(a, F.lit(1))).alias("_rows")))
    first_ts = F.min("_first").over(Window.partitionBy(key))
    is_new = first_ts.isNotNull() if since is None else F.coalesce(period_key(first_ts, grain) >= since, F.lit(False))
    return per.withColumn("_new", is_new).withColumn("_born", F.col("_new") & F.coalesce(F.col("_first") == first_ts, F.lit(False)))


def _flagged(orders: DataFrame, first_span: Span, since: str | None, span: Span, grain: str, key: str) -> DataFrame:
    """``_per_period`` rows with ``_existing``: the user is NOT IN the new customers."""
    flagged = _per_period(orders, first_span, since, span, grain, key)
    stats = flagged.select(F.struct(
        F.max(F.col("_new").cast("int")).alias("any_new"),
        F.coalesce(F.max(F.when(F.col(key).isNull(), F.col("_new").cast("int"))), F.lit(0)).alias("null_new"),
        F.max("_n").alias("max_n"),      # read every aggregated column, so the subquery's
        F.max("_rows").alias("max_rows"),  # plan equals the main one and its shuffle is reused
        F.max("_first").alias("max_first"),
    ).alias("g")).scalar()
    g = F.col("_g")
    existing = ((F.coalesce(g.any_new, F.lit(0)) == 0)
                | (F.col(key).isNotNull() & ~F.col("_new") & (g.null_new == 0)))
    return flagged.withColumn("_g", stats).withColumn("_existing", existing).drop("_g")


def monthly_totals(orders: DataFrame, span: Span, grain: str = "month",
                   approx_rsd: float | None = None) -> DataFrame:
    """OP30: ``order_month, total_customers, total_orders`` over all users.

    ``approx_rsd`` counts customers with a sketch instead (see ``period_activity``).
    """
    return period_activity(span.apply(orders, "ts"), grain, users_col="total_customers", approx_rsd=approx_rsd)


def acquisition_report(new: DataFrame, existing: DataFrame, monthly: DataFrame, key: str = "user_id") -> DataFrame:
    """OP31: per first-order month, new users next to existing-user and total activity.

    Inner joins on the month, as in the source: a month missing on any side
    is dropped. A new user's later orders count in neither column.
    """
    per_month = new.groupBy("first_order_month").agg(F.count_distinct(key).alias("new_customers"))
    ex = existing.select(F.col("order_month").alias("_m1"), F.col("active_customers").alias("existing_customers"),
                         F.col("total_orders").alias("existing_total_orders"))
    mo = monthly.select(F.col("order_month").alias("_m2"), "total_customers",
                        F.col("total_orders").alias("monthly_total_orders"))
    joined = (per_month.join(ex, per_month.first_order_month == ex._m1)
              .join(mo, per_month.first_order_month == mo._m2))
    return joined.select(
        F.col("first_order_month").alias("month"), "new_customers", "existing_customers",
        "existing_total_orders", "total_customers", "monthly_total_orders",
        (F.col("new_customers") / F.col("total_customers") * 100).alias("new_customer_rate"),
    )


def acquisition_report_one_pass(orders: DataFrame, first_span: Span, since: str, span: Span,
                                grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP31 in one scan of the orders, in order of month; equal to ``acquisition_report`` of its three inputs.

    The (user, period) rows of both spans hold all three sides, so a report row is one conditional aggregate
    and a period that a side lacks is dropped by its counts.
    """
    active, existing = F.col("_rows") > 0, (F.col("_rows") > 0) & F.col("_existing")
    per = (_flagged(orders, first_span, since, span, grain, key)
           .groupBy(label_of_start("_start", grain).alias("month"))
           .agg(F.count(F.when(F.col("_born"), F.col(key))).alias("new_customers"),
                F.count(F.when(existing, F.col(key))).alias("existing_customers"),
                F.sum(F.when(existing, F.col("_n"))).cast("long").alias("existing_total_orders"),
                F.count(F.when(active, F.col(key))).alias("total_customers"),
                F.sum(F.when(active, F.col("_n"))).cast("long").alias("monthly_total_orders"),
                F.bool_or("_born").alias("_a"), F.bool_or(existing).alias("_b"), F.bool_or(active).alias("_c"))
           .filter("_a AND _b AND _c"))
    rate = F.try_divide(F.col("new_customers"), F.col("total_customers")) * 100
    return per.drop("_a", "_b", "_c").withColumn("new_customer_rate", rate).orderBy("month")


def existing_outside_window(orders: DataFrame, first: DataFrame, span: Span, grain: str = "month",
                            key: str = "user_id") -> DataFrame:
    """OP32: activity in ``span`` of users NOT IN ``first``.

    When ``span`` lies inside the span ``first`` was built from, every
    ordering user is in ``first`` and the result is empty, as in the source.
    """
    return existing_activity(orders, first, span, grain, key)


def new_customer_rate(orders: DataFrame, first_span: Span, since: str, monthly_span: Span,
                      grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP33: ``month, new_customers, total_customers, new_customer_rate`` (percent), in order
    of month, from one scan; a month without a new or without an active customer is dropped."""
    active = F.col("_rows") > 0
    per = (_per_period(orders, first_span, since, monthly_span, grain, key)
           .groupBy(label_of_start("_start", grain).alias("month"))
           .agg(F.count(F.when(F.col("_born"), F.col(key))).alias("new_customers"),
                F.count(F.when(active, F.col(key))).alias("total_customers"),
                F.bool_or("_born").alias("_a"), F.bool_or(active).alias("_c"))
           .filter("_a AND _c"))
    rate = F.try_divide(F.col("new_customers"), F.col("total_customers")) * 100
    return per.drop("_a", "_c").withColumn("new_customer_rate", rate).orderBy("month")
