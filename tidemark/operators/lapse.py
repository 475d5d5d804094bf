"""Lapsed and consistent buyers, activity status and cohort trend (OP05-OP18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.periods import Span, label_of_start, period_trunc
from tidemark.functions.text import TS_TEXT_PATTERN
from tidemark.operators.relational import materialize, not_in, per_user_period, roll_up_periods, users_in

# Labels used by the source analyses.
CONSISTENT = "Consistent Buyer"
IRREGULAR = "Irregular Buyer"
INACTIVE = "Inactive"
ACTIVE = "Active"


def lapsed(orders: DataFrame, active: Span, silent: Span, key: str = "user_id") -> DataFrame:
    """OP05: distinct users with an order in ``active`` and none in ``silent``.

    One pass: both spans are read by one scan and reduced per user to two
    flags. ``NOT IN`` null rules are kept: a NULL user in ``silent`` empties
    the result; with an empty ``silent`` a NULL user from ``active`` stays.
    """
    a = active.predicate(orders, "ts")
    s = silent.predicate(orders, "ts")
    flags = (orders.filter(a | s)
             .groupBy(key)
             .agg(F.max(a.cast("int")).alias("_a"), F.max(s.cast("int")).alias("_s")))
    # The subquery reads both flags, so its plan below the aggregate is the
    # same as the main one and AQE reuses that shuffle instead of re-reading
    # the orders (with only `_s` the pruned aggregate would differ).
    stats = flags.select(F.struct(
        F.coalesce(F.max("_s"), F.lit(0)).alias("any_silent"),
        F.coalesce(F.max(F.when(F.col(key).isNull(), F.col("_s"))), F.lit(0)).alias("null_silent"),
        F.max("_a").alias("any_active"),
    ).alias("g")).scalar()
    g = F.col("_g")
    keep = (F.col("_a") == 1) & (
        (g.any_silent == 0) | (F.col(key).isNotNull() & (F.col("_s") == 0) & (g.null_silent == 0)))
    return flags.withColumn("_g", stats).filter(keep).select(key)


def lapse_funnel(orders: DataFrame, active: Span, silent: Span, later: Span, key: str = "user_id") -> DataFrame:
    """OP05 + OP06 in one pass: every lapsed user with ``still`` = no order in ``later``.

    Same rows as ``lapsed`` and, filtered on ``still``, as ``still_lapsed``
    (both ``NOT IN`` NULL rules included), from one scan of the three windows
    and one shuffle: per-user flags, and one scalar subquery over the same
    flags for the NULL rules.
    """
    a, s, lt = (w.predicate(orders, "ts") for w in (active, silent, later))
    flags = (orders.filter(a | s | lt)
             .groupBy(key)
             .agg(F.max(a.cast("int")).alias("_a"), F.max(s.cast("int")).alias("_s"),
                  F.max(lt.cast("int")).alias("_l")))
    is_null = F.col(key).isNull()
    stats = flags.select(F.struct(
        F.coalesce(F.max("_s"), F.lit(0)).alias("any_silent"),
        F.coalesce(F.max(F.when(is_null, F.col("_s"))), F.lit(0)).alias("null_silent"),
        F.coalesce(F.max("_l"), F.lit(0)).alias("any_later"),
        F.coalesce(F.max(F.when(is_null, F.col("_l"))), F.lit(0)).alias("null_later"),
        F.max("_a").alias("any_active"),
    ).alias("g")).scalar()
    g = F.col("_g")
    in_lapsed = (F.col("_a") == 1) & (
        (g.any_silent == 0) | (F.col(key).isNotNull() & (F.col("_s") == 0) & (g.null_silent == 0)))
    still = (g.any_later == 0) | (F.col(key).isNotNull() & (F.col("_l") == 0) & (g.null_later == 0))
    return flags.withColumn("_g", stats).filter(in_lapsed).select(key, still.alias("still"))


def still_lapsed(lapsed_users: DataFrame, orders: DataFrame, later: Span, key: str = "user_id") -> DataFrame:
    """OP06: lapsed users NOT IN the users with an order in ``later``."""
    return not_in(lapsed_users.select(key), later.apply(orders, "ts").select(key), key)


def lapse_counts(lapsed_users: DataFrame, still: DataFrame) -> DataFrame:
    """OP07: one row ``lapsed_count, still_lapsed_count``."""
    return (lapsed_users.agg(F.count(F.lit(1)).alias("lapsed_count"))
            .withColumn("still_lapsed_count", still.select(F.count(F.lit(1))).scalar()))


def funnel_counts(funnel: DataFrame) -> DataFrame:
    """OP07 from ``lapse_funnel``: one aggregate, no second pass."""
    return funnel.agg(F.count(F.lit(1)).alias("lapsed_count"),
                      F.count(F.when(F.col("still"), F.lit(1))).alias("still_lapsed_count"))


def activity_flags(orders: DataFrame, active: Span, silent: Span, pattern: Span, recent: Span,
                   grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP05, OP08 and OP11 from one scan: one row per user with

    ``lapsed`` (OP05, ``NOT IN`` NULL rules included), ``active_months``
    (distinct ``grain`` periods with an order in ``pattern``) and ``recent``
    (an order in ``recent``). Orders are reduced to (user, period) rows, then
    to users, and that per-user table is written under the checkpoint folder
    (``materialize``), so the orders are read once however the flags are used;
    the NULL rules come from one scalar subquery over the written table.
    """
    a, s, p, r = (w.predicate(orders, "ts") for w in (active, silent, pattern, recent))
    per = (orders.filter(a | s | p | r)
           .groupBy(key, period_trunc("ts", grain).alias("_start"))
           .agg(*[F.max(c.cast("int")).alias(n) for c, n in ((a, "_a"), (s, "_s"), (p, "_p"), (r, "_r"))]))
    # one row per user seen in the windows, written once: every consumer (and
    # the NULL-rule subquery) reads this small table, not the orders again
    users = materialize(per.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_s").alias("_s"),
                                             F.sum("_p").cast("long").alias("active_months"),
                                             F.max("_r").alias("_r")), "flags")
    stats = users.select(F.struct(
        F.coalesce(F.max("_s"), F.lit(0)).alias("any_silent"),
        F.coalesce(F.max(F.when(F.col(key).isNull(), F.col("_s"))), F.lit(0)).alias("null_silent"),
        F.max("_a").alias("any_active"), F.max("active_months").alias("max_months"), F.max("_r").alias("any_recent"),
    ).alias("g")).scalar()
    g = F.col("_g")
    is_lapsed = (F.col("_a") == 1) & (
        (g.any_silent == 0) | (F.col(key).isNotNull() & (F.col("_s") == 0) & (g.null_silent == 0)))
    return users.withColumn("_g", stats).select(
        key, is_lapsed.alias("lapsed"), "active_months", (F.col("_r") == 1).alias("recent"))


def cohort_periods(flags: DataFrame, key: str = "user_id", name: str = "active_months") -> DataFrame:
    """OP08 from ``activity_flags``: lapsed users (the cohort) with at least one pattern period."""
    return (flags.filter(F.col("lapsed") & F.col(key).isNotNull() & (F.col("active_months") > 0))
            .select(key, F.col("active_months").alias(name)))


def recent_from_flags(flags: DataFrame, key: str = "user_id") -> DataFrame:
    """OP11 from ``activity_flags``: users with an order in the recent span."""
    return flags.filter(F.col("recent")).select(key)


def active_periods(orders: DataFrame, span: Span, cohort: DataFrame, grain: str = "month",
                   key: str = "user_id", name: str = "active_months") -> DataFrame:
    """OP08: distinct periods with an order in ``span`` per cohort user; users with none are absent.

    (user, period) pairs are formed before the semi join, so the join sees
    at most one row per user and period.
    """
    per = span.apply(orders, "ts").select(key, period_trunc("ts", grain).alias("_p")).distinct()
    return per.join(cohort.select(key), key, "left_semi").groupBy(key).agg(F.count("_p").alias(name))


def purchase_pattern(periods: DataFrame, k: int = 3, name: str = "active_months") -> DataFrame:
    """OP09: 'Consistent Buyer' when active in all ``k`` periods, else 'Irregular Buyer'."""
    return periods.select("user_id", F.when(F.col(name) == k, CONSISTENT).otherwise(IRREGULAR)
                          .alias("purchase_pattern"))


def consistent_buyers(periods: DataFrame, k: int = 3, name: str = "active_months") -> DataFrame:
    """OP10: users active in all ``k`` periods."""
    return periods.filter(F.col(name) == k).select("user_id")


def recent_buyers(orders: DataFrame, span: Span) -> DataFrame:
    """OP11: distinct users with an order in ``span`` (open-ended when ``span.end`` is None)."""
    return users_in(orders, span)


def churned_consistent(consistent: DataFrame, recent: DataFrame, grades: DataFrame) -> DataFrame:
    """OP12: consistent buyers with a grade (inner join) and no recent order."""
    return (consistent.join(grades.select("user_id", "spending_grade"), "user_id")
            .join(recent.select("user_id"), "user_id", "left_anti")
            .select("user_id", "spending_grade", F.lit(CONSISTENT).alias("purchase_pattern")))


def activity_status(churned: DataFrame, recent: DataFrame, grades: DataFrame) -> DataFrame:
    """OP13: 'Inactive' = churned consistent buyers; 'Active' = every graded recent buyer."""
    g = grades.select("user_id", "spending_grade")
    inactive = churned.select("user_id", "spending_grade", F.lit(INACTIVE).alias("activity_status"))
    active = (recent.select("user_id").join(g, "user_id")
              .select("user_id", "spending_grade", F.lit(ACTIVE).alias("activity_status")))
    return inactive.unionByName(active)


def status_with_last_order(churned: DataFrame, recent: DataFrame, grades: DataFrame, orders: DataFrame) -> DataFrame:
    """OP13 -> OP15 with the last orders joined on each side of the union, where the user still has its partitioning:
    over tables bucketed by the user nothing is shuffled. Equal to ``with_last_order(activity_status(...), orders)``."""
    last = last_order(orders)
    inactive = churned.select("user_id", "spending_grade", F.lit(INACTIVE).alias("activity_status"))
    active = (recent.select("user_id").join(grades.select("user_id", "spending_grade"), "user_id")
              .select("user_id", "spending_grade", F.lit(ACTIVE).alias("activity_status")))
    return inactive.join(last, "user_id", "left").unionByName(active.join(last, "user_id", "left"))


def to_second(ts: Column | str) -> Column:
    """A timestamp truncated to the second (the source formats it as text and back)."""
    return F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def last_order(orders: DataFrame, key: str = "user_id") -> DataFrame:
    """Latest order time per user, truncated to the second."""
    return orders.groupBy(key).agg(to_second(F.max("ts")).alias("last_order_date"))


def with_last_order(status: DataFrame, orders: DataFrame | None = None, key: str = "user_id",
                    last: DataFrame | None = None) -> DataFrame:
    """OP15: ``status`` plus ``last_order_date``; NULL for a user without orders (update via left join).

    ``last`` (``key, last_order_date``) may come from a pass that already
    aggregated every order per user, e.g. ``grade_by_spend(orders, extra=...)``;
    otherwise it is computed from ``orders``.
    """
    return status.join(last if last is not None else last_order(orders, key), key, "left")


def consistent_counts(orders: DataFrame, span: Span, grain: str = "month", k: int = 3,
                      key: str = "user_id") -> DataFrame:
    """OP16: users with orders in exactly ``k`` distinct periods of ``span``, with their order count."""
    per = (span.apply(orders, "ts")
           .groupBy(key, period_trunc("ts", grain).alias("_p"))
           .agg(F.count(key).alias("_n")))
    return (per.groupBy(key)
            .agg(F.count("_p").alias("_periods"), F.sum("_n").cast("long").alias("order_count"))
            .filter(F.col("_periods") == k)
            .select(key, "order_count"))


def cohort_trend(orders: DataFrame, cohort: DataFrame, since: str, grain: str = "month",
                 key: str = "user_id") -> DataFrame:
    """OP17: ``order_month, active_customers, total_orders`` of cohort users from ``since`` on."""
    per_user = per_user_period(Span(since, None).apply(orders, "ts"), grain, key=key)
    return roll_up_periods(per_user.join(cohort.select(key), key, "left_semi"), key=key)


GRAINS = ("day", "month", "quarter", "year")  # each nests in the next


def cohort_trend_one_pass(orders: DataFrame, span: Span, cohort_grain: str, k: int, since: str,
                          grain: str = "month", key: str = "user_id") -> DataFrame:
    """OP16 -> OP17 in one scan, in order of month; equal to ``cohort_trend(orders, consistent_counts(...), since)``.

    Orders of the cohort span and of the trend become one row per (user, trend period); a
    window per user counts the cohort periods among them. A trend period must nest in a cohort period.
    """
    if GRAINS.index(grain) > GRAINS.index(cohort_grain):
        raise ValueError(f"a {grain} does not nest in a {cohort_grain}: use cohort_trend")
    c, t = span.predicate(orders, "ts"), Span(since, None).predicate(orders, "ts")
    per = (orders.filter((c | t) & F.col(key).isNotNull())
           .groupBy(key, period_trunc("ts", grain).alias("_start"))
           .agg(F.count(F.when(c, F.lit(1))).alias("_c"), F.count(F.when(t, F.lit(1))).alias("_t"),
                F.count(F.when(t, F.col("order_id"))).alias("_n")))
    periods = F.size(F.collect_set(F.when(F.col("_c") > 0, period_trunc("_start", cohort_grain)))
                     .over(Window.partitionBy(key)))
    rows = per.withColumn("_k", periods).filter((F.col("_k") == k) & (F.col("_t") > 0))
    return (rows.groupBy(label_of_start("_start", grain).alias("order_month"))
            .agg(F.count(key).alias("active_customers"), F.sum("_n").cast("long").alias("total_orders"))
            .orderBy("order_month"))


def ts_format_audit(df: DataFrame, column: str = "ts", pattern: str = TS_TEXT_PATTERN) -> DataFrame:
    """OP18: rows whose timestamp text is not 'YYYY-MM-DD hh:mm:ss' (NULL rows are not returned)."""
    return df.filter(~F.col(column).cast("string").rlike(pattern))


def churned_consistent_by_grade(consistent: DataFrame, recent: DataFrame, grades: DataFrame) -> DataFrame:
    """OP12 under its descriptive name."""
    return churned_consistent(consistent, recent, grades)
