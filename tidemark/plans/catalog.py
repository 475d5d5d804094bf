"""Registered queries: each binds an operator to the test tables and its parameters.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole input tables. Most are lazy;
those that need written rows (ranks, selected thresholds, grades, flags, tables, workbooks) run the jobs that write
them when they are called, under ``spark.checkpoint.dir`` or in the session warehouse, where they stay until
``session.clean_materialized`` or a drop. Parameters mirror the source analyses, moved onto
the date ranges of the test data (see ``tidemark.plans.params``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_missing_text, parse_date
from tidemark.operators import acquisition, activity, churn, distinct, gaps, grades, lapse, profiling, ranking, sales
from tidemark.operators.relational import filtering, materialize
from tidemark.plans import params as P
from tidemark.session import MATERIALIZED, checkpoint_dir
from tidemark.sources import files, sinks, statistics, updates, workbook
from tidemark.sources.tables import SCHEMAS, read_table, table_path
from tidemark.sources.views import events_view, orders_view, profiles_view, sales_summary, sales_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- customer grades -------------------------------------------------------

@register("rank_users")
def q_rank_users(spark, sf_dir):
    return ranking.rank_users(orders_view(spark, sf_dir), "total_spent", "sum")


@register("quartile_thresholds")
def q_quartile_thresholds(spark, sf_dir):
    # selected without a sort; equal to quartile_thresholds(rank_users(...)) (tests/test_grades.py)
    return ranking.thresholds_by_selection(ranking.written_totals(orders_view(spark, sf_dir)))


@register("grade_by_spend")
def q_grade_by_spend(spark, sf_dir):
    return grades.grade_by_spend(orders_view(spark, sf_dir))


@register("grade_by_count")
def q_grade_by_count(spark, sf_dir):
    return grades.grade_by_count(orders_view(spark, sf_dir))


# ---- lapse and activity ------------------------------------------------------

def _lapsed(spark, sf_dir):
    return lapse.lapsed(orders_view(spark, sf_dir), P.LAPSE_ACTIVE, P.LAPSE_SILENT)


@register("lapsed")
def q_lapsed(spark, sf_dir):
    return _lapsed(spark, sf_dir)


def _funnel(spark, sf_dir):
    return lapse.lapse_funnel(orders_view(spark, sf_dir), P.LAPSE_ACTIVE, P.LAPSE_SILENT, P.LAPSE_LATER)


@register("still_lapsed")
def q_still_lapsed(spark, sf_dir):
    # one pass over the three windows; equal to lapse.still_lapsed(_lapsed(...)) (tests/test_lapse.py)
    return _funnel(spark, sf_dir).filter("still").select("user_id")


@register("lapse_counts")
def q_lapse_counts(spark, sf_dir):
    return lapse.funnel_counts(_funnel(spark, sf_dir))


def _flags(spark, sf_dir):
    return lapse.activity_flags(orders_view(spark, sf_dir), P.LAPSE_ACTIVE, P.LAPSE_SILENT, P.PATTERN_SPAN,
                                P.RECENT_SPAN, P.PATTERN_GRAIN)


def _periods(spark, sf_dir):
    # one scan for the cohort and its periods; equal to
    # lapse.active_periods(orders, PATTERN_SPAN, lapse.lapsed(...), grain) (tests/test_lapse.py)
    return lapse.cohort_periods(_flags(spark, sf_dir))


@register("active_periods")
def q_active_periods(spark, sf_dir):
    return _periods(spark, sf_dir)


@register("purchase_pattern")
def q_purchase_pattern(spark, sf_dir):
    return lapse.purchase_pattern(_periods(spark, sf_dir), P.PATTERN_K)


@register("consistent_buyers")
def q_consistent_buyers(spark, sf_dir):
    return lapse.consistent_buyers(_periods(spark, sf_dir), P.PATTERN_K)


@register("recent_buyers")
def q_recent_buyers(spark, sf_dir):
    return lapse.recent_buyers(orders_view(spark, sf_dir), P.RECENT_SPAN)


def _churned(spark, sf_dir, grades_df, flags=None):
    flags = flags if flags is not None else _flags(spark, sf_dir)
    return lapse.churned_consistent(lapse.consistent_buyers(lapse.cohort_periods(flags), P.PATTERN_K),
                                    lapse.recent_from_flags(flags), grades_df)


@register("churned_consistent")
def q_churned_consistent(spark, sf_dir):
    return _churned(spark, sf_dir, grades.grade_by_spend(orders_view(spark, sf_dir)))


def _status(spark, sf_dir, grades_df=None):
    g = grades_df if grades_df is not None else grades.grade_by_spend(orders_view(spark, sf_dir))
    flags = _flags(spark, sf_dir)
    return lapse.activity_status(_churned(spark, sf_dir, g, flags), lapse.recent_from_flags(flags), g)


@register("activity_status")
def q_activity_status(spark, sf_dir):
    return _status(spark, sf_dir)


@register("with_last_order")
def q_with_last_order(spark, sf_dir):
    # the grades pass over all orders also keeps each user's last order time
    g = grades.grade_by_spend(orders_view(spark, sf_dir), extra={"_last_ts": F.max("ts")})
    last = g.select("user_id", lapse.to_second("_last_ts").alias("last_order_date"))
    status = _status(spark, sf_dir, g.select("user_id", "total_spent", "spending_grade"))
    return lapse.with_last_order(status, last=last)


def _consistent_counts(spark, sf_dir):
    return lapse.consistent_counts(orders_view(spark, sf_dir), P.CONSISTENT_SPAN, P.CONSISTENT_GRAIN,
                                   P.CONSISTENT_K)


@register("consistent_counts")
def q_consistent_counts(spark, sf_dir):
    return _consistent_counts(spark, sf_dir)


@register("cohort_trend")
def q_cohort_trend(spark, sf_dir):
    return lapse.cohort_trend_one_pass(orders_view(spark, sf_dir), P.CONSISTENT_SPAN, P.CONSISTENT_GRAIN,
                                       P.CONSISTENT_K, P.TREND_SINCE)


@register("written_cohort_trend")
def q_written_cohort_trend(spark, sf_dir):
    """Monthly activity of a cohort that was written before; beyond a broadcast its Bloom filter meets the orders' scan."""
    o = orders_view(spark, sf_dir)
    cohort = materialize(lapse.recent_buyers(o, P.RECENT_SPAN), "cohort")
    return lapse.cohort_trend(o, filtering(cohort), P.TREND_SINCE)


@register("ts_format_audit")
def q_ts_format_audit(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return lapse.ts_format_audit(ev, "ts")


# ---- periods, potential churners, churn by pattern ---------------------------

@register("user_periods")
def q_user_periods(spark, sf_dir):
    return churn.user_periods(orders_view(spark, sf_dir), "month")


@register("order_span")
def q_order_span(spark, sf_dir):
    return churn.order_span(orders_view(spark, sf_dir), "month")


@register("potential_churners")
def q_potential_churners(spark, sf_dir):
    return churn.potential_churners(orders_view(spark, sf_dir), P.CHURN_GAP)


@register("potential_churners_cut")
def q_potential_churners_cut(spark, sf_dir):
    return churn.potential_churners(orders_view(spark, sf_dir), P.CHURN_GAP, cut=P.CHURN_CUT)


@register("potential_churners_2m")
def q_potential_churners_2m(spark, sf_dir):
    return churn.potential_churners(orders_view(spark, sf_dir), P.CHURN_GAP, cut=P.CHURN_CUT,
                                    quiet_after_last=P.CHURN_QUIET)


@register("churners_as_of")
def q_churners_as_of(spark, sf_dir):
    return churn.churners_as_of(orders_view(spark, sf_dir), P.AS_OF, P.CHURN_GAP)


@register("churners_as_of_2m")
def q_churners_as_of_2m(spark, sf_dir):
    return churn.churners_as_of(orders_view(spark, sf_dir), P.AS_OF, P.CHURN_GAP, quiet_after_last=P.AS_OF_QUIET)


@register("user_period_counts")
def q_user_period_counts(spark, sf_dir):
    return churn.user_period_counts(orders_view(spark, sf_dir), P.PIVOT_SPAN, "month")


@register("period_pivot")
def q_period_pivot(spark, sf_dir):
    return churn.period_pivot(orders_view(spark, sf_dir), P.PIVOT_SPAN, P.PIVOT_PERIODS, "month")


@register("churn_by_grade_3q")
def q_churn_by_grade_3q(spark, sf_dir):
    o = orders_view(spark, sf_dir)
    return churn.churn_by_grade(o, grades.grade_by_spend(o), P.CHURN_SPAN, P.CHURN_3Q_ACTIVE,
                                P.CHURN_3Q_SILENT, P.CHURN_GRAIN)


@register("churn_by_grade_1_then_many")
def q_churn_by_grade_1_then_many(spark, sf_dir):
    o = orders_view(spark, sf_dir)
    return churn.churn_by_grade(o, grades.grade_by_spend(o), P.CHURN_SPAN, P.CHURN_1M_ACTIVE,
                                P.CHURN_1M_SILENT, P.CHURN_GRAIN)


@register("churn_curve")
def q_churn_curve(spark, sf_dir):
    # from one row of period bits per user; equal to churn.churn_curve (tests/test_activity.py)
    days = activity.Calendar.covering(P.CURVE_SPAN, P.CURVE_GRAIN)
    state = activity.activity_state(events_view(spark, sf_dir), days, P.CURVE_SPAN, P.CURVE_SPAN)
    return activity.churn_curve(state, days, P.CURVE_ACTIVE, P.CURVE_FOLLOW)


@register("activity_state_merged")
def q_activity_state_merged(spark, sf_dir):
    """Each user's first and last order, orders and active months, from the merged states of two halves of the orders."""
    o, months = orders_view(spark, sf_dir), activity.Calendar("1995-01", 84)
    halves = [activity.activity_state(o.filter(F.pmod("order_id", F.lit(2)) == half), months) for half in (0, 1)]
    state = activity.merge_states(*halves)
    return state.select("user_id", "first_ts", "last_ts", "n_orders", activity.n_periods(months).cast("long").alias("active_months"))


# ---- acquisition ---------------------------------------------------------------

def _first(spark, sf_dir):
    return acquisition.first_orders(orders_view(spark, sf_dir), P.FIRST_SPAN)


def _new(spark, sf_dir):
    return acquisition.new_customers(_first(spark, sf_dir), P.NEW_SINCE)


def _existing(spark, sf_dir):
    # one scan of both spans; equal to existing_activity(new_customers(first_orders(...))) (tests)
    return acquisition.existing_activity_one_pass(orders_view(spark, sf_dir), P.FIRST_SPAN, P.NEW_SINCE,
                                                  P.ACTIVITY_SPAN)


def _monthly(spark, sf_dir):
    return acquisition.monthly_totals(orders_view(spark, sf_dir), P.ACTIVITY_SPAN)


@register("first_orders")
def q_first_orders(spark, sf_dir):
    return _first(spark, sf_dir)


@register("new_customers")
def q_new_customers(spark, sf_dir):
    return _new(spark, sf_dir)


@register("existing_activity")
def q_existing_activity(spark, sf_dir):
    return _existing(spark, sf_dir)


@register("monthly_totals")
def q_monthly_totals(spark, sf_dir):
    return _monthly(spark, sf_dir)


def _monthly_bitmaps(spark, sf_dir):
    """Users of each month as bitmaps, united from those of its days."""
    days = distinct.period_bitmaps(P.ACTIVITY_SPAN.apply(orders_view(spark, sf_dir), "ts"))
    return distinct.roll_up(days, "month")


@register("monthly_totals_bitmap")
def q_monthly_totals_bitmap(spark, sf_dir):
    return distinct.period_counts(_monthly_bitmaps(spark, sf_dir), "month")


@register("quarterly_totals_bitmap")
def q_quarterly_totals_bitmap(spark, sf_dir):
    return distinct.period_counts(distinct.roll_up(_monthly_bitmaps(spark, sf_dir), "quarter"), "quarter", "order_quarter")


@register("cohort_by_month")
def q_cohort_by_month(spark, sf_dir):
    """How many of the first month's customers order in each month."""
    months = _monthly_bitmaps(spark, sf_dir)
    cohort = distinct.unite(months.filter(F.col("start") == F.lit(P.ACTIVITY_SPAN.start).cast("date")), [])
    return distinct.in_set(months, cohort).select(F.col("start").alias("month"), "customers")


@register("acquisition_report")
def q_acquisition_report(spark, sf_dir):
    return acquisition.acquisition_report_one_pass(orders_view(spark, sf_dir), P.FIRST_SPAN, P.NEW_SINCE, P.ACTIVITY_SPAN)


@register("existing_outside_window")
def q_existing_outside_window(spark, sf_dir):
    return acquisition.existing_activity_one_pass(orders_view(spark, sf_dir), P.FIRST_SPAN, None, P.ACTIVITY_SPAN)


@register("existing_later")
def q_existing_later(spark, sf_dir):
    return acquisition.existing_activity_one_pass(orders_view(spark, sf_dir), P.LATER_FIRST_SPAN, None, P.ACTIVITY_SPAN)


def _rate(spark, sf_dir):
    # one row of period bits per user; equal to acquisition.new_customer_rate (tests/test_activity.py)
    months = activity.Calendar.covering(P.RATE_MONTHLY_SPAN)
    state = activity.activity_state(orders_view(spark, sf_dir), months, P.RATE_MONTHLY_SPAN, P.RATE_FIRST_SPAN)
    return activity.new_customer_rate(state, months, P.RATE_SINCE)


@register("new_customer_rate")
def q_new_customer_rate(spark, sf_dir):
    return _rate(spark, sf_dir)


# ---- first gap -----------------------------------------------------------------

def _purchases(spark, sf_dir):
    return events_view(spark, sf_dir, "purchase")


def _gaps_window(spark, sf_dir):
    # from period bits; equal to gaps.first_gap and first_gap_one_pass (tests/test_activity.py)
    days = activity.Calendar.covering(P.GAP_WINDOW_SPAN, P.GAP_GRAIN)
    state = activity.activity_state(_purchases(spark, sf_dir), days, P.GAP_WINDOW_SPAN, P.GAP_WINDOW_FIRST_SPAN)
    return activity.first_gap(state, days, P.GAP_WINDOW_TARGETS)


@register("first_gap_cohort")
def q_first_gap_cohort(spark, sf_dir):
    days = activity.Calendar.covering(P.GAP_COHORT_SPAN, P.GAP_GRAIN)
    state = activity.activity_state(_purchases(spark, sf_dir), days, P.GAP_COHORT_SPAN, P.GAP_COHORT_FIRST_SPAN)
    return activity.first_gap(state, days, P.GAP_COHORT_TARGETS, first_period=P.GAP_COHORT_DAY)


@register("first_gap_window")
def q_first_gap_window(spark, sf_dir):
    return _gaps_window(spark, sf_dir)


@register("first_gap_fanout")
def q_first_gap_fanout(spark, sf_dir):
    return gaps.first_gap_fanout_one_pass(_purchases(spark, sf_dir), P.GAP_WINDOW_FIRST_SPAN, P.GAP_WINDOW_SPAN,
                                          P.GAP_WINDOW_TARGETS, P.GAP_GRAIN)


@register("first_gap_fanout_rows")
def q_first_gap_fanout_rows(spark, sf_dir):
    return gaps.fanout_rows(q_first_gap_fanout(spark, sf_dir))


@register("gap_counts")
def q_gap_counts(spark, sf_dir):
    return gaps.gap_counts(_gaps_window(spark, sf_dir))


@register("first_gap_graded")
def q_first_gap_graded(spark, sf_dir):
    return gaps.with_grade(_gaps_window(spark, sf_dir), grades.grade_by_spend(orders_view(spark, sf_dir)))


@register("first_gap_spine")
def q_first_gap_spine(spark, sf_dir):
    # the source's own form: users times target days, anti join of their orders, the least that is left
    p = _purchases(spark, sf_dir)
    spine = gaps.first_gap_spine(acquisition.first_orders(p, P.GAP_WINDOW_FIRST_SPAN, P.GAP_GRAIN), p, P.GAP_WINDOW_SPAN,
                                 P.GAP_WINDOW_TARGETS, P.GAP_GRAIN, method="spine")
    return gaps.with_grade(spine, grades.grade_by_spend(orders_view(spark, sf_dir)))


@register("month_text_to_date")
def q_month_text_to_date(spark, sf_dir):
    return gaps.month_text_to_date(_rate(spark, sf_dir), ["month"], "month")


# ---- tables of the session warehouse -------------------------------------------

def _table(name: str) -> str:
    """A table name of its own for each call; the result reads the table, so it stays until it is dropped."""
    return f"tidemark_{name}_{uuid.uuid4().hex[:12]}"


@register("table_create_append")
def q_table_create_append(spark, sf_dir):
    """Orders up to a date as a table, the later ones inserted with a column list in another order."""
    o, t = orders_view(spark, sf_dir), _table("orders")
    sinks.drop_table(spark, t)
    sinks.persist_table(P.TABLE_SPAN.apply(o, "ts"), t)
    later = o.filter(~P.TABLE_SPAN.predicate(o, "ts"))
    sinks.insert_into(spark, t, later.select("ts", "user_id", "order_id"), ["ts", "user_id", "order_id"])
    return spark.table(t)


@register("table_add_and_update")
def q_table_add_and_update(spark, sf_dir):
    """Totals as a table, a column added to it and filled from each user's orders of one span."""
    o, t = orders_view(spark, sf_dir), _table("totals")
    sinks.persist_table(ranking.user_totals(o), t)
    sinks.add_column(spark, t, "last_order", "timestamp_ntz")
    sinks.update_from(spark, t, P.LAPSE_ACTIVE.apply(o, "ts").groupBy("user_id").agg(F.max("ts").alias("last")), "user_id", {"last_order": "last"})
    return spark.table(t)


@register("table_update_and_retype")
def q_table_update_and_retype(spark, sf_dir):
    """First order months as a table: the text made a date text in place, then the column's type changed."""
    t = _table("first")
    sinks.persist_table(_first(spark, sf_dir), t)
    sinks.update_column(spark, t, "first_order_month", F.concat("first_order_month", F.lit("-01")))
    sinks.retype_column(spark, t, "first_order_month", "date")
    return spark.table(t)


@register("table_staged_copy")
def q_table_staged_copy(spark, sf_dir):
    """A staged view saved as a table and copied; the first one is dropped, and sheet-like names are trimmed."""
    t, copy = _table("staged"), _table("copy")
    raw = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(" id"), F.col("s_name").alias("name "))
    staged = sinks.stage(files.trim_column_names(raw), _table("view"))
    sinks.persist_table(staged, t)
    staged.unpersist()
    sinks.copy_table(spark, t, copy)
    sinks.drop_table(spark, t)
    return spark.table(copy)


@register("activity_status_two_writes")
def q_activity_status_two_writes(spark, sf_dir):
    g = grades.grade_by_spend(orders_view(spark, sf_dir))
    flags = _flags(spark, sf_dir)
    return sinks.activity_status_two_writes(spark, _table("status"), _churned(spark, sf_dir, g, flags), lapse.recent_from_flags(flags), g)


@register("table_update_partitions")
def q_table_update_partitions(spark, sf_dir):
    """Orders partitioned by year: those of the largest customers get a note from a join, one year's small ones a zero."""
    o, t = orders_view(spark, sf_dir), _table("by_year")
    sinks.persist_table(o.select("order_id", "user_id", "amount", F.lit(None).cast("string").alias("note"), F.year("ts").alias("year")), t, partition_by=["year"])
    big = o.filter(F.col("amount") >= P.BIG_ORDER).groupBy("order_id").agg(F.concat(F.lit("big "), F.floor(F.max("amount") / 1000).cast("string")).alias("note"))
    updates.update_partitions_from(spark, t, big, "order_id", {"note": "note"})
    updates.update_partitions_where(spark, t, {"amount": F.lit(0.0)}, (F.col("year") == P.SMALL_YEAR) & (F.col("amount") < P.SMALL_ORDER))
    return spark.table(t)


@register("status_bucketed")
def q_status_bucketed(spark, sf_dir):
    """Activity status with last orders over orders and grades that are bucketed by user: no shuffle after the tables are written."""
    o = orders_view(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = _table("orders_by_user"), _table("grades_by_user")
    sinks.persist_bucketed(o, names[0], "user_id", n)
    sinks.persist_bucketed(grades.grade_by_spend(o), names[1], "user_id", n)
    o, g = (spark.table(t) for t in names)
    lapsed = lapse.lapsed(o, P.LAPSE_ACTIVE, P.LAPSE_SILENT)
    steady = lapse.consistent_buyers(lapse.active_periods(o, P.PATTERN_SPAN, lapsed, P.PATTERN_GRAIN), P.PATTERN_K)
    recent = lapse.recent_buyers(o, P.RECENT_SPAN)
    return lapse.status_with_last_order(lapse.churned_consistent(steady, recent, g), recent, g, o)


@register("table_append_batches")
def q_table_append_batches(spark, sf_dir):
    """Orders appended by year of order, one year twice: it counts once."""
    o, t = orders_view(spark, sf_dir), _table("batches")
    for year in (*P.BATCH_YEARS, P.BATCH_YEARS[0]):
        updates.append_batch(spark, t, o.filter(F.year("ts") == year), str(year))
    return spark.table(t).groupBy("batch_id").agg(F.count(F.lit(1)).alias("orders"), F.max("order_id").alias("last_order"))


# ---- workbooks ---------------------------------------------------------------

@register("workbook_profiles")
def q_workbook_profiles(spark, sf_dir):
    """Suppliers, nations and regions written as workbooks of three sheets, read back by their schemas and joined."""
    tables = {name: read_table(spark, sf_dir, name) for name in ("supplier", "nation", "region")}
    path = f"{checkpoint_dir(spark)}/{MATERIALIZED}/workbook-{uuid.uuid4().hex}"
    workbook.write_workbook(tables, path, files=2)
    supplier, nation, region = (workbook.read_workbook(spark, path, name, SCHEMAS[name], rows_per_partition=10_000) for name in tables)
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
            .select("s_suppkey", "s_name", "n_name", "r_name", "s_acctbal"))


# ---- sales analytics -------------------------------------------------------------

# Reports by month read the lines themselves: a part has fewer lines than months, so a sum by part and month reduces nothing.
def _side(lines):
    return sales.side_of("date", P.SALES_CUT, lines)


@register("parse_date")
def q_parse_date(spark, sf_dir):
    """Order dates written in one of four ways, read back."""
    o = read_table(spark, sf_dir, "orders")
    way = F.pmod("o_orderkey", F.lit(len(P.DATE_TEXTS)))
    text = F.coalesce(*[F.when(way == i, F.date_format("o_orderdate", f)) for i, f in enumerate(P.DATE_TEXTS)])
    return o.select(F.col("o_orderkey").alias("order_id"), text.alias("date_text")).select(
        "order_id", "date_text", parse_date("date_text", strict=True).cast("date").alias("order_date"))


@register("distinct_values")
def q_distinct_values(spark, sf_dir):
    return sales.distinct_values(read_table(spark, sf_dir, "part"), "p_brand")


@register("first_rows")
def q_first_rows(spark, sf_dir):
    return sales.first_rows(orders_view(spark, sf_dir), P.TOP_K, "ts")


@register("volume_before_after_rows")
def q_volume_before_after_rows(spark, sf_dir):
    return sales.volume_before_after(sales_view(spark, sf_dir, "price", "date"), P.SALES_CUT, count_rows=True)


@register("monthly_price_and_count_since")
def q_monthly_price_and_count_since(spark, sf_dir):
    lines = sales_view(spark, sf_dir, "price", "date", "category_size")
    return sales.monthly_price_and_count(lines, P.SALES_CATEGORY, P.SALES_SINCE)


@register("yearly_summary_padded")
def q_yearly_summary_padded(spark, sf_dir):
    o = orders_view(spark, sf_dir)
    amount = F.when(~F.year("ts").isin(*P.PADDED_YEARS), F.col("amount"))
    return sales.yearly_summary(o.withColumn("amount", amount), P.YEARLY_SPAN, "ts", "amount", fill="pad")


@register("clean_number")
def q_clean_number(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.format_number("o_totalprice", 2).alias("price_text"),
        F.col("o_orderpriority").alias("priority_text"))
    o = sales.clean_number_column(o, "price_text", "price")
    return sales.clean_number_column(o, "priority_text", "priority_number")


@register("profile")
def q_profile(spark, sf_dir):
    return sales.profile(sales_view(spark, sf_dir, "price"), "price")


@register("profile_lineitem")
def q_profile_lineitem(spark, sf_dir):
    return profiling.profile_table(read_table(spark, sf_dir, "lineitem"), P.PROFILE_TOP)


@register("volume_before_after")
def q_volume_before_after(spark, sf_dir):
    return sales.volume_before_after(sales_view(spark, sf_dir, "price", "date"), P.SALES_CUT)


@register("mean_before_after")
def q_mean_before_after(spark, sf_dir):
    return sales.mean_before_after(sales_view(spark, sf_dir, "price", "date"), "price", P.SALES_CUT)


def _price_extremes(spark, sf_dir):
    """Of the lines' prices, from the files' footers; left joins with parts and suppliers leave them as they are."""
    return statistics.column_extremes(spark, table_path(sf_dir, "lineitem"), "l_extendedprice", SCHEMAS["lineitem"])[:2]


@register("trim_extremes")
def q_trim_extremes(spark, sf_dir):
    return sales.trim_extremes(sales_view(spark, sf_dir), "price", _price_extremes(spark, sf_dir))


@register("size_price_points")
def q_size_price_points(spark, sf_dir):
    return sales.size_price_points(sales_view(spark, sf_dir, "size", "price", "category_size"), _price_extremes(spark, sf_dir))


@register("monthly_mean_by_category")
def q_monthly_mean_by_category(spark, sf_dir):
    return sales.monthly_mean_by_category(sales_view(spark, sf_dir, "price", "date", "category_size"))


@register("category_counts")
def q_category_counts(spark, sf_dir):
    return sales.category_counts(sales_summary(spark, sf_dir, ["category_size"]))


@register("monthly_price_and_count")
def q_monthly_price_and_count(spark, sf_dir):
    return sales.monthly_price_and_count(sales_view(spark, sf_dir, "price", "date", "category_size"), P.SALES_CATEGORY)


@register("compare_before_after")
def q_compare_before_after(spark, sf_dir):
    return sales.compare_before_after(sales_summary(spark, sf_dir, ["category_size"], {"side": _side}), P.SALES_CUT, "category_size")


@register("top_companies")
def q_top_companies(spark, sf_dir):
    return sales.top_groups_by_mean(sales_summary(spark, sf_dir, ["company"]), ["company"], P.TOP_K)


@register("top_artist_company")
def q_top_artist_company(spark, sf_dir):
    return sales.top_groups_by_mean(sales_summary(spark, sf_dir, ["artist", "company"]), ["artist", "company"], P.TOP_K, P.TOP_MIN_COUNT)


@register("yearly_summary")
def q_yearly_summary(spark, sf_dir):
    return sales.yearly_summary(orders_view(spark, sf_dir), P.YEARLY_SPAN, "ts", "amount")


def _sources(spark, sf_dir):
    return sales.union_sources({
        "orders": (read_table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"),
        "lineitem": (read_table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice"),
        "events": (read_table(spark, sf_dir, "events"), "ts", "value"),
    })


@register("yearly_summary_by_group")
def q_yearly_summary_by_group(spark, sf_dir):
    return sales.yearly_summary(_sources(spark, sf_dir), P.MULTI_SPAN, by="artist")


@register("years_union")
def q_years_union(spark, sf_dir):
    return sales.years_union(_sources(spark, sf_dir), P.MULTI_SPAN)


@register("top_artists")
def q_top_artists(spark, sf_dir):
    return sales.top_by_total(sales_summary(spark, sf_dir, ["artist"]), "artist", P.TOP_TOTAL_K)


@register("money_text")
def q_money_text(spark, sf_dir):
    return sales.with_money_text(sales.top_by_total(sales_summary(spark, sf_dir, ["artist"]), "artist", P.TOP_TOTAL_K), "total")


def _profile_of_top(spark, sf_dir):
    top = sales.top_by_total(sales_summary(spark, sf_dir, ["company"]), "company", P.TOP_TOTAL_K)
    return sales.profile_of_top(profiles_view(spark, sf_dir), top, "company")


@register("profile_of_top")
def q_profile_of_top(spark, sf_dir):
    return _profile_of_top(spark, sf_dir)


@register("clean_missing_names")
def q_clean_missing_names(spark, sf_dir):
    """Country names as they come from sheets: padded with blanks and tabs, '-', blank or missing."""
    supplier, nation = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    way, n = F.pmod("s_suppkey", F.lit(8)), F.col("n_name")
    dirty = (F.when(way == 0, F.concat(F.lit("\t "), n, F.lit("  "))).when(way == 1, F.lit("-")).when(way == 2, F.lit("")).when(way == 3, F.lit(" \t "))
             .when(way == 4, F.lit(" - ")).when(way == 5, F.concat(n, F.lit("\n"))).when(way == 6, n))
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", clean_missing_text(dirty).alias("country"))


@register("mean_by_birth")
def q_mean_by_birth(spark, sf_dir):
    return sales.mean_by(_profile_of_top(spark, sf_dir), ["country_birth"])


@register("mean_by_activity")
def q_mean_by_activity(spark, sf_dir):
    return sales.mean_by(_profile_of_top(spark, sf_dir), ["country_of_activity"])


@register("mean_by_both")
def q_mean_by_both(spark, sf_dir):
    return sales.mean_by(_profile_of_top(spark, sf_dir), ["country_birth", "country_of_activity"])
