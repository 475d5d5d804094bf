"""Quartile customer grades by spend and by order count (OP03, OP04)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import thresholds_by_selection, thresholds_from_histogram, user_totals, written_totals

# Grade labels from the highest threshold down.
GRADE_LABELS = ("VIP", "Gold", "Silver", "Bronze")


def assign_grade(totals: DataFrame, thresholds: DataFrame, measure: str, grade_col: str) -> DataFrame:
    """Label each row: >= p75 VIP, >= p50 Gold, >= p25 Silver, else Bronze.

    ``thresholds`` is a global aggregate, so it has exactly one row; it is
    read as one scalar subquery (evaluated once, shipped as a constant).
    A NULL threshold fails its test, and ties at a threshold take the upper grade.
    """
    thr = thresholds.select(F.struct("p75", "p50", "p25").alias("t")).scalar()
    m = F.col(measure)
    t = F.col("_thr")
    grade = (F.when(m >= t.p75, GRADE_LABELS[0])
             .when(m >= t.p50, GRADE_LABELS[1])
             .when(m >= t.p25, GRADE_LABELS[2])
             .otherwise(GRADE_LABELS[3]))
    return totals.withColumn("_thr", thr).select(*totals.columns, grade.alias(grade_col))


def grade_by_spend(orders: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """OP03: ``user_id, total_spent, spending_grade``.

    The totals are written once; the three thresholds are selected from them without a
    sort, and the graded rows are read straight from them. ``extra`` per-user
    aggregates (e.g. the last order time) ride along in the same pass and
    come out as extra columns.
    """
    totals = written_totals(orders, "total_spent", "sum", extra=extra)
    return assign_grade(totals, thresholds_by_selection(totals, "total_spent"), "total_spent", "spending_grade").select(
        "user_id", "total_spent", *(extra or {}), "spending_grade")


def grade_by_count(orders: DataFrame) -> DataFrame:
    """OP04: ``user_id, total_orders, order_count_grade`` (thresholds from the count histogram)."""
    totals = user_totals(orders, "total_orders", "count")
    thr = thresholds_from_histogram(totals, "total_orders")
    return assign_grade(totals, thr, "total_orders", "order_count_grade")
