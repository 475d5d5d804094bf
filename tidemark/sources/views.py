"""Analysis views over the input tables.

``orders`` view: ``user_id, order_id, amount, ts`` (one row per completed order).
``sales`` view:  ``artist, company, price, date, category_size, size``.
``profiles`` view: ``name, country_birth, country_of_activity,
country_of_activity2, number_museum``.

Joins are left to Catalyst: the dimension sides are broadcast only when the
planner's size estimate is under ``spark.sql.autoBroadcastJoinThreshold``
(and AQE re-checks with runtime sizes); otherwise they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.periods import Span
from tidemark.operators.summaries import PARTS, summarise
from tidemark.sources.tables import read_table


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed orders from the ``orders`` table."""
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ts"),
    )


def events_view(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """Dense orders from ``events`` (microsecond timestamps); optionally one event type."""
    ev = read_table(spark, sf_dir, "events")
    if event_type is not None:
        ev = ev.filter(F.col("event_type") == event_type)
    return ev.select(
        "user_id",
        F.col("event_id").alias("order_id"),
        F.col("value").alias("amount"),
        "ts",
    )


def sales_view(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Sales lines: ``lineitem`` with ``part`` (artist, class, size) and ``supplier`` (house).

    ``columns`` (default: all) are returned; a table that none of them comes from is not read.
    """
    return sales_from(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part"),
                      read_table(spark, sf_dir, "supplier"), *columns)


_OF_PART = {"artist": "p_brand", "category_size": "p_type", "size": "p_size"}
_OF_SUPPLIER = {"company": "s_name"}


def _with_dimensions(lines: DataFrame, part: DataFrame, supplier: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``lines`` left-joined with those dimensions that ``columns`` come from, as view columns.

    Left joins: a sale whose part or supplier is absent stays, with NULL there.
    """
    if _OF_PART.keys() & set(columns):
        part = part.select("p_partkey", F.col("p_brand").alias("artist"), F.col("p_type").alias("category_size"),
                           F.col("p_size").cast("double").alias("size"))
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    if _OF_SUPPLIER.keys() & set(columns):
        supplier = supplier.select("s_suppkey", F.col("s_name").alias("company"))
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines


def _lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("date"))


def sales_from(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, *columns: str) -> DataFrame:
    """The sales view over given ``lineitem``, ``part`` and ``supplier`` DataFrames."""
    columns = columns or ("artist", "company", "price", "date", "category_size", "size")
    return _with_dimensions(_lines(lineitem), part, supplier, columns).select(*columns)


def sales_summary(spark: SparkSession, sf_dir: str, columns: Sequence[str],
                  by: Mapping[str, Callable[[DataFrame], Column]] | None = None,
                  span: Span | None = None) -> DataFrame:
    """Sums and counts of the sales lines by the dimension ``columns`` and the line
    keys ``by`` (name to a function of the lines), for the reports that take a summary."""
    return summary_from(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part"),
                        read_table(spark, sf_dir, "supplier"), columns, by, span)


def summary_from(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, columns: Sequence[str],
                 by: Mapping[str, Callable[[DataFrame], Column]] | None = None, span: Span | None = None) -> DataFrame:
    """``sales_summary`` over given DataFrames.

    Lines are summed by their part and supplier keys before any join, so a join moves at
    most one row per key (and line key) however many lines a part or supplier has.
    """
    lines = _lines(lineitem)
    if span is not None:
        lines = span.apply(lines, "date")
    own = {name: key(lines) for name, key in (by or {}).items()}
    keys = {}
    if _OF_PART.keys() & set(columns):
        keys["l_partkey"] = F.col("l_partkey")
    if _OF_SUPPLIER.keys() & set(columns):
        keys["l_suppkey"] = F.col("l_suppkey")
    return _with_dimensions(summarise(lines, keys | own), part, supplier, columns).select(*columns, *own, *PARTS)


def profiles_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist profiles: ``supplier`` joined to ``nation`` and ``region``."""
    supp = read_table(spark, sf_dir, "supplier").select("s_name", "s_nationkey", "s_acctbal")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (
        supp.join(nation, supp.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_name").alias("name"),
            F.col("n_name").alias("country_birth"),
            F.col("r_name").alias("country_of_activity"),
            F.col("r_name").alias("country_of_activity2"),
            F.col("s_acctbal").alias("number_museum"),
        )
    )


def register_sql_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temp views with the source analyses' table names, for Spark SQL users.

    ``orders_completed (user_id, id, masked_id, discounted_price, created_at)``
    and ``customer_grades (user_id, total_spent, spending_grade)``. The grades
    view is a snapshot: its totals are written when it is registered; register again to refresh it.
    Spark SQL spells date patterns as ``date_format(ts, 'yyyy-MM')``.
    """
    from tidemark.operators.grades import grade_by_spend

    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").cast("string").alias("masked_id"),
        F.col("o_totalprice").alias("discounted_price"),
        F.col("o_orderdate").alias("created_at"),
    )
    orders.createOrReplaceTempView("orders_completed")
    grade_by_spend(orders_view(spark, sf_dir)).createOrReplaceTempView("customer_grades")
    return ["orders_completed", "customer_grades"]
