"""Relational building blocks shared by the operators.

``not_in`` gives SQL ``x NOT IN (subquery)`` semantics (null-aware) with an
ordinary hash anti join plus two counts read as one scalar subquery,
instead of the broadcast-only null-aware anti join Spark plans for NOT IN.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.periods import Span, label_of_start, period_trunc
from tidemark.session import MATERIALIZED, checkpoint_dir


def users_in(orders: DataFrame, span: Span, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Distinct ``key`` values with an order in ``span`` (NULL included, as SQL DISTINCT keeps it)."""
    return span.apply(orders, ts).select(key).distinct()


def not_in(left: DataFrame, right: DataFrame, key: str = "user_id", right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose ``key`` is NOT IN ``right[right_key]``.

    SQL rules: an empty right side keeps every left row (NULL keys too); a
    NULL on the right makes the predicate unknown for every row, so nothing
    is kept; a NULL left key is dropped when the right side is non-empty.
    The right side is reduced to distinct keys (partial aggregation first),
    so a hot key costs one row per map task, not one per order.
    """
    rk = right_key or key
    r = right.select(F.col(rk).alias("_rk")).distinct()
    stats = r.select(F.struct(F.count(F.lit(1)).alias("n"),
                              (F.count(F.lit(1)) - F.count("_rk")).alias("nulls")).alias("s")).scalar()
    kept = left.join(r, left[key] == r["_rk"], "left_anti")
    s = F.col("_s")
    return (kept.withColumn("_s", stats)
            .filter((s.n == 0) | (F.col(key).isNotNull() & (s.nulls == 0)))
            .drop("_s"))


def per_user_period(orders: DataFrame, grain: str = "month", period_col: str = "order_month",
                    key: str = "user_id", ts: str = "ts", order_id: str = "order_id") -> DataFrame:
    """One row per (period, user) with ``_n`` = ``COUNT(order_id)``.

    Map-side partial aggregation reduces a hot user to one row per period
    per task before anything is shuffled or joined on the user.
    """
    per = orders.groupBy(period_trunc(ts, grain).alias("_start"), key).agg(F.count(order_id).alias("_n"))
    return per.select(label_of_start("_start", grain).alias(period_col), key, "_n")


def roll_up_periods(per_user: DataFrame, period_col: str = "order_month", users_col: str = "active_customers",
                    orders_col: str = "total_orders", key: str = "user_id") -> DataFrame:
    """Per period: distinct users and total orders from ``per_user_period`` rows."""
    return per_user.groupBy(period_col).agg(F.count(key).alias(users_col),
                                            F.sum("_n").cast("long").alias(orders_col))


def period_activity(orders: DataFrame, grain: str = "month", period_col: str = "order_month",
                    users_col: str = "active_customers", orders_col: str = "total_orders",
                    key: str = "user_id", ts: str = "ts", order_id: str = "order_id",
                    approx_rsd: float | None = None) -> DataFrame:
    """Per period: distinct users and ``COUNT(order_id)``.

    Exact by default: reduced first to one row per (period, user) so the
    distinct count needs no Expand and a hot user costs one row per period.
    ``approx_rsd`` (e.g. 0.01) switches the user count to a HyperLogLog++
    sketch with that relative standard deviation: one aggregate, no shuffle
    of user ids. Never the default.
    """
    if approx_rsd is not None:
        per = orders.groupBy(period_trunc(ts, grain).alias("_start")).agg(
            F.approx_count_distinct(key, approx_rsd).alias(users_col), F.count(order_id).alias(orders_col))
        return per.select(label_of_start("_start", grain).alias(period_col), users_col, orders_col)
    return roll_up_periods(per_user_period(orders, grain, period_col, key, ts, order_id),
                           period_col, users_col, orders_col, key)


def filtering(cohort: DataFrame, key: str = "user_id") -> DataFrame:
    """The cohort's non-NULL keys in a form from which Spark builds a run-time Bloom filter.

    Where a semi or inner join by ``key`` is too large to broadcast, the optimizer can build such a filter from one side and
    apply it at the scan of the other, under its partial aggregate and before its shuffle. It does so for a side that
    it takes for selective (by a comparison) and a scan beyond ``spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold``
    (10 GB). A written cohort has lost the comparisons it came from; this one holds for every key.
    """
    return cohort.filter(F.col(key).isNotNull() & (F.xxhash64(key) >= F.lit(-(1 << 63))))


def next_at_or_after(events: DataFrame, probes: DataFrame, key: str, at: str, name: str = "next_at") -> DataFrame:
    """As-of pass: the rows of ``probes`` (``key``, ``at``, ...) with the first event of the same key at or after ``at``,
    NULL if none follows.

    Events and probes are one tagged union, sorted within the key; a running minimum from the end answers
    each probe, with no range join. Events are reduced to distinct (key, at) pairs first, so a hot key has as many rows as it has
    different times; ``at`` should therefore be a period rather than a moment. NULL keys match nothing, as in a join.
    """
    more = [c for c in probes.columns if c not in (key, at)]
    own = probes.select(F.col(key), F.col(at), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in more]).alias("_more"), F.lit(True).alias("_probe"))
    seen = events.select(F.col(key), F.col(at).cast(probes.schema[at].dataType).alias(at)).filter(F.col(key).isNotNull()).distinct()
    both = own.unionByName(seen.withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    after = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_first()).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = F.min(F.when(~F.col("_probe"), F.col(at))).over(after)
    return (both.withColumn(name, F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), found)).filter("_probe")
            .select(key, at, *[F.col("_more")[c].alias(c) for c in more], name))


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor re-reads the
    files instead of recomputing, so values that depend on partitioning stay
    fixed), and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{MATERIALIZED}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
