"""Exact distinct counts that roll up (AG3, OP17, OP29-OP31).

A set of whole-number ids is kept as bitmaps: a bucket of 32,768 consecutive ids is one bitmap of 4 KB, built and united by
Spark's bitmap aggregates. Per period and bucket that is one row, so days roll up to months and months to quarters by
``bitmap_or_agg`` without reading the orders again, users who come on several days are counted once, and
new orders are united with what is stored. Counts are exact; NULL ids are in no set (as in COUNT(DISTINCT)) but
their orders count. Partial aggregation makes one row per task, period and bucket, whatever a user's volume.

For ids that are dense, as keys are: ids spread thinly over 64 bits would give a bitmap to nearly every id, and
``relational.period_activity`` (a row per period and user) is the form for those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import label_of_start, period_trunc

MAP, BUCKET, ROWS = "_ids", "_bucket", "_orders"


def id_bitmaps(rows: DataFrame, by: dict[str, Column], key: str = "user_id", counted: str = "order_id") -> DataFrame:
    """Per ``by`` and bucket of ids: the bitmap of the ``key`` values and ``COUNT(counted)``."""
    ids = F.col(key).cast("long")
    return (rows.groupBy(*[c.alias(n) for n, c in by.items()], F.bitmap_bucket_number(ids).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(ids)).alias(MAP), F.count(counted).cast("long").alias(ROWS)))


def period_bitmaps(orders: DataFrame, grain: str = "day", key: str = "user_id", ts: str = "ts", order_id: str = "order_id") -> DataFrame:
    """``id_bitmaps`` per period; ``start`` is the period's first day."""
    return id_bitmaps(orders, {"start": period_trunc(ts, grain)}, key, order_id)


def unite(bitmaps: DataFrame, by: dict[str, Column] | Sequence[str]) -> DataFrame:
    """Bitmaps of a coarser ``by``: the union of the sets and the sum of the orders, per bucket."""
    by = by if isinstance(by, dict) else {c: F.col(c) for c in by}
    return (bitmaps.groupBy(*[c.alias(n) for n, c in by.items()], BUCKET)
            .agg(F.bitmap_or_agg(MAP).alias(MAP), F.sum(ROWS).cast("long").alias(ROWS)))


def roll_up(bitmaps: DataFrame, grain: str) -> DataFrame:
    """Period bitmaps of a coarser grain, from those of a finer one."""
    return unite(bitmaps, {"start": period_trunc("start", grain)})


def merge(*bitmaps: DataFrame) -> DataFrame:
    """One set of bitmaps from several (stored ones and those of new orders)."""
    both = bitmaps[0]
    for b in bitmaps[1:]:
        both = both.unionByName(b)
    return unite(both, [c for c in both.columns if c not in (MAP, BUCKET, ROWS)])


def counts(bitmaps: DataFrame, by: Sequence[str] = ("start",), users: str = "total_customers", orders: str = "total_orders") -> DataFrame:
    """Distinct ids and orders per ``by``; buckets are disjoint, so their counts add up."""
    ids = F.when(F.col(BUCKET).isNotNull(), F.bitmap_count(MAP)).otherwise(F.lit(0))
    return bitmaps.groupBy(*by).agg(F.sum(ids).cast("long").alias(users), F.sum(ROWS).cast("long").alias(orders))


def period_counts(bitmaps: DataFrame, grain: str, period_col: str = "order_month", users: str = "total_customers",
                  orders: str = "total_orders") -> DataFrame:
    """OP30 of stored bitmaps: ``period_col``, distinct users and orders."""
    return counts(bitmaps, ("start",), users, orders).select(label_of_start("start", grain).alias(period_col), users, orders)


def in_set(bitmaps: DataFrame, among: DataFrame, by: Sequence[str] = ("start",)) -> DataFrame:
    """The bitmaps' sets cut with one set (``unite(..., [])`` of other bitmaps): how many of a cohort are in each period.
    Orders of others cannot be told apart in a bitmap, so there is no order count."""
    other = among.select(F.col(BUCKET).alias("_b"), F.col(MAP).alias("_among"))
    both = bitmaps.join(other, F.col(BUCKET) == F.col("_b"))
    pairs = both.select(*by, BUCKET, F.explode(F.array(F.struct(F.col(MAP).alias("m")), F.struct(F.col("_among").alias("m")))).alias("p"))
    cut = pairs.groupBy(*by, BUCKET).agg(F.bitmap_and_agg(F.col("p.m")).alias(MAP))
    return cut.groupBy(*by).agg(F.sum(F.bitmap_count(MAP)).cast("long").alias("customers"))
