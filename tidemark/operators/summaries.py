"""Mergeable sums and counts of sales lines.

A summary holds, per key, the parts of the exact sum (``numbers.sum_parts``), the number
of values (``_n``) and of rows (``_rows``). Lines are summed by their dimension's
key before they meet the dimension, so a part that holds a third of all lines
reaches the join as a row per key; the sums are merged by the report's own key afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import LIMBS, SCALE, number, sum_parts, total, units

_SUMS = (*LIMBS, "_rest")
PARTS = (*_SUMS, "_n", "_rows")


def is_summary(sales: DataFrame) -> bool:
    return set(PARTS) <= set(sales.columns)


def summarise(sales: DataFrame, by: Mapping[str, Column], value: str = "price", scale: int = SCALE) -> DataFrame:
    """One row per key ``by`` (name to expression over the lines), or, of a summary
    that already has those keys, its rows merged."""
    if is_summary(sales):
        return sales.groupBy(*by).agg(*[F.sum(c).alias(c) for c in PARTS])
    rows = sales.select(*[c.alias(n) for n, c in by.items()], number(value).alias("_value"), units(value, scale).alias("_units"))
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in sum_parts("_value", scale, F.col("_units")).items()],
                                 F.count("_value").alias("_n"), F.count(F.lit(1)).alias("_rows"))


def summary_total(scale: int = SCALE) -> Column:
    return total({c: F.col(c) for c in _SUMS}, scale)


def summary_mean(scale: int = SCALE) -> Column:
    """Mean of the values of a summary row, NULL when it has none."""
    return F.try_divide(summary_total(scale), F.col("_n"))
