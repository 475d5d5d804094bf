"""Profile of every column of a table with its most common values (OP41).

One scan gives each column's counts, least and greatest value and a heavy-hitter sketch
(``approx_top_k``). The sketch only names candidates: a second scan counts those exactly, for all columns at
once. Whether they are the most common values is then decided by the sketch's own bounds: a value that is not among the candidates
has at most the smallest estimate that was returned, or, where the sketch dropped it, at most its error bound. Where the last
exact count is not above that (flat columns such as keys and prices), the column is counted by a plain group-by instead, so the
result is exact for every column. A value that a third of all rows have is one entry of a sketch and one counter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED = 10_000  # values a sketch follows; its error is at most 3.5 / TRACKED of the rows
SPARE = 4  # candidates asked for, per value wanted

_SCHEMA = "column_name string, dtype string, row_count long, non_null long, min_value string, max_value string, value_rank int, value string, value_count long"


def _by_group(df: DataFrame, column: str, k: int) -> list[tuple]:
    """The ``k`` most common values by counting all of them: take-ordered, ties by the value."""
    c = F.col(f"`{column}`")
    rows = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return [(r["t"], r["n"]) for r in rows.orderBy(F.desc("n"), "v").limit(k).select(F.col("v").cast("string").alias("t"), "n").collect()]


def profile_table(df: DataFrame, k: int = 3, columns: Sequence[str] | None = None, tracked: int = TRACKED) -> DataFrame:
    """``column_name, dtype, row_count, non_null, min_value, max_value`` and, a row each, the ``k`` most common
    values (``value_rank``, ``value``, ``value_count``; ties by the value; NULL is no value). Values are text. A column without
    values has one row with NULLs. Columns of maps and other unordered types are left out."""
    fields = [f for f in df.schema.fields if (columns is None or f.name in columns)
              and not isinstance(f.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType, T.BinaryType))]
    if not fields:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    # one zero: -0.0 and 0.0 are equal but not the same text
    df = df.select(*[(F.col(f"`{f.name}`") + F.lit(0.0)).cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)
                     else F.col(f"`{f.name}`") for f in fields])
    stats = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        # the sketch takes no time without zone; its text orders and distinguishes alike
        seen = c.cast("string") if isinstance(f.dataType, (T.TimestampNTZType, T.BooleanType)) else c
        stats += [F.count(c).alias(f"count_{i}"), F.min(c).cast("string").alias(f"min_{i}"), F.max(c).cast("string").alias(f"max_{i}"),
                  F.call_function("approx_top_k", seen, F.lit(min(SPARE * k, tracked)), F.lit(tracked)).alias(f"top_{i}")]
    one = df.agg(*stats).first()
    asked = min(SPARE * k, tracked)
    returned = {i: one[f"top_{i}"] or [] for i in range(len(fields))}
    # the most that a value outside the candidates can count
    outside = {i: max(one["n"] * 3.5 / tracked, min(x["count"] for x in r)) if len(r) >= asked else 0 for i, r in returned.items()}
    # an estimate is never too low: where the k-th is not above that, an exact count would not be either
    candidates = {i: [x["item"] for x in r if x["item"] is not None] for i, r in returned.items()
                  if not outside[i] or sorted((x["count"] for x in r), reverse=True)[k - 1] > outside[i]}
    recount = [F.count(F.when(F.col(f"`{fields[i].name}`") == F.lit(v).cast(fields[i].dataType), 1)).alias(f"c_{i}_{j}")
               for i, values in candidates.items() for j, v in enumerate(values)]
    exact = df.agg(*recount).first() if recount else {}
    rows = []
    for i, f in enumerate(fields):
        counted = sorted(((v, exact[f"c_{i}_{j}"]) for j, v in enumerate(candidates.get(i, ()))), key=lambda x: (-x[1], x[0]))
        sure = one[f"count_{i}"] == sum(n for _, n in counted) or (len(counted) > k and counted[k - 1][1] > outside[i])
        if sure:
            text = _texts(df, f, [v for v, _ in counted[:k]])
            top = [(t, n) for t, (_, n) in zip(text, counted)]
        else:
            top = _by_group(df, f.name, k)
        head = (f.name, f.dataType.simpleString(), one["n"], one[f"count_{i}"], one[f"min_{i}"], one[f"max_{i}"])
        rows += [(*head, at, v, n) for at, (v, n) in enumerate(top, 1)] or [(*head, None, None, None)]
    return df.sparkSession.createDataFrame(rows, _SCHEMA)


def _texts(df: DataFrame, field: T.StructField, values: list) -> list[str]:
    """The values as Spark writes them."""
    if not values:
        return []
    return list(df.sparkSession.range(1).select(*[F.lit(v).cast(field.dataType).cast("string").alias(str(i)) for i, v in enumerate(values)]).first())
