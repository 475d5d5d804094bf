"""Exact global ranks and floor-rank quartile thresholds (OP01, OP02).

``ROW_NUMBER() OVER (ORDER BY m DESC)`` with no partition puts every row in
one task. Here the rank is computed distributed:

1. range-partition the rows on the sort key and sort inside each partition;
2. tag each row with its partition id and its position in the partition,
   and write the result as Parquet into the shared checkpoint folder, so
   the partition contents can never change between the passes below (a
   lost executor re-reads the files, it does not re-sample the ranges);
3. count rows per partition -- one row per partition, so the running
   offset over these counts is a tiny single-task window and its broadcast
   is bounded by the partition count;
4. rank = partition offset + position + 1.

Sort order is (measure DESC, tie-breaker ASC); with a unique tie-breaker
the ranks are reproducible.

Where only the values at a few ranks are wanted (the quartile thresholds), nothing is sorted:
``values_at_ranks`` brackets them with a quantile sketch and counts what lies above and inside (see there).
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import SCALE, exact_sum
from tidemark.operators.relational import materialize

# Quartile cut points as fractions of the user count, counted
# from the top (rank floor(n * f) holds the threshold).
QUARTILE_FRACTIONS = {"p75": Decimal("0.25"), "p50": Decimal("0.50"), "p25": Decimal("0.75")}


def range_tagged(df: DataFrame, order: list[Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort on ``order``; tag rows with ``_part`` and ``_pos``; materialize.

    Without ``num_partitions`` the range shuffle starts from
    ``spark.sql.shuffle.partitions`` and AQE coalesces neighbouring ranges to
    its advisory size; coalescing only merges adjacent ranges and the sort
    runs after it, so positions stay in global order.
    """
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    return materialize(tagged, "ranked")


def partition_offsets(tagged: DataFrame) -> DataFrame:
    """``_part, _offset, _total``: rows before each range partition. One row per partition."""
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )


def with_rank(tagged: DataFrame, name: str = "rank", total_name: str | None = None) -> DataFrame:
    """Rank = partition offset + position + 1; the offsets table is bounded by the partition count."""
    out = (tagged.join(F.broadcast(partition_offsets(tagged)), "_part")
           .withColumn(name, F.col("_offset") + F.col("_pos") + 1))
    if total_name:
        out = out.withColumn(total_name, F.col("_total"))
    return out.drop("_part", "_pos", "_offset", "_total")


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank",
                      total_name: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Append a 1-based exact row number in ``order`` (and optionally the row total)."""
    return with_rank(range_tagged(df, order, num_partitions), name, total_name)


def user_totals(orders: DataFrame, measure: str = "total_spent", how: str = "sum",
                value: str = "amount", key: str = "user_id", scale: int = SCALE,
                extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-user ``SUM(value)`` (exact to ``scale`` places) or ``COUNT(order_id)``.

    ``extra`` adds more per-user aggregates (e.g. ``{"last_ts": F.max("ts")}``)
    to the same pass over the orders.
    """
    if how == "sum":
        agg = exact_sum(value, scale)
    elif how == "count":
        agg = F.count("order_id")
    else:
        raise ValueError("how must be 'sum' or 'count'")
    return orders.groupBy(key).agg(agg.alias(measure), *[c.alias(n) for n, c in (extra or {}).items()])


def ranked_totals(orders: DataFrame, measure: str = "total_spent", how: str = "sum",
                  key: str = "user_id", extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-user totals, range-partitioned by (measure DESC, key) and materialized with ``_part, _pos``."""
    totals = user_totals(orders, measure, how, key=key, extra=extra)
    return range_tagged(totals, [F.col(measure).desc(), F.col(key).asc()])


def written_totals(orders: DataFrame, measure: str = "total_spent", how: str = "sum", key: str = "user_id",
                   extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-user totals, written once as they come out of the aggregate."""
    return materialize(user_totals(orders, measure, how, key=key, extra=extra), "totals")


def rank_users(orders: DataFrame, measure: str = "total_spent", how: str = "sum",
               key: str = "user_id") -> DataFrame:
    """OP01: ``user_id, <measure>, rank, total_count``; rank 1 = largest measure.

    Ties are broken by ``user_id`` ascending.
    """
    return with_rank(ranked_totals(orders, measure, how, key), "rank", "total_count")


def _cut_rank(total: Column, frac: Decimal) -> Column:
    return F.floor(total * F.lit(frac)).cast("long")


def quartile_thresholds(ranked: DataFrame, measure: str = "total_spent") -> DataFrame:
    """OP02: one row ``p75, p50, p25`` = measure at rank floor(n*0.25/0.5/0.75).

    This is not ``percentile_disc``. For n < 4 the rank is 0, which does not
    exist, so the threshold is NULL. Only the three ranks are kept before
    the (one-row) global aggregate.
    """
    total, rank, m = F.col("total_count"), F.col("rank"), F.col(measure)
    wanted = F.lit(False)
    for frac in QUARTILE_FRACTIONS.values():
        wanted = wanted | (rank == _cut_rank(total, frac))
    picked = ranked.filter(wanted)
    return picked.agg(*[
        F.max(F.when(rank == _cut_rank(total, frac), m)).alias(name)
        for name, frac in QUARTILE_FRACTIONS.items()
    ])


ACCURACY = 1000  # of the quantile sketch: it brackets a rank within about 1 / ACCURACY of the rows
MOST_KEPT = 100_000  # rows of a bracket that are decided by a histogram in one small window; a wider one is bracketed again


def _between(low, high) -> Column:
    """``_m`` strictly between two values; None is no bound."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col("_m") > F.lit(low))
    if high is not None:
        out = out & (F.col("_m") < F.lit(high))
    return out


def values_at_ranks(df: DataFrame, measure: str, ranks: Mapping[str, int], accuracy: int = ACCURACY,
                    most_kept: int = MOST_KEPT) -> dict[str, object]:
    """The exact values of ``measure`` at descending ranks (1: the largest; NULL sorts last, a rank that
    does not exist has the value None), without a sort or a range shuffle. ``df`` is read several times, so it
    should be a written table.

    Each round is two passes over the values still in question: a quantile sketch names, for every rank, two values that it
    should lie between by the sketch's error bound; one aggregate counts the rows above, at, between and
    below these two. The counts say where the rank really is: at one of the two (found), or strictly inside, above or
    below, which is the next range. A range of at most ``most_kept`` rows is decided by a running count over its
    histogram (ties are one entry). Only the two values and their counts reach the driver.
    """
    rows = df.select(F.col(measure).alias("_m")).filter(F.col(measure).isNotNull())
    n = rows.count()
    out: dict[str, object] = dict.fromkeys(ranks)
    # by rank: the open range it is in, the rows above the range, the rows inside
    ranges = {name: (None, None, 0, n) for name, k in ranks.items() if 1 <= k <= n}
    small = {}
    while ranges:
        small |= {name: r for name, r in ranges.items() if r[3] <= most_kept}
        ranges = {name: r for name, r in ranges.items() if r[3] > most_kept}
        if not ranges:
            break
        sketch = []
        for name, (low, high, above, inside) in ranges.items():
            place = (inside - (ranks[name] - above) + 0.5) / inside
            ends = [max(0.0, place - 2 / accuracy), min(1.0, place + 2 / accuracy)]
            sketch.append(F.percentile_approx(F.when(_between(low, high), F.col("_m")), ends, accuracy).alias(name))
        ends = rows.agg(*sketch).first()
        m, counts = F.col("_m"), []
        for name, (low, high, _, _) in ranges.items():
            a, b = ends[name]
            for what, cond in (("over", _between(b, high)), ("high", m == F.lit(b)), ("between", _between(a, b)), ("low", m == F.lit(a)),
                               ("under", _between(low, a))):
                counts.append(F.count(F.when(cond, 1)).alias(f"{name}_{what}"))
        got = rows.agg(*counts).first()
        for name, (low, high, above, _) in list(ranges.items()):
            a, b = ends[name]
            for what, value, bounds in (("over", None, (b, high)), ("high", b, None), ("between", None, (a, b)), ("low", a, None), ("under", None, (low, a))):
                if a == b and what in ("between", "low"):
                    continue
                here = got[f"{name}_{what}"]
                if ranks[name] <= above + here:
                    break
                above += here
            if bounds is None:
                out[name] = value
                del ranges[name]
            else:
                ranges[name] = (*bounds, above, here)
    if small:
        # at most three times most_kept rows, so one small window
        wanted = F.lit(False)
        for low, high, _, _ in small.values():
            wanted = wanted | _between(low, high)
        hist = rows.filter(wanted).groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
        falling = Window.orderBy(F.col("_m").desc()).rowsBetween(Window.unboundedPreceding, 0)
        picks = []
        for name, (low, high, above, _) in small.items():
            part = _between(low, high)
            reach = F.sum(F.when(part, F.col("_n")).otherwise(0)).over(falling)
            picks.append(F.when(part & (reach >= ranks[name] - above), F.col("_m")).alias(name))
        out |= hist.select(*picks).agg(*[F.max(name).alias(name) for name in small]).first().asDict()
    return out


def thresholds_by_selection(totals: DataFrame, measure: str = "total_spent") -> DataFrame:
    """OP02 without ranking: one row ``p75, p50, p25`` = the measure at rank floor(n * 0.25 / 0.5 / 0.75) of a
    written table; NULL for a rank that does not exist (n < 4) or has no value."""
    n = totals.count()
    values = values_at_ranks(totals, measure, {name: int(n * frac) for name, frac in QUARTILE_FRACTIONS.items()})
    kind = totals.schema[measure].dataType
    return totals.sparkSession.range(1).select(*[F.lit(values[name]).cast(kind).alias(name) for name in QUARTILE_FRACTIONS])


def thresholds_from_histogram(totals: DataFrame, measure: str) -> DataFrame:
    """OP02 for a low-cardinality measure (order counts) without ranking users.

    Users are first reduced to a histogram ``value -> users``. Its size is
    the number of distinct values, at most sqrt(2 x orders), so the running
    count over it is a small single-task window. The value at descending
    rank k is the largest value whose running count reaches k.
    """
    hist = totals.groupBy(measure).agg(F.count(F.lit(1)).alias("_users"))
    from_top = Window.orderBy(F.col(measure).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select(measure, F.sum("_users").over(from_top).alias("_reach"),
                      F.sum("_users").over(Window.partitionBy(F.lit(0))).alias("_n"))
    n = F.col("_n")
    return cum.agg(*[
        F.max(F.when((_cut_rank(n, frac) >= 1) & (F.col("_reach") >= _cut_rank(n, frac)), F.col(measure))).alias(name)
        for name, frac in QUARTILE_FRACTIONS.items()
    ])
