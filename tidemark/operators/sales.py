"""Price and volume analytics over sales lines (OP40-OP58).

Sales columns: ``artist, company, price, date, category_size, size``. The grouped
reports also take a summary of the lines (``operators.summaries``) that has their
keys, with the date key named as the report says. Sums and means are exact
(``functions.numbers``), so they do not depend on how rows were partitioned; NaN is missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import SCALE, exact_mean
from tidemark.functions.periods import Span, label_of_start, period_trunc
from tidemark.functions.text import DATE_FORMATS, clean_missing_text, clean_number, money_text, parse_date
from tidemark.operators.summaries import is_summary, summarise, summary_mean, summary_total

# Labels of the two sides of an event date.
BEFORE, AFTER = "before", "after"


def clean_number_column(df: DataFrame, column: str, name: str | None = None, strict: bool = False) -> DataFrame:
    """OP40: thousands commas stripped and bad text to NULL (``strict``: an error); a numeric column is only cast."""
    src = F.col(column)
    is_numeric = isinstance(df.schema[column].dataType, T.NumericType)
    return df.withColumn(name or column, F.nullif(src.cast("double"), F.lit(float("nan"))) if is_numeric else clean_number(src, strict))


def profile(df: DataFrame, column: str, approx_rsd: float | None = None) -> DataFrame:
    """OP41: one row ``column_name, dtype, row_count, non_null, distinct_count, min_value, max_value``.

    One global aggregate (partial per task, then one merge); the exact
    distinct count is the costly part and shuffles on the value.
    ``approx_rsd`` uses a HyperLogLog++ sketch for it instead (never the default).
    """
    c = F.col(column)
    distinct = F.count_distinct(c) if approx_rsd is None else F.approx_count_distinct(c, approx_rsd)
    return df.agg(
        F.lit(column).alias("column_name"),
        F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
        F.count(F.lit(1)).alias("row_count"),
        F.count(c).alias("non_null"),
        distinct.alias("distinct_count"),
        F.min(c).alias("min_value"),
        F.max(c).alias("max_value"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """OP41: every distinct value of ``column``, NULL included, in order."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """SO4: the first ``n`` rows by ``order`` (then by every other column that can be ordered, so that ties repeat)."""
    rest = [f.name for f in df.schema.fields if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(*[F.col(f"`{c}`") for c in (*order, *rest)]).limit(n)


def _side(date: Column, cut: str, like: DataFrame, date_col: str) -> tuple[Column, Column]:
    cut_lit = F.lit(cut).cast(like.schema[date_col].dataType)
    return date < cut_lit, date >= cut_lit


def side_of(date: str, cut: str, like: DataFrame) -> Column:
    """'before' or 'after' the cut; NULL for a NULL date."""
    before, after = _side(F.col(date), cut, like, date)
    return F.when(before, F.lit(BEFORE)).when(after, F.lit(AFTER))


def volume_before_after(sales: DataFrame, cut: str, count_rows: bool = False, date_col: str = "date",
                        value: str = "price") -> DataFrame:
    """OP42: ``period, transaction_volume`` -- always two rows, 0 for an empty side.

    Counts non-null prices, or rows with ``count_rows=True``. A NULL date is on neither side.
    """
    before, after = _side(F.col(date_col), cut, sales, date_col)
    what = F.lit(1) if count_rows else F.col(value)
    one = sales.agg(F.count(F.when(before, what)).alias("_b"), F.count(F.when(after, what)).alias("_a"))
    return one.select(F.explode(F.array(
        F.struct(F.lit(BEFORE).alias("period"), F.col("_b").alias("transaction_volume")),
        F.struct(F.lit(AFTER).alias("period"), F.col("_a").alias("transaction_volume")),
    )).alias("r")).select("r.*")


def mean_before_after(sales: DataFrame, value: str, cut: str, date_col: str = "date",
                      scale: int = SCALE) -> DataFrame:
    """OP43: ``period, avg_price`` -- mean of ``value`` on each side (NULL for an empty side)."""
    sides = summarise(sales, {"side": side_of(date_col, cut, sales)}, value, scale).withColumn("mean", summary_mean(scale))
    one = sides.agg(F.max(F.when(F.col("side") == BEFORE, F.col("mean"))).alias("_b"),
                    F.max(F.when(F.col("side") == AFTER, F.col("mean"))).alias("_a"))
    return one.select(F.explode(F.array(
        F.struct(F.lit(BEFORE).alias("period"), F.col("_b").alias("avg_price")),
        F.struct(F.lit(AFTER).alias("period"), F.col("_a").alias("avg_price")),
    )).alias("r")).select("r.*")


def trim_extremes(sales: DataFrame, value: str = "price", extremes: tuple | None = None) -> DataFrame:
    """OP44: drop every row tied at the column max or min; NULL and NaN values stay.

    Max and min, of the values that are numbers, come from one global aggregate read as a
    scalar subquery (left joins under it that give only other columns are not run). ``extremes`` (least,
    greatest), where they are known, for example from ``statistics.column_extremes``, save that scan.
    """
    m = F.col("_mm")
    v = F.nullif(F.col(value), F.lit(float("nan"))) if isinstance(sales.schema[value].dataType, T.FractionalType) else F.col(value)
    if extremes is not None:
        ends = [F.lit(x).cast(sales.schema[value].dataType) for x in extremes]
        return sales.filter(v.isNull() | (~v.eqNullSafe(ends[0]) & ~v.eqNullSafe(ends[1])))
    mm = sales.select(F.struct(F.max(v).alias("hi"), F.min(v).alias("lo")).alias("m")).scalar()
    return (sales.withColumn("_mm", mm)
            .filter(v.isNull() | (~v.eqNullSafe(m.hi) & ~v.eqNullSafe(m.lo)))
            .drop("_mm"))


def size_price_points(sales: DataFrame, extremes: tuple | None = None) -> DataFrame:
    """OP45: ``size, price, category_size`` of the trimmed sales (the data behind the scatter)."""
    return trim_extremes(sales, "price", extremes).select("size", "price", "category_size")


def monthly_mean_by_category(sales: DataFrame, scale: int = SCALE) -> DataFrame:
    """OP46: ``year_month, category_size, price`` = mean price by month and class; NULL date or class dropped.

    Of a summary: keys ``month_start`` and ``category_size``.
    """
    by = {"month_start": period_trunc("date", "month"), "category_size": F.col("category_size")}
    agg = summarise(sales, by, scale=scale).where("month_start IS NOT NULL AND category_size IS NOT NULL")
    return agg.select(label_of_start("month_start", "month").alias("year_month"), "category_size",
                      summary_mean(scale).alias("price"))


def category_counts(sales: DataFrame, column: str = "category_size") -> DataFrame:
    """OP47: frequency table, most common first, NULL dropped."""
    n = F.sum("_rows") if is_summary(sales) else F.count(F.lit(1))
    return (sales.filter(F.col(column).isNotNull()).groupBy(column).agg(n.alias("count"))
            .orderBy(F.col("count").desc(), F.col(column)))


def monthly_price_and_count(sales: DataFrame, category: str, since: str | None = None,
                            scale: int = SCALE) -> DataFrame:
    """OP48: one class; per month ``month`` (last day, as the chart labels it), mean price,
    non-null price count. Only months with sales appear.

    Of a summary: keys ``month`` and ``category_size``, its lines limited by the caller.
    """
    if since is not None:
        if is_summary(sales):
            raise ValueError("limit the lines before they are summarised")
        sales = Span(since, None).apply(sales, "date")
    by = {"month": F.col("month") if is_summary(sales) else F.last_day("date")}
    rows = sales.filter(F.col("category_size") == category)
    agg = summarise(rows, by, scale=scale).where("month IS NOT NULL")
    return agg.select("month", summary_mean(scale).alias("price"), F.col("_n").alias("sales_count"))


def compare_before_after(sales: DataFrame, cut: str, by: str = "category_size", scale: int = SCALE) -> DataFrame:
    """OP49: per ``by`` value, count and mean before/after ``cut`` and two percent changes.

    Lines are reduced to a row per value and side, and those to a row per value, instead
    of two summaries and a merge. Inner merge semantics: a value with rows on only one
    side is dropped. A zero count before gives a NULL change (the source's pandas gave
    inf). Of a summary: keys ``side`` (``side_of``) and ``by``.
    """
    keys = {by: F.col(by), "side": F.col("side") if is_summary(sales) else side_of("date", cut, sales)}
    sides = summarise(sales, keys, scale=scale).where(F.col(by).isNotNull() & F.col("side").isNotNull())
    sides = sides.select(by, "side", F.col("_n").alias("n"), summary_mean(scale).alias("mean"))
    b, a = F.col("side") == BEFORE, F.col("side") == AFTER
    agg = sides.groupBy(by).agg(
        F.count("side").alias("_sides"),
        F.max(F.when(b, F.col("n"))).alias("transaction_count_before"),
        F.max(F.when(b, F.col("mean"))).alias("avg_price_before"),
        F.max(F.when(a, F.col("n"))).alias("transaction_count_after"),
        F.max(F.when(a, F.col("mean"))).alias("avg_price_after"),
    ).filter("_sides = 2")
    cb, ca = F.col("transaction_count_before"), F.col("transaction_count_after")
    pb, pa = F.col("avg_price_before"), F.col("avg_price_after")
    return agg.select(
        by, "transaction_count_before", "avg_price_before", "transaction_count_after", "avg_price_after",
        (F.try_divide(ca - cb, cb) * 100).alias("transaction_count_change_pct"),
        (F.try_divide(pa - pb, pb) * 100).alias("avg_price_change_pct"),
    )


def top_groups_by_mean(sales: DataFrame, by: Sequence[str], k: int = 10, min_count: int | None = None,
                       value: str = "price", scale: int = SCALE) -> DataFrame:
    """OP50 / OP51: ``<by>, mean_price, transaction_count`` (non-null prices), top ``k`` by mean.

    A group without prices sorts last; ties are broken by the keys; rows
    with a NULL key are dropped, as pandas grouping drops them. The top-k is
    a distributed take-ordered (k rows per task, then one merge).
    """
    agg = summarise(sales, {c: F.col(c) for c in by}, value, scale)
    for c in by:
        agg = agg.filter(F.col(c).isNotNull())
    agg = agg.select(*by, summary_mean(scale).alias("mean_price"), F.col("_n").alias("transaction_count"))
    if min_count is not None:
        agg = agg.filter(F.col("transaction_count") >= min_count)
    return agg.orderBy(F.col("mean_price").desc_nulls_last(), *[F.col(c).asc() for c in by]).limit(k)


def yearly_summary(sales: DataFrame, span: Span, date_col: str = "date", value: str = "price",
                   by: str | None = None, scale: int = SCALE, fill: str | None = None) -> DataFrame:
    """OP52 / OP53: per year (and ``by``): non-null count, mean, and percent change
    against the previous *present* year of the same group.

    ``fill=None``: a NULL mean gives a NULL change. ``fill="pad"``: a NULL mean takes the
    group's last mean before it for the change (never in ``avg_price``), as pandas pads. A
    zero previous value gives NULL (pandas gave inf). The window is partitioned
    by ``by``; without it, it holds one row per year.
    """
    if fill not in (None, "pad"):
        raise ValueError("fill must be None or 'pad'")
    rows = span.apply(sales.filter(F.col(date_col).isNotNull()), date_col)
    if by:
        rows = rows.filter(F.col(by).isNotNull())
    keys = ({by: F.col(by)} if by else {}) | {"year": F.year(date_col).cast("long")}
    agg = summarise(rows, keys, value, scale).select(*keys, F.col("_n").alias("transaction_count"),
                                                     summary_mean(scale).alias("avg_price"))
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("year")
    mean = F.col("avg_price")
    if fill == "pad":
        mean = F.last("avg_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    agg = agg.withColumn("_mean", mean)
    change = lambda c: (F.try_divide(F.col(c), F.lag(c).over(w)) - 1) * 100
    return agg.select(*keys, "transaction_count", "avg_price",
                      change("transaction_count").alias("transaction_count_change_pct"),
                      change("_mean").alias("avg_price_change_pct"))


def union_sources(sources: Mapping[str, tuple[DataFrame, str, str]], name: str = "artist",
                  formats: Sequence[str] = DATE_FORMATS, strict: bool = False) -> DataFrame:
    """SRC5 / ST2: sources with their own date and price column names, stacked as
    ``<name>, date, price``. Text dates are read as ISO, then by ``formats`` in turn.
    Dates that do not parse and prices that are not numbers become NULL, or with
    ``strict`` fail the query."""
    parts = []
    for label, (df, date_col, price_col) in sources.items():
        dt = df.schema[date_col].dataType
        date = F.col(date_col) if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) \
            else parse_date(date_col, formats, strict)
        price = F.col(price_col).cast("double") if isinstance(df.schema[price_col].dataType, T.NumericType) \
            else clean_number(price_col, strict)
        parts.append(df.select(F.lit(label).alias(name), date.cast("timestamp_ntz").alias("date"),
                               price.alias("price")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def years_union(stacked: DataFrame, span: Span | None = None) -> DataFrame:
    """OP54: every year present in any source, sorted."""
    rows = stacked if span is None else span.apply(stacked, "date")
    return rows.select(F.year("date").cast("long").alias("year")).filter(F.col("year").isNotNull()).distinct().orderBy("year")


def top_by_total(sales: DataFrame, by: str = "artist", k: int = 20, value: str = "price",
                 scale: int = SCALE) -> DataFrame:
    """OP56: ``<by>, total`` -- sum of ``value`` (0 for a group of NULLs), top ``k``, NULL key dropped."""
    agg = (summarise(sales, {by: F.col(by)}, value, scale).filter(F.col(by).isNotNull())
           .select(by, F.coalesce(summary_total(scale), F.lit(0.0)).alias("total")))
    return agg.orderBy(F.col("total").desc(), F.col(by)).limit(k)


def with_money_text(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """OP55: add a '₩1,234' label of ``column``."""
    return df.withColumn(name or f"{column}_text", money_text(column))


def profile_of_top(profiles: DataFrame, top: DataFrame, top_key: str) -> DataFrame:
    """OP57: profiles whose ``name`` is among ``top`` (semi join, never collected),
    with ``country_birth`` cleaned: NULL / '' / '-' / blank to the unknown label."""
    keys = top.select(F.col(top_key).alias("name"))
    return (profiles.join(keys, "name", "left_semi")
            .select("name", clean_missing_text("country_birth").alias("country_birth"),
                    "country_of_activity", "country_of_activity2", "number_museum"))


def mean_by(profiles: DataFrame, by: Sequence[str], value: str = "number_museum", scale: int = SCALE) -> DataFrame:
    """OP58: mean of ``value`` by ``by``, descending; rows with a NULL key are dropped."""
    rows = profiles
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    return (rows.groupBy(*by).agg(exact_mean(value, scale).alias(value))
            .orderBy(F.col(value).desc(), *[F.col(c) for c in by]))


def yearly_summary_multi(sources: Mapping[str, tuple[DataFrame, str, str]], span: Span,
                         name: str = "artist", fill: str | None = None) -> DataFrame:
    """OP53: per-source yearly summary from sources with their own date and price columns;
    the percent change is computed within each source."""
    return yearly_summary(union_sources(sources, name), span, by=name, fill=fill)
