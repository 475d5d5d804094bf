"""Period labels and date spans.

A period label is text whose lexical order equals time order:
``day`` 'YYYY-MM-DD', ``month`` 'YYYY-MM', ``quarter`` 'YYYY-Qn',
``year`` 'YYYY'. Range filters are always applied to the raw timestamp so
they reach the parquet scan; labels are computed only after filtering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "month", "quarter", "year")


def period_key(ts: Column | str, grain: str = "month") -> Column:
    """Text label of the period that contains ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if grain == "day":
        return F.date_format(c, "yyyy-MM-dd")
    if grain == "month":
        return F.date_format(c, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c).cast("string"))
    if grain == "year":
        return F.date_format(c, "yyyy")
    raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")


def period_start(label: Column | str, grain: str = "month") -> Column:
    """First day (DATE) of the period named by ``label``; NULL or bad text gives NULL."""
    c = F.col(label) if isinstance(label, str) else label
    if grain == "day":
        return F.try_to_date(c, "yyyy-MM-dd")
    if grain == "month":
        return F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")
    if grain == "quarter":
        q = F.substring(c, 7, 1).try_cast("int")
        month = F.lpad(((q - 1) * 3 + 1).cast("string"), 2, "0")
        return F.try_to_date(F.concat(F.substring(c, 1, 4), F.lit("-"), month, F.lit("-01")), "yyyy-MM-dd")
    if grain == "year":
        return F.try_to_date(F.concat(c, F.lit("-01-01")), "yyyy-MM-dd")
    raise ValueError(f"unknown grain {grain!r}")


def shift_period(date: Column, n: int, grain: str = "month") -> Column:
    """Move a period-start DATE by ``n`` periods."""
    if grain == "day":
        return F.date_add(date, n)
    if grain == "month":
        return F.add_months(date, n)
    if grain == "quarter":
        return F.add_months(date, 3 * n)
    if grain == "year":
        return F.add_months(date, 12 * n)
    raise ValueError(f"unknown grain {grain!r}")


def typed_lit(value, like: DataFrame, column: str) -> Column:
    """A literal cast to the type of ``like[column]`` (folded to a constant,
    so a comparison against it is pushed into the parquet scan)."""
    return F.lit(value).cast(like.schema[column].dataType)


@dataclass(frozen=True)
class Span:
    """A date range on a timestamp column.

    ``start`` is inclusive. ``end`` is inclusive when ``closed`` is true and
    exclusive otherwise. A bare date bound means midnight, so a closed span
    ending '2024-06-30' drops orders later on June 30, as the source SQL
    does. ``None`` leaves a side open.
    """

    start: str | None = None
    end: str | None = None
    closed: bool = True

    def predicate(self, df: DataFrame, column: str) -> Column:
        c = F.col(column)
        cond = F.lit(True)
        if self.start is not None:
            cond = cond & (c >= typed_lit(self.start, df, column))
        if self.end is not None:
            hi = typed_lit(self.end, df, column)
            cond = cond & ((c <= hi) if self.closed else (c < hi))
        return cond

    def apply(self, df: DataFrame, column: str = "ts") -> DataFrame:
        return df.filter(self.predicate(df, column))


def period_trunc(ts: Column | str, grain: str = "month") -> Column:
    """First day (DATE) of the period containing ``ts``.

    An integer truncation: operators group and join on this per row and
    format the text label only after aggregating.
    """
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    if grain == "day":
        return d
    if grain in ("month", "quarter", "year"):
        return F.trunc(d, grain)
    raise ValueError(f"unknown grain {grain!r}")


def label_of_start(start: Column | str, grain: str = "month") -> Column:
    """Text label of the period that starts on ``start`` (a DATE)."""
    return period_key(start, grain)


def period_bounds(label: str, grain: str = "month") -> tuple[str, str]:
    """``[start, end)`` dates, as 'YYYY-MM-DD' text, of the period named ``label``."""
    import datetime as dt

    if grain == "day":
        start = dt.date.fromisoformat(label)
        return start.isoformat(), (start + dt.timedelta(days=1)).isoformat()
    if grain == "year":
        y = int(label)
        return f"{y:04d}-01-01", f"{y + 1:04d}-01-01"
    if grain == "month":
        y, m = int(label[:4]), int(label[5:7])
        months = 1
    elif grain == "quarter":
        y, m = int(label[:4]), (int(label[6]) - 1) * 3 + 1
        months = 3
    else:
        raise ValueError(f"unknown grain {grain!r}")
    ny, nm = y + (m - 1 + months) // 12, (m - 1 + months) % 12 + 1
    return f"{y:04d}-{m:02d}-01", f"{ny:04d}-{nm:02d}-01"


def in_period(df: DataFrame, column: str, label: str, grain: str = "month") -> Column:
    """``column`` falls in the period ``label``: two comparisons with literals, no per-row formatting."""
    lo, hi = period_bounds(label, grain)
    return Span(lo, hi, closed=False).predicate(df, column)
