"""Per-user activity as one mergeable row of period bits (OP08-OP13, OP16, OP25, OP26, OP33, OP35-OP38).

``activity_state`` reduces orders to one row per user: which periods of a calendar hold an order (bits in
longs, combined by ``bit_or``), the first order of a span, the last order and the number of orders. That takes one scan and one shuffle with
map-side partial aggregation, whatever a user's volume; no window, no row per (user, period). Everything
below is answered from that row: patterns are bit masks, counts of periods are bit counts, the first
missing period is the first zero bit, and monthly counts come from the set bits.

States merge: bits by ``bit_or``, firsts by ``min``, lasts by ``max``, counts by sum, so the state of all orders
is the merge of the states of its parts (``merge_states``), and new orders never make old ones be read again.
The calendar (origin, number of periods, grain) is fixed when the state is made; orders outside it set no bit. A
user has ``ceil(periods / 62)`` longs, so a calendar of years by month or of months by day stays a few longs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import Span, label_of_start, period_bounds, period_key, shift_period, typed_lit
from tidemark.operators.churn import STILL_ACTIVE

BITS = 62  # periods in a long; the sign stays out of it


@dataclass(frozen=True)
class Calendar:
    """``periods`` consecutive periods from the one labelled ``first``."""

    first: str
    periods: int
    grain: str = "month"

    @classmethod
    def covering(cls, span: Span, grain: str = "month") -> "Calendar":
        """The periods that a span with both ends touches."""
        if span.start is None or span.end is None:
            raise ValueError("a calendar needs both ends")
        start, end = dt.datetime.fromisoformat(span.start), dt.datetime.fromisoformat(span.end)
        if not span.closed:
            end -= dt.timedelta(microseconds=1)
        lo, hi = _number(start.date(), grain), _number(end.date(), grain)
        return cls(_label(lo, grain), max(hi - lo + 1, 1), grain)

    @property
    def origin(self) -> int:
        return _number(dt.date.fromisoformat(period_bounds(self.first, self.grain)[0]), self.grain)

    @property
    def words(self) -> int:
        return -(-self.periods // BITS)

    def place(self, label: str) -> int:
        """The number of a period in the calendar."""
        at = _number(dt.date.fromisoformat(period_bounds(label, self.grain)[0]), self.grain) - self.origin
        if not 0 <= at < self.periods:
            raise ValueError(f"{label} is not among the {self.periods} periods from {self.first}")
        return at

    def number_of(self, ts: Column) -> Column:
        """The number of the period that a time falls in (negative or beyond: outside)."""
        if self.grain == "day":
            n = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
        elif self.grain == "month":
            n = F.year(ts) * 12 + F.month(ts) - 1
        elif self.grain == "quarter":
            n = F.year(ts) * 4 + F.quarter(ts) - 1
        else:
            n = F.year(ts)
        return n - F.lit(self.origin)

    def start_of(self, number: Column) -> Column:
        """The first day of the period of that number."""
        return shift_period(F.lit(period_bounds(self.first, self.grain)[0]).cast("date"), number, self.grain)

    def labels(self) -> list[str]:
        return [_label(self.origin + i, self.grain) for i in range(self.periods)]


def _number(day: dt.date, grain: str) -> int:
    if grain == "day":
        return (day - dt.date(1970, 1, 1)).days
    if grain == "month":
        return day.year * 12 + day.month - 1
    if grain == "quarter":
        return day.year * 4 + (day.month - 1) // 3
    if grain == "year":
        return day.year
    raise ValueError(f"unknown grain {grain!r}")


def _label(number: int, grain: str) -> str:
    if grain == "day":
        return (dt.date(1970, 1, 1) + dt.timedelta(days=number)).isoformat()
    if grain == "month":
        return f"{number // 12:04d}-{number % 12 + 1:02d}"
    return f"{number // 4:04d}-Q{number % 4 + 1}" if grain == "quarter" else f"{number:04d}"


def _word(i: int) -> str:
    return f"bits_{i}"


def activity_state(orders: DataFrame, calendar: Calendar, span: Span = Span(), first_span: Span = Span(),
                   key: str = "user_id", ts: str = "ts") -> DataFrame:
    """One row per user with an order in ``span`` or ``first_span``: ``first_ts`` (earliest order in ``first_span``), ``last_ts`` and
    ``n_orders`` (of ``span``), and the bits of the calendar's periods with an order in ``span``."""
    a, f = span.predicate(orders, ts), first_span.predicate(orders, ts)
    at = calendar.number_of(F.col(ts))
    one, place = F.lit(1).cast("long"), F.col("_at")
    bits = [F.bit_or(F.when(a & (place >= i * BITS) & (place < min((i + 1) * BITS, calendar.periods)),
                            F.call_function("shiftleft", one, place - i * BITS))).alias(_word(i)) for i in range(calendar.words)]
    rows = orders.filter(a | f) if (span, first_span) != (Span(), Span()) else orders
    rows = rows.withColumn("_at", at)
    per = rows.groupBy(key).agg(F.min(F.when(f, F.col(ts))).alias("first_ts"), F.max(F.when(a, F.col(ts))).alias("last_ts"),
                                F.count(F.when(a, F.lit(1))).alias("n_orders"), *bits)
    return per.select(key, "first_ts", "last_ts", "n_orders", *[F.coalesce(_word(i), F.lit(0).cast("long")).alias(_word(i)) for i in range(calendar.words)])


def merge_states(*states: DataFrame, key: str = "user_id") -> DataFrame:
    """The state of all orders from the states of parts of them (same calendar and spans; the parts share no order)."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    words = [c for c in both.columns if c.startswith("bits_")]
    return both.groupBy(key).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_orders").cast("long").alias("n_orders"),
                                 *[F.bit_or(w).alias(w) for w in words])


def _masks(calendar: Calendar, periods: Sequence[str]) -> list[int]:
    out = [0] * calendar.words
    for p in periods:
        at = calendar.place(p)
        out[at // BITS] |= 1 << at % BITS
    return out


def _and(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def in_all(calendar: Calendar, periods: Sequence[str]) -> Column:
    """An order in each of the periods."""
    return _and(F.col(_word(i)).bitwiseAND(F.lit(m)) == m for i, m in enumerate(_masks(calendar, periods)) if m)


def in_none(calendar: Calendar, periods: Sequence[str]) -> Column:
    """No order in any of the periods."""
    return _and(F.col(_word(i)).bitwiseAND(F.lit(m)) == 0 for i, m in enumerate(_masks(calendar, periods)) if m)


def n_periods(calendar: Calendar, periods: Sequence[str] | None = None) -> Column:
    """How many of the periods (default: of the calendar) have an order."""
    masks = _masks(calendar, periods) if periods is not None else [(1 << BITS) - 1] * calendar.words
    out = F.lit(0)
    for i, m in enumerate(masks):
        out = out + F.bit_count(F.col(_word(i)).bitwiseAND(F.lit(m)))
    return out


def _bit(calendar: Calendar, period: str) -> Column:
    at = calendar.place(period)
    return F.col(_word(at // BITS)).bitwiseAND(F.lit(1 << at % BITS)) != 0


def first_missing(calendar: Calendar, targets: Sequence[str]) -> Column:
    """The first of the targets without an order; NULL if none lacks one."""
    return F.coalesce(*[F.when(~_bit(calendar, t), F.lit(t)) for t in targets])


def lapsed(state: DataFrame, calendar: Calendar, active: Sequence[str], silent: Sequence[str], key: str = "user_id") -> DataFrame:
    """OP05 for spans of whole periods: an order in one of ``active`` at least, none in ``silent``."""
    return state.filter((n_periods(calendar, active) > 0) & in_none(calendar, silent)).select(key)


def active_periods(state: DataFrame, calendar: Calendar, periods: Sequence[str] | None = None, key: str = "user_id",
                   name: str = "active_months") -> DataFrame:
    """OP08: per user, in how many of the periods there was an order (users with none are left out)."""
    return state.select(key, n_periods(calendar, periods).cast("long").alias(name)).filter(F.col(name) > 0)


def consistent(state: DataFrame, calendar: Calendar, periods: Sequence[str], key: str = "user_id") -> DataFrame:
    """OP10 / OP16: users with an order in every one of the periods, and their orders in the state's span."""
    return state.filter(in_all(calendar, periods)).select(key, F.col("n_orders").alias("order_count"))


def churn_by_grade(state: DataFrame, calendar: Calendar, grades: DataFrame, active: Sequence[str], silent: Sequence[str],
                   key: str = "user_id") -> DataFrame:
    """OP25: users with orders in every active period and none in the silent ones, by grade."""
    churned = state.filter(in_all(calendar, active) & in_none(calendar, silent)).select(key)
    return (churned.join(grades.select(key, "spending_grade"), key).groupBy("spending_grade")
            .agg(F.count(key).alias("churned_customer_count")))


def churn_curve(state: DataFrame, calendar: Calendar, active: Sequence[str], follow: Sequence[str], key: str = "user_id") -> DataFrame:
    """OP26: users active in every ``active`` period, by the first ``follow`` period without an order."""
    kept = state.filter(F.col(key).isNotNull() & in_all(calendar, active))
    label = F.coalesce(first_missing(calendar, follow), F.lit(STILL_ACTIVE))
    return kept.groupBy(label.alias("churned_month")).agg(F.count(key).alias("churned_customer_count"))


def first_gap(state: DataFrame, calendar: Calendar, targets: Sequence[str], first_period: str | None = None,
              key: str = "user_id") -> DataFrame:
    """OP35: ``first_order_month`` and the first target without an order, per user with a first order. A NULL user
    matches no order of its own (SQL's join), so its first target is missing. ``first_period`` keeps the
    (known) users whose first period it is."""
    missing = F.when(F.col(key).isNull(), F.lit(targets[0])).otherwise(first_missing(calendar, targets))
    out = state.filter(F.col("first_ts").isNotNull()).select(
        key, period_key("first_ts", calendar.grain).alias("first_order_month"), missing.alias("churned_month"))
    if first_period is not None:
        out = out.filter((F.col("first_order_month") == first_period) & F.col(key).isNotNull())
    return out


def _set_bits(calendar: Calendar) -> Column:
    """The numbers of the periods with an order, as an array."""
    words = F.array(*[F.col(_word(i)) for i in range(calendar.words)])
    numbers = F.sequence(F.lit(0), F.lit(calendar.periods - 1))
    return F.filter(numbers, lambda i: F.getbit(F.element_at(words, (F.floor(i / BITS) + 1).cast("int")), (i % BITS).cast("int")) == 1)


def period_rows(state: DataFrame, calendar: Calendar, key: str = "user_id", name: str = "order_month") -> DataFrame:
    """OP19 from the state: one row per user and period with an order."""
    rows = state.select(key, F.explode(_set_bits(calendar)).alias("_at"))
    return rows.select(key, label_of_start(calendar.start_of(F.col("_at")), calendar.grain).alias(name))


def new_customer_rate(state: DataFrame, calendar: Calendar, since: str, key: str = "user_id") -> DataFrame:
    """OP33: ``month, new_customers, total_customers, new_customer_rate`` (percent) in order of
    period: users whose first order (from ``since`` on) is in the period, and users with an order in it.
    A period without a new or without an active user is dropped, as by the inner join of the two."""
    is_new = F.coalesce(F.col("first_ts") >= typed_lit(period_bounds(since, calendar.grain)[0], state, "first_ts"), F.lit(False))
    own = state.select(key, F.when(is_new, calendar.number_of(F.col("first_ts"))).alias("_born"), _set_bits(calendar).alias("_on"))
    born = F.col("_born")
    seen = F.transform("_on", lambda i: F.struct(i.alias("at"), F.lit(True).alias("active"), F.coalesce(i == born, F.lit(False)).alias("born")))
    alone = F.array(F.struct(born.alias("at"), F.lit(False).alias("active"), F.lit(True).alias("born")))  # a first order outside the state's span
    rows = own.select(key, F.explode(F.when(born.isNull() | F.array_contains("_on", born), seen).otherwise(F.concat(seen, alone))).alias("p"))
    p = F.col("p")
    per = (rows.groupBy(p["at"].alias("_at"))
           .agg(F.count(F.when(p["born"], F.col(key))).alias("new_customers"), F.count(F.when(p["active"], F.col(key))).alias("total_customers"),
                F.bool_or(p["born"]).alias("_a"), F.bool_or(p["active"]).alias("_c"))
           .filter("_a AND _c"))
    rate = F.try_divide(F.col("new_customers"), F.col("total_customers")) * 100
    return per.orderBy("_at").select(label_of_start(calendar.start_of(F.col("_at")), calendar.grain).alias("month"), "new_customers",
                                     "total_customers", rate.alias("new_customer_rate"))
