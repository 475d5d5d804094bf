"""Sums and means of numbers that do not depend on how rows were partitioned.

A value is taken apart into whole units of ``10**-scale`` and what is left of it. The units, up to 2**52 of
them, are added as three limbs of a long (18, 17 and 17 bits, so that 2**45 rows cannot overflow a sum), which
gives the same total in every order; no decimal is made per row. What is left, nothing for a number of
``scale`` places, is added as doubles, so that small numbers keep their digits; so are values beyond 2**52 units (4.5e9 at six
places) and infinite ones. Of these last two, and of numbers far below a unit, the last digit of a total can depend on the order
of addition; of others the remainders are too small to show in the total. NaN is a missing number, as NULL is.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 6
_LOW, _HIGH = 18, 35  # where the second and the third limb begin
LIMBS = ("_low", "_mid", "_high")


def number(c: str | Column) -> Column:
    """A numeric column as double, NaN as NULL."""
    x = F.col(c) if isinstance(c, str) else c
    return F.nullif(x.cast("double"), F.lit(float("nan")))


def units(c: str | Column, scale: int = SCALE) -> Column:
    """The nearest whole number of units of ``10**-scale``; NULL from 2**52 units on."""
    x = number(c) * F.lit(10.0 ** scale)
    return F.when(F.abs(x) < F.lit(2.0 ** 52), F.rint(x).cast("long"))


def sum_parts(c: str | Column, scale: int = SCALE, n: Column | None = None) -> dict[str, Column]:
    """The aggregates that ``total`` makes a sum of; each may be summed further. ``n`` is a
    column with the value's ``units``, where they were computed beforehand (once per row)."""
    x = number(c)
    n = units(c, scale) if n is None else n
    near = n / F.lit(10.0 ** scale)
    left = F.when(n.isNull(), x).when(near != x, x - near)
    return {"_low": F.sum(n.bitwiseAND(F.lit((1 << _LOW) - 1))),
            "_mid": F.sum(F.shiftright(n, _LOW).bitwiseAND(F.lit((1 << _HIGH - _LOW) - 1))),
            "_high": F.sum(F.shiftright(n, _HIGH)), "_rest": F.sum(left)}


def total(parts: dict[str, Column], scale: int = SCALE) -> Column:
    """The sum as double from its parts; NULL when no row had a number."""
    low, mid, high = (parts[p].cast("decimal(20,0)") * F.lit(Decimal(1 << at).scaleb(-scale)) for p, at in zip(LIMBS, (0, _LOW, _HIGH)))
    exact, rest = (low + mid + high).cast("double"), parts["_rest"]
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def exact_sum(c: str | Column, scale: int = SCALE) -> Column:
    return total(sum_parts(c, scale), scale)


def exact_mean(c: str | Column, scale: int = SCALE) -> Column:
    """NULL for no numbers."""
    return F.try_divide(exact_sum(c, scale), F.count(number(c)))
