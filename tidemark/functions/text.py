"""Text cleaning for numbers, money labels and category values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source analyses.
UNKNOWN_LABEL = "미상"          # label for a missing birth country
MISSING_MARKERS = ("", "-")    # exact cell values treated as missing
WON_SIGN = "₩"                 # prefix of money labels
TS_TEXT_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"


NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
DATE_FORMATS = ("yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy.M.d", "yyyyMMdd")  # tried after ISO text
ISO_DATE = r"^\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?$"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"  # white space of any kind at either end


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _or_fail(value: Column, text: Column, what: str) -> Column:
    """``value``, or a failed query where there is text but no value."""
    return F.when(value.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {what}: "), text))).otherwise(value)


def clean_number(c: Column | str, strict: bool = False) -> Column:
    """Text such as '1,234' to DOUBLE: thousands commas stripped; anything but a
    decimal number ('nan', '1d', 'bad') is missing, so NULL; with ``strict`` it fails the query.
    """
    text = _c(c).cast("string")
    stripped = F.regexp_replace(text, ",", "")
    value = F.when(stripped.rlike(NUMBER_PATTERN), F.trim(stripped).try_cast("double"))
    return _or_fail(value, text, "number") if strict else value


def parse_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS, strict: bool = False) -> Column:
    """Date text to a timestamp: ISO first, then each of ``formats``; text that none
    reads is NULL, or with ``strict`` fails the query."""
    text = _c(c).cast("string")
    trimmed = F.regexp_replace(text, EDGE_SPACE, "")
    value = F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]) if formats else F.lit(None).cast("timestamp")
    iso = F.when(trimmed.rlike(ISO_DATE), F.try_to_timestamp(trimmed))
    value = F.coalesce(iso, value)
    return _or_fail(value, text, "date") if strict else value


def money_text(c: Column | str, sign: str = WON_SIGN) -> Column:
    """Whole-unit money label with thousands separators, e.g. '₩1,234'.

    Rounds half to even, like the axis formatter it replaces.
    """
    return F.concat(F.lit(sign), F.format_number(_c(c), 0))


def clean_missing_text(c: Column | str, label: str = UNKNOWN_LABEL) -> Column:
    """NULL, '' or '-' become ``label``; then white space of any kind goes from both
    ends; then blank text becomes ``label``.

    The order matters: ' - ' trims to '-' and stays '-'.
    """
    x = _c(c)
    step1 = F.when(x.isNull() | x.isin(*MISSING_MARKERS), F.lit(label)).otherwise(x)
    step2 = F.regexp_replace(step1, EDGE_SPACE, "")
    return F.when(step2 == "", F.lit(label)).otherwise(step2)


def ts_text_is_clean(c: Column | str, pattern: str = TS_TEXT_PATTERN) -> Column:
    """True when the text of a timestamp is exactly 'YYYY-MM-DD hh:mm:ss'."""
    return _c(c).cast("string").rlike(pattern)
