"""Value rules of the event model.

A missing string is the empty string, a failed conversion is null and never an error, and numbers may come as `8`,
`8.0` or quoted text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight.schemas import CLOSED_STATES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The string, blank when missing, so that negated tests keep the row."""
    return F.coalesce(_col(c), F.lit(""))


def not_blank(c: Column | str) -> Column:
    return text(c) != ""


def or_default(c: Column | str, default: str) -> Column:
    """The string, or `default` when it is missing or blank."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def is_open(status: Column | str) -> Column:
    """True unless the status ends the order; events without a status count as open."""
    return ~text(status).isin(*CLOSED_STATES)


def has_prefix(c: Column | str, prefix: str) -> Column:
    """Prefix test that ignores case (equality tests do not)."""
    return F.lower(text(c)).startswith(prefix.lower())


def as_double(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def as_long(c: Column | str) -> Column:
    """Whole numbers exactly, other numbers truncated, anything else null."""
    return F.coalesce(_col(c).try_cast("bigint"), _col(c).try_cast("double").try_cast("bigint"))


def as_int(c: Column | str) -> Column:
    return as_long(c).try_cast("int")


def ratio(numerator: Column, denominator: Column | str) -> Column:
    """Floating-point division where x/0 is infinite instead of an error."""
    below = _col(denominator).cast("double")
    return F.when(below == 0, F.lit(float("inf"))).otherwise(F.try_divide(numerator, below))
