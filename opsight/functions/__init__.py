"""Column and frame helpers shared by all operators."""

from opsight.functions.latest import latest_by
from opsight.functions.lookup import lookup, with_zeros
from opsight.functions.payload import payload_fields
from opsight.functions.timebox import bucketed, instant, recent, span, start_of_day, until, utc_day
from opsight.functions.values import (
    as_double,
    as_int,
    as_long,
    has_prefix,
    is_open,
    not_blank,
    or_default,
    ratio,
    text,
)

__all__ = [
    "as_double",
    "as_int",
    "as_long",
    "bucketed",
    "has_prefix",
    "instant",
    "is_open",
    "latest_by",
    "lookup",
    "not_blank",
    "or_default",
    "payload_fields",
    "ratio",
    "recent",
    "span",
    "start_of_day",
    "text",
    "until",
    "utc_day",
    "with_zeros",
]
