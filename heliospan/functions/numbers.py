"""Parsing, rounding and exact summing of payload numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# No payload quantity comes near this; larger ones could not be summed exactly.
LARGEST = 1e15


def parse_double(value: Column) -> Column:
    """Number text as DOUBLE, null when it is not a number that a payload can hold.

    Java accepts a type suffix (``1d``, ``2.f``) that is not a number here. ``nan``,
    ``inf`` and numbers beyond ``LARGEST`` are no quantities either: they would spoil
    every sum they take part in.
    """
    number = value.try_cast("double")
    return F.when(~value.rlike(r"[0-9.][dDfF]\s*$") & number.between(-LARGEST, LARGEST), number)


def to_float(value: Column, default: float = 0.0) -> Column:
    """Lenient number: null, empty and bad text become the default."""
    return F.coalesce(parse_double(value), F.lit(float(default)))


def is_blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def strict_float(value: Column) -> Column:
    """Strict number: null and empty are 0; bad text is null, see ``bad_number``."""
    return F.when(is_blank(value), F.lit(0.0)).otherwise(parse_double(value))


def bad_number(value: Column) -> Column:
    """True where ``strict_float`` found text that is not a number."""
    return ~is_blank(value) & parse_double(value).isNull()


def first_truthy(*values: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def first_nonzero(*values: Column) -> Column:
    """First number text that is neither null, empty nor zero."""
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0"), v) for v in values])


def round_n(value: Column, digits: int) -> Column:
    """Round half away from zero on the binary value.

    Within floating-point error of a decimal tie this can differ from
    half-even rounding: 0.125 gives 0.13, and 2.675 gives 2.68. The value is used
    three times, so pass a column, not a long expression.
    """
    scale = float(10**digits)
    size = F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when(value < 0, F.lit(0.0) - size).otherwise(size)


def exact_sum(value: Column) -> Column:
    """Sum of DOUBLE that does not depend on the order of the rows."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")
