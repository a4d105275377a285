"""Number and truth coercions with the recording format's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Beyond this a product with 10 ** digits has no exact halves any more.
_LARGE = float(1 << 45)


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding by the exact binary value, halves to even: 12.5 -> 12, 13.5 -> 14; 2.675 -> 2.67, as it lies below the half.

    Only where the product with 10 ** digits is rounded onto a half does its error decide. The error is exact: the
    number is split into two parts of 26 bits, whose products need no rounding.
    """
    if digits == 0:
        return F.bround(value, 0)
    x, scale = value.cast("double"), float(10**digits)
    wide = x * F.lit(134217729.0)  # 2 ** 27 + 1
    high = wide - (wide - x)
    product = x * F.lit(scale)
    error = (high * F.lit(scale) - product) + (x - high) * F.lit(scale)
    plain = F.bround(product, 0)
    half = F.abs(product - plain) == 0.5
    settled = F.when(half & (error != 0), product + F.signum(error) * 0.5).otherwise(plain) / F.lit(scale)
    return F.when(F.abs(x) < _LARGE, settled).otherwise(F.bround(x, digits))


def whole(value: Column) -> Column:
    """The whole part of a number, cut towards zero; missing and unreadable ones count as 0."""
    fraction = value.try_cast("decimal(38,9)").try_cast("bigint")
    return F.coalesce(value.try_cast("bigint"), fraction, F.lit(0).cast("bigint"))


def truthy(*values: Column) -> Column:
    """True when any of the flags is true; NULL reads as false."""
    result = F.lit(False)
    for value in values:
        result = result | F.coalesce(value, F.lit(False))
    return result


def text_or(value: Column, default: str) -> Column:
    """Missing and empty strings both read as ``default``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def percent_of(part: Column, total: Column, digits: int = 1) -> Column:
    """``part`` of ``total`` in percent; 0 for an empty total."""
    return F.when(total > 0, half_even(part / total * F.lit(100.0), digits)).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two second readings, never negative; NULL unless both are known."""
    return F.when(
        start.isNotNull() & end.isNotNull(),
        half_even(F.greatest(F.lit(0.0), end - start) * F.lit(1000.0), 2),
    )


def decimal_text(value: Column) -> Column:
    """A number of at most two decimals as text, never in exponent form: ``12345678.5``."""
    plain = F.regexp_replace(value.cast("decimal(38,2)").cast("string"), "0$", "")
    return F.when(F.abs(value) >= 1e7, plain).otherwise(value.cast("string"))
