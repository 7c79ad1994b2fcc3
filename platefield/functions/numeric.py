"""Number semantics that differ between JavaScript and Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round halves towards +infinity (Spark's ``round`` goes away from zero)."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low, high) -> Column:
    """``low <= x <= high``; NaN stays NaN, which bare greatest/least would turn into ``high``."""
    low, high = _lit(low), _lit(high)
    return F.when(F.isnan(x), x).otherwise(F.greatest(low, F.least(high, x)))


def clamp_int(x: Column, low, high) -> Column:
    return F.greatest(_lit(low), F.least(_lit(high), x))


def clamp01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def clamp_input(x: Column, low: float, high: float) -> Column:
    """The validating form: what is not a number becomes ``low``."""
    return F.when(x.isNull() | F.isnan(x), F.lit(low)).otherwise(clamp(x, low, high))


def in_range(x: Column, low, high) -> Column:
    return x.between(_lit(low), _lit(high))


def clz32(x: Column) -> Column:
    """Leading zero bits of the lowest 32 bits."""
    low = x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low == 0, F.lit(32)).otherwise(F.lit(32) - F.length(F.bin(low)))


def imul(x: Column, y: Column) -> Column:
    """32-bit wrapping product, as a signed number.

    One factor is split into 16-bit halves, so the 64-bit products never overflow.
    """
    mask = F.lit(0xFFFFFFFF)
    a = x.cast("bigint").bitwiseAND(mask)
    b = y.cast("bigint").bitwiseAND(mask)
    high = F.shiftright(b, 16)
    low = b.bitwiseAND(F.lit(0xFFFF))
    product = (F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16) + a * low).bitwiseAND(mask)
    return F.when(product >= F.lit(1 << 31), product - F.lit(1 << 32)).otherwise(product)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
