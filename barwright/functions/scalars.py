"""Column helpers: rounding, guarded division, limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a sum or a deviation counts as none.
EPSILON = 2.220446049250313e-16


def rnd(x: Column, digits: int) -> Column:
    """Half away from zero on the scaled binary value (F.round works on the decimal rendering)."""
    scale = 10.0**digits
    return F.round(x * scale) / scale


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, and ``otherwise`` where b is 0. ANSI mode raises on a bare division."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def clamp(x: Column, low: float, high: float) -> Column:
    """NaN stays NaN."""
    return F.when(F.isnan(x), x).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def snapped(x: Column, digits: int | None) -> Column:
    """Running sums cut to ``digits`` decimals, so that a return to an old high is one whatever the
    order of addition. None leaves them."""
    return x if digits is None else rnd(x, digits)


def positive(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(0.0)


def negative(x: Column) -> Column:
    return F.when(x < 0, x).otherwise(0.0)
