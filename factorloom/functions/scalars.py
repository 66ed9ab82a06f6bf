"""Protected scalar functions: missing or undefined results become 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10
LARGEST = 1.7976931348623157e308


def _without_infinity(x: Column) -> Column:
    """Infinities become NaN. The remainder by the largest double keeps every other value, and
    names ``x`` once: nested functions would otherwise grow exponentially in the plan."""
    return x % F.lit(LARGEST)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.nanvl(_without_infinity(x), F.lit(None).cast("double"))


def nan_to_num(x: Column) -> Column:
    return F.coalesce(F.nanvl(_without_infinity(x), F.lit(0.0)), F.lit(0.0))


def safe_add(a: Column, b: Column) -> Column:
    return nan_to_num(a + b)


def safe_sub(a: Column, b: Column) -> Column:
    return nan_to_num(a - b)


def safe_mul(a: Column, b: Column) -> Column:
    return nan_to_num(a * b)


def safe_div(a: Column, b: Column) -> Column:
    return nan_to_num(F.try_divide(a, b))


def safe_log(x: Column) -> Column:
    return nan_to_num(F.ln(x))  # NULL unless positive


def safe_sqrt(x: Column) -> Column:
    return nan_to_num(F.sqrt(x))  # NaN if negative


def safe_abs(x: Column) -> Column:
    return nan_to_num(F.abs(x))


def safe_inv(x: Column) -> Column:
    """1/x, with magnitudes under 1e-10 moved to 1e-10 of the same sign; 0 gives 0."""
    moved = F.when(F.abs(x) < TINY, F.signum(x) * TINY).otherwise(x)
    return nan_to_num(F.try_divide(F.lit(1.0), moved))


def clip_bounds(x: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp to [low, high]; a missing value stays missing."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))
