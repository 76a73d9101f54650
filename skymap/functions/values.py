"""Missing-data rules for pixel values.

A pixel is *seen* when its value is finite and above the sentinel threshold.
Everything else is stored as NULL, so every Spark aggregate skips it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map file format.
UNSEEN = -1.6375e30
SEEN_ABOVE = -1e30

INF = float("inf")
NAN = float("nan")


def is_seen(value: Column) -> Column:
    """TRUE for a finite value above the threshold; FALSE (never NULL) otherwise."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (v > F.lit(SEEN_ABOVE)) & (v < F.lit(INF))


def seen_or_null(value: Column) -> Column:
    """The value where it is seen, NULL elsewhere."""
    return F.when(is_seen(value), value)


def zero_to_unseen(value: Column) -> Column:
    """An exact 0.0 (also -0.0) becomes NULL."""
    return F.nullif(value, F.lit(0.0).cast("double"))


def unit_scale(value: Column, factor: float, dtype: str = "double") -> Column:
    """Multiply seen values; float maps use a float factor and stay float."""
    scaled = value.cast(dtype) * F.lit(factor).cast(dtype)
    return F.when(is_seen(value), scaled).otherwise(value.cast(dtype))


def ieee_ln(x: Column) -> Column:
    """Natural log with IEEE results: ln(0) = -inf, ln(<0) = NaN."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def ieee_div(a: Column, b: Column) -> Column:
    """Division that follows IEEE for a zero divisor instead of raising."""
    zero = (
        F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    )
    return F.when(b != 0, a / b).otherwise(zero)


def clamp01(t: Column) -> Column:
    """Clamp to [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(t), t).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    )


def odd_asinh(x: Column) -> Column:
    """asinh through |x|: keeps all digits for large negative arguments."""
    return F.signum(x) * F.asinh(F.abs(x))
