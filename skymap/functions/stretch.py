"""Value -> [0, 1] stretches, classes, gamma and colour index.

A stretch returns ``t`` or NULL for a bad value (unseen, or not representable).
NaN marks a seen value whose stretch is undefined; it takes colour index 0.
``lo`` and ``hi`` may be numbers or per-map columns.

Two families: the plain ones, and the ``*_norm`` ones that normalise by the
transformed limits. Rasters use ``*_norm`` plus the histogram stretch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions.search import with_count_below
from skymap.functions.staging import as_col
from skymap.functions.values import NAN, clamp01, ieee_div, ieee_ln, is_seen, odd_asinh

KINDS = ("linear", "log", "asinh", "symlog", "plancklog", "histogram")
# Knots of a histogram where the caller asks for no other number.
KNOTS = 1024


@dataclass(frozen=True)
class Scale:
    """A stretch: its kind and its one parameter."""

    kind: str = "linear"
    param: float = 1.0  # asinh scale, or the linear threshold of the log-like ones
    negative: str = "unseen"  # plain log only: "unseen" or "zero"
    bins: int = KNOTS  # histogram only: the most knots a map may have

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown stretch {self.kind!r}")
        if self.kind in ("asinh", "symlog", "plancklog") and self.param <= 0:
            raise ValueError("the stretch parameter must be positive")


def _framed(value, lo, hi, body) -> Column:
    """Rules shared by the plain stretches: swap limits, flat range, unseen."""
    v, a, b = as_col(value), as_col(lo), as_col(hi)
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(is_seen(v), F.when(low == high, F.lit(0.5)).otherwise(body(v, low, high)))


def scale_linear(value, lo, hi) -> Column:
    return _framed(
        value, lo, hi,
        lambda v, a, b: F.when(v <= a, F.lit(0.0)).when(v >= b, F.lit(1.0)).otherwise((v - a) / (b - a)),
    )


def scale_log(value, lo, hi, negative: str = "unseen") -> Column:
    floor = F.lit(0.0) if negative == "zero" else F.lit(None).cast("double")
    return _framed(
        value, lo, hi,
        lambda v, a, b: F.when(v <= 0, floor)
        .when(v < a, F.lit(0.0))
        .when(v >= b, F.lit(1.0))
        .otherwise(clamp01(ieee_div(ieee_ln(v) - ieee_ln(a), ieee_ln(b) - ieee_ln(a)))),
    )


def scale_asinh(value, lo, hi, scale: float) -> Column:
    def body(v, a, b):
        f = lambda x: odd_asinh(x / F.lit(scale))
        return clamp01(ieee_div(f(v) - f(a), f(b) - f(a)))

    return _framed(value, lo, hi, body)


def _two_sided_log(v: Column, top: Column, thresh: float) -> Column:
    lin = F.lit(thresh)
    num = lin + ieee_ln(F.abs(v) - lin)
    den = lin + ieee_ln(top - lin)
    outer = clamp01(F.lit(0.5) + F.signum(v) * 0.5 * ieee_div(num, den))
    return F.when(F.abs(v) < lin, clamp01(F.lit(0.5) + v / lin * 0.5)).otherwise(outer)


def scale_symlog(value, lo, hi, thresh: float) -> Column:
    return _framed(value, lo, hi, lambda v, a, b: _two_sided_log(v, F.abs(b), thresh))


def scale_plancklog(value, lo, hi, thresh: float) -> Column:
    return _framed(value, lo, hi, lambda v, a, b: _two_sided_log(v, b, thresh))


# ------------------------------------------------------------- normalised forms


def scale_linear_norm(value, lo, hi) -> Column:
    v, a, b = as_col(value), as_col(lo), as_col(hi)
    return F.when(
        is_seen(v),
        F.when(b <= a, F.lit(0.5))
        .when(v <= a, F.lit(0.0))
        .when(v >= b, F.lit(1.0))
        .otherwise((v - a) / (b - a)),
    )


def scale_log_norm(value, lo, hi) -> Column:
    v, a, b = as_col(value), as_col(lo), as_col(hi)
    span = ieee_ln(b) - ieee_ln(a)
    return F.when(
        is_seen(v) & (v > 0),
        F.when(span <= 0, F.lit(0.5)).otherwise(clamp01(ieee_div(ieee_ln(v) - ieee_ln(a), span))),
    )


def _normed(value, lo, hi, f) -> Column:
    v, a, b = as_col(value), as_col(lo), as_col(hi)
    span = f(b) - f(a)
    return F.when(
        is_seen(v),
        clamp01((f(v) - f(a)) / F.when(F.abs(span) > 1e-10, span).otherwise(F.lit(1.0))),
    )


def symlog_term(x: Column, thresh: float) -> Column:
    """x/L inside the threshold, sign * ln(|x|/L) outside."""
    ratio = x / F.lit(thresh)
    return F.when(F.abs(ratio) < 1.0, ratio).otherwise(F.signum(x) * F.ln(F.abs(ratio)))


def plancklog_term(x: Column, thresh: float) -> Column:
    """x/L inside the threshold, sign * (1 + ln(|x|/L)) outside."""
    ratio = x / F.lit(thresh)
    return F.when(F.abs(ratio) < 1.0, ratio).otherwise(F.signum(x) * (F.ln(F.abs(ratio)) + 1.0))


def scale_symlog_norm(value, lo, hi, thresh: float) -> Column:
    return _normed(value, lo, hi, lambda x: symlog_term(x, thresh))


def scale_plancklog_norm(value, lo, hi, thresh: float) -> Column:
    return _normed(value, lo, hi, lambda x: plancklog_term(x, thresh))


def scale_asinh_norm(value, lo, hi, scale: float) -> Column:
    return _normed(value, lo, hi, lambda x: odd_asinh(x / F.lit(scale)))


# -------------------------------------------------------------------- histogram


def with_knot_position(
    df: DataFrame, value: str = "value", xs: str = "xs", out: str = "at", bins: int = KNOTS
) -> DataFrame:
    """Add the number of knots at or below a value; more than ``bins`` knots fail the job."""
    return with_count_below(df, xs, value, bins, out)


def knot_share(value, xs, ps, at) -> Column:
    """Cumulative share of a value by linear interpolation between its knots.

    ``at`` comes from ``with_knot_position``. Among equal knots the last one counts.
    """
    v, x, p, k = as_col(value), as_col(xs), as_col(ps), as_col(at)
    x0, x1 = F.get(x, k - 1), F.get(x, k)
    p0, p1 = F.get(p, k - 1), F.get(p, k)
    return (
        F.when(k == 0, F.lit(0.0))
        .when(x0 == v, p0)
        .when(k >= F.size(x), F.lit(1.0))
        .otherwise(clamp01(p0 + (v - x0) / (x1 - x0) * (p1 - p0)))
    )


def scale_histogram(value, xs, ps, at, lo, hi) -> Column:
    """Equi-depth stretch: 0 and 1 at the limits, the cumulative share between."""
    v = as_col(value)
    return F.when(
        is_seen(v),
        F.when(v <= as_col(lo), F.lit(0.0))
        .when(v >= as_col(hi), F.lit(1.0))
        .otherwise(knot_share(v, xs, ps, at)),
    )


# --------------------------------------------------------------------- inverses


def scale_inverse(tcol, lo, hi, scale: Scale) -> Column:
    """t -> value for the linear, log and asinh stretches."""
    x, a, b = as_col(tcol), as_col(lo), as_col(hi)
    if scale.kind == "linear":
        return a + x * (b - a)
    if scale.kind == "log":
        return F.exp(ieee_ln(a) + x * (ieee_ln(b) - ieee_ln(a)))
    if scale.kind == "asinh":
        s = F.lit(scale.param)
        fa, fb = odd_asinh(a / s), odd_asinh(b / s)
        return F.sinh(fa + x * (fb - fa)) * s
    raise ValueError(f"no inverse for {scale.kind}")


def value_to_t(value, lo, hi, scale: Scale) -> Column:
    """Unclamped forward stretch; asinh ignores the lower limit."""
    v, a, b = as_col(value), as_col(lo), as_col(hi)
    if scale.kind == "linear":
        return ieee_div(v - a, b - a)
    if scale.kind == "log":
        ok = (v > 0) & (a > 0)
        return F.when(ok, ieee_div(ieee_ln(v) - ieee_ln(a), ieee_ln(b) - ieee_ln(a)))
    if scale.kind == "asinh":
        return ieee_div(odd_asinh(v / F.lit(scale.param)), odd_asinh(b / F.lit(scale.param)))
    if scale.kind == "symlog":
        f = lambda x: symlog_term(x, scale.param)
    elif scale.kind == "plancklog":
        f = lambda x: plancklog_term(x, scale.param)
    else:
        raise ValueError(f"no closed form for {scale.kind}")
    return ieee_div(f(v) - f(a), f(b) - f(a))


def with_raster_stretch(df: DataFrame, scale: Scale, out: str = "t") -> DataFrame:
    """Add the stretch a raster applies: ``*_norm``, or the histogram stretch.

    Reads value, minv, maxv and, for the histogram, the knot arrays xs and ps.
    """
    v, lo, hi = "value", "minv", "maxv"
    if scale.kind == "linear":
        t = scale_linear_norm(v, lo, hi)
    elif scale.kind == "log":
        t = scale_log_norm(v, lo, hi)
    elif scale.kind == "asinh":
        t = scale_asinh_norm(v, lo, hi, scale.param)
    elif scale.kind == "symlog":
        t = scale_symlog_norm(v, lo, hi, scale.param)
    elif scale.kind == "plancklog":
        t = scale_plancklog_norm(v, lo, hi, scale.param)
    else:
        df = with_knot_position(df, bins=scale.bins)
        return df.withColumn(out, scale_histogram(v, "xs", "ps", "at", lo, hi)).drop("at")
    return df.withColumn(out, t)


# ---------------------------------------------------------------- class, colour


def classify(tcol) -> Column:
    """'Bad', 'Underflow', 'Overflow' or 'Color'."""
    x = as_col(tcol)
    return (
        F.when(x.isNull(), F.lit("Bad"))
        .when(F.isnan(x), F.lit("Color"))
        .when(x <= 0, F.lit("Underflow"))
        .when(x >= 1, F.lit("Overflow"))
        .otherwise(F.lit("Color"))
    )


def gamma(tcol, g: float) -> Column:
    """t to the power of g; 0.333 to three digits stands for the cube root."""
    if g <= 0:
        raise ValueError("gamma must be > 0")
    return F.pow(as_col(tcol), F.lit(1.0 / 3.0 if round(g, 3) == 0.333 else float(g)))


def cmap_index(tcol) -> Column:
    """Colour table row 0..255: truncated 255 t; NaN takes row 0."""
    x = as_col(tcol)
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(
        F.floor(F.nanvl(clamp01(x), F.lit(0.0)) * 255.0).cast("int")
    )
