"""Equi-depth histograms: knots, cumulative shares, quantiles, distortion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skymap.functions.pixels import idiv
from skymap.functions.search import with_count_below
from skymap.functions.stretch import KNOTS, scale_histogram, with_knot_position
from skymap.operators.asof import asof_join
from skymap.operators.order import exact_quantiles, ranked_values
from skymap.plans.sizing import small_side


@dataclass(frozen=True)
class HistogramRange:
    """Limits of a histogram: ``full``, ``explicit`` (values) or ``percentile`` (shares)."""

    kind: str = "full"
    low: float | None = None
    high: float | None = None


def hist_range(
    df: DataFrame, rng: HistogramRange, rows_per_key: int, buckets: int | None = None
) -> DataFrame:
    """(map_id, minv, maxv) of the seen values of each map."""
    if rng.kind == "explicit":
        return df.groupBy("map_id").agg(
            F.lit(float(rng.low)).alias("minv"), F.lit(float(rng.high)).alias("maxv")
        )
    if rng.kind == "full":
        return df.groupBy("map_id").agg(F.min("value").alias("minv"), F.max("value").alias("maxv"))
    return exact_quantiles(
        df, {"minv": rng.low, "maxv": rng.high}, rows_per_key, method="nearest", buckets=buckets
    ).drop("n")


def hist_knots(
    df: DataFrame,
    rows_per_key: int,
    bins: int = KNOTS,
    limits: DataFrame | None = None,
    n_maps: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Knots (map_id, k, value, cdf) of the seen values, inside ``limits`` if given.

    Sorted values are split into chunks of ceil(n / bins); the middle element of
    chunk k is its knot, with share k * step / (n - 1). Which distinct value sits
    in the middle follows from its rank range by arithmetic alone.
    """
    if limits is not None:
        df = df.join(small_side(limits.select("map_id", "minv", "maxv"), n_maps), "map_id").filter(
            F.col("value").between(F.col("minv"), F.col("maxv"))
        )
    ranked = ranked_values(df, rows_per_key, buckets=buckets)
    n, lo = F.col("n"), F.col("lo")
    hi = lo + F.col("cnt") - 1
    step, last = F.col("step"), F.col("last")
    half = idiv(step, F.lit(2).cast("long"))
    first_k = F.greatest(F.lit(0).cast("long"), idiv(lo - half + step - 1, step))
    last_k = F.least(last - 1, idiv(hi - half, step))
    mid_last = last * step + idiv(n - last * step, F.lit(2).cast("long"))
    nothing = F.array().cast("array<bigint>")
    sized = ranked.withColumn("step", idiv(n + (bins - 1), F.lit(bins).cast("long"))).withColumn(
        "last", idiv(n - 1, step)
    )
    ks = F.concat(
        F.when((hi >= half) & (first_k <= last_k), F.sequence(first_k, F.greatest(first_k, last_k))).otherwise(nothing),
        F.when(mid_last.between(lo, hi), F.array(last)).otherwise(nothing),
    )
    share = F.when(n == 1, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.col("k") * step / F.greatest(n - 1, F.lit(1)))
    )
    return sized.withColumn("k", F.explode(ks)).select("map_id", "k", "value", share.alias("cdf"))


def knot_arrays(knots: DataFrame) -> DataFrame:
    """One row per map with ``xs`` and ``ps`` arrays (at most ``bins`` long)."""
    packed = knots.groupBy("map_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "value", "cdf"))).alias("kn")
    )
    return packed.select("map_id", F.col("kn.value").alias("xs"), F.col("kn.cdf").alias("ps"))


def with_knots(
    df: DataFrame, arrays: DataFrame, n_maps: int | None = None, bins: int = KNOTS
) -> DataFrame:
    """Attach the knot arrays of each row's map.

    Broadcast while maps x knots fits; otherwise a join on map_id, where adaptive
    execution splits a large map.
    """
    limit = 4_000_000 // bins
    return df.join(small_side(arrays, n_maps, limit), "map_id", "left")


def stretch_by_histogram(
    df: DataFrame, arrays: DataFrame, limits: DataFrame, n_maps: int | None = None, bins: int = KNOTS
) -> DataFrame:
    """Add ``t``: each value located between the knots of its map."""
    bounds = limits.select("map_id", "minv", "maxv")
    joined = with_knots(df, arrays.join(bounds, "map_id"), n_maps, bins)
    t = scale_histogram("value", "xs", "ps", "at", "minv", "maxv")
    return with_knot_position(joined, bins=bins).withColumn("t", t).drop("at", "xs", "ps", "minv", "maxv")


def share_by_asof(df: DataFrame, knots: DataFrame, out: str = "share") -> DataFrame:
    """Add the cumulative share of each value from knot rows (map_id, k, value, cdf), for any number of
    maps and knots: no arrays travel and no map is gathered in one task. As ``knot_share``."""
    ahead = W.partitionBy("map_id").orderBy("k")
    pairs = knots.select(
        "map_id", "k", "value", "cdf", F.lead("value").over(ahead).alias("x1"), F.lead("cdf").over(ahead).alias("p1")
    )
    met = asof_join(df, pairs, "map_id", "value", "k", "__at")
    v, x0, p0, x1, p1 = F.col("value"), *(F.col(f"__at.{c}") for c in ("value", "cdf", "x1", "p1"))
    between = p0 + (v - x0) / (x1 - x0) * (p1 - p0)
    share = (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(x0.isNull(), F.lit(0.0))
        .when(x0 == v, p0)
        .when(x1.isNull(), F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), between)))
    )
    return met.withColumn(out, share).drop("__at")


# ------------------------------------------------------------ lookups in knots


def with_cdf_step(df: DataFrame, value: str = "value", out: str = "share", bins: int = KNOTS) -> DataFrame:
    """Step share: exact hit, else the next knot; 0 below all, 1 above all.

    Reads the arrays ``xs`` and ``ps`` of the row.
    """
    x, p, at = F.col("xs"), F.col("ps"), F.col("__at")
    share = (
        F.when(F.size(x) == 0, F.lit(None).cast("double"))
        .when(at == 0, F.lit(0.0))
        .when(F.get(x, at - 1) == F.col(value), F.get(p, at - 1))
        .when(at >= F.size(x), F.lit(1.0))
        .otherwise(F.get(p, at))
    )
    return with_count_below(df, "xs", value, bins, "__at").withColumn(out, share).drop("__at")


def with_cdf_inverse(df: DataFrame, q: str = "q", out: str = "value", bins: int = KNOTS) -> DataFrame:
    """Value at a share: exact hit, else the next knot; clamped at the ends."""
    x, p, at = F.col("xs"), F.col("ps"), F.col("__at")
    value = (
        F.when(F.size(x) == 0, F.lit(None).cast("double"))
        .when(at == 0, F.get(x, F.lit(0)))
        .when(F.get(p, at - 1) == F.col(q), F.get(x, at - 1))
        .when(at >= F.size(x), F.get(x, F.size(x) - 1))
        .otherwise(F.get(x, at))
    )
    return with_count_below(df, "ps", q, bins, "__at").withColumn(out, value).drop("__at")


def with_value_at_quantile(df: DataFrame, q: str = "q", out: str = "value", bins: int = KNOTS) -> DataFrame:
    """Value at a share with linear interpolation; limits at the ends; 0 if empty."""
    x, p, at, s = F.col("xs"), F.col("ps"), F.col("__at"), F.col(q)
    p0, p1 = F.get(p, at - 1), F.get(p, at)
    x0, x1 = F.get(x, at - 1), F.get(x, at)
    value = (
        F.when(F.size(x) == 0, F.lit(0.0))
        .when(s <= 0, F.col("minv"))
        .when(s >= 1, F.col("maxv"))
        .when(at == 0, F.get(x, F.lit(0)))
        .when(p0 == s, x0)
        .when(at >= F.size(x), F.get(x, F.size(x) - 1))
        .otherwise(x0 + (s - p0) / (p1 - p0) * (x1 - x0))
    )
    return with_count_below(df, "ps", q, bins, "__at").withColumn(out, value).drop("__at")


def quantile_table(hists: DataFrame, count: int, bins: int = KNOTS) -> DataFrame:
    """``count`` uniform quantiles of each map: (map_id, i, q, value)."""
    if count < 2:
        raise ValueError("at least two quantiles")
    grid = hists.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    grid = grid.withColumn("q", F.col("i") / F.lit(float(count - 1)))
    return with_value_at_quantile(grid, bins=bins).select("map_id", "i", "q", "value")


def distortion_profile(hists: DataFrame, count: int, bins: int = KNOTS) -> DataFrame:
    """Slope of the inverse cumulative share at ``count`` points, log-compressed.

    Windows run over ``count`` rows per map.
    """
    points = quantile_table(hists, count, bins)
    by = W.partitionBy("map_id").orderBy("i")
    before, after = F.lag("value").over(by), F.lead("value").over(by)
    dt = 1.0 / (count - 1)
    here = F.col("value")
    slope = (
        F.when(before.isNull(), F.abs(after - here) / dt)
        .when(after.isNull(), F.abs(here - before) / dt)
        .otherwise(F.abs(after - before) / (2.0 * dt))
    )
    logged = points.withColumn("d", F.log1p(slope))
    top = F.max("d").over(W.partitionBy("map_id"))
    return logged.withColumn("__top", top).select(
        "map_id",
        "i",
        F.when(F.col("__top") > 0, F.col("d") / F.col("__top")).otherwise(F.col("d")).alias("distortion"),
    )
