"""Lower resolution: five sampling policies as grouped means over parent pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.pixels import (
    NESTED,
    TWO_PI,
    idiv,
    nest_parent,
    npix_of,
    require_power_of_two,
    with_ang2pix,
    with_pix2ang,
    with_pix_of_xyf,
    with_xyf,
)

ANGULAR_BELOW = 256
# Resolution above which ``auto_degrade`` acts, where the caller gives no other.
AUTO_ABOVE = 1024
GNOMONIC_WIDTH = 32768


def _check_ratio(source: int, target: int) -> int:
    if source % target:
        raise ValueError(f"nside {source} is no multiple of {target}")
    return source // target


def _levels(fact: int) -> int | None:
    return fact.bit_length() - 1 if fact & (fact - 1) == 0 else None


def _by_parent(df: DataFrame, source: int, target: int, ordering: str, keep: str) -> DataFrame:
    """Mean of the kept children of each parent; NULL when none is seen.

    ``keep``: 'all', 'rows' (every 2nd row) or 'checker' (every 2nd row and
    column). NESTED parents are a bit shift, and row/column parity is the lowest
    bit pair, so nothing is decoded. RING children are grouped on the face cell;
    the parent's RING index is computed once per parent, after the aggregation.
    The partial aggregate combines siblings before the shuffle.
    """
    fact = _check_ratio(source, target)
    levels = _levels(fact)
    if ordering == NESTED and levels is not None:
        require_power_of_two(source)
        if keep != "all" and fact > 1:
            bits = 3 if keep == "checker" else 2
            df = df.filter(F.col("pix").bitwiseAND(F.lit(bits).cast("long")) == 0)
        parent = nest_parent("pix", levels).alias("pix")
        return df.groupBy("map_id", parent).agg(F.avg("value").alias("value"))
    cells = with_xyf(df.select("map_id", "pix", "value"), source, ordering, out=("__x", "__y", "__f"))
    k = F.lit(fact).cast("long")
    x, y = F.col("__x"), F.col("__y")
    if levels is not None:
        px, py = F.shiftright(x, levels), F.shiftright(y, levels)
    else:
        px, py = idiv(x, k), idiv(y, k)
    even_y, even_x = (y - py * k) % 2 == 0, (x - px * k) % 2 == 0
    value = F.col("value")
    if keep == "rows":
        value = F.when(even_y, value)
    elif keep == "checker":
        value = F.when(even_y & even_x, value)
    cell = (F.col("__f") * target + py) * target + px
    means = cells.groupBy("map_id", cell.alias("__cell")).agg(F.avg(value).alias("value"))
    side = F.lit(target).cast("long")
    parents = means.withColumns(
        {
            "__x": F.col("__cell") % side,
            "__y": idiv(F.col("__cell"), side) % side,
            "__f": idiv(F.col("__cell"), side * side),
        }
    )
    out = with_pix_of_xyf(parents, target, ordering, "__x", "__y", "__f", "pix")
    return out.select("map_id", "pix", "value")


def degrade_best(df: DataFrame, source: int, target: int, ordering: str) -> DataFrame:
    """Mean over all seen children; unchanged when the target is not coarser."""
    if source <= target:
        return df.select("map_id", "pix", "value")
    return _by_parent(df, source, target, ordering, "all")


def degrade_balanced(df: DataFrame, source: int, target: int, ordering: str) -> DataFrame:
    """Mean over every second row of children."""
    return _by_parent(df, source, target, ordering, "rows")


def degrade_fast(df: DataFrame, source: int, target: int, ordering: str) -> DataFrame:
    """Mean over every second row and column of children."""
    return _by_parent(df, source, target, ordering, "checker")


def angular_samples(spark: SparkSession, source: int, target: int, ordering: str) -> DataFrame:
    """(target_pix, pix, weight): source pixels hit by each target's sample grid.

    Depends on the geometry alone, so one table serves all maps. A source pixel
    hit several times counts several times.
    """
    n = min(source // target, 4)
    centres = with_pix2ang(
        spark.range(npix_of(target)).select(F.col("id").alias("target_pix")),
        target, ordering, "target_pix", ("__t", "__p"),
    )
    offsets = [(i + 0.5) / n - 0.5 for i in range(n)]
    grid = F.array(*[F.struct(F.lit(a).alias("dt"), F.lit(b).alias("dp")) for a in offsets for b in offsets])
    width_t, width_p = math.pi / (2.0 * target), TWO_PI / target
    points = centres.withColumn("__o", F.explode(grid)).select(
        "target_pix",
        F.greatest(
            F.lit(0.0), F.least(F.lit(math.pi), F.col("__t") + F.col("__o.dt") * F.lit(width_t))
        ).alias("__t"),
        F.pmod(F.col("__p") + F.col("__o.dp") * F.lit(width_p), F.lit(TWO_PI)).alias("__p"),
    )
    hits = with_ang2pix(points, source, ordering, "__t", "__p", "pix")
    return hits.groupBy("target_pix", "pix").agg(F.count(F.lit(1)).alias("weight"))


def degrade_ang(df: DataFrame, source: int, target: int, ordering: str) -> DataFrame:
    """Mean over an n x n grid of directions inside each target pixel (n <= 4).

    The sample table has at most 16 * 12 * target^2 rows. For the targets this
    policy is meant for (< 256) that is 12.6 M at most before merging equal hits;
    up to 128 (3.1 M) it is broadcast and the map is read without a shuffle, above
    that the join is left to the optimizer.
    """
    if source <= target:
        return df.select("map_id", "pix", "value")
    samples = angular_samples(df.sparkSession, source, target, ordering)
    if 16 * npix_of(target) <= 4_000_000:
        samples = F.broadcast(samples)
    seen = df.filter(F.col("value").isNotNull())
    joined = seen.join(samples, "pix")
    mean = F.sum(F.col("value") * F.col("weight")) / F.sum("weight")
    return joined.groupBy("map_id", F.col("target_pix").alias("pix")).agg(mean.alias("value"))


def degrade_two_phase(df: DataFrame, source: int, target: int, ordering: str) -> DataFrame:
    """Full mean to half resolution, then the checkerboard; for ratios of 8 and more."""
    if _check_ratio(source, target) < 8:
        raise ValueError("two phases need a ratio of at least 8")
    middle = source // 2
    return degrade_fast(degrade_best(df, source, middle, ordering), middle, target, ordering)


def degrade_by_size(df: DataFrame, source: int, target: int, ordering: str) -> DataFrame:
    """Angular sampling for targets below nside 256, full means from there on."""
    f = degrade_ang if target < ANGULAR_BELOW else degrade_best
    return f(df, source, target, ordering)


POLICIES = {
    "angular": degrade_ang,
    "balanced": degrade_balanced,
    "best": degrade_best,
    "by_size": degrade_by_size,
    "fast": degrade_fast,
    "two_phase": degrade_two_phase,
}


def degrade(df: DataFrame, source: int, target: int, ordering: str, policy: str = "best") -> DataFrame:
    """Lower the resolution by a named policy; the full mean when none is named."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    return POLICIES[policy](df, source, target, ordering)


def target_nside(width: int, height: int) -> int:
    """Largest 2^k not above the rounded geometric mean of the raster sides."""
    goal = int(math.floor(math.sqrt(float(width * height)) + 0.5))
    return 1 << max(0, goal.bit_length() - 1)


def auto_target(
    nside: int, width: int, enabled: bool = True, threshold: int = AUTO_ABOVE
) -> int:
    """Resolution a map is lowered to before drawing; ``nside`` itself if kept."""
    if not enabled or nside <= threshold:
        return nside
    return min(nside, target_nside(width, width // 2))


def auto_degrade(
    df: DataFrame,
    nside: int,
    ordering: str,
    width: int,
    quality: str = "best",
    enabled: bool = True,
    threshold: int = AUTO_ABOVE,
) -> tuple[DataFrame, int]:
    """Lower the resolution to what a raster needs; returns pixels and nside.

    Planned on the driver from metadata alone. ``quality`` names a policy; an unknown
    one means 'best'.
    """
    target = auto_target(nside, width, enabled, threshold)
    if target >= nside:
        return df.select("map_id", "pix", "value"), nside
    return degrade(df, nside, target, ordering, quality if quality in POLICIES else "best"), target
