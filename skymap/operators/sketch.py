"""Quantiles of maps from mergeable sketches: made once per map and file, merged without pixels.

A sketch keeps a weighted sample of a few thousand values whatever the size of the map, beside the
exact count and extremes. Sketches of parts of a map, of files, of days merge to the sketch of all of
them, so limits follow new files without a second look at the old ones. A quantile read from one
stands within ``rank_error`` of its share, with a probability of 99 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymap.operators.limits import HIGH, LOW

SIZE = 4096
KEPT = ("n", "minv", "maxv", "sketch")


def rank_error(size: int = SIZE) -> float:
    """Published bound of the sketch: how far a quantile's share may be off, at 99 %."""
    return 2.296 / size**0.9021


def sketch_maps(pixels: DataFrame, keys: tuple[str, ...] = ("map_id",), size: int = SIZE) -> DataFrame:
    """(keys, n, minv, maxv, sketch) of the seen values. A map without any keeps a row, with n = 0 and
    no sketch. Tasks sketch what they read; only sketches are shuffled."""
    value = F.col("value").cast("double")
    return pixels.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min(value).alias("minv"), F.max(value).alias("maxv"),
        F.when(F.count("value") > 0, F.kll_sketch_agg_double(value, size)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: tuple[str, ...] = ("map_id",), size: int = SIZE) -> DataFrame:
    """Sketches of parts to one for each key."""
    return sketches.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("minv").alias("minv"), F.max("maxv").alias("maxv"),
        F.when(F.sum("n") > 0, F.kll_merge_agg_double("sketch", size)).alias("sketch"),
    )


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Add a column for each share (0..1); the ends are the exact extremes. NULL without values."""
    for name, q in shares.items():
        if not 0.0 <= q <= 1.0:
            raise ValueError("a share lies in 0..1")
        found = F.col("minv") if q == 0 else F.col("maxv") if q == 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(q))
        sketches = sketches.withColumn(name, F.when(F.col("n") > 0, found))
    return sketches


def sketch_limits(sketches: DataFrame, kind: str = "linear") -> DataFrame:
    """(map_id, minv, maxv, status) as ``auto_limits`` gives them, p5 and p95 within the rank error;
    the histogram stretch takes the exact extremes."""
    low, high = (0.0, 1.0) if kind == "histogram" else (LOW, HIGH)
    found = quantiles(sketches, {"__lo": low, "__hi": high})
    status = F.when(F.col("n") > 0, F.lit("ok")).otherwise(F.lit("empty"))
    return found.select("map_id", F.col("__lo").alias("minv"), F.col("__hi").alias("maxv"), status.alias("status"))
