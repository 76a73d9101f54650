"""Reports: diagnostics, coverage, comparison of maps and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymap.functions.values import SEEN_ABOVE, UNSEEN

FIRST = 5


def map_diagnostics(raw: DataFrame) -> DataFrame:
    """Counts of finite, above-threshold, infinite and NaN values; extremes; first five.

    Works on raw values. Extremes skip NaN. The first five are those of pixels
    0..4, so no ordering is needed.
    """
    v = F.col("value").cast("double")
    nan, inf = F.isnan(v), F.abs(v) == F.lit(float("inf"))
    number = F.when(~nan, v)
    first = [F.max(F.when(F.col("pix") == i, v)) for i in range(FIRST)]
    return raw.groupBy("map_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v.isNotNull() & ~nan & ~inf).alias("finite"),
        F.count_if(~nan & (v > F.lit(SEEN_ABOVE))).alias("above"),
        F.count_if(inf).alias("infinite"),
        F.count_if(nan).alias("nan"),
        F.min(number).alias("minv"),
        F.max(number).alias("maxv"),
        F.array(*first).alias("first_values"),
    )


def map_coverage(df: DataFrame, npix: int) -> DataFrame:
    """Seen pixels and their share of the full map."""
    seen = F.count("value")
    return df.groupBy("map_id").agg(
        F.lit(npix).cast("long").alias("total"),
        seen.alias("valid"),
        (seen * 100.0 / F.lit(npix)).alias("valid_pct"),
    )


def map_compare(a: DataFrame, b: DataFrame, npix: int, tolerance: float = 1e-6) -> DataFrame:
    """Mismatches, RMSE over all npix pixels and unseen counts of two pixel tables.

    Pixels are paired on (map_id, pix); one that a side lacks is unseen there and
    counts with the sentinel value, as in a dense map.
    """
    right = b.select("map_id", "pix", F.col("value").alias("__b"))
    both = a.select("map_id", "pix", F.col("value").alias("__a")).join(
        right, ["map_id", "pix"], "full_outer"
    )
    gone = F.lit(UNSEEN)
    d = F.coalesce("__a", gone) - F.coalesce("__b", gone)
    off = F.abs(d) > tolerance
    return both.groupBy("map_id").agg(
        F.count_if(off).alias("mismatches"),
        F.sqrt(F.sum(F.when(off, d * d).otherwise(F.lit(0.0))) / F.lit(npix)).alias("rmse"),
        (F.lit(npix) - F.count("__a")).alias("unseen_a"),
        (F.lit(npix) - F.count("__b")).alias("unseen_b"),
    )


def raster_compare(a: DataFrame, b: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Largest and mean channel difference and cells above a threshold, per map.

    Rasters hold (map_id, x, y, r, g, b) of the same size.
    """
    keys = ["map_id", "x", "y"]
    right = b.select(*keys, *[F.col(c).alias("__" + c) for c in "rgb"])
    diffs = [F.abs(F.col(c).cast("double") - F.col("__" + c).cast("double")) for c in "rgb"]
    rows = a.join(right, keys).select("map_id", *[d.alias("d" + c) for d, c in zip(diffs, "rgb")])
    worst = F.greatest("dr", "dg", "db")
    n = F.count(F.lit(1))
    return rows.groupBy("map_id").agg(
        F.max(worst).alias("max_diff"),
        (F.sum(F.col("dr") + F.col("dg") + F.col("db")) / (n * 3)).alias("mean_diff"),
        F.count_if(worst > threshold).alias("differing"),
        (F.count_if(worst > threshold) * 100.0 / n).alias("differing_pct"),
    )
