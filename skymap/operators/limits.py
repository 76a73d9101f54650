"""Value limits per map: extremes, percentiles, automatic and field-of-view limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.operators.order import bucket_count, exact_quantiles
from skymap.plans.sizing import small_side

LOW, HIGH = 0.05, 0.95


def map_min_max(df: DataFrame) -> DataFrame:
    """Smallest and largest seen value of each map."""
    return df.groupBy("map_id").agg(F.min("value").alias("minv"), F.max("value").alias("maxv"))


def percentile_exact(
    df: DataFrame, percents: dict[str, float], rows_per_key: int, buckets: int | None = None
) -> DataFrame:
    """Percentiles (0..100) with linear interpolation between ranks."""
    for p in percents.values():
        if not 0.0 <= p <= 100.0:
            raise ValueError("a percentile lies in 0..100")
    qs = {k: p / 100.0 for k, p in percents.items()}
    return exact_quantiles(df, qs, rows_per_key, buckets=buckets).drop("n")


def percentile_sampled(
    df: DataFrame,
    percents: dict[str, float],
    npix: int,
    every: int,
    buckets: int | None = None,
) -> DataFrame:
    """Percentiles of every ``every``-th pixel index, at any size of map.

    A map without a sampled seen value gets 0. Large samples are selected like the
    exact percentiles, not gathered per map.
    """
    if every < 1:
        raise ValueError("every must be at least 1")
    sample = df.filter(F.col("pix") % every == 0)
    found = percentile_exact(sample, percents, -(-npix // every), buckets)
    ids = df.select("map_id").distinct()
    names = [F.coalesce(name, F.lit(0.0)).alias(name) for name in percents]
    return ids.join(found, "map_id", "left").select("map_id", *names)


def _checked(minv: Column, maxv: Column, seen: Column, strict: bool) -> list[Column]:
    """Limits and status: 'ok', 'empty' (no values) or 'swapped'; limits only when ok.

    With ``strict`` a map that is not ok fails the job.
    """
    status = F.when(seen.isNull(), F.lit("empty")).when(minv > maxv, F.lit("swapped")).otherwise(F.lit("ok"))
    if strict:
        text = F.when(status == "empty", F.lit("map contains no valid pixel values")).otherwise(
            F.lit("invalid colour scale: minimum above maximum")
        )
        status = F.when(status == "ok", status).otherwise(F.raise_error(text).cast("string"))
    good = status == "ok"
    return [F.when(good, minv).alias("minv"), F.when(good, maxv).alias("maxv"), status.alias("status")]


def auto_limits(
    df: DataFrame,
    rows_per_key: int,
    kind: str = "linear",
    minv: float | None = None,
    maxv: float | None = None,
    strict_limits: bool = False,
    buckets: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """(map_id, minv, maxv, status): p5/p95, or min/max for the histogram stretch.

    Every map of the input has a row: one without values, or with swapped limits,
    has none and says so in ``status`` (with ``strict`` it fails the job).

    User limits count only when both are given; with ``strict_limits`` a single
    one is honoured. Small maps take one aggregate. Large ones select the two
    percentiles without ordering the map.
    """
    extremes = [F.min("value").alias("__lo"), F.max("value").alias("__hi")]
    user = minv is not None and maxv is not None
    if kind == "histogram" or user:
        found = df.groupBy("map_id").agg(*extremes)
        low, high = F.col("__lo"), F.col("__hi")
    elif (bucket_count(rows_per_key) if buckets is None else buckets) <= 1:
        found = df.groupBy("map_id").agg(
            *extremes, F.percentile("value", F.array(F.lit(LOW), F.lit(HIGH))).alias("__p")
        )
        low, high = F.get("__p", F.lit(0)), F.get("__p", F.lit(1))
    else:
        chosen = exact_quantiles(df, {"__lo": LOW, "__hi": HIGH}, rows_per_key, buckets=buckets)
        found = df.select("map_id").distinct().join(chosen, "map_id", "left")
        low, high = F.col("__lo"), F.col("__hi")
    if user or (strict_limits and minv is not None):
        low = F.lit(float(minv))
    if user or (strict_limits and maxv is not None):
        high = F.lit(float(maxv))
    return found.select("map_id", *_checked(low, high, F.col("__lo"), strict))


def _weighted_limits(
    hits: DataFrame, cells: int, kind: str, minv: float | None, maxv: float | None, buckets: int | None
) -> DataFrame:
    """As ``auto_limits``, each value counted ``hits`` times. A map has at most ``cells`` hits: few are
    counted in one aggregate, many are written out and selected by buckets."""
    user = minv is not None and maxv is not None
    many = (bucket_count(cells) if buckets is None else buckets) > 1
    if kind == "histogram" or user or many:
        each = hits if kind == "histogram" or user else hits.withColumn("hits", F.explode(F.sequence(F.lit(1).cast("long"), F.col("hits"))))
        return auto_limits(each.select("map_id", "value"), cells, kind, minv, maxv, buckets=buckets)
    share = F.percentile("value", F.array(F.lit(LOW), F.lit(HIGH)), F.col("hits"))
    found = hits.groupBy("map_id").agg(F.min("value").alias("__lo"), share.alias("__p"))
    return found.select("map_id", *_checked(F.get("__p", F.lit(0)), F.get("__p", F.lit(1)), F.col("__lo"), False))


def fov_limits(
    df: DataFrame,
    index: DataFrame,
    cells: int,
    rows_per_key: int,
    kind: str = "linear",
    minv: float | None = None,
    maxv: float | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Limits from the values a raster hits, one value per hitting cell.

    ``index`` is a raster index (x, y, pix) of at most ``cells`` rows, so the map
    is cut by it before anything is aggregated. A map without a hit falls back to
    its whole-map limits, and one without any value keeps a row without limits.
    An ``index`` of (pix, hits), as of ``raster.unit_hits``, weighs each value by its hits.
    """
    seen = df.filter(F.col("value").isNotNull())
    if "hits" in index.columns:
        hits = seen.join(small_side(index.select("pix", "hits"), cells), "pix").select("map_id", "value", "hits")
        inside = _weighted_limits(hits, cells, kind, minv, maxv, buckets)
    else:
        hits = seen.join(small_side(index.select("pix"), cells), "pix").select("map_id", "value")
        inside = auto_limits(hits, cells, kind, minv, maxv, buckets=buckets)
    missed = df.join(small_side(hits.select("map_id").distinct()), "map_id", "left_anti")
    return inside.unionByName(auto_limits(missed, rows_per_key, kind, minv, maxv, buckets=buckets))


