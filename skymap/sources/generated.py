"""Generated maps and dense forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.pixels import npix_of
from skymap.plans.sizing import spread


def index_map(spark: SparkSession, nside: int, map_id: str = "index") -> DataFrame:
    """A full map whose value is the pixel index."""
    return spark.range(npix_of(nside)).select(
        F.lit(map_id).alias("map_id"),
        F.col("id").alias("pix"),
        F.col("id").cast("double").alias("value"),
    )


def all_pixels(maps: DataFrame, *keep: str) -> DataFrame:
    """(map_id, pix, columns to keep) of every pixel of every map in ``maps`` (map_id, nside).

    Base faces are spread over tasks before their pixels are generated.
    """
    faces = maps.select("map_id", "nside", *keep, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("face"))
    rows = faces.select(
        "map_id",
        "nside",
        *keep,
        F.explode(F.sequence(F.col("face") * F.col("nside"), (F.col("face") + 1) * F.col("nside") - 1)).alias("row"),
    )
    rows = spread(rows, "map_id", "row")
    first = F.col("row") * F.col("nside")
    return rows.select("map_id", F.explode(F.sequence(first, first + F.col("nside") - 1)).alias("pix"), *keep)


def index_maps(maps: DataFrame) -> DataFrame:
    """Full maps of the given sizes (map_id, nside) whose values are the pixel indices."""
    return all_pixels(maps).withColumn("value", F.col("pix").cast("double"))


def densify(pixels: DataFrame, maps: DataFrame) -> DataFrame:
    """Every pixel of every map, NULL where unseen: a left join on (map_id, pix)."""
    return all_pixels(maps).join(pixels.select("map_id", "pix", "value"), ["map_id", "pix"], "left")


def sparse_pixels(rows: DataFrame, npix: int) -> DataFrame:
    """Pixel table of explicit (map_id, row_no, pix, value) rows.

    Indices outside 0..npix-1 are dropped; of repeated ones the last row wins, as
    a combinable aggregate.
    """
    kept = rows.filter(F.col("pix").between(0, npix - 1))
    return kept.groupBy("map_id", "pix").agg(F.max_by("value", "row_no").alias("value"))
