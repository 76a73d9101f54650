"""Stored pixels, clustered so that a piece of sky is a piece of a file.

All maps are numbered NESTED, whatever their ordering, one folder per resolution, sorted by pixel
and map. A region is a short list of pixel ranges (``operators.regions``), pushed to the row
groups' statistics: what lies elsewhere is not read. Maps of any resolution share a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.frames import IDENTITY, Matrix
from skymap.functions.pixels import NESTED, RING, with_ring2nest
from skymap.operators.raster import Projection, sample_index
from skymap.operators.regions import MOST_RANGES, Range, Region, footprint, in_ranges, pixels_in, shortened
from skymap.plans.sizing import small_side

# Bytes of a row group: small enough that a cut-out of a few degrees leaves most of them out.
GROUP_BYTES = 8 << 20
# Sample points are told by at most this many cells (nside 16) when the map is cut by them.
POINT_ORDER = 4


def to_nested(pixels: DataFrame, maps: DataFrame) -> DataFrame:
    """(nside, pix, map_id, value) in NESTED numbers; ``maps`` tells nside and ordering of each map.

    Maps of both orderings and of any resolutions may be mixed. A map that ``maps`` lacks, or with an
    unknown ordering, fails the job.
    """
    known = small_side(maps.select("map_id", F.col("nside").cast("long").alias("nside"), "ordering"))
    rows = pixels.select("map_id", "pix", "value").join(known, "map_id", "left")
    wrong = F.raise_error(F.concat(F.lit("no ordering known for map "), "map_id"))
    rows = rows.withColumn("ordering", F.when(F.col("ordering").isin(RING, NESTED), F.col("ordering")).otherwise(wrong))
    ring = with_ring2nest(rows.filter(F.col("ordering") == RING), "nside", "pix", "pix")
    columns = ["nside", "pix", "map_id", "value"]
    return ring.select(*columns).unionByName(rows.filter(F.col("ordering") == NESTED).select(*columns))


def write_store(pixels: DataFrame, maps: DataFrame, path: str, group_bytes: int = GROUP_BYTES, mode: str = "error") -> None:
    """Store the seen pixels of all maps. One shuffle, dealt by range, so that files follow each other
    on the sky and a hot map is spread over all of them."""
    rows = to_nested(pixels, maps).filter(F.col("value").isNotNull())
    order = ["nside", "pix", "map_id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.partitionBy("nside").option("parquet.block.size", group_bytes).mode(mode).parquet(path)


def read_store(spark: SparkSession, path: str, nside: int) -> DataFrame:
    """(map_id, pix, value) of the maps of one resolution, NESTED."""
    schema = "pix long, map_id string, value double, nside long"
    return spark.read.schema(schema).parquet(path).filter(F.col("nside") == nside).select("map_id", "pix", "value")


def read_region(spark: SparkSession, path: str, nside: int, region: Region, exact: bool = True, most: int = MOST_RANGES) -> DataFrame:
    """Pixels of one resolution in a region; row groups outside its ranges are skipped."""
    return pixels_in(read_store(spark, path, nside), region, nside, exact, most)


def read_footprint(spark: SparkSession, path: str, nside: int, proj: Projection, view: Matrix = IDENTITY) -> DataFrame:
    """Pixels that a raster can hit: all of them for a whole-sky projection."""
    region = footprint(proj, view)
    if region is None:
        return read_store(spark, path, nside)
    return read_region(spark, path, nside, region, exact=False)


def _ranges_of_cells(cells: list[int], shift: int, most: int) -> list[Range]:
    return shortened([(c << shift, (c + 1) << shift) for c in sorted(cells)], most)


def sample_stored(
    points: DataFrame, path: str, nside: int, view: Matrix = IDENTITY, most: int = MOST_RANGES
) -> DataFrame:
    """Add ``pix`` (NESTED) and ``value`` at each direction (map_id, theta, phi) from a store.

    The points' coarse cells, 3072 at most, become the ranges of the scan, so the map is read where
    there are points and only that much of it meets them.
    """
    hit = sample_index(points, nside, NESTED, view)
    shift = max(0, 2 * (nside.bit_length() - 1 - POINT_ORDER))
    found = hit.select(F.shiftright("pix", shift).alias("cell")).distinct().collect()
    ranges = _ranges_of_cells([r.cell for r in found if r.cell is not None], shift, most)
    near = read_store(points.sparkSession, path, nside).filter(in_ranges(F.col("pix"), ranges))
    return hit.join(near, ["map_id", "pix"], "left")
