"""Rasters: cells, cell-to-pixel index, sampling, reprojection, layers, tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions import projections as P
from skymap.functions.frames import IDENTITY, Matrix, rotate_inverse, sph_to_vec, vec_to_sph
from skymap.functions.pixels import TWO_PI, with_ang2pix
from skymap.functions.staging import as_col
from skymap.functions.stretch import Scale, classify, cmap_index, gamma, with_raster_stretch
from skymap.operators.histogram import with_knots
from skymap.operators.bitmap import in_set
from skymap.operators.masks import one_mask
from skymap.plans.sizing import BROADCAST_ROWS, materialize, small_side, spread

RGBA = tuple[int, int, int, int]
GRAY: RGBA = (128, 128, 128, 255)
# Cells a task makes of a raster.
CELLS_PER_TASK = 1 << 20


@dataclass(frozen=True)
class Projection:
    """A raster geometry. ``res``/``lon``/``lat``/``roll`` serve the gnomonic one
    (arc minutes, degrees, degrees, radians)."""

    kind: str
    width: int
    height: int
    res: float = 1.0
    lon: float = 0.0
    lat: float = 0.0
    roll: float = 0.0

    def inside(self, x, y) -> Column | None:
        """Cheap test that drops cells outside before any trigonometry."""
        if self.kind == P.GNOMONIC:
            return None
        if self.kind == P.MOLLWEIDE:
            return P.mollweide_cell_inside(x, y, self.width, self.height)
        u, v = P.cell_uv(x, y, self.width, self.height)
        a, b = F.lit(1.0) - u * 2.0, F.lit(1.0) - v * 2.0
        return a * a + b * b <= 1.0

    def cell(self, x, y) -> tuple[Column, Column]:
        """(lon, lat) of a cell."""
        if self.kind == P.MOLLWEIDE:
            return P.mollweide_cell(x, y, self.width, self.height)
        if self.kind == P.HAMMER:
            return P.hammer_cell(x, y, self.width, self.height)
        if self.kind == P.GNOMONIC:
            return P.gnomonic_cell(x, y, self.width, self.res, self.lon, self.lat, self.roll)
        raise ValueError(f"unknown projection {self.kind!r}")

    def with_forward(self, df: DataFrame, lon: str, lat: str, out=("u", "v")) -> DataFrame:
        """Add the (u, v) of a sky point."""
        if self.kind == P.MOLLWEIDE:
            return P.with_mollweide_forward(df, lon, lat, out)
        f = P.hammer_forward if self.kind == P.HAMMER else P.gnomonic_forward
        return df.withColumns(dict(zip(out, f(lon, lat))))


# --------------------------------------------------------------------- sampling


def with_map_angles(
    df: DataFrame, view: Matrix = IDENTITY, theta="theta", phi="phi", out=("theta_m", "phi_m")
) -> DataFrame:
    """Directions of the view brought back into map coordinates (NULL if not finite)."""
    th, ph = as_col(theta), as_col(phi)
    inf = F.lit(float("inf"))
    finite = ~F.isnan(th) & ~F.isnan(ph) & (F.abs(th) < inf) & (F.abs(ph) < inf)
    th, ph = F.when(finite, th), F.when(finite, ph)
    vx, vy, vz = sph_to_vec(th, ph)
    df = df.withColumns({"__vx": vx, "__vy": vy, "__vz": vz})
    v = rotate_inverse(view, (F.col("__vx"), F.col("__vy"), F.col("__vz")))
    theta_m, phi_m = vec_to_sph(*v)
    return df.withColumns({out[0]: theta_m, out[1]: F.pmod(phi_m, F.lit(TWO_PI))}).drop(
        "__vx", "__vy", "__vz"
    )


def sample_index(
    points: DataFrame, nside, ordering: str, view: Matrix = IDENTITY, theta="theta", phi="phi"
) -> DataFrame:
    """Add ``pix``: the map pixel that each direction of the view falls in."""
    df = with_map_angles(points, view, theta, phi, ("__tm", "__pm"))
    return with_ang2pix(df, nside, ordering, "__tm", "__pm", "pix").drop("__tm", "__pm")


def sample_points(
    points: DataFrame, pixels: DataFrame, nside, ordering: str, view: Matrix = IDENTITY
) -> DataFrame:
    """Add ``pix`` and ``value`` at each direction: an equi left join on (map_id, pix).

    ``points`` carry map_id. The pixel side has one row per key, so a direction
    that a third of the points share is split by adaptive skew handling.
    """
    hit = sample_index(points, nside, ordering, view)
    return hit.join(pixels.select("map_id", "pix", "value"), ["map_id", "pix"], "left")


# ------------------------------------------------------------------------ cells


def raster_cells(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All cells (x, y) with their (u, v)."""
    tasks = max(spark.sparkContext.defaultParallelism, width * height // CELLS_PER_TASK)
    cells = spark.range(0, width * height, 1, tasks).select(
        (F.col("id") % width).cast("int").alias("x"),
        F.floor(F.col("id") / F.lit(float(width))).cast("int").alias("y"),
    )
    u, v = P.cell_uv("x", "y", width, height)
    return cells.withColumns({"u": u, "v": v})


def raster_index(
    spark: SparkSession, proj: Projection, nside: int, ordering: str, view: Matrix = IDENTITY
) -> DataFrame:
    """(x, y, pix) of the valid cells of a geometry; serves every map that shares it."""
    cells = raster_cells(spark, proj.width, proj.height).select("x", "y")
    inside = proj.inside("x", "y")
    if inside is not None:
        cells = cells.filter(inside)
    lon, lat = proj.cell("x", "y")
    angles = cells.withColumns({"__lon": lon, "__lat": lat}).withColumn(
        "__th", F.lit(math.pi / 2.0) - F.col("__lat")
    )
    return sample_index(angles, nside, ordering, view, "__th", "__lon").select("x", "y", "pix")


def cells_of_maps(maps: DataFrame, width: int, height: int) -> DataFrame:
    """(map_id, x, y) for every map. Rows are spread before they are multiplied by x."""
    rows = maps.select("map_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return spread(rows, "map_id", "y").select("map_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "y")


def cells_of_rasters(rasters: DataFrame) -> DataFrame:
    """(map_id, x, y, u, v) of every cell of rasters of their own sizes (map_id, width, height)."""
    rows = rasters.select("map_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = spread(rows, "map_id", "y")
    cells = rows.select("map_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y", "width", "height")
    u, v = F.col("x") / (F.col("width") - 1.0), F.col("y") / (F.col("height") - 1.0)
    return cells.select("map_id", "x", "y", u.alias("u"), v.alias("v"))


def index_of_maps(maps: DataFrame, index: DataFrame, proj: Projection, n_maps: int | None = None) -> DataFrame:
    """(map_id, x, y, pix): the raster index for every map; its size is that of the raster.

    The smaller of both goes to every task. Cells of maps are multiplied after their shuffle, so
    adaptive execution takes them for a few rows: they must never be the side it may broadcast.
    """
    size = proj.width * proj.height
    if size <= BROADCAST_ROWS:
        return cells_of_maps(maps, proj.width, proj.height).join(F.broadcast(index), ["x", "y"])
    own = maps.select("map_id")
    if n_maps is None:
        own = materialize(own)
        n_maps = own.limit(BROADCAST_ROWS + 1).count()
    if n_maps <= BROADCAST_ROWS:
        return index.crossJoin(F.broadcast(own)).select("map_id", "x", "y", "pix")
    return cells_of_maps(own, proj.width, proj.height).join(index.hint("merge"), ["x", "y"])


def unit_hits(
    spark: SparkSession, proj: Projection, nside: int, ordering: str, view: Matrix = IDENTITY
) -> DataFrame:
    """(pix, hits): how often the grid over the tangent plane -1 .. 1 falls in each pixel. The grid
    has width x width places, u = x / width."""
    places = spark.range(proj.width * proj.width)
    u = (F.col("id") % proj.width) / F.lit(float(proj.width))
    v = F.floor(F.col("id") / F.lit(float(proj.width))) / F.lit(float(proj.width))
    lon, lat = P.gnomonic_inverse(u, v, proj.lon, proj.lat, proj.roll)
    angles = places.select(lon.alias("__lon"), lat.alias("__lat")).withColumn("__th", F.lit(math.pi / 2.0) - F.col("__lat"))
    found = sample_index(angles, nside, ordering, view, "__th", "__lon").filter("pix is not null")
    return found.groupBy("pix").agg(F.count(F.lit(1)).alias("hits"))


def raster_values(
    pixels: DataFrame, maps: DataFrame, index: DataFrame, proj: Projection, n_maps: int | None = None
) -> DataFrame:
    """(map_id, x, y, pix, value) of every valid cell of every map.

    The index has at most width * height rows. While it can be broadcast it first cuts the pixel
    table to the pixels on the raster, so the big table is never shuffled; the cells of each map
    are joined to what is left. A larger raster meets the pixel table in one shuffle.
    """
    size = proj.width * proj.height
    own = pixels.select("map_id", "pix", "value")
    if size <= BROADCAST_ROWS:
        own = own.join(F.broadcast(index.select("pix").distinct()), "pix", "left_semi")
    placed = index_of_maps(maps, index, proj, n_maps)
    return placed.join(own, ["map_id", "pix"], "left").select("map_id", "x", "y", "pix", "value")


# ----------------------------------------------------------------------- colour


def colour_table(lut: DataFrame, cmap: str | None = None) -> DataFrame:
    """(__i, __c): one colour for each row 0..255, so at most 256 rows.

    Of several tables ``cmap`` names one; a row given twice, as by two tables, fails the job.
    """
    if cmap is not None:
        lut = lut.filter(F.col("cmap") == cmap)
    twice = F.raise_error(F.lit("colour row given twice")).cast("int")
    one = lut.filter(F.col("idx").between(0, 255)).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("r", "g", "b", F.lit(255).alias("a"))).alias("__c")
    )
    return one.select(F.when(F.col("n") == 1, F.col("idx")).otherwise(twice).alias("__i"), "__c")


def with_colour(
    df: DataFrame, lut: DataFrame, bad: RGBA = GRAY, out: str = "rgba", cmap: str | None = None
) -> DataFrame:
    """Add ``rgba`` from ``cls`` and ``idx``."""
    table = F.broadcast(colour_table(lut, cmap))
    row = (
        F.when(F.col("cls") == "Underflow", F.lit(0))
        .when(F.col("cls") == "Overflow", F.lit(255))
        .when(F.col("cls") == "Color", F.col("idx"))
    )
    colour = F.struct(*[F.lit(c).alias(n) for c, n in zip(bad, "rgba")])
    return (
        df.withColumn("__i", row.cast("int"))
        .join(table, "__i", "left")
        .withColumn(out, F.coalesce(F.col("__c"), colour))
        .drop("__i", "__c")
    )


def colorize(
    df: DataFrame, lut: DataFrame, g: float = 1.0, bad: RGBA = GRAY, cmap: str | None = None
) -> DataFrame:
    """Class, gamma, colour row and colour of a stretched value ``t``."""
    df = df.withColumn("cls", classify("t"))
    df = df.withColumn("idx", F.when(F.col("cls") != "Bad", cmap_index(gamma("t", g))))
    return with_colour(df, lut, bad, cmap=cmap)


def reproject(
    pixels: DataFrame,
    maps: DataFrame,
    limits: DataFrame,
    proj: Projection,
    nside: int,
    ordering: str,
    lut: DataFrame | None = None,
    view: Matrix = IDENTITY,
    scale: Scale = Scale(),
    g: float = 1.0,
    bad: RGBA = GRAY,
    mask: DataFrame | None = None,
    mask_nside: int | None = None,
    fill: RGBA | None = None,
    knots: DataFrame | None = None,
    index: DataFrame | None = None,
    n_maps: int | None = None,
    mask_id: str | None = None,
    cmap: str | None = None,
) -> DataFrame:
    """Full raster of every map: value, class, stretch, colour row, colour.

    ``limits`` has one row per map; ``knots`` (arrays) is needed by the histogram
    stretch. A masked cell takes ``fill``; without one it is left out. ``index``
    may be a stored raster index.
    """
    if mask is not None and mask_nside is None:
        raise ValueError("a mask needs its mask_nside")
    if mask is not None and mask_nside != nside:
        raise ValueError("mask and map differ in nside")
    if index is None:
        index = raster_index(pixels.sparkSession, proj, nside, ordering, view)
    cells = raster_values(pixels, maps, index, proj, n_maps)
    bounds = limits.select("map_id", "minv", "maxv")
    cells = cells.join(small_side(bounds, n_maps), "map_id", "left")
    if scale.kind == "histogram":
        if knots is None:
            raise ValueError("the histogram stretch needs knots")
        cells = with_knots(cells, knots, n_maps, scale.bins)
    cells = with_raster_stretch(cells, scale).drop("minv", "maxv", "xs", "ps")
    if lut is not None:
        cells = colorize(cells, lut, g, bad, cmap)
    else:
        cells = cells.withColumn("cls", classify("t"))
        cells = cells.withColumn("idx", F.when(F.col("cls") != "Bad", cmap_index(gamma("t", g))))
    if mask is None:
        return cells
    own, keys = one_mask(mask, cells, mask_id)
    hidden = ~F.coalesce(F.col("valid"), F.lit(True))
    cells = in_set(cells, own, hidden, [k for k in keys if k != "pix"], nside, "__hidden")
    cells = cells.withColumn("__ok", ~F.col("__hidden")).drop("__hidden")
    if fill is None:
        return cells.filter("__ok").drop("__ok")
    if lut is not None:
        colour = F.struct(*[F.lit(c).alias(n) for c, n in zip(fill, "rgba")])
        cells = cells.withColumn("rgba", F.when(~F.col("__ok"), colour).otherwise(F.col("rgba")))
    return cells.drop("__ok")


def render_mollweide(pixels: DataFrame, maps: DataFrame, limits: DataFrame, width: int, nside: int, ordering: str, **options) -> DataFrame:
    """Whole-sky Mollweide raster (height = width / 2)."""
    return reproject(pixels, maps, limits, Projection(P.MOLLWEIDE, width, width // 2), nside, ordering, **options)


def render_hammer(pixels: DataFrame, maps: DataFrame, limits: DataFrame, width: int, nside: int, ordering: str, **options) -> DataFrame:
    """Whole-sky Hammer raster (height = width / 2)."""
    return reproject(pixels, maps, limits, Projection(P.HAMMER, width, width // 2), nside, ordering, **options)


def render_gnomonic(
    pixels: DataFrame, maps: DataFrame, limits: DataFrame, fov_arcmin: float, res: float,
    lon: float, lat: float, nside: int, ordering: str, roll: float = 0.0, **options,
) -> DataFrame:
    """Square cut-out of ceil(fov / res) cells about a centre."""
    width = math.ceil(fov_arcmin / res)
    proj = Projection(P.GNOMONIC, width, width, res, lon, lat, roll)
    return reproject(pixels, maps, limits, proj, nside, ordering, **options)


# --------------------------------------------------------------- layers and tiles


def layer_union(layers: Sequence[DataFrame], keys: Sequence[str] = ("map_id", "x", "y")) -> DataFrame:
    """Stack rasters (keys, rgba): a later layer overwrites an earlier cell.

    The winner per cell is a combinable aggregate, so layers are not sorted.
    """
    stacked = None
    for rank, layer in enumerate(layers):
        part = layer.select(*keys, "rgba", F.lit(rank).alias("__layer"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(F.max_by("rgba", "__layer").alias("rgba"))


def tile_of(x, y, tile: int) -> tuple[Column, Column]:
    """(tile_x, tile_y) of a cell."""
    return (
        F.floor(as_col(x) / F.lit(float(tile))).cast("int"),
        F.floor(as_col(y) / F.lit(float(tile))).cast("int"),
    )


def partition_tiles(rasters: DataFrame, tile: int) -> DataFrame:
    """Tiles of each raster (map_id, width, height): origin and clipped size."""
    last = lambda side: F.floor((F.col(side) - 1) / F.lit(float(tile))).cast("int")
    tiles = rasters.withColumn("ty", F.explode(F.sequence(F.lit(0), last("height"))))
    tiles = tiles.withColumn("tx", F.explode(F.sequence(F.lit(0), last("width"))))
    x0, y0 = F.col("tx") * tile, F.col("ty") * tile
    return tiles.select(
        "map_id",
        x0.alias("x0"),
        y0.alias("y0"),
        F.least(F.lit(tile), F.col("width") - x0).alias("w"),
        F.least(F.lit(tile), F.col("height") - y0).alias("h"),
    )


def place_raster(cells: DataFrame, x0: int, y0: int) -> DataFrame:
    """Cells moved to their place in a larger target."""
    return cells.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0})


def write_raster(cells: DataFrame, path: str, x0: int = 0, y0: int = 0, tile: int = 256) -> None:
    """Store placed cells as Parquet, one folder per map and tile.

    Cells are gathered by tile first, so each tile is written by one task once.
    """
    tx, ty = tile_of("x", "y", tile)
    placed = place_raster(cells, x0, y0).withColumns({"tile_x": tx, "tile_y": ty})
    placed.repartition("map_id", "tile_y", "tile_x").write.partitionBy(
        "map_id", "tile_y", "tile_x"
    ).mode("overwrite").parquet(path)
