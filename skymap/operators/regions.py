"""Regions of the sky and the NESTED pixel ranges that cover them.

A region is what several caps have in common: a cone is one cap, a convex polygon has one
half-sphere per edge, the footprint of a gnomonic raster is such a polygon. Its cover is found by
descending the NESTED hierarchy: a cell whose circle lies outside a cap is dropped, one inside all
caps is taken whole, the others are cut in four. NESTED numbers of a cell's pixels are one range,
so a cover is a short list of ranges, and a table sorted by NESTED pixel is read by its row groups.

Covers are supersets; ``contains`` decides a pixel exactly, by its centre.

* ``cover`` works on the driver for one region. Its lists are bounded by ``most`` whatever the
  region: where more cells are cut than that, the descent ends early.
* ``cells_of_cones`` does the same descent for a table of cones, as projections without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions import projections as P
from skymap.functions.frames import IDENTITY, Matrix, sph_to_vec, transpose
from skymap.functions.pixels import with_pix2ang_nest
from skymap.operators.raster import Projection
from skymap.plans.sizing import materialize, small_side, spread

Point = tuple[float, float, float]
Range = tuple[int, int]

# Ranges of a pushed filter, and cells of one descent step.
MOST_RANGES = 64
MOST_CELLS = 4096
# Pairs of a cell's cones and pixels that one task compares.
PAIRS = 1 << 26
# Leaves room for the rounding of centres and cosines.
SLACK = 1e-9


def direction(lon: float, lat: float) -> Point:
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def _cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Point, b: Point) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


@dataclass(frozen=True)
class Region:
    """Directions whose product with each cap's axis is at least the cap's cosine."""

    caps: tuple[tuple[Point, float], ...]

    def contains(self, x, y, z) -> Column:
        """Whether a unit vector lies in the region, borders included."""
        inside = F.lit(True)
        for (a, b, c), least in self.caps:
            inside = inside & (F.lit(a) * x + F.lit(b) * y + F.lit(c) * z >= F.lit(least))
        return inside


def cone(lon: float, lat: float, radius: float) -> Region:
    """All directions within an angle (radians) of a centre."""
    if not 0 <= radius <= math.pi:
        raise ValueError("the radius of a cone lies in 0..pi")
    return Region(((direction(lon, lat), math.cos(radius)),))


def polygon(corners: Sequence[Point]) -> Region:
    """The convex polygon of three or more unit vectors, in either order around it."""
    n = len(corners)
    if n < 3:
        raise ValueError("a polygon has three corners or more")
    caps = []
    for i, a in enumerate(corners):
        axis = _cross(a, corners[(i + 1) % n])
        size = math.sqrt(_dot(axis, axis))
        if size < 1e-12:
            raise ValueError("two corners of a polygon fall together or are opposite")
        caps.append((tuple(c / size for c in axis), 0.0))
    sides = [_dot(axis, c) for i, (axis, _) in enumerate(caps) for k, c in enumerate(corners) if k not in (i, (i + 1) % n)]
    if min(sides) < -1e-12 and max(sides) > 1e-12:
        raise ValueError("the polygon is not convex")
    sign = 1.0 if max(sides) > 1e-12 else -1.0
    return Region(tuple((tuple(sign * c for c in axis), 0.0) for axis, _ in caps))


def footprint(proj: Projection, view: Matrix = IDENTITY) -> Region | None:
    """What a raster can hit, in the frame of the map; None for the whole sky."""
    if proj.kind != P.GNOMONIC:
        return None
    tangent = P.tangent_matrix(proj.lon, proj.lat, proj.roll)
    step, half = P.arcmin(proj.res), proj.width / 2.0
    low, high = -half * step, (proj.width - 1 - half) * step
    back = transpose(view)
    corners = []
    for dx, dy in ((low, low), (high, low), (high, high), (low, high)):
        seen = (1.0, -dx, -dy)
        size = math.sqrt(_dot(seen, seen))
        sky = tuple(_dot(row, seen) / size for row in tangent)
        corners.append(tuple(_dot(row, sky) for row in back))
    return polygon(corners)


# --------------------------------------------------------------- the hierarchy


def radius_of(order: int) -> float:
    """No pixel of nside 2^order reaches farther from its centre. The widest pixels touch the
    border of a cap: from the middle of their upper edge to their side corner."""
    n = 1 << order
    a = (2.0 / 3.0, math.pi / (4 * n))
    b = (1.0 - (1.0 - 1.0 / n) ** 2 / 3.0, 0.0)
    va, vb = (direction(phi, math.asin(z)) for z, phi in (a, b))
    return math.acos(min(1.0, _dot(va, vb)))


def _even_bits(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(30):
        out |= (v >> (2 * bit) & 1) << bit
    return out


def centres(cells: np.ndarray, order: int) -> np.ndarray:
    """Unit vectors (rows) of the centres of NESTED cells.

    Each base face is a diamond of the plane: its place in rows from the north and columns in
    eighths of a turn. Rows nearer than one to a pole are stretched to its cap.
    """
    n = 1 << order
    inside, face = cells & (n * n - 1), cells // (n * n)
    u, v = ((_even_bits(inside >> k) + 0.5) / n for k in (0, 1))
    row = 2 + face // 4 - u - v
    pole = np.minimum(np.minimum(row, 4 - row), 1.0)
    column = (face % 4) * 2 + (face // 4 != 1) + (u - v) / pole
    z = np.where(pole < 1.0, np.sign(2 - row) * (1 - pole**2 / 3), (2 - row) * 2 / 3)
    phi, flat = column * (math.pi / 4), np.sqrt(np.maximum(0.0, 1 - z * z))
    return np.stack([flat * np.cos(phi), flat * np.sin(phi), z], axis=1)


def cover(region: Region, order: int, most: int = MOST_CELLS) -> list[Range]:
    """Ascending ranges [first, end) of cells of nside 2^order that hold the region."""
    cells = np.arange(12, dtype=np.int64)
    found: list[Range] = []
    for level in range(order + 1):
        middle, reach = centres(cells, level), radius_of(level) + SLACK
        whole, out = np.ones(len(cells), bool), np.zeros(len(cells), bool)
        for axis, least in region.caps:
            angle = np.arccos(np.clip(middle @ np.array(axis), -1, 1))
            wide = math.acos(max(-1.0, min(1.0, least)))
            out |= angle > wide + reach
            whole &= angle + reach <= wide
        shift = 2 * (order - level)
        last = level == order or 4 * int((~out & ~whole).sum()) > most
        for c in cells[~out if last else whole & ~out].tolist():
            found.append((c << shift, (c + 1) << shift))
        if last:
            break
        cells = (cells[~out & ~whole][:, None] * 4 + np.arange(4)).ravel()
    return _merged(found)


def _merged(ranges: list[Range]) -> list[Range]:
    out: list[Range] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shortened(ranges: list[Range], most: int = MOST_RANGES) -> list[Range]:
    """At most so many ranges that hold the same cells: the narrowest gaps are closed."""
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)
    kept = sorted(gaps[: most - 1])
    starts = [0, *kept]
    ends = [*[i - 1 for i in kept], len(ranges) - 1]
    return [(ranges[a][0], ranges[b][1]) for a, b in zip(starts, ends)] if ranges else []


def pixel_ranges(region: Region, nside: int, most: int = MOST_RANGES) -> list[Range]:
    """At most ``most`` ranges of NESTED pixels of a map that hold every pixel the region touches."""
    order = nside.bit_length() - 1
    # Finer cells than a few per range cost driver time and would be merged again.
    depth = min(order, 12)
    shift = 2 * (order - depth)
    return [(a << shift, b << shift) for a, b in shortened(cover(region, depth), most)]


def in_ranges(pix: Column, ranges: list[Range]) -> Column:
    """Test that reaches the file scan: a flat OR of closed ranges under one outer range."""
    if not ranges:
        return F.lit(False)
    tests = [(pix >= F.lit(a).cast("long")) & (pix <= F.lit(b - 1).cast("long")) for a, b in ranges]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + (tests[-1:] if len(tests) % 2 else [])
    return tests[0]


def pixels_in(pixels: DataFrame, region: Region, nside: int, exact: bool = True, most: int = MOST_RANGES) -> DataFrame:
    """Rows of a NESTED pixel table in a region: by range first, then, if ``exact``, by the centre."""
    near = pixels.filter(in_ranges(F.col("pix"), pixel_ranges(region, nside, most)))
    if not exact:
        return near
    placed = with_pix2ang_nest(near, nside, "pix", ("__t", "__p"))
    return placed.filter(region.contains(*sph_to_vec("__t", "__p"))).drop("__t", "__p")


# ------------------------------------------------------------- tables of cones


def cells_of_cones(cones: DataFrame, order: int) -> DataFrame:
    """The rows with ``cell``: one for each cell of nside 2^order that may hold pixels of the row's
    cone (lon, lat, radius in radians). One stage; a cone makes as many rows as it has cells."""
    x, y, z = F.cos("lat") * F.cos("lon"), F.cos("lat") * F.sin("lon"), F.sin("lat")
    rows = cones.withColumns({"__ax": x, "__ay": y, "__az": z})
    rows = rows.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    for level in range(order + 1):
        rows = with_pix2ang_nest(rows, 1 << level, "cell", ("__t", "__p"))
        cx, cy, cz = sph_to_vec("__t", "__p")
        product = F.col("__ax") * cx + F.col("__ay") * cy + F.col("__az") * cz
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product)))
        rows = rows.filter(angle <= F.col("radius") + F.lit(radius_of(level) + SLACK)).drop("__t", "__p")
        if level < order:
            children = F.sequence(F.col("cell") * 4, F.col("cell") * 4 + 3)
            rows = rows.withColumn("cell", F.explode(children))
    return rows.drop("__ax", "__ay", "__az")


def cone_search(cones: DataFrame, pixels: DataFrame, nside: int, order: int | None = None) -> DataFrame:
    """Pairs of a cone (its columns) and the pixels (map_id, pix, value) with centres in it.

    NESTED pixels meet cones on their coarse cell, an equi-join whose two sides are dealt by cell,
    then the angle decides. ``order`` sets the cells' size: about that of the cones. Directions are
    computed once for each pixel and cone, not for each pair. Both sides keep their number of
    partitions: adaptive execution would merge them, because it sees the rows and not their pairs.
    A cell of more than ``PAIRS`` pairs is cut into parts by its cones.
    """
    top = nside.bit_length() - 1
    order = min(top, 4 if order is None else order)
    near = materialize(cells_of_cones(spread(cones), order))
    x, y, z = F.cos("lat") * F.cos("lon"), F.cos("lat") * F.sin("lon"), F.sin("lat")
    cell = F.shiftright("pix", 2 * (top - order))
    placed = pixels.select("map_id", "pix", "value", cell.alias("cell"))
    sizes = near.groupBy("cell").agg(F.count("*").alias("a")).join(placed.groupBy("cell").agg(F.count("*").alias("b")), "cell")
    parts = F.ceil(F.col("a") * F.col("b") / F.lit(float(PAIRS))).cast("int")
    hot = small_side(sizes.select("cell", parts.alias("__parts")).filter("__parts > 1"))

    placed = with_pix2ang_nest(placed, nside, "pix", ("__t", "__p"))
    px, py, pz = sph_to_vec("__t", "__p")
    placed = placed.withColumns({"__px": px, "__py": py, "__pz": pz}).drop("__t", "__p").join(hot, "cell", "left")
    each = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    placed = placed.withColumn("__part", F.explode(each)).drop("__parts")
    part = F.pmod(F.xxhash64(*cones.columns), F.coalesce("__parts", F.lit(1))).cast("int")
    near = near.join(hot, "cell", "left").withColumn("__part", part).drop("__parts")
    near = near.withColumns({"__ax": x, "__ay": y, "__az": z, "__least": F.cos("radius")})
    met = spread(placed, "cell", "__part").join(spread(near, "cell", "__part"), ["cell", "__part"])
    product = F.col("__px") * F.col("__ax") + F.col("__py") * F.col("__ay") + F.col("__pz") * F.col("__az")
    return met.filter(product >= F.col("__least")).select("map_id", "pix", "value", *cones.columns)
