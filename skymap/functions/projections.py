"""Map projections as column expressions.

Plane coordinates (u, v) run over [0, 1] from the top left; longitude grows to
the left. A point outside a projection is NULL. Angles are radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions.frames import Matrix, matmul, rotate, vec_to_lonlat
from skymap.functions.staging import as_col, as_sql, compute

PI = math.pi
SQRT2 = math.sqrt(2.0)

MOLLWEIDE = "mollweide"
HAMMER = "hammer"
GNOMONIC = "gnomonic"

LonLat = tuple[Column, Column]


def cell_uv(x, y, width: int, height: int) -> LonLat:
    """(u, v) of a raster cell."""
    if width < 2 or height < 2:
        raise ValueError("a raster needs at least 2 x 2 cells")
    return as_col(x) / F.lit(float(width - 1)), as_col(y) / F.lit(float(height - 1))


def _in_unit(u: Column, v: Column) -> Column:
    return u.between(0.0, 1.0) & v.between(0.0, 1.0)


# ------------------------------------------------------------------ Mollweide


def _mollweide_from_plane(px: Column, py: Column, inside: Column, keep_apex: bool) -> LonLat:
    """Plane point to sky. With c = cos(asin(y)), sin(2 asin(y)) = 2 y c."""
    c = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - py * py))
    sin_lat = (F.asin(py) + py * c) * F.lit(2.0 / PI)
    away = c > F.lit(1e-12)
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_lat)))
    lon = F.when(away, px * F.lit(PI / 2.0) / c)
    if keep_apex:
        return F.when(inside, F.coalesce(lon, F.lit(0.0))), F.when(inside, lat)
    return F.when(inside, lon), F.when(inside & away, lat)


def mollweide_inverse(u, v) -> LonLat:
    """(lon, lat) of a plane point; NULL outside the ellipse."""
    px, py = F.lit(2.0) - as_col(u) * 4.0, F.lit(1.0) - as_col(v) * 2.0
    return _mollweide_from_plane(px, py, px * px / 4.0 + py * py <= 1.0, True)


def mollweide_cell_inside(x, y, width: int, height: int) -> Column:
    """TRUE for a cell inside the ellipse: a cheap test to filter cells early."""
    u, v = cell_uv(x, y, width, height)
    px, py = F.lit(2.0) - u * 4.0, F.lit(1.0) - v * 2.0
    return (px * px + py * py * 4.0 <= 4.0) & (F.lit(1.0) - py * py > F.lit(1e-24))


def mollweide_cell(x, y, width: int, height: int) -> LonLat:
    """(lon, lat) of a raster cell; the two apex cells are rejected."""
    u, v = cell_uv(x, y, width, height)
    px, py = F.lit(2.0) - u * 4.0, F.lit(1.0) - v * 2.0
    return _mollweide_from_plane(px, py, px * px + py * py * 4.0 <= 4.0, False)


def with_mollweide_forward(df: DataFrame, lon="lon", lat="lat", out=("u", "v")) -> DataFrame:
    """Add the (u, v) of a sky point: ten Newton steps from the latitude.

    At a pole the slope vanishes; the step is then NULL and so is the point.
    """
    lo, la = as_sql(lon), as_sql(lat)
    steps, last = {"goal": f"sin({la}) * {PI!r}D"}, f"CAST({la} AS DOUBLE)"
    for k in range(10):
        steps[f"s{k}"] = f"{last} * 2.0D"
        steps[f"n{k}"] = f"{last} - try_divide(:s{k} + sin(:s{k}) - :goal, 2.0D + cos(:s{k}) * 2.0D)"
        last = f":n{k}"
    steps["u"] = f"(2.0D - {lo} * {2.0 / PI!r}D * cos({last})) * 0.25D"
    steps["v"] = f"(1.0D - sin({last})) * 0.5D"
    steps["in"] = ":u BETWEEN 0.0D AND 1.0D AND :v BETWEEN 0.0D AND 1.0D"
    return compute(df, steps, {out[0]: "CASE WHEN :in THEN :u END", out[1]: "CASE WHEN :in THEN :v END"})


# --------------------------------------------------------------------- Hammer


def hammer_inverse(u, v) -> LonLat:
    """(lon, lat) of a plane point in closed form; NULL outside the ellipse."""
    a = F.lit(1.0) - as_col(u) * 2.0
    b = F.lit(1.0) - as_col(v) * 2.0
    inside = a * a + b * b <= 1.0
    # X = 2*sqrt(2)*a and Y = sqrt(2)*b give (X/4)^2 = a^2/2 and (Y/2)^2 = b^2/2.
    zz = F.lit(1.0) - a * a * 0.5 - b * b * 0.5
    zq = F.sqrt(F.greatest(F.lit(0.0), zz))
    lon = F.atan2(zq * a * F.lit(2.0 * SQRT2), (zz * 2.0 - 1.0) * 2.0) * 2.0
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), zq * b * F.lit(SQRT2))))
    return F.when(inside, lon), F.when(inside, lat)


def hammer_cell(x, y, width: int, height: int) -> LonLat:
    """(lon, lat) of a raster cell."""
    return hammer_inverse(*cell_uv(x, y, width, height))


def hammer_forward(lon, lat) -> LonLat:
    """(u, v) of a sky point; NULL at the antipode of the centre."""
    half, la = as_col(lon) * 0.5, as_col(lat)
    d2 = F.lit(1.0) + F.cos(la) * F.cos(half)
    d = F.sqrt(F.greatest(F.lit(0.0), d2))
    away = d >= F.lit(1e-10)
    u = F.when(away, F.lit(0.5) - F.cos(la) * F.sin(half) / (d * 2.0))
    v = F.when(away, F.lit(0.5) - F.sin(la) / (d * 2.0))
    ok = _in_unit(u, v)
    return F.when(ok, u), F.when(ok, v)


# ------------------------------------------------------------------- Gnomonic


def tangent_matrix(lon_deg: float, lat_deg: float, roll: float = 0.0) -> Matrix:
    """Rotation from the tangent frame (centre on +x) to the sky."""
    lo, la = math.radians(lon_deg), math.radians(lat_deg)
    turn = ((math.cos(lo), -math.sin(lo), 0.0), (math.sin(lo), math.cos(lo), 0.0), (0.0, 0.0, 1.0))
    tip = (
        (math.cos(la), 0.0, -math.sin(la)),
        (0.0, 1.0, 0.0),
        (math.sin(la), 0.0, math.cos(la)),
    )
    base = matmul(turn, tip)
    if roll == 0.0:
        return base
    c, s = math.cos(roll), math.sin(roll)
    return matmul(((c, -s, 0.0), (s, c, 0.0), (0.0, 0.0, 1.0)), base)


def arcmin(res: float) -> float:
    """Arc minutes in radians."""
    return res * PI / (180.0 * 60.0)


def _tangent_to_sky(dx: Column, dy: Column, m: Matrix) -> LonLat:
    return vec_to_lonlat(*rotate(m, (F.lit(1.0), -dx, -dy)))


def gnomonic_cell(
    x, y, width: int, res_arcmin: float, lon_deg: float, lat_deg: float, roll: float = 0.0
) -> LonLat:
    """(lon, lat) of a tangent-plane cell of ``res_arcmin`` about a centre."""
    delta = arcmin(res_arcmin)
    start = -(width / 2.0) * delta
    dx = as_col(x) * F.lit(delta) + F.lit(start)
    dy = as_col(y) * F.lit(delta) + F.lit(start)
    return _tangent_to_sky(dx, dy, tangent_matrix(lon_deg, lat_deg, roll))


def gnomonic_inverse(u, v, lon_deg: float, lat_deg: float, roll: float = 0.0) -> LonLat:
    """(lon, lat) of (u, v) on the plane -1..1 about a centre."""
    dx, dy = as_col(u) * 2.0 - 1.0, as_col(v) * 2.0 - 1.0
    lon, lat = _tangent_to_sky(dx, dy, tangent_matrix(lon_deg, lat_deg, roll))
    centre = (dx == 0) & (dy == 0)
    return (
        F.when(centre, F.lit(math.radians(lon_deg))).otherwise(lon),
        F.when(centre, F.lit(math.radians(lat_deg))).otherwise(lat),
    )


def gnomonic_forward(lon, lat) -> LonLat:
    """(u, v) about (0, 0); NULL behind the plane or outside it."""
    lo, la = as_col(lon), as_col(lat)
    depth = F.cos(la) * F.cos(lo)
    front = depth > 0
    u = F.when(front, (F.cos(la) * F.sin(lo) / depth + 1.0) * 0.5)
    v = F.when(front, (F.sin(la) / depth + 1.0) * 0.5)
    ok = _in_unit(u, v)
    return F.when(ok, u), F.when(ok, v)


def plane_about_pole(vx, vy, vz, delta: float, cx: float, cy: float) -> LonLat:
    """Cell position of a view vector on the plane about +z; NULL behind it."""
    x, y, z = as_col(vx), as_col(vy), as_col(vz)
    front = z > 0
    px = F.when(front, F.lit(cx) - x / z / F.lit(delta))
    py = F.when(front, F.lit(cy) - y / z / F.lit(delta))
    return px, py


def plane_of_local(lon, lat, delta: float, cx: float, cy: float) -> LonLat:
    """Cell position of local tangent angles; NULL behind the plane."""
    lo, la = as_col(lon), as_col(lat)
    front = F.cos(la) * F.cos(lo) > 0
    px = F.when(front, F.lit(cx) - F.tan(lo) / F.lit(delta))
    py = F.when(front, F.lit(cy) - F.tan(la) / F.cos(lo) / F.lit(delta))
    return px, py
