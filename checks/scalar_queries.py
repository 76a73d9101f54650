"""Queries of the scalar operators: pixel indices, frames, projections, stretches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as S
from checks.registry import query
from skymap.functions import frames, pixels, projections, stretch
from skymap.functions.values import seen_or_null
from skymap.operators import clean
from skymap.operators.raster import sample_index

r6 = X.r6

# ------------------------------------------------------------- pixel indices (2.6)


def _points(spark, d):
    return X.sky_points(spark, d), X.nside_of(spark, d, "orders")


for _name, _f, _sql in (
    ("ang2pix_ring", pixels.with_ang2pix_ring, S.ang2pix_ring),
    ("ang2pix_nest", pixels.with_ang2pix_nest, S.ang2pix_nest),
):

    def _run(spark, d, f=_f):
        pts, n = _points(spark, d)
        return f(pts, n).select("point_id", "pix")

    query(
        _name,
        f"WITH {S.params('orders')}, {S.POINTS}, r AS (SELECT *, {_sql('nside', 'theta', 'phi', 'pix')} FROM pts, p) "
        "SELECT point_id, pix FROM r",
    )(_run)


@query(
    "ang2pix",
    f"WITH {S.params('orders')}, {S.POINTS}, "
    f"r AS (SELECT *, {S.ang2pix_ring('nside', 'theta', 'phi', 'pix')} FROM pts, p), "
    f"t AS (SELECT *, {S.ang2pix_nest('nside', 'theta', 'phi', 'pix')} FROM pts, p) "
    "SELECT 'RING' AS ordering, point_id, pix FROM r UNION ALL SELECT 'NESTED', point_id, pix FROM t",
)
def ang2pix(spark, d):
    pts, n = _points(spark, d)
    parts = [
        pixels.with_ang2pix(pts, n, o).select(F.lit(o).alias("ordering"), "point_id", "pix")
        for o in (pixels.RING, pixels.NESTED)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "pix2ang_ring",
    f"WITH {S.ORDERS}, r AS (SELECT *, {S.pix2ang_ring('nside', 'pix', 'th', 'ph')} FROM a, p) "
    f"SELECT pix, {S.r6('th')} AS theta, {S.r6('ph')} AS phi FROM r",
)
def pix2ang_ring(spark, d):
    df, n = X.sky_orders(spark, d)
    return pixels.with_pix2ang_ring(df, n).select("pix", r6("theta").alias("theta"), r6("phi").alias("phi"))


@query(
    "pix2ang_nest",
    f"WITH {S.ORDERS}, c AS (SELECT *, {S.nest2xyf('nside', 'pix', 'x', 'y', 'f')} FROM a, p), "
    f"k AS (SELECT *, {S.xyf2ring('nside', 'x', 'y', 'f', 'rp')} FROM c), "
    f"r AS (SELECT *, {S.pix2ang_ring('nside', 'rp', 'th', 'ph')} FROM k) "
    f"SELECT pix, {S.r6('th')} AS theta, {S.r6('ph')} AS phi FROM r",
)
def pix2ang_nest(spark, d):
    df, n = X.sky_orders(spark, d)
    return pixels.with_pix2ang_nest(df, n).select("pix", r6("theta").alias("theta"), r6("phi").alias("phi"))


@query(
    "nest2xyf",
    f"WITH {S.ORDERS} SELECT pix, {S.nest2xyf('nside', 'pix', 'ix', 'iy', 'face')} FROM a, p",
)
def nest2xyf(spark, d):
    df, n = X.sky_orders(spark, d)
    return pixels.with_nest2xyf(df, n).select("pix", "ix", "iy", "face")


@query(
    "xyf2nest",
    f"WITH {S.ORDERS}, c AS (SELECT pix, nside, pix % nside AS ix, (pix // nside) % nside AS iy, pix // (nside*nside) AS face FROM a, p) "
    f"SELECT ix, iy, face, {S.xyf2nest('nside', 'ix', 'iy', 'face')} AS nest FROM c",
)
def xyf2nest(spark, d):
    df, n = X.sky_orders(spark, d)
    k = F.lit(n).cast("long")
    cells = df.select(
        (F.col("pix") % k).alias("ix"),
        (pixels.idiv(F.col("pix"), k) % k).alias("iy"),
        pixels.idiv(F.col("pix"), k * k).alias("face"),
    )
    return pixels.with_xyf2nest(cells, n, out="nest")


@query(
    "ring2xyf",
    f"WITH {S.ORDERS}, r AS (SELECT *, {S.ring2xyf('nside', 'pix', 'ix', 'iy', 'face')} FROM a, p) SELECT pix, ix, iy, face FROM r",
)
def ring2xyf(spark, d):
    df, n = X.sky_orders(spark, d)
    return pixels.with_ring2xyf(df, n).select("pix", "ix", "iy", "face")


@query(
    "xyf2ring",
    f"WITH {S.ORDERS}, c AS (SELECT pix, nside, pix % nside AS ix, (pix // nside) % nside AS iy, pix // (nside*nside) AS face FROM a, p), "
    f"r AS (SELECT *, {S.xyf2ring('nside', 'ix', 'iy', 'face', 'ring')} FROM c) SELECT ix, iy, face, ring FROM r",
)
def xyf2ring(spark, d):
    df, n = X.sky_orders(spark, d)
    k = F.lit(n).cast("long")
    cells = df.select(
        (F.col("pix") % k).alias("ix"),
        (pixels.idiv(F.col("pix"), k) % k).alias("iy"),
        pixels.idiv(F.col("pix"), k * k).alias("face"),
    )
    return pixels.with_xyf2ring(cells, n, out="ring")


@query(
    "ring2nest",
    f"WITH {S.ORDERS}, r AS (SELECT *, {S.ring2xyf('nside', 'pix', 'ix', 'iy', 'face')} FROM a, p) "
    f"SELECT pix, {S.xyf2nest('nside', 'ix', 'iy', 'face')} AS nest FROM r",
)
def ring2nest(spark, d):
    df, n = X.sky_orders(spark, d)
    return pixels.with_ring2nest(df, n, out="nest").select("pix", "nest")


@query(
    "nest2ring",
    f"WITH {S.ORDERS}, c AS (SELECT *, {S.nest2xyf('nside', 'pix', 'x', 'y', 'f')} FROM a, p), "
    f"k AS (SELECT *, {S.xyf2ring('nside', 'x', 'y', 'f', 'ring')} FROM c) SELECT pix, ring FROM k",
)
def nest2ring(spark, d):
    df, n = X.sky_orders(spark, d)
    return pixels.with_nest2ring(df, n, out="ring").select("pix", "ring")


@query(
    "ang_dist",
    f"WITH {S.POINTS} SELECT point_id, {S.r6('acos(greatest(-1, least(1, sin(theta)*sin(1.1::DOUBLE)*cos(phi-2.2::DOUBLE) + cos(theta)*cos(1.1::DOUBLE))))')} AS dist FROM pts",
)
def ang_dist(spark, d):
    pts = X.sky_points(spark, d)
    return pts.select("point_id", r6(pixels.ang_dist("theta", "phi", 1.1, 2.2)).alias("dist"))


@query(
    "angular_sep",
    f"WITH {S.POINTS} SELECT point_id, {S.r6('acos(greatest(-1, least(1, sin(theta)*cos(phi)*0.6::DOUBLE + cos(theta)*0.8::DOUBLE)))')} AS sep FROM pts",
)
def angular_sep(spark, d):
    pts = X.sky_points(spark, d)
    v = frames.sph_to_vec("theta", "phi")
    return pts.select("point_id", r6(pixels.angular_sep(v, (0.6, 0.0, 0.8))).alias("sep"))


# -------------------------------------------------------------------- frames (2.7)

VEC = "sin(theta)*cos(phi) AS vx, sin(theta)*sin(phi) AS vy, cos(theta) AS vz"


@query("sph_to_vec", f"WITH {S.POINTS}, v AS (SELECT point_id, {VEC} FROM pts) SELECT point_id, {S.r6('vx')} AS x, {S.r6('vy')} AS y, {S.r6('vz')} AS z FROM v")
def sph_to_vec(spark, d):
    x, y, z = frames.sph_to_vec("theta", "phi")
    return X.sky_points(spark, d).select("point_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query(
    "vec_to_sph",
    f"WITH {S.POINTS} SELECT point_id, {S.r6('theta')} AS theta, {S.r6(f'CASE WHEN phi > {S.PI} THEN phi - {S.TAU} ELSE phi END')} AS phi FROM pts",
)
def vec_to_sph(spark, d):
    x, y, z = frames.sph_to_vec("theta", "phi")
    v = X.sky_points(spark, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))
    th, ph = frames.vec_to_sph("x", "y", "z")
    return v.select("point_id", r6(th).alias("theta"), r6(ph).alias("phi"))


LL = f"phi - {S.PI} AS lon, {S.HALF} - theta AS lat"


def _lonlat(spark, d):
    return X.sky_points(spark, d).select(
        "point_id",
        (F.col("phi") - F.lit(math.pi)).alias("lon"),
        (F.lit(math.pi / 2) - F.col("theta")).alias("lat"),
    )


@query(
    "lonlat_to_vec",
    f"WITH {S.POINTS}, q AS (SELECT point_id, {LL} FROM pts) SELECT point_id, {S.r6('cos(lat)*cos(lon)')} AS x, {S.r6('cos(lat)*sin(lon)')} AS y, {S.r6('sin(lat)')} AS z FROM q",
)
def lonlat_to_vec(spark, d):
    x, y, z = frames.lonlat_to_vec("lon", "lat")
    return _lonlat(spark, d).select("point_id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query(
    "vec_to_lonlat",
    f"WITH {S.POINTS}, q AS (SELECT point_id, {LL} FROM pts) SELECT point_id, {S.r6('lon')} AS lon, {S.r6('lat')} AS lat FROM q",
)
def vec_to_lonlat(spark, d):
    x, y, z = frames.lonlat_to_vec("lon", "lat")
    v = _lonlat(spark, d).select("point_id", (x * 3).alias("x"), (y * 3).alias("y"), (z * 3).alias("z"))
    lon, lat = frames.vec_to_lonlat("x", "y", "z")
    return v.select("point_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


_PAIRS = [(a, b) for a in "GCE" for b in "GCE"]
_G2C, _E2G, _E2C = frames.GAL_TO_EQ, frames.ECL_TO_GAL, frames.ECL_TO_EQ
_MAT = {
    ("G", "C"): _G2C, ("C", "G"): tuple(zip(*_G2C)), ("E", "G"): _E2G, ("G", "E"): tuple(zip(*_E2G)),
    ("E", "C"): _E2C, ("C", "E"): tuple(zip(*_E2C)),
}


def _frame_sql(a: str, b: str) -> str:
    m = _MAT.get((a, b), frames.IDENTITY)
    return (
        f"SELECT '{a}{b}' AS pair, point_id, {S.r6('x')} AS x, {S.r6('y')} AS y, {S.r6('z')} AS z "
        f"FROM (SELECT point_id, {S.rotate(m, 'vx', 'vy', 'vz', ('x', 'y', 'z'))} FROM v)"
    )


@query(
    "frame_transform",
    f"WITH {S.POINTS}, v AS (SELECT point_id, {VEC} FROM pts) " + " UNION ALL ".join(_frame_sql(a, b) for a, b in _PAIRS),
)
def frame_transform(spark, d):
    x, y, z = frames.sph_to_vec("theta", "phi")
    v = X.sky_points(spark, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))
    out = None
    for a, b in _PAIRS:
        w = frames.rotate(frames.frame_matrix(a, b), (F.col("x"), F.col("y"), F.col("z")))
        part = v.select(F.lit(a + b).alias("pair"), "point_id", *[r6(c).alias(n) for c, n in zip(w, "xyz")])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "frame_transform_mixed",
    f"WITH {S.POINTS}, v AS (SELECT point_id, {VEC} FROM pts), w AS (" + " UNION ALL ".join(_frame_sql(a, b) for a, b in _PAIRS)
    + ") SELECT pair, point_id, x, y, z FROM w WHERE pair = substr('GCE', CAST(point_id % 3 AS INT) + 1, 1) || substr('GCE', CAST(point_id // 3 % 3 AS INT) + 1, 1)",
)
def frame_transform_mixed(spark, d):
    """Each point in a frame of its own, turned to another of its own."""
    x, y, z = frames.sph_to_vec("theta", "phi")
    frame = lambda k: F.substring(F.lit("GCE"), (k % 3 + 1).cast("int"), F.lit(1))
    k = F.col("point_id")
    v = X.sky_points(spark, d).select(
        "point_id", frame(k).alias("source"), frame(F.floor(k / 3)).alias("target"), x.alias("x"), y.alias("y"), z.alias("z")
    )
    out = frames.with_frames(v)
    return out.select(F.concat("source", "target").alias("pair"), "point_id", *[r6(c).alias(c) for c in "xyz"])


def _camera_sql(lon: float, lat: float, roll: float):
    """Camera matrix written out: Rz(roll) Ry(-lat) Rz(-lon)."""
    cl, sl, cb, sb, cr, sr = math.cos(lon), math.sin(lon), math.cos(lat), math.sin(lat), math.cos(roll), math.sin(roll)
    m = ((cb * cl, cb * sl, -sb), (-sl, cl, 0.0), (sb * cl, sb * sl, cb))
    return tuple(
        tuple(r) for r in (
            [cr * m[0][j] - sr * m[1][j] for j in range(3)],
            [sr * m[0][j] + cr * m[1][j] for j in range(3)],
            list(m[2]),
        )
    )


_CAM = _camera_sql(0.3, 0.2, 0.1)
_VIEW_SQL = tuple(tuple(sum(_CAM[i][k] * _G2C[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def _view_oracle(m) -> str:
    return (
        f"WITH {S.POINTS}, v AS (SELECT point_id, {VEC} FROM pts), "
        f"w AS (SELECT point_id, {S.rotate(m, 'vx', 'vy', 'vz', ('x', 'y', 'z'))} FROM v) "
        f"SELECT point_id, {S.r6('x')} AS x, {S.r6('y')} AS y, {S.r6('z')} AS z FROM w"
    )


@query("view_apply", _view_oracle(_VIEW_SQL))
def view_apply(spark, d):
    v = frames.rotate(X.VIEW, frames.sph_to_vec("theta", "phi"))
    return X.sky_points(spark, d).select("point_id", *[r6(c).alias(n) for c, n in zip(v, "xyz")])


@query("view_apply_inverse", _view_oracle(tuple(zip(*_VIEW_SQL))))
def view_apply_inverse(spark, d):
    v = frames.rotate_inverse(X.VIEW, frames.sph_to_vec("theta", "phi"))
    return X.sky_points(spark, d).select("point_id", *[r6(c).alias(n) for c, n in zip(v, "xyz")])


@query(
    "grid_transform",
    f"WITH {S.POINTS}, q AS (SELECT point_id, {LL} FROM pts), "
    "v AS (SELECT point_id, cos(lat)*cos(lon) AS vx, cos(lat)*sin(lon) AS vy, sin(lat) AS vz FROM q), "
    f"e AS (SELECT point_id, {S.rotate(_E2G, 'vx', 'vy', 'vz', ('ex', 'ey', 'ez'))} FROM v), "
    f"w AS (SELECT point_id, {S.rotate(_CAM, 'ex', 'ey', 'ez', ('x', 'y', 'z'))} FROM e) "
    f"SELECT point_id, {S.r6('x')} AS x, {S.r6('y')} AS y, {S.r6('z')} AS z FROM w",
)
def grid_transform(spark, d):
    v = frames.grid_transform("lon", "lat", "E", "G", frames.camera_matrix(0.3, 0.2, 0.1))
    return _lonlat(spark, d).select("point_id", *[r6(c).alias(n) for c, n in zip(v, "xyz")])


@query(
    "sample_index",
    f"WITH {S.params('orders')}, {S.POINTS}, g AS (SELECT *, {S.sample_angles(_VIEW_SQL, 'theta', 'phi')} FROM pts, p), "
    f"r AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'pix')} FROM g) SELECT point_id, pix FROM r",
)
def sample_index_(spark, d):
    pts, n = _points(spark, d)
    return sample_index(pts, n, "RING", X.VIEW).select("point_id", "pix")


# --------------------------------------------------------------- projections (2.8)

UV = "u AS (SELECT event_id AS point_id, ((event_id*7919) % 1000003 + 0.5::DOUBLE)/1000003.0::DOUBLE AS u, ((event_id*15485863) % 1000033 + 0.5::DOUBLE)/1000033.0::DOUBLE AS v FROM events)"


def _uv(spark, d):
    k = F.col("event_id")
    return X.table(spark, d, "events").select(
        k.alias("point_id"),
        (((k * 7919) % 1000003 + F.lit(0.5)) / 1000003.0).alias("u"),
        (((k * 15485863) % 1000033 + F.lit(0.5)) / 1000033.0).alias("v"),
    )


def _inv(name: str, body: str, f):
    query(name, f"WITH {UV}, r AS (SELECT *, {body} FROM u) SELECT point_id, CASE WHEN ok THEN {S.r6('lon')} END AS lon, CASE WHEN ok THEN {S.r6('lat')} END AS lat FROM r")(
        lambda spark, d: _uv(spark, d).select("point_id", *[r6(c).alias(n) for c, n in zip(f("u", "v"), ("lon", "lat"))])
    )


_inv(
    "mollweide_inverse",
    f"""2-4*u AS mx, 1-2*v AS my, mx*mx/4 + my*my <= 1 AS ok, asin(my) AS aux,
    asin(greatest(-1, least(1, (2*aux+sin(2*aux))/{S.PI}))) AS lat, {S.PI}*mx/(2*cos(aux)) AS lon""",
    projections.mollweide_inverse,
)
_inv("hammer_inverse", S.hammer_inverse("u", "v"), projections.hammer_inverse)

_TAN = projections.tangent_matrix(266.4, -28.9, 0.25)


def _tangent_sql(dx: str, dy: str) -> str:
    return f"""{dx} AS dx, {dy} AS dy, {S.rotate(_TAN, '1.0::DOUBLE', '-dx', '-dy', ('tx', 'ty', 'tz'))},
    true AS ok, atan2(ty, tx) AS lon, asin(tz/sqrt(tx*tx+ty*ty+tz*tz)) AS lat"""


_inv(
    "gnomonic_inverse",
    _tangent_sql("2*u-1", "2*v-1"),
    lambda u, v: projections.gnomonic_inverse(u, v, 266.4, -28.9, 0.25),
)


def _fwd(name: str, body: str, f):
    query(
        name,
        f"WITH {S.POINTS}, q AS (SELECT point_id, {LL} FROM pts), r AS (SELECT *, {body} FROM q), s AS (SELECT *, ok AND u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AS inside FROM r) "
        f"SELECT point_id, CASE WHEN inside THEN {S.r6('u')} END AS u, CASE WHEN inside THEN {S.r6('v')} END AS v FROM s",
    )(lambda spark, d: f(_lonlat(spark, d)).select("point_id", r6("u").alias("u"), r6("v").alias("v")))


def mollweide_forward_sql(lon: str = "lon", lat: str = "lat") -> str:
    steps, last = [], lat
    for i in range(10):
        steps.append(f"{last} - (2*{last} + sin(2*{last}) - {S.PI}*sin({lat}))/nullif(2 + 2*cos(2*{last}), 0) AS n{i}")
        last = f"n{i}"
    steps.append(f"(2 - (2*{lon}/{S.PI})*cos({last}))*0.25::DOUBLE AS u, (1 - sin({last}))*0.5::DOUBLE AS v, {last} IS NOT NULL AS ok")
    return ", ".join(steps)


def hammer_forward_sql(lon: str = "lon", lat: str = "lat") -> str:
    s2 = repr(math.sqrt(2))
    return f"""sqrt(greatest(0, 1 + cos({lat})*cos({lon}/2))) AS hd, hd >= 1e-10 AS ok,
    CASE WHEN ok THEN (2*{s2} - 2*{s2}*cos({lat})*sin({lon}/2)/hd)/(4*{s2}) END AS u,
    CASE WHEN ok THEN ({s2} - {s2}*sin({lat})/hd)/(2*{s2}) END AS v"""


_fwd("mollweide_forward", mollweide_forward_sql(), projections.with_mollweide_forward)
_fwd("hammer_forward", hammer_forward_sql(), lambda df: df.withColumns(dict(zip("uv", projections.hammer_forward("lon", "lat")))))
_fwd(
    "gnomonic_forward",
    "cos(lat)*cos(lon) AS zz, zz > 0 AS ok, CASE WHEN ok THEN 0.5::DOUBLE*(cos(lat)*sin(lon)/zz + 1) END AS u, CASE WHEN ok THEN 0.5::DOUBLE*(sin(lat)/zz + 1) END AS v",
    lambda df: df.withColumns(dict(zip("uv", projections.gnomonic_forward("lon", "lat")))),
)


def _cells(spark, d):
    """Raster cells addressed by the events: a raster of 8 nside x 4 nside."""
    n = X.nside_of(spark, d, "orders")
    w, h = 8 * n, 4 * n
    k = F.col("event_id")
    cells = X.table(spark, d, "events").select(
        k.alias("point_id"), ((k * 7919) % w).alias("x"), ((k * 104729 + k % 97) % h).alias("y")
    )
    return cells, w, h


CELLS = "c AS (SELECT event_id AS point_id, (event_id*7919) % (8*nside) AS x, (event_id*104729 + event_id % 97) % (4*nside) AS y, nside FROM events, p)"


def _cell(name: str, body: str, f):
    query(
        name,
        f"WITH {S.params('orders')}, {CELLS}, r AS (SELECT *, {body} FROM c) SELECT point_id, CASE WHEN ok THEN {S.r6('lon')} END AS lon, CASE WHEN ok THEN {S.r6('lat')} END AS lat FROM r",
    )(f)


def _cell_run(f):
    def run(spark, d):
        cells, w, h = _cells(spark, d)
        return cells.select("point_id", *[r6(c).alias(n) for c, n in zip(f(w, h), ("lon", "lat"))])

    return run


_cell("mollweide_cell", S.mollweide_cell("(8*nside)", "(4*nside)"), _cell_run(lambda w, h: projections.mollweide_cell("x", "y", w, h)))
_cell("hammer_cell", S.hammer_inverse("x/(8*nside-1.0::DOUBLE)", "y/(4*nside-1.0::DOUBLE)"), _cell_run(lambda w, h: projections.hammer_cell("x", "y", w, h)))
_D = repr(projections.arcmin(7.5))
_cell(
    "gnomonic_cell",
    _tangent_sql(f"-(8*nside/2.0::DOUBLE)*{_D} + x*{_D}", f"-(8*nside/2.0::DOUBLE)*{_D} + y*{_D}"),
    _cell_run(lambda w, h: projections.gnomonic_cell("x", "y", w, 7.5, 266.4, -28.9, 0.25)),
)

# ------------------------------------------------------------------ cleaning (2.2)


@query("is_seen", f"WITH {S.RAW} SELECT pix, {S.SEEN} AS seen FROM raw")
def is_seen(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    return clean.flag_seen(df).select("pix", "seen")


def _sentinel_free(expr: str) -> str:
    """NaN and sentinels to NULL for output."""
    return f"CASE WHEN isnan({expr}) OR abs({expr}) > 1e29 THEN NULL ELSE {S.r6(expr)} END"


@query("zero_to_unseen", f"WITH {S.RAW} SELECT pix, {_sentinel_free('nullif(value, 0.0)')} AS value FROM raw")
def zero_to_unseen(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    return clean.apply_zero_to_unseen(df).select("pix", r6(seen_or_null(F.col("value"))).alias("value"))


@query("unit_scale", f"WITH {S.RAW} SELECT pix, CASE WHEN {S.SEEN} THEN {S.r6('value*0.001::DOUBLE')} END AS value FROM raw")
def unit_scale(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    return clean.apply_unit_scale(df, 0.001).select("pix", r6(seen_or_null(F.col("value"))).alias("value"))


@query("clean_map", f"WITH {S.RAW} SELECT pix, CASE WHEN {S.SEEN} AND value <> 0 THEN {S.r6('value*0.001::DOUBLE')} END AS value FROM raw")
def clean_map(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    return clean.clean_map(df, 0.001).select("pix", r6("value").alias("value"))


# ---------------------------------------------------------------- stretches (2.10)

LO, HI = 50_000.0, 400_000.0  # inside the order price range
BLO, BHI = -500.0, 7_000.0  # inside the balance range
NB = S.BIPOLAR
NO = S.RAW


def _ln(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln(greatest({x}, 1e-300)) WHEN {x} = 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END)"


def _c01(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE greatest(0, least(1, {x})) END)"


def _stretch(name: str, source: str, body: str, f):
    """``body`` is SQL over v; sources: orders (raw) or customer."""
    with_, tab = (NO, "raw") if source == "orders" else (NB, "b")
    query(
        name,
        f"WITH {with_}, s AS (SELECT pix, value AS v FROM {tab}), r AS (SELECT pix, CASE WHEN {S.SEEN.replace('value', 'v')} THEN {body} END AS t FROM s) "
        f"SELECT pix, {S.r6('t')} AS t FROM r",
    )(lambda spark, d: _stretch_rows(spark, d, source, f))


def _stretch_rows(spark, d, source, f):
    df, _ = (X.sky_orders_raw if source == "orders" else X.sky_bipolar)(spark, d)
    t = df.select("pix", f(F.col("value")).alias("t"))
    return t.select("pix", r6(F.nanvl("t", F.lit(None).cast("double"))).alias("t"))


_lin = f"CASE WHEN v <= {LO} THEN 0.0 WHEN v >= {HI} THEN 1.0 ELSE (v-{LO})/({HI}-{LO}) END"
_stretch("scale_linear", "orders", _lin, lambda v: stretch.scale_linear(v, LO, HI))
_stretch("scale_linear_norm", "orders", _lin, lambda v: stretch.scale_linear_norm(v, LO, HI))
_lnv = "ln(CASE WHEN v > 0 THEN v ELSE 1 END)"
_stretch(
    "scale_log", "customer",
    f"CASE WHEN v <= 0 THEN NULL WHEN v < 20 THEN 0.0 WHEN v >= 7000 THEN 1.0 ELSE ({_lnv}-ln(20))/(ln(7000)-ln(20)) END",
    lambda v: stretch.scale_log(v, 20.0, 7000.0),
)
_stretch(
    "scale_log_norm", "customer",
    f"CASE WHEN v <= 0 THEN NULL ELSE greatest(0, least(1, ({_lnv}-ln(20))/(ln(7000)-ln(20)))) END",
    lambda v: stretch.scale_log_norm(v, 20.0, 7000.0),
)
_as = "greatest(0, least(1, (asinh(v/300)-asinh({lo}/300))/(asinh({hi}/300)-asinh({lo}/300))))".format(lo=BLO, hi=BHI)
_stretch("scale_asinh", "customer", _as, lambda v: stretch.scale_asinh(v, BLO, BHI, 300.0))
_stretch("scale_asinh_norm", "customer", _as, lambda v: stretch.scale_asinh_norm(v, BLO, BHI, 300.0))
_out = f"0.5+0.5*sign(v)*(200+{_ln('(abs(v)-200)')})/(200+ln({BHI}-200))"
_two = f"CASE WHEN abs(v) < 200 THEN {_c01('(0.5+0.5*(v/200))')} ELSE {_c01('(' + _out + ')')} END"
_stretch("scale_symlog", "customer", _two, lambda v: stretch.scale_symlog(v, BLO, BHI, 200.0))
_stretch("scale_plancklog", "customer", _two, lambda v: stretch.scale_plancklog(v, BLO, BHI, 200.0))


def _term(x: str, planck: bool) -> str:
    plus = "1 + " if planck else ""
    return f"(CASE WHEN abs({x}) < 200 THEN ({x})/200 ELSE sign({x})*({plus}ln(greatest(abs({x}), 1)/200)) END)"


for _n, _p, _f in (
    ("scale_symlog_norm", False, stretch.scale_symlog_norm),
    ("scale_plancklog_norm", True, stretch.scale_plancklog_norm),
):
    _b = f"greatest(0, least(1, ({_term('v', _p)}-{_term(f'({BLO})', _p)})/({_term(f'({BHI})', _p)}-{_term(f'({BLO})', _p)})))"
    _stretch(_n, "customer", _b, lambda v, f=_f: f(v, BLO, BHI, 200.0))


def _unit(spark, d):
    df, _ = X.sky_bipolar(spark, d)
    return df.select("pix", ((F.col("value") + 1000.0) / 11000.0).alias("t"))


UNIT = f"WITH {NB}, s AS (SELECT pix, (value + 1000.0::DOUBLE)/11000.0::DOUBLE AS t FROM b)"


@query(
    "scale_inverse",
    f"{UNIT} SELECT pix, {S.r6('-500 + t*7500')} AS linear, {S.r6('exp(ln(20) + t*(ln(7000)-ln(20)))')} AS log, "
    f"{S.r6('300*sinh(asinh(-500/300.0::DOUBLE) + t*(asinh(7000/300.0::DOUBLE)-asinh(-500/300.0::DOUBLE)))')} AS asinh FROM s",
)
def scale_inverse(spark, d):
    inv = stretch.scale_inverse
    return _unit(spark, d).select(
        "pix",
        r6(inv("t", BLO, BHI, stretch.Scale("linear"))).alias("linear"),
        r6(inv("t", 20.0, 7000.0, stretch.Scale("log"))).alias("log"),
        r6(inv("t", BLO, BHI, stretch.Scale("asinh", 300.0))).alias("asinh"),
    )


@query(
    "value_to_t",
    f"WITH {NB}, s AS (SELECT pix, value AS v FROM b) SELECT pix, {S.r6('(v+500)/7500')} AS linear, "
    f"CASE WHEN v > 0 THEN {S.r6(f'({_lnv}-ln(20))/(ln(7000)-ln(20))')} END AS log, {S.r6('asinh(v/300)/asinh(7000/300.0::DOUBLE)')} AS asinh, "
    + ", ".join(
        f"{S.r6(f'({_term(chr(118), p)}-{_term(f'({BLO})', p)})/({_term(f'({BHI})', p)}-{_term(f'({BLO})', p)})')} AS {n}"
        for n, p in (("symlog", False), ("plancklog", True))
    )
    + " FROM s",
)
def value_to_t(spark, d):
    df, _ = X.sky_bipolar(spark, d)
    f = lambda lo, *a: r6(stretch.value_to_t("value", lo, BHI, stretch.Scale(*a))).alias(a[0])
    return df.select("pix", f(BLO, "linear"), f(20.0, "log"), f(BLO, "asinh", 300.0), f(BLO, "symlog", 200.0), f(BLO, "plancklog", 200.0))


@query(
    "classify",
    f"WITH {NO}, s AS (SELECT pix, CASE WHEN {S.SEEN} THEN (value-{LO})/({HI}-{LO}) END AS t FROM raw) "
    "SELECT pix, CASE WHEN t IS NULL THEN 'Bad' WHEN t <= 0 THEN 'Underflow' WHEN t >= 1 THEN 'Overflow' ELSE 'Color' END AS cls FROM s",
)
def classify(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    return df.select("pix", stretch.classify(stretch.scale_linear_norm("value", LO, HI)).alias("cls"))


_GAMMAS = {"g1": 1.0, "g2": 2.0, "g05": 0.5, "g3": 3.0, "g033": 0.333, "g17": 1.7}


@query(
    "gamma",
    f"{UNIT} SELECT pix, " + ", ".join(f"{S.r6(f'pow(t, {1/3 if k == chr(103) + '033' else g})')} AS {k}" for k, g in _GAMMAS.items()) + " FROM s",
)
def gamma(spark, d):
    return _unit(spark, d).select("pix", *[r6(stretch.gamma("t", g)).alias(k) for k, g in _GAMMAS.items()])


@query("cmap_index", f"{UNIT} SELECT pix, CAST(floor(greatest(0, least(1, t*1.2::DOUBLE-0.1::DOUBLE))*255) AS BIGINT) AS idx FROM s")
def cmap_index(spark, d):
    return _unit(spark, d).select("pix", stretch.cmap_index(F.col("t") * 1.2 - 0.1).cast("long").alias("idx"))
