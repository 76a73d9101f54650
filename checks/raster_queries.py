"""Queries of sampling, rasters, layers, tiles, tracks and map files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as S
from checks.registry import query
from checks.scalar_queries import _VIEW_SQL, hammer_forward_sql, mollweide_forward_sql
from skymap.functions import projections as P
from skymap.functions.frames import IDENTITY
from skymap.functions.pixels import npix_of
from skymap.functions.stretch import Scale, classify, scale_linear_norm
from skymap.operators import compare, histogram, limits, raster, tracks
from skymap.operators.masks import mask_from_pixels
from skymap.plans.sizing import materialize
from skymap.sources import fits, manifest

r6 = X.r6


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# -------------------------------------------------------------------- sampling (2.3)


@query(
    "sample_points",
    f"WITH {S.ORDERS}, {S.POINTS}, g AS (SELECT *, {S.sample_angles(_VIEW_SQL, 'theta', 'phi')} FROM pts, p), "
    f"r AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'pix')} FROM g) "
    f"SELECT point_id, pix, {S.r6('value')} AS value FROM r LEFT JOIN a USING (pix)",
)
def sample_points(spark, d):
    df, n = X.sky_orders(spark, d)
    pts = X.sky_points(spark, d).withColumn("map_id", F.lit("orders"))
    return raster.sample_points(pts, df, n, "RING", X.VIEW).select("point_id", "pix", r6("value").alias("value"))


# ------------------------------------------------------------------ cells, index (2.9)


@query(
    "raster_cells",
    "WITH r AS (SELECT s_name AS map_id, 11 + s_suppkey % 31 AS w, 6 + s_suppkey % 17 AS h FROM supplier), "
    "c AS (SELECT map_id, w, h, unnest(range(0, w)) AS x FROM r), c2 AS (SELECT *, unnest(range(0, h)) AS y FROM c) "
    f"SELECT map_id, x, y, {S.r6('x/(w - 1.0::DOUBLE)')} AS u, {S.r6('y/(h - 1.0::DOUBLE)')} AS v FROM c2",
)
def raster_cells(spark, d):
    k = F.col("s_suppkey")
    rasters = X.table(spark, d, "supplier").select(
        F.col("s_name").alias("map_id"), (k % 31 + 11).cast("int").alias("width"), (k % 17 + 6).cast("int").alias("height")
    )
    c = raster.cells_of_rasters(rasters)
    return c.select("map_id", *_long("x", "y"), r6("u").alias("u"), r6("v").alias("v"))


def _index_sql(table: str, w: str, h: str, proj: str, view=_VIEW_SQL) -> str:
    """CTEs up to ``ix``: x, y, pix of the valid cells of a w x h raster."""
    inverse = {
        "mollweide": S.mollweide_cell(w, h),
        "hammer": S.hammer_inverse(f"x/({w}-1.0::DOUBLE)", f"y/({h}-1.0::DOUBLE)"),
    }[proj]
    return (
        f"{S.cells(w, h)}, c1 AS (SELECT *, {inverse} FROM c0), c2 AS (SELECT x, y, nside, {S.HALF} - lat AS th0, lon FROM c1 WHERE ok), "
        f"c3 AS (SELECT *, {S.sample_angles(view, 'th0', 'lon')} FROM c2), "
        f"ix AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'pix')} FROM c3)"
    )


W, H = "(4*nside)", "(2*nside)"


def _proj(kind: str, n: int) -> raster.Projection:
    return raster.Projection(kind, 4 * n, 2 * n)


@query(
    "raster_index",
    f"WITH {S.params('orders')}, {_index_sql('orders', W, H, 'mollweide')}, ids AS (SELECT DISTINCT l_returnflag || l_linestatus AS map_id FROM lineitem) "
    "SELECT map_id, x, y, pix FROM ix, ids",
)
def raster_index(spark, d):
    n = X.nside_of(spark, d, "orders")
    index = raster.raster_index(spark, _proj(P.MOLLWEIDE, n), n, "RING", X.VIEW)
    out = raster.index_of_maps(X.multi_maps(spark, d, n), index, _proj(P.MOLLWEIDE, n))
    return out.select("map_id", *_long("x", "y"), "pix")


_LIM = "lim AS (SELECT map_id, quantile_cont(value, 0.05) AS minv, quantile_cont(value, 0.95) AS maxv FROM {t} GROUP BY 1)"
_TT = "CASE WHEN value IS NULL THEN NULL WHEN value <= minv THEN 0.0 WHEN value >= maxv THEN 1.0 ELSE (value-minv)/(maxv-minv) END AS t"
_COLOUR = """CASE WHEN t IS NULL THEN 'Bad' WHEN t <= 0 THEN 'Underflow' WHEN t >= 1 THEN 'Overflow' ELSE 'Color' END AS cls,
  CASE WHEN t IS NULL THEN NULL ELSE CAST(floor(pow(greatest(0, least(1, t)), {g})*255) AS BIGINT) END AS idx, coalesce(idx, 128) AS r"""


def _raster_sql(src: str, t: str, proj: str, g: float, mask: str = "") -> str:
    return (
        f"WITH {src}, {_index_sql('orders', W, H, proj)}, {_LIM.format(t=t)}, "
        f"j AS (SELECT lim.map_id, ix.x, ix.y, ix.pix, {t}.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN {t} ON {t}.map_id = lim.map_id AND {t}.pix = ix.pix), "
        f"s AS (SELECT *, {_TT} FROM j), k AS (SELECT *, {_COLOUR.format(g=g)} FROM s) " + mask
    )


_OUT = f"map_id, x, y, k.pix, {S.r6('value')} AS value, cls, {S.r6('t')} AS t, idx"


@query(
    "reproject",
    _raster_sql(S.MULTI + ", " + S.mask_parts(), "m", "mollweide", 0.5)
    + f"SELECT {_OUT}, CASE WHEN coalesce(valid, true) THEN r ELSE 1 END AS r, CASE WHEN coalesce(valid, true) THEN 255 ELSE 4 END AS alpha FROM k LEFT JOIN mk ON mk.pix = k.pix",
)
def reproject(spark, d):
    df, n = X.stored_multi(spark, d)
    maps = X.multi_maps(spark, d, n)
    lim = materialize(limits.auto_limits(df, npix_of(n)))
    out = raster.reproject(
        df, maps, lim, _proj(P.MOLLWEIDE, n), n, "RING", X.lut_gray(spark), X.VIEW, g=0.5,
        mask=X.mask_parts(spark, d, npix_of(n)), mask_nside=n, fill=(1, 2, 3, 4),
    )
    return out.select(
        "map_id", *_long("x", "y"), "pix", r6("value").alias("value"), "cls", r6("t").alias("t"), *_long("idx"),
        F.col("rgba.r").cast("long").alias("r"), F.col("rgba.a").cast("long").alias("alpha"),
    )


def _render(f):
    def run(spark, d):
        df, n = X.sky_orders(spark, d)
        lim = materialize(limits.auto_limits(df, npix_of(n)))
        out = f(df, X.one_map(spark, "orders", n), lim, 4 * n, n, "RING", lut=X.lut_gray(spark), view=X.VIEW, n_maps=1)
        return out.select(
            "map_id", *_long("x", "y"), "pix", r6("value").alias("value"), "cls", r6("t").alias("t"), *_long("idx"),
            F.col("rgba.r").cast("long").alias("r"),
        )

    return run


for _name, _kind, _f in (
    ("render_mollweide", "mollweide", raster.render_mollweide),
    ("render_hammer", "hammer", raster.render_hammer),
):
    query(_name, _raster_sql(S.ORDERS, "a", _kind, 1.0) + f"SELECT {_OUT}, r FROM k")(_render(_f))

# A cut-out of 2 nside cells a side covers 40 degrees at every size of table.
_SIDE = 1200.0
_D = f"({P.arcmin(_SIDE)!r}/nside)"


def _res(n: int) -> float:
    return _SIDE / n


_TAN = P.tangent_matrix(266.4, -28.9, 0.25)


def _gnomonic_index(w: str) -> str:
    return (
        f"{S.cells(w, w)}, c1 AS (SELECT *, -({w}/2.0::DOUBLE)*{_D} + x*{_D} AS dx, -({w}/2.0::DOUBLE)*{_D} + y*{_D} AS dy, "
        f"{S.rotate(_TAN, '1.0::DOUBLE', '-dx', '-dy', ('tx', 'ty', 'tz'))}, atan2(ty, tx) AS lon, {S.HALF} - asin(tz/sqrt(tx*tx+ty*ty+tz*tz)) AS th0 FROM c0), "
        f"c3 AS (SELECT *, {S.sample_angles(IDENTITY, 'th0', 'lon')} FROM c1), ix AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'pix')} FROM c3)"
    )


def _gnomonic(n: int) -> raster.Projection:
    return raster.Projection(P.GNOMONIC, 2 * n, 2 * n, _res(n), 266.4, -28.9, 0.25)


_FOV = f"WITH {S.ORDERS}, {_gnomonic_index('(2*nside)')}, hit AS (SELECT map_id, value FROM ix JOIN a USING (pix))"


@query(
    "fov_limits",
    f"{_FOV} SELECT map_id, {S.r6('quantile_cont(value, 0.05)')} AS minv, {S.r6('quantile_cont(value, 0.95)')} AS maxv FROM hit GROUP BY 1",
)
def fov_limits(spark, d):
    df, n = X.sky_orders(spark, d)
    proj = _gnomonic(n)
    index = materialize(raster.raster_index(spark, proj, n, "RING"))
    out = limits.fov_limits(df, index, proj.width * proj.height, npix_of(n))
    return out.select("map_id", r6("minv").alias("minv"), r6("maxv").alias("maxv"))


# The middle of the grid is the centre itself, whatever the roll.
_UNIT_AT = (266.513, -28.937, 0.21)
_UNIT_TAN = P.tangent_matrix(*_UNIT_AT)
_UNIT = (
    f"WITH {S.ORDERS}, {S.cells('(2*nside)', '(2*nside)')}, c1 AS (SELECT *, 2*x/(2.0::DOUBLE*nside) - 1 AS dx, 2*y/(2.0::DOUBLE*nside) - 1 AS dy, "
    f"{S.rotate(_UNIT_TAN, '1.0::DOUBLE', '-dx', '-dy', ('tx', 'ty', 'tz'))}, dx = 0 AND dy = 0 AS mid, CASE WHEN mid THEN radians({_UNIT_AT[0]}) ELSE atan2(ty, tx) END AS lon, "
    f"{S.HALF} - CASE WHEN mid THEN radians({_UNIT_AT[1]}) ELSE asin(tz/sqrt(tx*tx+ty*ty+tz*tz)) END AS th0 FROM c0), "
    f"c3 AS (SELECT *, {S.sample_angles(IDENTITY, 'th0', 'lon')} FROM c1), ix AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'pix')} FROM c3), "
    "hit AS (SELECT map_id, value FROM ix JOIN a USING (pix))"
)


@query(
    "fov_limits_unit",
    f"{_UNIT} SELECT map_id, {S.r6('quantile_cont(value, 0.05)')} AS minv, {S.r6('quantile_cont(value, 0.95)')} AS maxv FROM hit GROUP BY 1",
)
def fov_limits_unit(spark, d):
    df, n = X.sky_orders(spark, d)
    proj = raster.Projection(P.GNOMONIC, 2 * n, 2 * n, _res(n), *_UNIT_AT)
    hits = materialize(raster.unit_hits(spark, proj, n, "RING"))
    out = limits.fov_limits(df, hits, proj.width * proj.width, npix_of(n))
    return out.select("map_id", r6("minv").alias("minv"), r6("maxv").alias("maxv"))


@query(
    "render_gnomonic",
    f"{_FOV}, lim AS (SELECT map_id, quantile_cont(value, 0.05) AS minv, quantile_cont(value, 0.95) AS maxv FROM hit GROUP BY 1), "
    f"j AS (SELECT 'orders' AS map_id, ix.x, ix.y, ix.pix, a.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN a ON a.pix = ix.pix), "
    f"s AS (SELECT *, {_TT} FROM j) SELECT x, y, pix, {S.r6('value')} AS value, {S.r6('t')} AS t FROM s",
)
def render_gnomonic(spark, d):
    df, n = X.sky_orders(spark, d)
    proj = _gnomonic(n)
    index = materialize(raster.raster_index(spark, proj, n, "RING"))
    lim = materialize(limits.fov_limits(df, index, proj.width * proj.height, npix_of(n)))
    out = raster.render_gnomonic(
        df, X.one_map(spark, "orders", n), lim, 2 * n * _res(n), _res(n), 266.4, -28.9, n, "RING", roll=0.25, index=index, n_maps=1
    )
    return out.select(*_long("x", "y"), "pix", r6("value").alias("value"), r6("t").alias("t"))


# ------------------------------------------------------------------------- colour


@query(
    "colorize",
    f"WITH {S.RAW}, s AS (SELECT pix, CASE WHEN {S.SEEN} THEN (value - 50000.0)/350000.0 END AS t FROM raw), "
    "k AS (SELECT pix, t, CASE WHEN t IS NULL THEN NULL ELSE CAST(floor(greatest(0, least(1, t))*255) AS BIGINT) END AS idx FROM s) "
    "SELECT pix, CASE WHEN t IS NULL THEN 'Bad' WHEN t <= 0 THEN 'Underflow' WHEN t >= 1 THEN 'Overflow' ELSE 'Color' END AS cls, idx, "
    "coalesce(255 - idx, 10) AS r, coalesce(255 - idx, 20) AS g, CASE WHEN idx IS NULL THEN 40 ELSE 255 END AS alpha FROM k",
)
def colorize(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    t = df.select("pix", scale_linear_norm("value", 50_000.0, 400_000.0).alias("t"))
    out = raster.colorize(t, X.lut_gray(spark, "reversed"), bad=(10, 20, 30, 40))
    return out.select(
        "pix", "cls", *_long("idx"), F.col("rgba.r").cast("long").alias("r"), F.col("rgba.g").cast("long").alias("g"), F.col("rgba.a").cast("long").alias("alpha")
    )


@query(
    "cmap_ends",
    f"WITH {S.BIPOLAR}, t AS (SELECT pix, (value - 1000.0)/3000.0 AS t FROM b) SELECT pix, CASE WHEN t <= 0 THEN 255 WHEN t >= 1 THEN 0 "
    "ELSE 255 - (pix % 200 + 20) END AS r FROM t",
)
def cmap_ends(spark, d):
    """Both ends take the ends of the colour table, the rows between a colour of their own."""
    df, _ = X.sky_bipolar(spark, d)
    own = (F.col("pix") % 200 + 20).cast("int")
    out = df.select("pix", classify(scale_linear_norm("value", 1000.0, 4000.0)).alias("cls"), own.alias("idx"))
    return raster.with_colour(out, X.lut_gray(spark, "reversed")).select("pix", F.col("rgba.r").cast("long").alias("r"))


def _gray_raster(spark, d, proj: str):
    """Cells (map_id, x, y, rgba, r, g, b) of the order map."""
    df, n = X.sky_orders(spark, d)
    lim = materialize(limits.auto_limits(df, npix_of(n)))
    out = raster.reproject(df, X.one_map(spark, "orders", n), lim, _proj(proj, n), n, "RING", X.lut_gray(spark), X.VIEW, n_maps=1)
    return out.select("map_id", "x", "y", "rgba", "rgba.r", "rgba.g", "rgba.b")


def _two_rasters(final: str) -> str:
    """Both projections of the order map as CTEs ``ka`` (Mollweide) and ``kb`` (Hammer)."""
    parts = [f"WITH {S.ORDERS}, {_LIM.format(t='a')}"]
    for tag, proj in (("a", "mollweide"), ("b", "hammer")):
        ctes = _index_sql("orders", W, H, proj)
        for name in ("c0", "c1", "c2", "c3", "ix"):
            ctes = ctes.replace(f"{name} AS (", f"{name}{tag} AS (").replace(f"FROM {name})", f"FROM {name}{tag})").replace(f"FROM {name} ", f"FROM {name}{tag} ")
        parts.append(ctes)
        parts.append(
            f"j{tag} AS (SELECT ix{tag}.x, ix{tag}.y, a.value, minv, maxv FROM ix{tag} CROSS JOIN lim LEFT JOIN a ON a.pix = ix{tag}.pix), "
            f"s{tag} AS (SELECT *, {_TT} FROM j{tag}), k{tag} AS (SELECT *, {_COLOUR.format(g=1.0)} FROM s{tag})"
        )
    return ", ".join(parts) + " " + final


@query(
    "raster_compare",
    _two_rasters(
        f"SELECT 'orders' AS map_id, CAST(max(abs(ka.r-kb.r)) AS DOUBLE) AS max_diff, {S.r6('avg(CAST(abs(ka.r-kb.r) AS DOUBLE))')} AS mean_diff, "
        f"count(*) FILTER (abs(ka.r-kb.r) > 5) AS differing, {S.r6('count(*) FILTER (abs(ka.r-kb.r) > 5)*100.0::DOUBLE/count(*)')} AS differing_pct FROM ka JOIN kb USING (x, y)"
    ),
)
def raster_compare(spark, d):
    a, b = _gray_raster(spark, d, P.MOLLWEIDE), _gray_raster(spark, d, P.HAMMER)
    out = compare.raster_compare(a, b)
    return out.withColumns({"mean_diff": r6("mean_diff"), "differing_pct": r6("differing_pct")})


@query(
    "layer_union",
    _two_rasters("SELECT coalesce(kb.x, ka.x) AS x, coalesce(kb.y, ka.y) AS y, coalesce(kb.r, ka.r) AS r FROM ka FULL JOIN kb ON ka.x = kb.x AND ka.y = kb.y"),
)
def layer_union(spark, d):
    out = raster.layer_union([_gray_raster(spark, d, P.MOLLWEIDE), _gray_raster(spark, d, P.HAMMER)])
    return out.select(*_long("x", "y"), F.col("rgba.r").cast("long").alias("r"))


@query(
    "raster_sink",
    f"WITH {S.ORDERS}, {_index_sql('orders', W, H, 'mollweide')} SELECT x + 10 AS x, y + 20 AS y, (x + 10)//64 AS tile_x, (y + 20)//64 AS tile_y, ix.pix, {S.r6('value')} AS value FROM ix LEFT JOIN a ON a.pix = ix.pix",
)
def raster_sink(spark, d):
    df, n = X.sky_orders(spark, d)
    index = raster.raster_index(spark, _proj(P.MOLLWEIDE, n), n, "RING", X.VIEW)
    cells = raster.raster_values(df, X.one_map(spark, "orders", n), index, _proj(P.MOLLWEIDE, n))
    path = X.new_folder(spark, "raster")
    raster.write_raster(cells, path, 10, 20, 64)
    back = spark.read.parquet(path)
    return back.select(*_long("x", "y", "tile_x", "tile_y"), "pix", r6("value").alias("value"))


@query(
    "tile_partition",
    "WITH r AS (SELECT s_name AS map_id, 100 + s_suppkey % 301 AS w, 60 + s_suppkey % 173 AS h FROM supplier), "
    "t AS (SELECT map_id, w, h, unnest(range(0, (w + 63)//64)) AS tx FROM r), t2 AS (SELECT *, unnest(range(0, (h + 63)//64)) AS ty FROM t) "
    "SELECT map_id, tx*64 AS x0, ty*64 AS y0, least(64, w - tx*64) AS w, least(64, h - ty*64) AS h FROM t2",
)
def tile_partition(spark, d):
    k = F.col("s_suppkey")
    r = X.table(spark, d, "supplier").select(
        F.col("s_name").alias("map_id"), (k % 301 + 100).cast("int").alias("width"), (k % 173 + 60).cast("int").alias("height")
    )
    return raster.partition_tiles(r, 64).select("map_id", *_long("x0", "y0", "w", "h"))


# ----------------------------------------------------------------- tracks (2.5, 2.11)


def _track_vec(src: str) -> str:
    """``tv``: track points as view vectors vx, vy, vz and angles tlon, tlat."""
    m = _VIEW_SQL
    return (
        f"{src}, t0 AS (SELECT track_id, seq, cos(lat)*cos(lon) AS ax, cos(lat)*sin(lon) AS ay, sin(lat) AS az FROM tr), "
        f"tv AS (SELECT *, {S.rotate(m, 'ax', 'ay', 'az', ('vx', 'vy', 'vz'))}, atan2(vy, vx) AS tlon, asin(greatest(-1, least(1, vz/sqrt(vx*vx+vy*vy+vz*vz)))) AS tlat FROM t0)"
    )


def _track_uv(src: str, proj: str) -> str:
    body = (mollweide_forward_sql if proj == "mollweide" else hammer_forward_sql)("tlon", "tlat")
    return (
        f"{_track_vec(src)}, tp0 AS (SELECT *, {body}, ok AND u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AS inside FROM tv), "
        "tp AS (SELECT track_id, seq, CASE WHEN inside THEN u END AS u, CASE WHEN inside THEN v END AS v FROM tp0)"
    )


def _tracks(spark, d, kind: str):
    return X.tracks_grid(spark, d) if kind == "grid" else tracks.dense_seq(X.tracks_users(spark, d))


def _projected(spark, d, kind: str, proj: str = P.MOLLWEIDE):
    n = X.nside_of(spark, d, "orders")
    return tracks.track_project(_tracks(spark, d, kind), _proj(proj, n), "G", "G", X.VIEW)


for _name, _kind, _pr in (("track_project", "users", "mollweide"), ("track_project_hammer", "grid", "hammer")):
    query(
        _name,
        f"WITH {_track_uv(S.USERS if _kind == 'users' else S.GRID, _pr)} SELECT track_id, seq, {S.r6('u')} AS u, {S.r6('v')} AS v FROM tp",
    )(lambda spark, d, k=_kind, p=_pr: _projected(spark, d, k, p).select("track_id", "seq", r6("u").alias("u"), r6("v").alias("v")))

_GN = (
    "gp AS (SELECT track_id, seq, {w}/2.0::DOUBLE - vx/vz/" + _D + " AS px, {w}/2.0::DOUBLE - vy/vz/" + _D + " AS py FROM tv, p WHERE vz > 0)"
)


def _gnomonic_tracks(spark, d, kind: str):
    n = X.nside_of(spark, d, "orders")
    return tracks.track_project_gnomonic(_tracks(spark, d, kind), 2 * n, _res(n), "G", "G", X.VIEW), n


@query(
    "track_project_gnomonic",
    f"WITH {S.params('orders')}, {_track_vec(S.GRID)}, {_GN.format(w='(2*nside)')} SELECT track_id, seq, round(px, 4) AS px, round(py, 4) AS py FROM gp",
)
def track_project_gnomonic(spark, d):
    df, _ = _gnomonic_tracks(spark, d, "grid")
    return df.filter("px is not null").select("track_id", "seq", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query(
    "track_project_tangent",
    f"WITH {S.params('orders')}, {S.GRID} SELECT track_id, seq, CASE WHEN cos(lat)*cos(lon) > 0 THEN round(nside - tan(lon)/{_D}, 4) END AS px, "
    f"CASE WHEN cos(lat)*cos(lon) > 0 THEN round(nside - tan(lat)/cos(lon)/{_D}, 4) END AS py FROM tr, p",
)
def track_project_tangent(spark, d):
    n = X.nside_of(spark, d, "orders")
    df = tracks.track_project_tangent(X.tracks_grid(spark, d), 2 * n, _res(n))
    return df.select("track_id", "seq", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


def _breaks_sql(src: str) -> str:
    """Walks every track point by point (recursive), the plain form of the rule."""
    return (
        f"WITH RECURSIVE {_track_uv(src, 'mollweide')}, "
        "nx AS (SELECT *, max(seq) OVER (PARTITION BY track_id) AS last FROM tp), "
        "wk AS (SELECT track_id, seq, u, v, NULL::DOUBLE AS step, CASE WHEN u IS NULL THEN 0 ELSE 1 END AS len, CASE WHEN u IS NULL THEN -1 ELSE 0 END AS seg FROM nx WHERE seq = 0 "
        "UNION ALL SELECT n.track_id, n.seq, n.u, n.v, sqrt(power(n.u-w.u, 2) + power(n.v-w.v, 2)) AS step, "
        "CASE WHEN n.u IS NULL THEN 0 WHEN w.len = 0 OR sqrt(power(n.u-w.u, 2) + power(n.v-w.v, 2)) > (CASE WHEN w.len < 2 THEN 0.15 ELSE greatest(0.05, 3*w.step) END) THEN 1 ELSE w.len + 1 END AS len, "
        "CASE WHEN n.u IS NULL THEN w.seg WHEN w.len = 0 OR sqrt(power(n.u-w.u, 2) + power(n.v-w.v, 2)) > (CASE WHEN w.len < 2 THEN 0.15 ELSE greatest(0.05, 3*w.step) END) THEN w.seg + 1 ELSE w.seg END AS seg "
        "FROM wk w JOIN nx n ON n.track_id = w.track_id AND n.seq = w.seq + 1), "
        "sg AS (SELECT track_id, seg AS seg_id, seq, u, v, count(*) OVER (PARTITION BY track_id, seg) AS c FROM wk WHERE u IS NOT NULL), "
        "br AS (SELECT track_id, seg_id, seq, u, v FROM sg WHERE c > 1)"
    )


for _name, _kind in (("track_breaks", "users"), ("track_breaks_smooth", "grid")):
    query(
        _name,
        f"{_breaks_sql(S.USERS if _kind == 'users' else S.GRID)} SELECT track_id, CAST(seg_id AS BIGINT) AS seg_id, seq, {S.r6('u')} AS u, {S.r6('v')} AS v FROM br",
    )(
        lambda spark, d, k=_kind: tracks.track_breaks(_projected(spark, d, k)).select(
            "track_id", "seg_id", "seq", r6("u").alias("u"), r6("v").alias("v")
        )
    )

_PX = (
    f"WITH {S.params('orders')}, {_track_vec(S.GRID)}, {_GN.format(w='(2*nside)')}, "
    "dn AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS seq, px, py FROM gp), "
    "lg AS (SELECT track_id, seq, px, py, lag(px) OVER w AS lx, lag(py) OVER w AS ly FROM dn WINDOW w AS (PARTITION BY track_id ORDER BY seq)), "
    "sp AS (SELECT track_id, seq, px, py, sum(CASE WHEN sqrt(power(px-lx, 2) + power(py-ly, 2)) <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seq) - 1 AS seg_id FROM lg), "
    "sq AS (SELECT track_id, seg_id, seq, px AS a0, py AS b0, lead(px) OVER w AS a1, lead(py) OVER w AS b1 FROM sp WINDOW w AS (PARTITION BY track_id, seg_id ORDER BY seq))"
)


@query("track_breaks_px", f"{_PX} SELECT track_id, CAST(seg_id AS BIGINT) AS seg_id, seq, round(px, 4) AS px, round(py, 4) AS py FROM sp")
def track_breaks_px(spark, d):
    df, _ = _gnomonic_tracks(spark, d, "grid")
    return tracks.track_breaks_px(df).select("track_id", "seg_id", "seq", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


_SEG = (
    f"{_breaks_sql(S.GRID)}, sq AS (SELECT track_id, seg_id, seq, u AS a0, v AS b0, lead(u) OVER w AS a1, lead(v) OVER w AS b1 FROM br WINDOW w AS (PARTITION BY track_id, seg_id ORDER BY seq)), "
    "sm AS (SELECT * FROM sq WHERE a1 IS NOT NULL)"
)


def _segments(spark, d):
    return tracks.track_segments(tracks.track_breaks(_projected(spark, d, "grid")))


@query(
    "track_segments",
    f"{_SEG} SELECT track_id, CAST(seg_id AS BIGINT) AS seg_id, seq, " + ", ".join(f"{S.r6(c)} AS {c}" for c in ("a0", "b0", "a1", "b1")) + " FROM sm",
)
def track_segments(spark, d):
    return _segments(spark, d).select("track_id", "seg_id", "seq", *[r6(c).alias(c) for c in ("a0", "b0", "a1", "b1")])


@query(
    "track_raster_dda",
    _SEG.replace("WITH RECURSIVE ", f"WITH RECURSIVE {S.params('orders')}, ") + ", cc AS (SELECT track_id, seg_id, seq, nside, CAST(trunc(a0*(4*nside-1)) AS BIGINT) AS x0, CAST(trunc(b0*(2*nside-1)) AS BIGINT) AS y0, "
    "CAST(trunc(a1*(4*nside-1)) AS BIGINT) AS x1, CAST(trunc(b1*(2*nside-1)) AS BIGINT) AS y1 FROM sm, p), "
    "nn AS (SELECT *, greatest(abs(x1-x0), abs(y1-y0)) AS n FROM cc), wk2 AS (SELECT *, unnest(range(0, n+1)) AS i FROM nn WHERE n > 0) "
    "SELECT track_id, CAST(seg_id AS BIGINT) AS seg_id, seq, CAST(round((1 - i/n::DOUBLE)*x0 + i/n::DOUBLE*x1) AS BIGINT) AS x, CAST(round((1 - i/n::DOUBLE)*y0 + i/n::DOUBLE*y1) AS BIGINT) AS y FROM wk2",
)
def track_raster_dda(spark, d):
    n = X.nside_of(spark, d, "orders")
    return tracks.track_raster_dda(_segments(spark, d), 4 * n, 2 * n).select("track_id", "seg_id", "seq", *_long("x", "y"))


@query(
    "track_raster_bres",
    # A step of one cell along the long side; across it, the least k whose upper edge is not below
    # the line half a step ahead.
    f"{_PX}, cc AS (SELECT track_id, seg_id, seq, 2*nside AS w, CAST(trunc(a0) AS BIGINT) AS x0, CAST(trunc(b0) AS BIGINT) AS y0, CAST(trunc(a1) AS BIGINT) AS x1, CAST(trunc(b1) AS BIGINT) AS y1 FROM sq, p WHERE a1 IS NOT NULL), "
    "ln AS (SELECT *, greatest(abs(x1-x0), abs(y1-y0)) AS far, least(abs(x1-x0), abs(y1-y0)) AS near, abs(x1-x0) >= abs(y1-y0) AS flat FROM cc), "
    "st AS (SELECT track_id, seg_id, seq, w, x0, y0, sign(x1-x0) AS sx, sign(y1-y0) AS sy, far, near, flat, unnest(range(0, far + 1)) AS i FROM ln), "
    "pl AS (SELECT *, list_min(list_filter(range(0, near + 1), lambda k: (k + 0.5)*far >= (i + 0.5)*near)) AS k FROM st), "
    "ce AS (SELECT track_id, seg_id, seq, w, x0 + sx*(CASE WHEN flat THEN i ELSE k END) AS x, y0 + sy*(CASE WHEN flat THEN k ELSE i END) AS y FROM pl) "
    "SELECT track_id, CAST(seg_id AS BIGINT) AS seg_id, seq, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM ce WHERE x >= 0 AND y >= 0 AND x < w AND y < w",
)
def track_raster_bres(spark, d):
    df, n = _gnomonic_tracks(spark, d, "grid")
    segs = tracks.track_segments(tracks.track_breaks_px(df), "px", "py")
    return tracks.track_raster_bres(segs, 2 * n, 2 * n).select("track_id", "seg_id", "seq", *_long("x", "y"))


_DDA = (
    "cc AS (SELECT track_id, seg_id, seq, nside, CAST(trunc(a0*(4*nside-1)) AS BIGINT) AS x0, CAST(trunc(b0*(2*nside-1)) AS BIGINT) AS y0, "
    "CAST(trunc(a1*(4*nside-1)) AS BIGINT) AS x1, CAST(trunc(b1*(2*nside-1)) AS BIGINT) AS y1 FROM sm, p), "
    "nn AS (SELECT *, greatest(abs(x1-x0), abs(y1-y0)) AS n FROM cc), wk2 AS (SELECT *, unnest(range(0, n+1)) AS i FROM nn WHERE n > 0), "
    "tc AS (SELECT DISTINCT CAST(round((1 - i/n::DOUBLE)*x0 + i/n::DOUBLE*x1) AS BIGINT) AS x, CAST(round((1 - i/n::DOUBLE)*y0 + i/n::DOUBLE*y1) AS BIGINT) AS y FROM wk2)"
)


@query(
    "draw_tracks",
    _SEG.replace("WITH RECURSIVE ", f"WITH RECURSIVE {S.ORDERS}, ")
    + f", {_DDA}, {_index_sql('orders', W, H, 'mollweide')}, {_LIM.format(t='a')}, "
    f"j AS (SELECT ix.x, ix.y, a.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN a ON a.pix = ix.pix), s AS (SELECT *, {_TT} FROM j), k AS (SELECT *, {_COLOUR.format(g=1.0)} FROM s) "
    "SELECT coalesce(tc.x, k.x) AS x, coalesce(tc.y, k.y) AS y, CASE WHEN tc.x IS NULL THEN k.r ELSE 0 END AS r FROM k FULL JOIN tc ON tc.x = k.x AND tc.y = k.y",
)
def draw_tracks(spark, d):
    """Tracks over the order map: both raster layers stacked."""
    n = X.nside_of(spark, d, "orders")
    cells = tracks.draw_tracks(X.tracks_grid(spark, d), _proj(P.MOLLWEIDE, n), "G", "G", X.VIEW)
    lines = tracks.cells_as_layer(cells, map_id=F.lit("orders"))
    out = raster.layer_union([_gray_raster(spark, d, P.MOLLWEIDE), lines])
    return out.select(*_long("x", "y"), F.col("rgba.r").cast("long").alias("r"))


# ------------------------------------------------------------------- map files (2.1)

_CHUNK = "ch AS (SELECT o_orderkey // 3072 AS n, o_orderkey % 3072 AS pix, o_totalprice AS v FROM orders), nf AS (SELECT DISTINCT n FROM ch)"
_FULL = f"WITH {_CHUNK}, g AS (SELECT n, i AS pix FROM nf, (SELECT unnest(range(0, 3072)) AS i)), f AS (SELECT n, pix, v FROM g LEFT JOIN ch USING (n, pix))"
_NAME = "'m' || lpad(CAST(n AS VARCHAR), 6, '0') || '#{c}' AS map_id"


def _columns(spark, d, kind: str):
    folder = X.write_dense(spark, d, kind, X.new_folder(spark, f"dense-{kind}"))
    return fits.describe_maps(fits.list_files(spark, folder))


def _dense(kind: str, cols: list[int]):
    def run(spark, d):
        out = fits.read_maps(_columns(spark, d, kind), cols)
        return out.select(X.stem().alias("map_id"), "pix", r6(seen_value()).alias("value"))

    return run


def seen_value():
    from skymap.functions.values import seen_or_null

    return seen_or_null(F.col("value"))


query(
    "src_dense_f32",
    f"{_FULL} SELECT {_NAME.format(c=0)}, pix, {S.r6('CAST(CAST(v AS FLOAT) AS DOUBLE)')} AS value FROM f UNION ALL SELECT {_NAME.format(c=1)}, pix, CAST(pix AS DOUBLE) FROM f",
)(_dense("f32", [0, 1]))
query("src_dense_f64", f"{_FULL} SELECT {_NAME.format(c=0)}, pix, {S.r6('v')} AS value FROM f")(_dense("f64", [0]))
query(
    "src_dense_mixed",
    f"{_FULL} SELECT {_NAME.format(c=1)}, pix, CAST(coalesce(round_even(v, 0), -1) AS DOUBLE) AS value FROM f",
)(_dense("mixed", [1]))


@query(
    "src_sparse_explicit",
    f"WITH {S.params('orders')}, s AS (SELECT (o_orderkey*7919) % npix - 100 AS pix, o_totalprice AS v, npix FROM orders, p) "
    f"SELECT pix, {S.r6('CAST(CAST(v AS FLOAT) AS DOUBLE)')} AS value FROM s WHERE pix BETWEEN 0 AND npix - 1",
)
def src_sparse_explicit(spark, d):
    folder = X.write_sparse(spark, d, X.new_folder(spark, "sparse"))
    out = fits.read_maps(fits.describe_maps(fits.list_files(spark, folder)), [0])
    return out.select("pix", r6("value").alias("value"))


_META = f"WITH {_CHUNK} SELECT 'm' || lpad(CAST(n AS VARCHAR), 6, '0') || '#' || c AS map_id, 16 AS nside, CASE WHEN n % 2 = 1 THEN 'RING' ELSE 'NESTED' END AS ordering, substr('GCE', CAST(n % 3 AS INT) + 1, 1) AS coord, 'IMPLICIT' AS indxschm, 'float' AS dtype, c AS col FROM nf, (SELECT unnest([0, 1]) AS c)"


@query("src_metadata", _META.replace("c AS col", "CAST(c AS BIGINT) AS col").replace("16 AS nside", "CAST(16 AS BIGINT) AS nside"))
def src_metadata(spark, d):
    m = fits.map_metadata(_columns(spark, d, "f32"))
    return m.select(X.stem().alias("map_id"), "nside", "ordering", "coord", "indxschm", "dtype", *_long("col"))


@query(
    "describe_maps",
    f"WITH {_CHUNK} SELECT 'm' || lpad(CAST(n AS VARCHAR), 6, '0') AS file, CAST(c AS BIGINT) AS col, CASE WHEN c = 0 THEN 'TAG' ELSE 'COUNTS' END AS name, "
    "CASE WHEN c = 0 THEN '3A' ELSE '1J' END AS tform, CAST(c*3 AS BIGINT) AS col_offset, CAST(7 AS BIGINT) AS row_bytes, CAST(3072 AS BIGINT) AS n_rows FROM nf, (SELECT unnest([0, 1]) AS c)",
)
def describe_maps(spark, d):
    c = _columns(spark, d, "mixed")
    return c.select(X.stem("path").alias("file"), *_long("col"), "name", "tform", "col_offset", "row_bytes", "n_rows")


@query(
    "src_mask",
    f"{_FULL} SELECT 'k' || lpad(CAST(n AS VARCHAR), 6, '0') || '#0' AS mask_id, pix, coalesce(v > 100000, false) AS valid, CAST(16 AS BIGINT) AS nside, 'G' AS coord FROM f",
)
def src_mask(spark, d):
    folder = X.write_masks(spark, d, X.new_folder(spark, "masks"))
    columns = fits.describe_maps(fits.list_files(spark, folder))
    m = mask_from_pixels(fits.read_maps(columns, [0]), fits.map_metadata(columns))
    return m.select(X.stem("mask_id").alias("mask_id"), "pix", "valid", "nside", "coord")


@query("ingest_incremental", f"{_FULL} SELECT {_NAME.format(c=0)}, pix, {S.r6('v')} AS value FROM f")
def ingest_incremental(spark, d):
    """Two runs over the same files: the second finds nothing new."""
    folder = X.write_dense(spark, d, "f64", X.new_folder(spark, "incoming"))
    store = X.new_folder(spark, "store")
    manifest.ingest_incremental(spark, folder, store)
    again = manifest.ingest_incremental(spark, folder, store)
    pixels = manifest.current(spark.read.parquet(f"{store}/pixels"), spark.read.parquet(f"{store}/manifest"))
    fresh = again.select("map_id").withColumn("new", F.lit(True))
    out = pixels.join(fresh, "map_id", "left").filter("new is null")
    return out.select(X.stem().alias("map_id"), "pix", r6(seen_value()).alias("value"))
