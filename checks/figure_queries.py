"""Rasters under every stretch, and whole figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as S
from checks.raster_queries import _CHUNK, _COLOUR, _LIM, _TT, H, W, _index_sql, _proj
from checks.registry import query
from checks.scalar_queries import _VIEW_SQL, _term
from checks.table_queries import BINS, RANKED
from skymap.functions import projections as P
from skymap.functions.frames import view_matrix
from skymap.functions.pixels import npix_of
from skymap.functions.stretch import Scale
from skymap.operators import histogram, limits, raster
from skymap.plans.figure import figure, figure_files
from skymap.plans.sizing import materialize
from skymap.sources import fits

r6 = X.r6

_CLAMPED = "greatest(0, least(1, ({v}-{lo})/({hi}-{lo})))"


def _by(term) -> str:
    return _CLAMPED.format(v=term("value"), lo=term("minv"), hi=term("maxv"))


_LOGS = "CASE WHEN value <= 0 THEN NULL ELSE " + _by(lambda x: f"ln(CASE WHEN {x} > 0 THEN {x} ELSE 1 END)") + " END"
# kind: (table of the map, its fixture, parameter, stretch)
_KINDS = {
    "log": ("orders", "a", S.ORDERS, 1.0, _LOGS),
    "asinh": ("customer", "b", S.BIPOLAR, 300.0, _by(lambda x: f"asinh({x}/300)")),
    "symlog": ("customer", "b", S.BIPOLAR, 200.0, _by(lambda x: _term(x, False))),
    "plancklog": ("customer", "b", S.BIPOLAR, 200.0, _by(lambda x: _term(x, True))),
}
_OUT = f"map_id, x, y, {S.r6('value')} AS value, cls, {S.r6('t')} AS t, idx"


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _shown(out):
    return out.select("map_id", *_long("x", "y"), r6("value").alias("value"), "cls", r6("t").alias("t"), *_long("idx"))


def _stretched(kind: str):
    name, t, src, param, body = _KINDS[kind]
    sql = (
        f"WITH {src}, {_index_sql(name, W, H, 'mollweide')}, {_LIM.format(t=t)}, "
        f"j AS (SELECT lim.map_id, ix.x, ix.y, {t}.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN {t} ON {t}.pix = ix.pix), "
        f"s AS (SELECT *, CASE WHEN value IS NULL THEN NULL ELSE {body} END AS t FROM j), k AS (SELECT *, {_COLOUR.format(g=1.0)} FROM s) SELECT {_OUT} FROM k"
    )

    @query(f"reproject_{kind}", sql)
    def run(spark, d):
        df, n = X.sky_orders(spark, d) if name == "orders" else X.sky_bipolar(spark, d)
        lim = materialize(limits.auto_limits(df, npix_of(n)))
        out = raster.reproject(
            df, X.one_map(spark, name, n), lim, _proj(P.MOLLWEIDE, n), n, "RING", X.lut_gray(spark), X.VIEW, Scale(kind, param), n_maps=1
        )
        return _shown(out)


for _kind in _KINDS:
    _stretched(_kind)


@query(
    "reproject_histogram",
    f"{RANKED}, {_index_sql('orders', W, H, 'mollweide')}, "
    "j AS (SELECT lim.map_id, ix.x, ix.y, m.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN m ON m.map_id = lim.map_id AND m.pix = ix.pix), "
    "l0 AS (SELECT j.map_id, j.x, j.y, j.value, minv, maxv, max(kn.k) AS k0 FROM j LEFT JOIN kn ON kn.map_id = j.map_id AND kn.value <= j.value GROUP BY ALL), "
    "l1 AS (SELECT l0.*, c.value AS x0, c.cdf AS p0, e.value AS x1, e.cdf AS p1 FROM l0 LEFT JOIN kn c ON c.map_id = l0.map_id AND c.k = k0 LEFT JOIN kn e ON e.map_id = l0.map_id AND e.k = coalesce(k0, -1) + 1), "
    "s AS (SELECT map_id, x, y, value, CASE WHEN value IS NULL THEN NULL WHEN value <= minv THEN 0.0 WHEN value >= maxv THEN 1.0 WHEN x0 IS NULL THEN 0.0 WHEN x0 = value THEN p0 WHEN x1 IS NULL THEN 1.0 "
    f"ELSE p0 + (value-x0)/(x1-x0)*(p1-p0) END AS t FROM l1), k AS (SELECT *, {_COLOUR.format(g=1.0)} FROM s) SELECT {_OUT} FROM k",
)
def reproject_histogram(spark, d):
    df, n = X.stored_multi(spark, d)
    knots = materialize(histogram.knot_arrays(histogram.hist_knots(df, npix_of(n), BINS)))
    lim = materialize(histogram.hist_range(df, histogram.HistogramRange(), npix_of(n)))
    out = raster.reproject(
        df, X.multi_maps(spark, d, n), lim, _proj(P.MOLLWEIDE, n), n, "RING", X.lut_gray(spark), X.VIEW,
        Scale("histogram", bins=BINS), knots=knots,
    )
    return _shown(out)


@query(
    "figure",
    f"WITH {S.RAW}, cl AS (SELECT map_id, pix, CASE WHEN {S.SEEN} AND value <> 0 THEN value*0.5 END AS value FROM raw), "
    "lim AS (SELECT map_id, quantile_cont(value, 0.05) AS minv, quantile_cont(value, 0.95) AS maxv FROM cl GROUP BY 1), "
    f"{S.mask_parts()}, {_index_sql('orders', '96', '48', 'hammer', _VIEW_SQL)}, "
    "j AS (SELECT lim.map_id, ix.x, ix.y, ix.pix, cl.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN cl ON cl.pix = ix.pix), "
    f"s AS (SELECT *, {_TT} FROM j), k AS (SELECT *, {_COLOUR.format(g=0.5)} FROM s) "
    f"SELECT k.map_id, k.x, k.y, {S.r6('k.value')} AS value, k.cls, {S.r6('k.t')} AS t, k.idx FROM k LEFT JOIN mk ON mk.pix = k.pix WHERE coalesce(mk.valid, true)",
)
def whole_figure(spark, d):
    """Raw order map to a masked Hammer raster: clean, scale, limits, view, colour."""
    raw, n = X.sky_orders_raw(spark, d)
    out = figure(
        raw, X.one_map(spark, "orders", n), n, "RING", width=96, projection=P.HAMMER, lut=X.lut_gray(spark), view=X.VIEW,
        gamma=0.5, factor=0.5, mask=X.mask_parts(spark, d, npix_of(n)), mask_nside=n,
    )
    return _shown(out)


def _seen_in(coord: str) -> str:
    """Raster cells with both pixel numbers of a map in this frame, shown in galactic coordinates."""
    return (
        f"g{coord} AS (SELECT *, {S.sample_angles(view_matrix(coord, 'G'), 'th0', 'lon')} FROM c2), "
        f"i{coord} AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'ring')}, {S.ang2pix_nest('nside', 'g_th', 'g_ph', 'nest', 'h_')} FROM g{coord})"
    )


@query(
    "figure_files",
    f"WITH {_CHUNK}, p AS (SELECT 16 AS nside, 3072 AS npix), fm AS (SELECT n, CASE WHEN n % 2 = 1 THEN 'RING' ELSE 'NESTED' END AS ordering, substr('GCE', CAST(n % 3 AS INT) + 1, 1) AS coord FROM nf), "
    f"{S.cells('32', '16')}, c1 AS (SELECT *, {S.mollweide_cell('32', '16')} FROM c0), c2 AS (SELECT x, y, nside, {S.HALF} - lat AS th0, lon FROM c1 WHERE ok), "
    + ", ".join(map(_seen_in, "GCE"))
    + ", ia AS (" + " UNION ALL ".join(f"SELECT '{c}' AS coord, x, y, ring, nest FROM i{c}" for c in "GCE") + "), "
    "lim AS (SELECT n, quantile_cont(v, 0.05) AS minv, quantile_cont(v, 0.95) AS maxv FROM ch WHERE v <> 0 GROUP BY 1), "
    "j0 AS (SELECT fm.n, fm.ordering, fm.coord, x, y, CASE WHEN ordering = 'RING' THEN ring ELSE nest END AS pix, minv, maxv FROM fm JOIN lim USING (n) JOIN ia ON ia.coord = fm.coord), "
    "j AS (SELECT 'm' || lpad(CAST(j0.n AS VARCHAR), 6, '0') || '#0' AS map_id, ordering, coord, x, y, v AS value, minv, maxv FROM j0 LEFT JOIN ch ON ch.n = j0.n AND ch.pix = j0.pix), "
    f"s AS (SELECT *, {_TT} FROM j), k AS (SELECT *, {_COLOUR.format(g=1.0)} FROM s) SELECT {_OUT}, ordering, coord FROM k",
)
def all_figures(spark, d):
    """Files of both orderings and all frames to figures in one frame."""
    folder = X.write_dense(spark, d, "f64", X.new_folder(spark, "figures"))
    out = figure_files(fits.describe_maps(fits.list_files(spark, folder)), [0], 32, "G", lut=X.lut_gray(spark))
    shown = out.withColumn("map_id", X.stem())
    return shown.select(*(c for c in _shown(shown).columns if c not in ("value", "t", "x", "y", "idx")), *_long("x", "y", "idx"), r6("value").alias("value"), r6("t").alias("t"), "ordering", "coord")
