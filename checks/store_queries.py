"""Queries of sky regions and of the pixel store they are read from."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as S
from checks.raster_queries import _FOV, _TT, _VIEW_SQL, _gnomonic, _res
from checks.registry import query
from skymap.functions.frames import GAL_TO_EQ, sph_to_vec
from skymap.functions.pixels import npix_of, with_pix2ang_nest
from skymap.operators import geometry, limits, masks, pyramid, raster, regions, sketch
from skymap.plans.sizing import materialize
from skymap.sources import manifest, store

r6 = X.r6

# Centre and opening of the cone, corners of the polygon (degrees).
CONE = (266.4, -28.9, 25.0)
CORNERS = ((10.3, -20.2), (75.1, -11.7), (80.6, 33.3), (20.9, 41.5))


def _maps_stored(spark, d):
    """Line-item maps (RING) and the balances' map (numbers taken as NESTED) in one store."""
    lines, n = X.sky_multi(spark, d)
    balances, m = X.sky_bipolar(spark, d)
    maps = X.multi_maps(spark, d, n).withColumn("ordering", F.lit("RING"))
    maps = maps.unionByName(X.one_map(spark, "customer", m).withColumn("ordering", F.lit("NESTED")))
    path = X.new_folder(spark, "store")
    store.write_store(lines.unionByName(balances), maps, path)
    return path, sorted({n, m})


# Both tables as (map_id, nside, pix NESTED, value) with the vector of the pixel's centre.
_STORED = (
    f"WITH {S.MULTI}, {S.params('customer', 'pc')}, "
    f"m1 AS (SELECT *, {S.ring2xyf('nside', 'pix', 'fx', 'fy', 'ff')} FROM m, p), "
    f"m2 AS (SELECT map_id, nside, {S.xyf2nest('nside', 'fx', 'fy', 'ff')} AS pix, value, w_th AS th, w_ph AS ph FROM m1), "
    f"b1 AS (SELECT *, {S.nest2xyf('nside', 'pix', 'fx', 'fy', 'ff')} FROM (SELECT 'customer' AS map_id, nside, (c_custkey*7919) % npix AS pix, c_acctbal AS value FROM customer, pc)), "
    f"b2 AS (SELECT *, {S.xyf2ring('nside', 'fx', 'fy', 'ff', 'rp')} FROM b1), "
    f"b3 AS (SELECT *, {S.pix2ang_ring('nside', 'rp', 'th', 'ph', 'z_')} FROM b2), "
    "u AS (SELECT map_id, nside, pix, value, th, ph FROM m2 UNION ALL SELECT map_id, nside, pix, value, th, ph FROM b3), "
    "v AS (SELECT map_id, nside, pix, value, sin(th)*cos(ph) AS x, sin(th)*sin(ph) AS y, cos(th) AS z FROM u) "
)


def _inside(region: regions.Region) -> str:
    return " AND ".join(f"({a!r})*x + ({b!r})*y + ({c!r})*z >= {least!r}" for (a, b, c), least in region.caps)


def _cone() -> regions.Region:
    lon, lat, radius = map(math.radians, CONE)
    return regions.cone(lon, lat, radius)


def _polygon() -> regions.Region:
    return regions.polygon([regions.direction(math.radians(lon), math.radians(lat)) for lon, lat in CORNERS])


def _read_all(spark, d, region):
    path, nsides = _maps_stored(spark, d)
    out = None
    for n in nsides:
        part = store.read_region(spark, path, n, region).withColumn("nside", F.lit(n).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.select("map_id", "nside", "pix", r6("value").alias("value"))


@query("store_cone", f"{_STORED} SELECT map_id, nside, pix, {S.r6('value')} AS value FROM v WHERE {_inside(_cone())}")
def store_cone(spark, d):
    return _read_all(spark, d, _cone())


@query("store_polygon", f"{_STORED} SELECT map_id, nside, pix, {S.r6('value')} AS value FROM v WHERE {_inside(_polygon())}")
def store_polygon(spark, d):
    return _read_all(spark, d, _polygon())


@query(
    "store_render_gnomonic",
    f"{_FOV}, lim AS (SELECT map_id, quantile_cont(value, 0.05) AS minv, quantile_cont(value, 0.95) AS maxv FROM hit GROUP BY 1), "
    f"j AS (SELECT ix.x, ix.y, a.value, minv, maxv FROM ix CROSS JOIN lim LEFT JOIN a ON a.pix = ix.pix), "
    f"s AS (SELECT *, {_TT} FROM j) SELECT x, y, {S.r6('value')} AS value, {S.r6('t')} AS t FROM s",
)
def store_render_gnomonic(spark, d):
    df, n = X.sky_orders(spark, d)
    maps = X.one_map(spark, "orders", n)
    path = X.new_folder(spark, "store")
    store.write_store(df, maps.withColumn("ordering", F.lit("RING")), path)
    proj = _gnomonic(n)
    near = store.read_footprint(spark, path, n, proj)
    index = materialize(raster.raster_index(spark, proj, n, "NESTED"))
    lim = materialize(limits.fov_limits(near, index, proj.width * proj.height, npix_of(n)))
    out = raster.render_gnomonic(
        near, maps, lim, 2 * n * _res(n), _res(n), 266.4, -28.9, n, "NESTED", roll=0.25, index=index, n_maps=1
    )
    whole = ["x", "y"]
    return out.select(*(F.col(c).cast("long").alias(c) for c in whole), r6("value").alias("value"), r6("t").alias("t"))


@query(
    "store_sample_points",
    f"WITH {S.ORDERS}, {S.POINTS}, g AS (SELECT *, {S.sample_angles(_VIEW_SQL, 'theta', 'phi')} FROM pts, p), "
    f"r AS (SELECT *, {S.ang2pix_ring('nside', 'g_th', 'g_ph', 'pix')}, {S.ang2pix_nest('nside', 'g_th', 'g_ph', 'nest', 'h_')} FROM g) "
    f"SELECT point_id, nest AS pix, {S.r6('value')} AS value FROM r LEFT JOIN a USING (pix)",
)
def store_sample_points(spark, d):
    df, n = X.sky_orders(spark, d)
    path = X.new_folder(spark, "store")
    store.write_store(df, X.one_map(spark, "orders", n).withColumn("ordering", F.lit("RING")), path)
    pts = X.sky_points(spark, d).withColumn("map_id", F.lit("orders"))
    return store.sample_stored(pts, path, n, X.VIEW).select("point_id", "pix", r6("value").alias("value"))


def _supplier_cones(spark, d):
    """A cone of 1 to 6 degrees for every supplier."""
    k = F.col("s_suppkey")
    return X.table(spark, d, "supplier").select(
        k.alias("cone_id"),
        F.radians((k * 137) % 360 + F.lit(0.37)).alias("lon"),
        F.asin(((k * 61) % 199 + F.lit(0.5)) / F.lit(99.5) - F.lit(1.0)).alias("lat"),
        F.radians(k % 6 + F.lit(1.013)).alias("radius"),
    )


@query(
    "cone_search",
    f"WITH {S.BIPOLAR}, b1 AS (SELECT *, {S.nest2xyf('nside', 'pix', 'fx', 'fy', 'ff')} FROM b, p), "
    f"b2 AS (SELECT *, {S.xyf2ring('nside', 'fx', 'fy', 'ff', 'rp')} FROM b1), b3 AS (SELECT *, {S.pix2ang_ring('nside', 'rp', 'th', 'ph', 'z_')} FROM b2), "
    "v AS (SELECT pix, value, sin(th)*cos(ph) AS x, sin(th)*sin(ph) AS y, cos(th) AS z FROM b3), "
    "c AS (SELECT s_suppkey AS cone_id, radians((s_suppkey*137) % 360 + 0.37::DOUBLE) AS lon, asin(((s_suppkey*61) % 199 + 0.5::DOUBLE)/99.5::DOUBLE - 1.0::DOUBLE) AS lat, radians(s_suppkey % 6 + 1.013::DOUBLE) AS radius FROM supplier) "
    f"SELECT cone_id, count(*) AS n, {S.r6('avg(value)')} AS mean FROM c JOIN v ON x*cos(lat)*cos(lon) + y*cos(lat)*sin(lon) + z*sin(lat) >= cos(radius) GROUP BY 1",
)
def cone_search(spark, d):
    df, n = X.sky_bipolar(spark, d)
    met = regions.cone_search(_supplier_cones(spark, d), df, n)
    return met.groupBy("cone_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(
    "cone_cells",
    f"WITH {S.params('orders')}, {S.params('customer', 'pc')}, "
    f"c AS (SELECT s_suppkey AS cone_id, radians((s_suppkey*137) % 360 + 0.37::DOUBLE) AS lon, asin(((s_suppkey*61) % 199 + 0.5::DOUBLE)/99.5::DOUBLE - 1.0::DOUBLE) AS lat, radians(s_suppkey % 6 + 1.013::DOUBLE) AS radius FROM supplier), "
    "k0 AS (SELECT unnest(range(0, 768)) AS pix, 8 AS nside), "
    f"k1 AS (SELECT *, {S.nest2xyf('nside', 'pix', 'fx', 'fy', 'ff')} FROM k0), k2 AS (SELECT *, {S.xyf2ring('nside', 'fx', 'fy', 'ff', 'rp')} FROM k1), "
    f"k3 AS (SELECT *, {S.pix2ang_ring('nside', 'rp', 'th', 'ph', 'z_')} FROM k2) "
    "SELECT cone_id, pix AS cell FROM c JOIN k3 ON sin(th)*cos(ph)*cos(lat)*cos(lon) + sin(th)*sin(ph)*cos(lat)*sin(lon) + cos(th)*sin(lat) >= cos(radius)",
)
def cone_cells(spark, d):
    """Of each cone's cover at nside 8, the cells whose own centre lies in it."""
    rows = regions.cells_of_cones(_supplier_cones(spark, d), 3)
    x, y, z = sph_to_vec("t", "p")
    rows = with_pix2ang_nest(rows, 8, "cell", ("t", "p"))
    ax, ay, az = F.cos("lat") * F.cos("lon"), F.cos("lat") * F.sin("lon"), F.sin("lat")
    return rows.filter(x * ax + y * ay + z * az >= F.cos("radius")).select("cone_id", "cell")


# ------------------------------------------------- all resolutions, mixed geometries


@query(
    "pyramid",
    f"WITH {S.MULTI}, c AS (SELECT *, {S.ring2xyf('nside', 'pix', 'x', 'y', 'f')} FROM m, p), "
    "lv AS (SELECT map_id, value, x, y, f, nside, unnest(range(1, 20)) AS k FROM c), "
    "g AS (SELECT map_id, nside >> k AS nside, x >> k AS x, y >> k AS y, f, avg(value) AS value FROM lv WHERE nside >> k >= 1 GROUP BY ALL) "
    f"SELECT map_id, CAST(nside AS BIGINT) AS nside, {S.xyf2nest('nside', 'x', 'y', 'f')} AS pix, {S.r6('value')} AS value FROM g",
)
def pyramid_levels(spark, d):
    df, n = X.sky_multi(spark, d)
    made = pyramid.build(df, n, "RING")
    out = None
    for size in made.levels:
        part = pyramid.level(made, size).withColumn("nside", F.lit(size).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.select("map_id", "nside", "pix", r6("value").alias("value"))


def _mixed(spark, d):
    """The order map (RING) and the balances' map (NESTED), of different resolutions."""
    orders, n = X.sky_orders(spark, d)
    balances, m = X.sky_bipolar(spark, d)
    maps = X.one_map(spark, "orders", n).withColumn("ordering", F.lit("RING"))
    maps = maps.unionByName(X.one_map(spark, "customer", m).withColumn("ordering", F.lit("NESTED")))
    return orders.unionByName(balances), maps


@query(
    "degrade_maps",
    f"WITH {S.ORDERS}, {S.params('customer', 'pc')}, c AS (SELECT *, {S.ring2xyf('nside', 'pix', 'x', 'y', 'f')} FROM a, p), "
    "g AS (SELECT map_id, x//2 AS px, y//2 AS py, f, nside//2 AS tn, avg(value) AS value FROM c GROUP BY ALL), "
    f"k AS (SELECT *, {S.xyf2ring('tn', 'px', 'py', 'f', 'tp')} FROM g), "
    "b AS (SELECT nside//2 AS nside, (c_custkey*7919) % npix // 4 AS pix, avg(c_acctbal) AS value FROM customer, pc GROUP BY ALL) "
    f"SELECT map_id, tn AS nside, 'RING' AS ordering, tp AS pix, {S.r6('value')} AS value FROM k UNION ALL "
    f"SELECT 'customer', nside, 'NESTED', pix, {S.r6('value')} FROM b",
)
def degrade_maps(spark, d):
    pixels, maps = _mixed(spark, d)
    out = geometry.degrade_maps(pixels, maps)
    return out.select("map_id", F.col("nside").cast("long").alias("nside"), "ordering", "pix", r6("value").alias("value"))


@query(
    "fit_maps",
    f"WITH {S.ORDERS}, {S.params('customer', 'pc')}, o1 AS (SELECT *, {S.pix2ang_ring('nside', 'pix', 'th', 'ph')} FROM a, p), "
    f"b1 AS (SELECT *, {S.nest2xyf('nside', 'pix', 'fx', 'fy', 'ff')} FROM (SELECT 'customer' AS map_id, nside, (c_custkey*7919) % npix AS pix, c_acctbal AS value FROM customer, pc)), "
    f"b2 AS (SELECT *, {S.xyf2ring('nside', 'fx', 'fy', 'ff', 'rp')} FROM b1), b3 AS (SELECT *, {S.pix2ang_ring('nside', 'rp', 'th', 'ph', 'z_')} FROM b2), "
    "u AS (SELECT map_id, nside, 'RING' AS ordering, value, th, ph FROM o1 UNION ALL SELECT map_id, nside, 'NESTED', value, th, ph FROM b3), "
    "v AS (SELECT map_id, nside, ordering, value, sin(th)*cos(ph) AS x, sin(th)*sin(ph) AS y, cos(th) AS z FROM u), "
    "s AS (SELECT map_id, nside, ordering, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz, "
    "sum(value) AS b0, sum(value*x) AS bx, sum(value*y) AS by_, sum(value*z) AS bz FROM v GROUP BY ALL), "
    # Elimination, one unknown after the other.
    "e1 AS (SELECT *, xx - sx*sx/n AS a11, xy - sx*sy/n AS a12, xz - sx*sz/n AS a13, yy - sy*sy/n AS a22, yz - sy*sz/n AS a23, zz - sz*sz/n AS a33, bx - sx*b0/n AS r1, by_ - sy*b0/n AS r2, bz - sz*b0/n AS r3 FROM s), "
    "e2 AS (SELECT *, a22 - a12*a12/a11 AS c22, a23 - a12*a13/a11 AS c23, a33 - a13*a13/a11 AS c33, r2 - a12*r1/a11 AS q2, r3 - a13*r1/a11 AS q3 FROM e1), "
    "e3 AS (SELECT *, (q3 - c23*q2/c22)/(c33 - c23*c23/c22) AS dz, (q2 - c23*dz)/c22 AS dy, (r1 - a12*dy - a13*dz)/a11 AS dx, (b0 - sx*dx - sy*dy - sz*dz)/n AS m FROM e2) "
    "SELECT map_id, nside, ordering, round(m, 3) AS m, round(dx, 3) AS dx, round(dy, 3) AS dy, round(dz, 3) AS dz FROM e3",
)
def fit_maps(spark, d):
    pixels, maps = _mixed(spark, d)
    out = geometry.fit_maps(pixels, maps)
    return out.select("map_id", "nside", "ordering", *(F.round(c, 3).alias(c) for c in ("m", "dx", "dy", "dz")))


# ------------------------------------------------------------------------- sketches


def _within_error(values, found):
    """(map_id, n, minv, maxv, low_ok, high_ok): whether the shares below the two quantiles are as near
    to 5 and 95 % as the sketch promises."""
    met = values.filter("value is not null").join(F.broadcast(found), "map_id")
    share = lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    near = lambda c, q: F.abs(share(c) - q) <= sketch.rank_error() + 2 / F.count("*")
    return met.groupBy("map_id").agg(
        F.max("n").alias("n"), r6(F.max("minv")).alias("minv"), r6(F.max("maxv")).alias("maxv"),
        near("p5", 0.05).alias("low_ok"), near("p95", 0.95).alias("high_ok"),
    )


@query(
    "sketch_limits",
    f"WITH {S.MULTI} SELECT map_id, count(*) AS n, {S.r6('min(value)')} AS minv, {S.r6('max(value)')} AS maxv, true AS low_ok, true AS high_ok FROM m GROUP BY 1",
)
def sketch_limits(spark, d):
    """Sketches of four parts of each map, merged."""
    df, _ = X.stored_multi(spark, d)
    parts = sketch.sketch_maps(df.withColumn("part", F.col("pix") % 4), ("map_id", "part"))
    found = sketch.quantiles(sketch.merge_sketches(parts), {"p5": 0.05, "p95": 0.95}).drop("sketch")
    return _within_error(df, materialize(found))


@query(
    "stored_limits",
    "SELECT 'm' || lpad(CAST(o_orderkey // 3072 AS VARCHAR), 6, '0') || '#0' AS map_id, count(*) AS n, 'ok' AS status, true AS inside FROM orders GROUP BY 1",
)
def stored_limits(spark, d):
    """Limits of ingested files from their sketches: p5 and p95 lie between the exact p4 and p6, p94 and p96."""
    folder = X.write_dense(spark, d, "f64", X.new_folder(spark, "incoming"))
    path = X.new_folder(spark, "store")
    manifest.ingest_incremental(spark, folder, path)
    found = manifest.stored_limits(spark, path)
    pixels = spark.read.parquet(f"{path}/pixels").filter("value > -1e30")
    q = lambda p: F.percentile("value", F.lit(p))
    exact = pixels.groupBy("map_id").agg(F.count("*").alias("n"), q(0.04).alias("a"), q(0.06).alias("b"), q(0.94).alias("c"), q(0.96).alias("d"))
    both = exact.join(found, "map_id")
    inside = F.col("minv").between(F.col("a"), F.col("b")) & F.col("maxv").between(F.col("c"), F.col("d"))
    return both.select(X.stem().alias("map_id"), "n", "status", inside.alias("inside"))


# --------------------------------------------------------------------- foreign masks


@query(
    "mask_turned",
    f"WITH {S.params('orders')}, {S.params('customer', 'pc')}, "
    "mk AS (SELECT (p_partkey*104729) % npix AS pix, bool_and(p_size > 10) AS valid FROM part, pc GROUP BY 1), "
    f"t0 AS (SELECT unnest(range(0, npix)) AS pix, nside FROM p), t1 AS (SELECT *, {S.pix2ang_ring('nside', 'pix', 'th', 'ph')} FROM t0), "
    "t2 AS (SELECT pix, sin(th)*cos(ph) AS ax, sin(th)*sin(ph) AS ay, cos(th) AS az FROM t1), "
    f"t3 AS (SELECT *, {S.rotate(GAL_TO_EQ, 'ax', 'ay', 'az', ('bx', 'by_', 'bz'))}, acos(greatest(-1, least(1, bz))) AS mth, atan2(by_, bx) AS mph FROM t2), "
    "t4 AS (SELECT t3.pix AS tp, mth, mph, pc.nside AS m FROM t3, pc), "
    f"t5 AS (SELECT *, {S.ang2pix_nest('m', 'mth', 'mph', 'mp', 'k_')} FROM t4) "
    "SELECT tp AS pix, coalesce(mk.valid, true) AS valid FROM t5 LEFT JOIN mk ON mk.pix = t5.mp",
)
def mask_turned(spark, d):
    """A mask of the balances' resolution, NESTED and equatorial, for the order map."""
    n, m = X.nside_of(spark, d, "orders"), X.nside_of(spark, d, "customer")
    mask = X.mask_parts(spark, d, npix_of(m))
    return masks.turn_mask(mask, m, "NESTED", "C", n, "RING", "G")
