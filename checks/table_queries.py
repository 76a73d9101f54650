"""Queries of cleaning, masks, degrading, statistics, ordering and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import sql as S
from checks.registry import query
from skymap.functions.pixels import npix_of
from skymap.functions.stretch import knot_share, with_knot_position
from skymap.functions.values import seen_or_null
from skymap.operators import compare, degrade, fit, histogram, limits, masks, order
from skymap.operators.clean import clean_map
from skymap.plans.sizing import materialize
from skymap.sources import generated

r6 = X.r6

# ------------------------------------------------------------- generated maps (2.1)


def supplier_specs(spark, d, amount):
    """A map of nside 1 to 8 for each supplier, and an amount."""
    k = F.col("s_suppkey")
    nside = F.expr("shiftleft(1L, CAST(s_suppkey % 4 AS INT))")
    return X.table(spark, d, "supplier").select(F.col("s_name").alias("mask_id"), nside.alias("nside"), amount(k).alias("amount"))


def _specs_sql(amount: str) -> str:
    return (
        f"sp AS (SELECT s_name AS mask_id, CAST(1 << (s_suppkey % 4) AS BIGINT) AS nside, {amount} AS amount FROM supplier), "
        "sx AS (SELECT *, 12*nside*nside AS npix FROM sp), ps AS (SELECT mask_id, nside, npix, amount, unnest(range(0, npix)) AS pix FROM sx)"
    )


@query(
    "src_index_map",
    f"WITH {_specs_sql('0')} SELECT mask_id AS map_id, pix, CAST(pix AS DOUBLE) AS value FROM ps",
)
def src_index_map(spark, d):
    specs = supplier_specs(spark, d, lambda k: F.lit(0)).withColumnRenamed("mask_id", "map_id")
    return generated.index_maps(specs)


@query(
    "densify",
    f"WITH {S.MULTI}, ids AS (SELECT DISTINCT map_id FROM l), g AS (SELECT map_id, i AS pix FROM ids, p, LATERAL (SELECT unnest(range(0, npix)) AS i)) "
    f"SELECT map_id, pix, {S.r6('value')} AS value FROM g LEFT JOIN m USING (map_id, pix)",
)
def densify(spark, d):
    df, n = X.sky_multi(spark, d)
    return generated.densify(df, X.multi_maps(spark, d, n)).select("map_id", "pix", r6("value").alias("value"))


@query(
    "src_sparse_dupes",
    f"WITH {S.LINES} SELECT map_id, pix, arg_max(value, (l_orderkey, l_linenumber, l_partkey, l_suppkey, value)) AS value FROM l GROUP BY ALL",
)
def src_sparse_dupes(spark, d):
    df, n = X.sky_lines(spark, d)
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value")
    return generated.sparse_pixels(df.withColumn("row_no", row), npix_of(n))


# -------------------------------------------------------------------- masks (2.1, 2.2)


def _window(amount: str, size: str, centred: bool) -> str:
    first = "greatest(0, npix//2 - k//2)" if centred else "npix - k"
    return (
        f"WITH {_specs_sql(amount)}, sz AS (SELECT mask_id, pix, npix, CAST({size} AS BIGINT) AS k FROM ps) "
        f"SELECT mask_id, pix, NOT (pix >= {first} AND pix < {first} + k) AS valid FROM sz"
    )


@query("mask_band", _window("5.25::DOUBLE + s_suppkey % 40", "floor(npix*amount/90.0::DOUBLE)", True))
def mask_band(spark, d):
    return masks.masks_of(supplier_specs(spark, d, lambda k: F.lit(5.25) + k % 40), masks.BAND)


@query("mask_uniform", _window("(s_suppkey % 9)/10.0::DOUBLE", "npix - floor(npix*(1 - amount))", False))
def mask_uniform(spark, d):
    return masks.masks_of(supplier_specs(spark, d, lambda k: (k % 9) / F.lit(10.0)), masks.UNIFORM)


@query("mask_patch", _window("20.5::DOUBLE + s_suppkey % 120", "floor(npix*power(amount/180.0::DOUBLE, 2))", True))
def mask_patch(spark, d):
    return masks.masks_of(supplier_specs(spark, d, lambda k: F.lit(20.5) + k % 120), masks.PATCH)


def _permuted_sql(n: str, seed: int) -> str:
    """Image of ``pix``: low and high part in turn moved by a scrambled value of the other."""
    keys, steps = masks.round_keys(seed), [f"pix // (4*{n}) AS h0", f"pix % (4*{n}) AS l0"]
    for r in range(len(keys) // 2):
        steps.append(f"(h{r}*1103515245 + {keys[2 * r]}) % 2147483647 AS p{r}")
        steps.append(f"(l{r} + p{r}*p{r} % 2147483647) % (4*{n}) AS l{r + 1}")
        steps.append(f"(l{r + 1}*1103515245 + {keys[2 * r + 1]}) % 2147483647 AS q{r}")
        steps.append(f"(h{r} + q{r}*q{r} % 2147483647) % (3*{n}) AS h{r + 1}")
    return ", ".join(steps) + f", h{r + 1}*4*{n} + l{r + 1} AS image"


@query(
    "mask_random",
    f"WITH {_specs_sql('(1 + s_suppkey % 9)/10.0::DOUBLE')}, im AS (SELECT *, {_permuted_sql('nside', 42)} FROM ps) "
    "SELECT mask_id, pix, image >= CAST(floor(npix*amount) AS BIGINT) AS valid FROM im",
)
def mask_random(spark, d):
    return masks.masks_of(supplier_specs(spark, d, lambda k: (F.lit(1) + k % 9) / F.lit(10.0)), masks.RANDOM, 42)


@query(
    "mask_range",
    f"WITH {S.RAW} SELECT pix, (NOT isnan(value)) AND value >= 50000 AND value <= 300000 AS valid FROM raw",
)
def mask_range(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    return masks.mask_range(df, 50_000.0, 300_000.0).select("pix", "valid")


@query(
    "mask_apply",
    f"WITH {S.ORDERS}, {S.mask_parts()} SELECT a.pix, value, coalesce(valid, true) AS valid, "
    "CASE WHEN coalesce(valid, true) THEN 0 ELSE 128 END AS r FROM a LEFT JOIN mk USING (pix)",
)
def mask_apply(spark, d):
    df, n = X.sky_orders(spark, d)
    out = masks.mask_apply(df, X.mask_parts(spark, d, npix_of(n)), nside=n)
    black = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    rgba = masks.mask_fill(black, F.col("valid"), (128, 128, 128, 255))
    return out.select("pix", "value", "valid", rgba["r"].cast("long").alias("r"))


@query(
    "mask_frame_check",
    "WITH mp AS (SELECT s_name AS map_id, 'm' || s_nationkey AS mask_id, substr('GCE', CAST(s_suppkey % 3 AS INT) + 1, 1) AS map_coord FROM supplier), "
    "ms AS (SELECT 'm' || n_nationkey AS mask_id, substr('GCE', CAST(n_nationkey % 3 AS INT) + 1, 1) AS mask_coord FROM nation) "
    "SELECT map_id, mask_id, map_coord, mask_coord FROM mp JOIN ms USING (mask_id) WHERE map_coord <> mask_coord",
)
def mask_frame_check(spark, d):
    frame = lambda k: F.substring(F.lit("GCE"), (F.col(k) % 3 + 1).cast("int"), F.lit(1))
    maps = X.table(spark, d, "supplier").select(
        F.col("s_name").alias("map_id"), F.concat(F.lit("m"), F.col("s_nationkey")).alias("mask_id"), frame("s_suppkey").alias("coord")
    )
    ms = X.table(spark, d, "nation").select(
        F.concat(F.lit("m"), F.col("n_nationkey")).alias("mask_id"), frame("n_nationkey").alias("coord")
    )
    return masks.mask_frame_check(maps, ms)


@query(
    "mask_stats",
    f"WITH {S.params('orders')}, {S.mask_parts()} SELECT count(*) AS total, count(*) FILTER (NOT valid) AS masked, count(*) FILTER (valid) AS valid_count, "
    f"{S.r6('count(*) FILTER (NOT valid)*100.0::DOUBLE/count(*)')} AS masked_pct, {S.r6('count(*) FILTER (valid)*100.0::DOUBLE/count(*)')} AS valid_pct FROM mk",
)
def mask_stats(spark, d):
    m = X.mask_parts(spark, d, npix_of(X.nside_of(spark, d, "orders")))
    s = masks.mask_stats(m)
    return s.select("total", "masked", "valid_count", r6("masked_pct").alias("masked_pct"), r6("valid_pct").alias("valid_pct"))


# ------------------------------------------------------------------- degrading (2.4)


def _parents(keep: str, fact: int = 4) -> str:
    """RING parents of the line-item maps at nside / fact."""
    cond = {"all": "true", "rows": f"(y - {fact}*(y//{fact})) % 2 = 0", "checker": f"(y - {fact}*(y//{fact})) % 2 = 0 AND (x - {fact}*(x//{fact})) % 2 = 0"}[keep]
    return (
        f"c AS (SELECT *, {S.ring2xyf('nside', 'pix', 'x', 'y', 'f')} FROM src, p), "
        f"g AS (SELECT map_id, x//{fact} AS px, y//{fact} AS py, f, nside//{fact} AS tn, avg(CASE WHEN {cond} THEN value END) AS value FROM c GROUP BY ALL), "
        f"k AS (SELECT *, {S.xyf2ring('tn', 'px', 'py', 'f', 'tp')} FROM g)"
    )


DOWN = f"SELECT map_id, tp AS pix, {S.r6('value')} AS value FROM k"
SRC = f"WITH {S.MULTI}, src AS (SELECT * FROM m), "


def _down(f, fact):
    def run(spark, d):
        df, n = X.sky_multi(spark, d)
        return f(df, n, n // fact, "RING").select("map_id", "pix", r6("value").alias("value"))

    return run


query("degrade_best", f"{SRC}{_parents('all')} {DOWN}")(_down(degrade.degrade_best, 4))
query("degrade_balanced", f"{SRC}{_parents('rows')} {DOWN}")(_down(degrade.degrade_balanced, 4))
query("degrade_fast", f"{SRC}{_parents('checker')} {DOWN}")(_down(degrade.degrade_fast, 4))

_NEST = {
    "degrade_best_nest": ("true", degrade.degrade_best),
    "degrade_balanced_nest": ("((pix >> 1) & 1) = 0", degrade.degrade_balanced),
    "degrade_fast_nest": ("(pix & 3) = 0", degrade.degrade_fast),
}
for _name, (_cond, _f) in _NEST.items():

    def _nest_run(spark, d, f=_f):
        df, n = X.sky_multi(spark, d)
        return f(df, n, n // 4, "NESTED").select("map_id", "pix", r6("value").alias("value"))

    query(_name, f"WITH {S.MULTI} SELECT map_id, pix // 16 AS pix, {S.r6('avg(value)')} AS value FROM m WHERE {_cond} GROUP BY map_id, pix // 16")(_nest_run)


def _ang_sql(fact: int) -> str:
    n = min(fact, 4)
    return (
        f"WITH {S.MULTI}, t AS (SELECT i AS tp, nside, nside//{fact} AS tn FROM p, LATERAL (SELECT unnest(range(0, 12*(nside//{fact})*(nside//{fact}))) AS i)), "
        f"tc AS (SELECT *, {S.pix2ang_ring('tn', 'tp', 'th', 'ph')} FROM t), "
        f"o AS (SELECT (i + 0.5::DOUBLE)/{n} - 0.5::DOUBLE AS dt, (j + 0.5::DOUBLE)/{n} - 0.5::DOUBLE AS dp FROM (SELECT unnest(range(0, {n})) AS i), (SELECT unnest(range(0, {n})) AS j)), "
        f"s AS (SELECT tp, nside, greatest(0, least({S.PI}, th + dt*{S.PI}/(2*tn))) AS sth, (((ph + dp*{S.TAU}/tn) % {S.TAU}) + {S.TAU}) % {S.TAU} AS sph FROM tc, o), "
        f"q AS (SELECT *, {S.ang2pix_ring('nside', 'sth', 'sph', 'pix', 'z_')} FROM s) "
        f"SELECT map_id, tp AS pix, {S.r6('avg(value)')} AS value FROM q JOIN m USING (pix) GROUP BY map_id, tp"
    )


query("degrade_ang", _ang_sql(4))(_down(degrade.degrade_ang, 4))
query("degrade", f"{SRC}{_parents('all', 8)} {DOWN}")(_down(degrade.degrade, 8))
query("degrade_by_size", _ang_sql(8))(_down(degrade.degrade_by_size, 8))

_TWO = (
    f"{SRC}{_parents('all', 2)}, half AS (SELECT map_id, tp AS pix, value FROM k), p2 AS (SELECT nside//2 AS nside FROM p), "
    f"c2 AS (SELECT *, {S.ring2xyf('nside', 'pix', 'x', 'y', 'f')} FROM half, p2), "
    "g2 AS (SELECT map_id, x//4 AS px, y//4 AS py, f, nside//4 AS tn, avg(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN value END) AS value FROM c2 GROUP BY ALL), "
    f"k2 AS (SELECT *, {S.xyf2ring('tn', 'px', 'py', 'f', 'tp')} FROM g2) SELECT map_id, tp AS pix, {S.r6('value')} AS value FROM k2"
)
query("degrade_two_phase", _TWO)(_down(degrade.degrade_two_phase, 8))


@query(
    "auto_degrade",
    f"WITH {S.MULTI}, t AS (SELECT nside AS sn, CAST(power(2, floor(log2(round(sqrt((nside//2) * (nside//4)))))) AS BIGINT) AS tn FROM p), "
    f"src AS (SELECT map_id, pix, value, sn, tn, sn//tn AS fc FROM m, t), "
    f"c AS (SELECT *, {S.ring2xyf('sn', 'pix', 'x', 'y', 'f')} FROM src), "
    "g AS (SELECT map_id, x//fc AS px, y//fc AS py, f, tn, avg(CASE WHEN (y - fc*(y//fc)) % 2 = 0 THEN value END) AS value FROM c GROUP BY ALL), "
    f"k AS (SELECT *, {S.xyf2ring('tn', 'px', 'py', 'f', 'tp')} FROM g) SELECT map_id, tp AS pix, tn AS nside, {S.r6('value')} AS value FROM k",
)
def auto_degrade(spark, d):
    df, n = X.sky_multi(spark, d)
    out, target = degrade.auto_degrade(df, n, "RING", n // 2, "balanced", threshold=n // 2)
    return out.select("map_id", "pix", F.lit(target).cast("long").alias("nside"), r6("value").alias("value"))


# --------------------------------------------------------------- limits, percentiles


@query("map_min_max", f"WITH {S.MULTI} SELECT map_id, {S.r6('min(value)')} AS minv, {S.r6('max(value)')} AS maxv FROM m GROUP BY 1")
def map_min_max(spark, d):
    df, _ = X.sky_multi(spark, d)
    return limits.map_min_max(df).select("map_id", r6("minv").alias("minv"), r6("maxv").alias("maxv"))


_PCT = {"p5": 5.0, "p33": 33.3, "p50": 50.0, "p95": 95.0}


@query(
    "percentile_exact",
    f"WITH {S.MULTI} SELECT map_id, " + ", ".join(f"{S.r6(f'quantile_cont(value, {p/100})')} AS {k}" for k, p in _PCT.items()) + " FROM m GROUP BY 1",
)
def percentile_exact(spark, d):
    """Takes the large-map path (8 buckets) whatever the table size."""
    df, n = X.stored_multi(spark, d)
    out = limits.percentile_exact(df, _PCT, npix_of(n), buckets=8)
    return out.select("map_id", *[r6(k).alias(k) for k in _PCT])


@query(
    "percentile_sampled",
    f"WITH {S.MULTI}, s AS (SELECT map_id, value FROM m, p WHERE pix % CAST(ceil(npix/(npix//5)::DOUBLE) AS BIGINT) = 0) "
    f"SELECT map_id, {S.r6('quantile_cont(value, 0.05)')} AS p5, {S.r6('quantile_cont(value, 0.95)')} AS p95 FROM s GROUP BY 1",
)
def percentile_sampled(spark, d):
    df, n = X.sky_multi(spark, d)
    out = limits.percentile_sampled(df, {"p5": 5.0, "p95": 95.0}, npix_of(n), -(-npix_of(n) // (npix_of(n) // 5)))
    return out.select("map_id", r6("p5").alias("p5"), r6("p95").alias("p95"))


@query(
    "auto_limits",
    f"WITH {S.MULTI} SELECT map_id, {S.r6('quantile_cont(value, 0.05)')} AS minv, {S.r6('quantile_cont(value, 0.95)')} AS maxv, "
    f"{S.r6('min(value)')} AS hmin, {S.r6('max(value)')} AS hmax FROM m GROUP BY 1",
)
def auto_limits(spark, d):
    df, n = X.stored_multi(spark, d)
    a = limits.auto_limits(df, npix_of(n), minv=3.0)
    h = limits.auto_limits(df, npix_of(n), "histogram").select("map_id", F.col("minv").alias("hmin"), F.col("maxv").alias("hmax"))
    return a.join(h, "map_id").select("map_id", *[r6(c).alias(c) for c in ("minv", "maxv", "hmin", "hmax")])


# -------------------------------------------------------------------- fit (2.4)

_FIT_SRC = f"""{S.MULTI}, {S.mask_parts()},
v0 AS (SELECT map_id, pix, value, nside FROM m, p WHERE pix IN (SELECT pix FROM mk WHERE valid)),
v1 AS (SELECT *, {S.pix2ang_ring('nside', 'pix', 'th', 'ph')} FROM v0),
v AS (SELECT map_id, pix, value, 1.0::DOUBLE AS h0, sin(th)*cos(ph) AS h1, sin(th)*sin(ph) AS h2, cos(th) AS h3 FROM v1),
s AS (SELECT map_id, """ + ", ".join(
    f"sum(h{i}*h{j}) AS a{i}{j}" for i in range(4) for j in range(i, 4)
) + ", " + ", ".join(f"sum(value*h{i}) AS b{i}" for i in range(4)) + " FROM v GROUP BY 1)"


def _a(i: int, j: int, lvl: int) -> str:
    return f"a{min(i, j)}{max(i, j)}_{lvl}" if lvl else f"a{min(i, j)}{max(i, j)}"


def _b(i: int, lvl: int) -> str:
    return f"b{i}_{lvl}" if lvl else f"b{i}"


def _elimination() -> str:
    """Symmetric elimination without pivoting, then back substitution."""
    cols = []
    for c in range(3):
        for i in range(c + 1, 4):
            for j in range(i, 4):
                cols.append(f"{_a(i, j, c)} - {_a(c, i, c)}*{_a(c, j, c)}/{_a(c, c, c)} AS {_a(i, j, c + 1)}")
            cols.append(f"{_b(i, c)} - {_a(c, i, c)}*{_b(c, c)}/{_a(c, c, c)} AS {_b(i, c + 1)}")
    for i in (3, 2, 1, 0):
        back = "".join(f" - {_a(i, j, i)}*x{j}" for j in range(i + 1, 4))
        cols.append(f"({_b(i, i)}{back})/{_a(i, i, i)} AS x{i}")
    return ", ".join(cols)


_FIT = f"{_FIT_SRC}, e AS (SELECT *, {_elimination()} FROM s)"


@query(
    "fit_sums",
    f"WITH {_FIT_SRC} SELECT map_id, " + ", ".join(f"{S.r6(f'a{i}{j}')} AS a{i}{j}" for i in range(4) for j in range(i, 4)) + ", "
    + ", ".join(f"round(b{i} + 3.3e-5::DOUBLE, 3) + 0.0::DOUBLE AS b{i}" for i in range(4)) + " FROM s",
)
def fit_sums(spark, d):
    df, n = X.sky_multi(spark, d)
    s = fit.fit_sums(df, n, "RING", X.mask_parts(spark, d, npix_of(n)))
    ax = fit.AXES
    return s.select(
        "map_id",
        *[r6(f"a_{ax[i]}_{ax[j]}").alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)],
        *[(F.round(F.col(f"b_{ax[i]}") + 3.3e-5, 3) + 0.0).alias(f"b{i}") for i in range(4)],
    )


@query(
    "fit_mono_dipole",
    f"WITH {_FIT}, z AS (SELECT *, sqrt(x1*x1+x2*x2+x3*x3) AS amp, degrees(atan2(x2, x1)) AS l0 FROM e) "
    f"SELECT map_id, round(x0, 4) AS m, round(x1, 4) AS dx, round(x2, 4) AS dy, round(x3, 4) AS dz, round(amp, 4) AS amplitude, "
    f"round(CASE WHEN l0 < 0 THEN l0 + 360 ELSE l0 END, 6) AS lon, round(degrees(asin(x3/amp)), 6) AS lat FROM z",
)
def fit_mono_dipole(spark, d):
    df, n = X.sky_multi(spark, d)
    f = fit.fit_mono_dipole(df, n, "RING", X.mask_parts(spark, d, npix_of(n)))
    return f.select("map_id", *[F.round(c, 4).alias(c) for c in ("m", "dx", "dy", "dz", "amplitude")], *[F.round(c, 6).alias(c) for c in ("lon", "lat")])


@query(
    "subtract_mono_dipole",
    f"WITH {_FIT} SELECT m.map_id, m.pix, round(CASE WHEN v.pix IS NULL THEN m.value ELSE m.value - (x0 + x1*h1 + x2*h2 + x3*h3) END, 4) AS value "
    "FROM m LEFT JOIN v USING (map_id, pix) LEFT JOIN e USING (map_id)",
)
def subtract_mono_dipole(spark, d):
    df, n = X.stored_multi(spark, d)
    out = fit.subtract_mono_dipole(df, n, "RING", mask=X.mask_parts(spark, d, npix_of(n)))
    return out.select("map_id", "pix", F.round("value", 4).alias("value"))


# ---------------------------------------------------------------- reports (2.4)


@query(
    "map_diagnostics",
    f"WITH {S.RAW} SELECT map_id, count(*) AS total, count(*) FILTER (NOT isnan(value) AND abs(value) < 'infinity'::DOUBLE) AS finite, "
    "count(*) FILTER (NOT isnan(value) AND value > -1e30) AS above, count(*) FILTER (abs(value) = 'infinity'::DOUBLE) AS infinite, count(*) FILTER (isnan(value)) AS nan, "
    "round(min(CASE WHEN NOT isnan(value) AND value < 1e300 THEN value END)/1e24::DOUBLE, 3) AS minv, max(CASE WHEN isnan(value) THEN NULL ELSE value END) = 'infinity'::DOUBLE AS max_is_inf, "
    + ", ".join(f"{S.r6(f'max(CASE WHEN pix = {i} AND abs(value) < 1e29 THEN value END)')} AS v{i}" for i in range(5))
    + " FROM raw GROUP BY 1",
)
def map_diagnostics(spark, d):
    df, _ = X.sky_orders_raw(spark, d)
    g = compare.map_diagnostics(df)
    first = [r6(seen_or_null(F.get("first_values", F.lit(i)))).alias(f"v{i}") for i in range(5)]
    return g.select(
        "map_id", "total", "finite", "above", "infinite", "nan", F.round(F.col("minv") / 1e24, 3).alias("minv"),
        (F.col("maxv") == float("inf")).alias("max_is_inf"), *first,
    )


@query(
    "map_coverage",
    f"WITH {S.MULTI} SELECT map_id, any_value(npix) AS total, count(value) AS valid, {S.r6('count(value)*100.0::DOUBLE/any_value(npix)')} AS valid_pct FROM m, p GROUP BY 1",
)
def map_coverage(spark, d):
    df, n = X.sky_multi(spark, d)
    return compare.map_coverage(df, npix_of(n)).withColumn("valid_pct", r6("valid_pct"))


@query(
    "map_compare",
    f"{SRC}c AS (SELECT *, {S.ring2xyf('nside', 'pix', 'x', 'y', 'f')} FROM src, p), "
    "g AS (SELECT map_id, x//4 AS px, y//4 AS py, f, nside//4 AS tn, avg(value) AS va, avg(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN value END) AS vb, 12*(nside//4)*(nside//4) AS tp FROM c GROUP BY ALL), "
    "dd AS (SELECT map_id, tp, va, vb, coalesce(va, -1.6375e30::DOUBLE) - coalesce(vb, -1.6375e30::DOUBLE) AS df FROM g) "
    "SELECT map_id, count(*) FILTER (abs(df) > 1e-6) AS mismatches, round(sqrt(sum(CASE WHEN abs(df) > 1e-6 THEN df*df ELSE 0 END)/any_value(tp))/1e24::DOUBLE, 6) AS rmse, "
    "any_value(tp) - count(va) AS unseen_a, any_value(tp) - count(vb) AS unseen_b FROM dd GROUP BY 1",
)
def map_compare(spark, d):
    df, n = X.stored_multi(spark, d)
    a, b = degrade.degrade_best(df, n, n // 4, "RING"), degrade.degrade_fast(df, n, n // 4, "RING")
    out = compare.map_compare(a, b, npix_of(n // 4))
    return out.withColumn("rmse", F.round(F.col("rmse") / 1e24, 6))


# ------------------------------------------------------------ ranks, histograms (2.4, 2.5)

BINS = 64


@query(
    "value_rank",
    f"WITH {S.LINES}, one AS (SELECT map_id, pix, min(value) AS value FROM l GROUP BY ALL) "
    "SELECT map_id, pix, value, row_number() OVER (PARTITION BY map_id ORDER BY value, pix) AS rn FROM one",
)
def value_rank(spark, d):
    """Takes the large-map path (8 buckets) whatever the table size."""
    df, n = X.sky_lines(spark, d)
    one = materialize(df.groupBy("map_id", "pix").agg(F.min("value").alias("value")))
    return order.value_rank(one, npix_of(n), buckets=8).select("map_id", "pix", "value", F.col("rn").cast("long").alias("rn"))


RANKED = f"""WITH {S.MULTI}, srt AS (SELECT map_id, value, row_number() OVER (PARTITION BY map_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY map_id) AS n FROM m),
st AS (SELECT *, CAST(ceil(n/{BINS}.0::DOUBLE) AS BIGINT) AS step FROM srt),
ch AS (SELECT *, i // step AS k FROM st),
kn AS (SELECT map_id, k, max(CASE WHEN i = k*step + least(step, n - k*step)//2 THEN value END) AS value,
  CASE WHEN any_value(n) = 1 THEN 1.0 ELSE least(1.0, k*any_value(step)/(any_value(n) - 1.0::DOUBLE)) END AS cdf FROM ch GROUP BY map_id, k),
lim AS (SELECT map_id, min(value) AS minv, max(value) AS maxv FROM m GROUP BY 1)"""


@query("hist_knots", f"{RANKED} SELECT map_id, k, {S.r6('value')} AS value, {S.r6('cdf')} AS cdf FROM kn")
def hist_knots(spark, d):
    df, n = X.stored_multi(spark, d)
    out = histogram.hist_knots(df, npix_of(n), BINS, buckets=8)
    return out.select("map_id", "k", r6("value").alias("value"), r6("cdf").alias("cdf"))


@query(
    "hist_range",
    f"{RANKED} SELECT map_id, {S.r6('max(CASE WHEN i = CAST(round((n-1)*0.1::DOUBLE) AS BIGINT) THEN value END)')} AS minv, "
    f"{S.r6('max(CASE WHEN i = CAST(round((n-1)*0.9::DOUBLE) AS BIGINT) THEN value END)')} AS maxv, {S.r6('min(value)')} AS fmin, {S.r6('max(value)')} AS fmax FROM st GROUP BY 1",
)
def hist_range(spark, d):
    df, n = X.stored_multi(spark, d)
    p = histogram.hist_range(df, histogram.HistogramRange("percentile", 0.1, 0.9), npix_of(n), buckets=8)
    f = histogram.hist_range(df, histogram.HistogramRange(), npix_of(n)).select("map_id", F.col("minv").alias("fmin"), F.col("maxv").alias("fmax"))
    return p.join(f, "map_id").select("map_id", *[r6(c).alias(c) for c in ("minv", "maxv", "fmin", "fmax")])


def _hists(spark, d):
    df, n = X.stored_multi(spark, d)
    knots = histogram.knot_arrays(histogram.hist_knots(df, npix_of(n), BINS))
    lim = histogram.hist_range(df, histogram.HistogramRange(), npix_of(n))
    return df, materialize(knots), lim


_LOCATED = f"""{RANKED}, loc AS (SELECT v.map_id, v.pix, v.value AS v, max(kn.k) AS k0 FROM m v LEFT JOIN kn ON kn.map_id = v.map_id AND kn.value <= v.value GROUP BY ALL),
pr AS (SELECT loc.map_id, pix, v, minv, maxv, a.value AS x0, a.cdf AS p0, b.value AS x1, b.cdf AS p1 FROM loc JOIN lim USING (map_id)
  LEFT JOIN kn a ON a.map_id = loc.map_id AND a.k = k0 LEFT JOIN kn b ON b.map_id = loc.map_id AND b.k = coalesce(k0, -1) + 1)"""
_SHARE = "CASE WHEN x0 IS NULL THEN 0.0 WHEN x0 = v THEN p0 WHEN x1 IS NULL THEN 1.0 ELSE p0 + (v-x0)/(x1-x0)*(p1-p0) END"


@query("hist_lookup", f"{_LOCATED} SELECT map_id, pix, {S.r6(_SHARE)} AS share FROM pr")
def hist_lookup(spark, d):
    df, knots, _ = _hists(spark, d)
    joined = with_knot_position(histogram.with_knots(df, knots))
    return joined.select("map_id", "pix", r6(knot_share("value", "xs", "ps", "at")).alias("share"))


@query("hist_lookup_asof", f"{_LOCATED} SELECT map_id, pix, {S.r6(_SHARE)} AS share FROM pr")
def hist_lookup_asof(spark, d):
    df, n = X.stored_multi(spark, d)
    knots = histogram.hist_knots(df, npix_of(n), BINS)
    return histogram.share_by_asof(df, knots).select("map_id", "pix", r6("share").alias("share"))


@query(
    "scale_histogram",
    f"{_LOCATED} SELECT map_id, pix, {S.r6(f'CASE WHEN v <= minv THEN 0.0 WHEN v >= maxv THEN 1.0 ELSE {_SHARE} END')} AS t FROM pr",
)
def scale_histogram(spark, d):
    df, knots, lim = _hists(spark, d)
    return histogram.stretch_by_histogram(df, knots, lim).select("map_id", "pix", r6("t").alias("t"))


@query(
    "cdf_step",
    f"{_LOCATED} SELECT map_id, pix, {S.r6('CASE WHEN x0 IS NULL THEN 0.0 WHEN x0 = v THEN p0 WHEN x1 IS NULL THEN 1.0 ELSE p1 END')} AS share FROM pr",
)
def cdf_step(spark, d):
    df, knots, _ = _hists(spark, d)
    joined = histogram.with_cdf_step(histogram.with_knots(df, knots))
    return joined.select("map_id", "pix", r6("share").alias("share"))


_QS = f"""{RANKED}, q AS (SELECT map_id, minv, maxv, i, i/97.0::DOUBLE AS q FROM lim, (SELECT unnest(range(0, 98)) AS i)),
loc AS (SELECT q.map_id, i, q, minv, maxv, max(kn.k) AS k0 FROM q LEFT JOIN kn ON kn.map_id = q.map_id AND kn.cdf <= q.q GROUP BY ALL),
pr AS (SELECT loc.map_id, i, q, minv, maxv, a.value AS x0, a.cdf AS p0, b.value AS x1, b.cdf AS p1 FROM loc
  LEFT JOIN kn a ON a.map_id = loc.map_id AND a.k = k0 LEFT JOIN kn b ON b.map_id = loc.map_id AND b.k = coalesce(k0, -1) + 1),
vq AS (SELECT map_id, i, q, CASE WHEN q <= 0 THEN minv WHEN q >= 1 THEN maxv WHEN x0 IS NULL THEN x1 WHEN p0 = q THEN x0 WHEN x1 IS NULL THEN x0
  ELSE x0 + (q-p0)/(p1-p0)*(x1-x0) END AS value, CASE WHEN x0 IS NULL THEN x1 WHEN p0 = q THEN x0 WHEN x1 IS NULL THEN x0 ELSE x1 END AS step_value FROM pr)"""


def _hist_rows(spark, d):
    _, knots, lim = _hists(spark, d)
    return knots.join(lim, "map_id")


@query("cdf_inverse", f"{_QS} SELECT map_id, i, {S.r6('step_value')} AS value FROM vq")
def cdf_inverse(spark, d):
    rows = _hist_rows(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(97).cast("long"))))
    rows = histogram.with_cdf_inverse(rows.withColumn("q", F.col("i") / 97.0))
    return rows.select("map_id", "i", r6("value").alias("value"))


@query("value_at_quantile", f"{_QS} SELECT map_id, i, {S.r6('q')} AS q, {S.r6('value')} AS value FROM vq")
def value_at_quantile(spark, d):
    out = histogram.quantile_table(_hist_rows(spark, d), 98)
    return out.select("map_id", F.col("i").cast("long").alias("i"), r6("q").alias("q"), r6("value").alias("value"))


@query(
    "distortion_profile",
    f"{_QS}, sl AS (SELECT map_id, i, CASE WHEN i = 0 THEN abs(lead(value) OVER w - value)*97 WHEN i = 97 THEN abs(value - lag(value) OVER w)*97 "
    "ELSE abs(lead(value) OVER w - lag(value) OVER w)*97/2 END AS s FROM vq WINDOW w AS (PARTITION BY map_id ORDER BY i)), "
    "lg AS (SELECT map_id, i, ln(1 + s) AS g FROM sl) "
    f"SELECT map_id, i, {S.r6('g/max(g) OVER (PARTITION BY map_id)')} AS distortion FROM lg",
)
def distortion_profile(spark, d):
    out = histogram.distortion_profile(_hist_rows(spark, d), 98)
    return out.select("map_id", F.col("i").cast("long").alias("i"), r6("distortion").alias("distortion"))
