"""Operators against brute force, with one key or value that holds most rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skymap.functions.stretch import Scale
from skymap.operators import degrade, fit, histogram, limits, masks, order, raster, tracks
from skymap.sources import generated


@pytest.fixture(scope="module")
def skewed(spark):
    """Three maps; one has most rows, and one value fills a third of it."""
    rng = np.random.default_rng(3)
    parts = []
    for name, n in (("big", 9000), ("mid", 700), ("one", 1)):
        v = rng.normal(size=n).round(3)
        if name == "big":
            v[rng.permutation(n)[: n // 3]] = 0.25
        parts.append(pd.DataFrame({"map_id": name, "pix": rng.permutation(n), "value": v}))
    pdf = pd.concat(parts)
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_value_rank(skewed, buckets):
    df, pdf = skewed
    got = order.value_rank(df, 9000, buckets=buckets).toPandas()
    want = pdf.sort_values(["map_id", "value", "pix"]).assign(rn=lambda x: x.groupby("map_id").cumcount() + 1)
    both = got.merge(want, on=["map_id", "pix", "value"])
    assert len(both) == len(pdf) and (both.rn_x == both.rn_y).all()


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_quantiles(skewed, buckets):
    df, pdf = skewed
    qs = {f"q{i}": q for i, q in enumerate((0.0, 0.05, 0.333, 0.5, 0.95, 1.0))}
    got = order.exact_quantiles(df, qs, 9000, buckets=buckets).toPandas().set_index("map_id")
    near = order.exact_quantiles(df, qs, 9000, method="nearest", buckets=buckets).toPandas().set_index("map_id")
    for name, part in pdf.groupby("map_id"):
        s = np.sort(part.value)
        for k, q in qs.items():
            assert got.loc[name, k] == pytest.approx(np.quantile(s, q), abs=1e-12)
            assert near.loc[name, k] == s[math.floor((len(s) - 1) * q + 0.5)]


@pytest.mark.parametrize("buckets", [1, 16])
@pytest.mark.parametrize("bins", [5, 64, 1024])
def test_knots(skewed, buckets, bins):
    df, pdf = skewed
    got = histogram.hist_knots(df, 9000, bins, buckets=buckets).toPandas()
    for name, part in pdf.groupby("map_id"):
        s = np.sort(part.value)
        n, step = len(s), -(-len(s) // bins)
        chunks = [s[i : i + step] for i in range(0, n, step)]
        mine = got[got.map_id == name].sort_values("k")
        assert list(mine.k) == list(range(len(chunks)))
        assert np.allclose(mine.value, [c[len(c) // 2] for c in chunks])
        assert np.allclose(mine.cdf, [min(1.0, i * step / (n - 1)) if n > 1 else 1.0 for i in range(len(chunks))])


def test_random_mask_is_exact(spark):
    m = masks.mask_random(spark, 16, 0.1, seed=5)
    again = masks.mask_random(spark, 16, 0.1, seed=6)
    assert m.filter("not valid").count() == int(3072 * 0.1) and m.count() == 3072
    assert m.filter("not valid").join(again.filter("not valid"), "pix").count() < 150


def test_mask_range(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (3, 3.5), (4, None), (5, math.nan)], "pix long, value double")
    got = [r.valid for r in masks.mask_range(df, 1.0, 3.0).orderBy("pix").collect()]
    assert got == [False, True, True, False, False, False]
    above = [r.valid for r in masks.mask_range(df, None, 3.0).orderBy("pix").collect()]
    assert above == [True, True, True, False, True, False]


@pytest.mark.parametrize("ordering", ["RING", "NESTED"])
def test_degrade_full_map(spark, ordering):
    """Orderings agree: the RING result, renumbered, is the NESTED one."""
    from skymap.functions.pixels import with_ring2nest

    n, t = 16, 4
    ring = generated.index_map(spark, n)
    nest = with_ring2nest(ring, n).select("map_id", F.col("pix_nest").alias("pix"), "value")
    for f in (degrade.degrade_best, degrade.degrade_balanced, degrade.degrade_fast):
        a = with_ring2nest(f(ring, n, t, "RING"), t).select(F.col("pix_nest").alias("pix"), F.col("value").alias("a"))
        b = f(nest, n, t, "NESTED").select("pix", F.col("value").alias("b"))
        both = a.join(b, "pix").toPandas()
        assert len(both) == 12 * t * t and np.allclose(both.a, both.b)


def test_degrade_rules(spark):
    df = generated.index_map(spark, 4)
    assert degrade.degrade_best(df, 4, 8, "RING").count() == 192
    with pytest.raises(ValueError):
        degrade.degrade_best(df, 8, 3, "RING")
    assert degrade.target_nside(1200, 600) == 512
    assert degrade.auto_target(2048, 1200) == 512 and degrade.auto_target(1024, 1200) == 1024
    assert degrade.auto_target(8192, degrade.GNOMONIC_WIDTH) == 8192
    assert degrade.auto_target(2048, 1200, enabled=False) == 2048


def test_fit_recovers_a_dipole(spark):
    from skymap.functions.frames import sph_to_vec
    from skymap.functions.pixels import with_pix2ang_ring

    df = with_pix2ang_ring(generated.index_map(spark, 8), 8)
    x, y, z = sph_to_vec("theta", "phi")
    df = df.select("map_id", "pix", (F.lit(5.0) + x * 3 - y * 2 + z).alias("value"))
    row = fit.fit_mono_dipole(df, 8, "RING").first()
    assert (row.m, row.dx, row.dy, row.dz) == pytest.approx((5, 3, -2, 1), abs=1e-9)
    assert row.amplitude == pytest.approx(math.sqrt(14)) and 0 <= row.lon < 360
    left = fit.subtract_mono_dipole(df, 8, "RING").agg(F.max(F.abs("value"))).first()[0]
    assert left < 1e-9
    two = df.filter("pix < 2")
    assert fit.fit_mono_dipole(two, 8, "RING").first().m == 0.0


def test_limits_rules(spark, skewed):
    df, pdf = skewed
    df = df.filter("map_id = 'big'")
    s = pdf[pdf.map_id == "big"].value
    for buckets in (1, 16):
        row = limits.auto_limits(df, 9000, buckets=buckets).first()
        assert (row.minv, row.maxv) == pytest.approx((np.quantile(s, 0.05), np.quantile(s, 0.95)))
    row = limits.auto_limits(df, 9000, minv=-9.0).first()
    assert row.minv == pytest.approx(np.quantile(s, 0.05))
    assert limits.auto_limits(df, 9000, minv=-9.0, strict_limits=True).first().minv == -9.0
    empty = df.withColumn("value", F.lit(None).cast("double"))
    for buckets in (1, 16):
        row = limits.auto_limits(empty, 9000, buckets=buckets).first()
        assert (row.map_id, row.minv, row.maxv, row.status) == ("big", None, None, "empty")
    assert limits.auto_limits(df, 9000, minv=2.0, maxv=1.0).first().status == "swapped"
    with pytest.raises(Exception, match="no valid pixel"):
        limits.auto_limits(empty, 9000, strict=True).collect()
    with pytest.raises(Exception, match="minimum above maximum"):
        limits.auto_limits(df, 9000, minv=2.0, maxv=1.0, strict=True).collect()


def test_many_knots(spark):
    squares = spark.range(20_000).select(F.lit("m").alias("map_id"), F.col("id").alias("pix"), (F.col("id") * F.col("id")).cast("double").alias("value"))
    arrays = histogram.knot_arrays(histogram.hist_knots(squares, 20_000, 4096))
    bounds = limits.map_min_max(squares)
    t = histogram.stretch_by_histogram(squares, arrays, bounds, 1, bins=4096).toPandas().set_index("pix").t
    assert t[12_000] == pytest.approx(0.6, abs=1e-3) and t[18_000] == pytest.approx(0.9, abs=1e-3)
    with pytest.raises(Exception, match="array longer than 1024"):
        histogram.stretch_by_histogram(squares, arrays, bounds, 1).collect()


def test_one_mask_of_several(spark):
    df = generated.index_map(spark, 2)
    two = spark.createDataFrame([("a", p, p < 24) for p in range(48)] + [("b", p, p < 12) for p in range(48)], "mask_id string, pix long, valid boolean")
    assert masks.mask_apply(df, two, "b").filter("valid").count() == 12
    own = df.withColumn("mask_id", F.lit("a"))
    assert masks.mask_apply(own, two).filter("valid").count() == 24 and masks.mask_apply(own, two).count() == 48
    with pytest.raises(ValueError, match="mask_id"):
        masks.mask_apply(df, two)


def test_one_colour_table_of_several(spark):
    lut = _lut(spark).withColumn("cmap", F.lit("a"))
    both = lut.unionByName(lut.withColumn("cmap", F.lit("b")))
    cells = spark.range(5).select((F.col("id") / 4).alias("t"))
    assert raster.colorize(cells, both, cmap="b").count() == 5
    with pytest.raises(Exception, match="given twice"):
        raster.colorize(cells, both).collect()


def test_refusals(spark):
    df = generated.index_map(spark, 4)
    with pytest.raises(ValueError, match="ordering"):
        degrade.degrade_ang(df, 4, 2, "ring")
    with pytest.raises(ValueError, match="ratio"):
        degrade.degrade(df, 4, 2, "RING", "two_phase")
    with pytest.raises(ValueError, match="policy"):
        degrade.degrade(df, 4, 2, "RING", "other")


def test_sampled_percentiles(spark, skewed):
    df, pdf = skewed
    df = df.unionByName(spark.createDataFrame([("none", 1, 2.0)], df.schema))
    for buckets in (1, 8):
        got = limits.percentile_sampled(df, {"p": 50.0}, 9000, 5, buckets).toPandas().set_index("map_id").p
        assert got["none"] == 0.0
        big = pdf[(pdf.map_id == "big") & (pdf.pix % 5 == 0)].value
        assert got["big"] == pytest.approx(np.quantile(big, 0.5))


# ------------------------------------------------------------------------- tracks


def _walk(points):
    """The break rule, point by point."""
    done, cur = [], []
    for p in points:
        if p is None:
            done.append(cur)
            cur = []
            continue
        if cur:
            jump = math.dist(p, cur[-1])
            allowed = 0.15 if len(cur) < 2 else max(3 * math.dist(cur[-1], cur[-2]), 0.05)
            if jump > allowed:
                done.append(cur)
                cur = []
        cur.append(p)
    done.append(cur)
    return [s for s in done if len(s) > 1]


@pytest.mark.parametrize("span", [3, 4, 17, 65_536])
def test_track_breaks(spark, span):
    """Chunks of any size give the breaks of the plain walk, also for one long track."""
    rng = np.random.default_rng(11)
    rows = []
    for track, n in ((0, 4000), (1, 50), (2, 1), (3, 2)):
        at = np.array([0.5, 0.5])
        for i in range(n):
            step = rng.choice([0.002, 0.03, 0.06, 0.1, 0.4], p=[0.35, 0.25, 0.2, 0.15, 0.05])
            a = rng.uniform(0, 2 * math.pi)
            at = at + step * np.array([math.cos(a), math.sin(a)])
            gone = rng.random() < 0.03
            rows.append((track, i, None if gone else float(at[0]), None if gone else float(at[1])))
    df = spark.createDataFrame(rows, "track_id long, seq long, u double, v double")
    got = tracks.track_breaks(df, span).orderBy("track_id", "seq").toPandas()
    pdf = pd.DataFrame(rows, columns=["track_id", "seq", "u", "v"])
    for track, part in pdf.groupby("track_id"):
        pts = [None if math.isnan(u) else (u, v) for u, v in zip(part.u, part.v)]
        mine = got[got.track_id == track]
        segs = [list(zip(s.u, s.v)) for _, s in mine.groupby("seg_id")]
        assert segs == _walk(pts)
    pairs = tracks.track_segments(tracks.track_breaks(df, span), span=span).count()
    assert pairs == len(got) - got.groupby("track_id").seg_id.nunique().sum()


def test_dense_seq(spark):
    rows = [(t, s) for t in range(3) for s in range(0, 500, t + 2)]
    df = spark.createDataFrame(rows, "track_id long, seq long").withColumn("old", F.col("seq"))
    got = tracks.dense_seq(df, 16).orderBy("track_id", "old").toPandas()
    for _, part in got.groupby("track_id"):
        assert list(part.seq) == list(range(len(part)))


def _line(x0, y0, x1, y1):
    """The incremental line rule."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    sx, sy = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1)
    err, out = (dx - dy) / 2, []
    while True:
        out.append((x0, y0))
        if (x0, y0) == (x1, y1):
            return out
        e = err
        if e > -dx:
            err, x0 = err - dy, x0 + sx
        if e < dy:
            err, y0 = err + dx, y0 + sy


def test_line_cells(spark):
    rng = np.random.default_rng(2)
    ends = rng.integers(-40, 90, (800, 4)).tolist() + [[5, 5, 5, 5], [0, 0, 9, 0], [0, 9, 0, 0], [3, 3, 9, 9]]
    rows = [(i, 0, 0, *map(float, e)) for i, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "track_id long, seg_id long, seq long, a0 double, b0 double, a1 double, b1 double")
    got = tracks.track_raster_bres(df, 60, 50).toPandas()
    cells = {i: set() for i in range(len(ends))}
    for t, x, y in zip(got.track_id, got.x, got.y):
        cells[t].add((x, y))
    assert len(got) == sum(map(len, cells.values()))
    for i, e in enumerate(ends):
        assert cells[i] == {(x, y) for x, y in _line(*e) if 0 <= x < 60 and 0 <= y < 50}


# ------------------------------------------------------------------------ rasters


def _maps(spark, n):
    return spark.createDataFrame([("index", n)], "map_id string, nside long")


def _lut(spark):
    i = F.col("id").cast("int")
    return spark.range(256).select(i.alias("idx"), i.alias("r"), i.alias("g"), i.alias("b"))


@pytest.mark.parametrize("kind", ["linear", "log", "asinh", "symlog", "plancklog", "histogram"])
def test_reproject_every_stretch(spark, kind):
    n = 4
    df = generated.index_map(spark, n).withColumn("value", F.col("value") + 1)
    lim = limits.auto_limits(df, 192, kind)
    knots = histogram.knot_arrays(histogram.hist_knots(df, 192)) if kind == "histogram" else None
    out = raster.render_mollweide(df, _maps(spark, n), lim, 40, n, "RING", lut=_lut(spark), scale=Scale(kind, 10.0), knots=knots)
    pdf = out.toPandas()
    assert len(pdf) > 500 and pdf.t.between(0, 1).all()
    assert all(c == (128, 128, 128, 255) or c[3] == 255 for c in pdf.rgba)


def test_mask_without_fill_drops_cells_and_checks_nside(spark):
    n = 4
    df = generated.index_map(spark, n)
    lim = limits.auto_limits(df, 192)
    half = masks.mask_uniform(spark, n, 0.5)
    args = (df, _maps(spark, n), lim, 40, n, "RING")
    whole = raster.render_mollweide(*args)
    cut = raster.render_mollweide(*args, mask=half, mask_nside=n)
    assert cut.count() == whole.filter("pix < 96").count()
    filled = raster.render_mollweide(*args, lut=_lut(spark), mask=half, mask_nside=n, fill=(1, 2, 3, 4))
    assert filled.count() == whole.count() and filled.filter("rgba.a = 4").count() == whole.filter("pix >= 96").count()
    with pytest.raises(ValueError):
        raster.render_mollweide(*args, mask=half, mask_nside=8)


def test_reproject_never_shuffles_the_map(spark, tmp_path):
    """The pixel table meets the raster by a broadcast semi join on its scan."""
    generated.index_map(spark, 64).write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    index = raster.raster_index(spark, raster.Projection("mollweide", 40, 20), 64, "RING")
    plan = raster.raster_values(df, _maps(spark, 64), index, raster.Projection("mollweide", 40, 20))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in text and "BroadcastHashJoin" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SinglePartition" not in text
    scan_up = text[: text.index("FileScan parquet")].rsplit("Exchange", 1)[1]
    assert "LeftSemi" in scan_up


def test_layers_and_tiles(spark):
    a = spark.createDataFrame([("m", 0, 0, (1, 1, 1, 255)), ("m", 1, 0, (1, 1, 1, 255))], "map_id string, x int, y int, rgba struct<r:int,g:int,b:int,a:int>")
    b = spark.createDataFrame([("m", 1, 0, (9, 9, 9, 255))], a.schema)
    got = {(r.x, r.y): r.rgba.r for r in raster.layer_union([a, b]).collect()}
    assert got == {(0, 0): 1, (1, 0): 9}
    sizes = spark.createDataFrame([("m", 130, 64)], "map_id string, width int, height int")
    tiles = raster.partition_tiles(sizes, 64).orderBy("x0").collect()
    assert [(t.x0, t.w, t.h) for t in tiles] == [(0, 64, 64), (64, 64, 64), (128, 2, 64)]


def test_sample_ramp(spark):
    n = 16
    df = generated.index_map(spark, n).withColumn("value", F.col("value") * 0.1)
    pts = spark.createDataFrame(
        [("index", float(t), float(p)) for t, p in zip((0.5, 1, 1.5, 2, 2.5, 3, 3.1, math.pi), (0, 1, 2, 3, 4, 5, 6, 2 * math.pi))]
        + [("index", math.nan, 1.0)],
        "map_id string, theta double, phi double",
    )
    rows = raster.sample_points(pts, df, n, "RING").collect()
    assert sum(r.value is None for r in rows) == 1
    assert all(r.value == pytest.approx(0.1 * r.pix) for r in rows if r.pix is not None)


def test_asof_join(spark):
    """One key with half of all rows, one value with a third, ties, nulls, keys of one side only."""
    from skymap.operators.asof import asof_join

    rng = np.random.default_rng(8)
    left = [("hot", 7.0 if rng.random() < 0.6 else float(rng.integers(0, 40)), i) for i in range(900)]
    left += [(str(rng.choice(["a", "b", "lone"])), float(rng.normal() * 10), 1000 + i) for i in range(300)]
    left += [("a", None, 2000), (None, 1.0, 2001), ("a", 1.0, 2002), ("a", 1.0, 2002)]
    right = [("hot", float(x), k, k) for k, x in enumerate(sorted(rng.integers(0, 40, 60)))]
    right += [("a", -3.0, 0, 100), ("a", 2.0, 1, 101), ("b", 0.0, 0, 102), ("b", None, 1, 103), (None, 0.0, 0, 104), ("only", 0.0, 0, 105)]
    l = spark.createDataFrame(left, "m string, v double, i long").repartition(5)
    r = spark.createDataFrame(right, "m string, v double, k long, id long")
    got = asof_join(l, r, "m", "v", "k").collect()

    def want(m, v):
        near = [(x, k, i) for n, x, k, i in right if m is not None and n == m and x is not None and v is not None and x <= v]
        return max(near)[2] if near else None

    assert len(got) == len(left)
    assert sorted(((x.m, x.v, x.i, x.hit and x.hit.id) for x in got), key=repr) == sorted(((m, v, i, want(m, v)) for m, v, i in left), key=repr)
