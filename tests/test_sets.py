"""Bitmaps, generated masks, pyramids, maps of mixed geometry and frame."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymap.functions import frames
from skymap.functions import projections as P
from skymap.functions.pixels import npix_of
from skymap.operators import bitmap, degrade, fit, geometry, limits, masks, pyramid, raster

RNG = np.random.default_rng(5)


def pixel_sets():
    """Whole blocks and words, single pixels, borders of words, groups and blocks."""
    block = 1 << 16
    return {
        "none": [],
        "edges": [0, 63, 64, 4095, 4096, 65535, 65536, 3 * block - 1, 3 * block],
        "block": list(range(block, 2 * block)),
        "words": [*range(64, 128), *range(4096 * 5, 4096 * 6), 200, 70000 + 63],
        "random": RNG.choice(3 * block, 5000, replace=False).tolist(),
    }


@pytest.mark.parametrize("name", list(pixel_sets()))
@pytest.mark.parametrize("way", ["proven", "measured", "join"])
def test_in_set(spark, name, way):
    chosen = pixel_sets()[name]
    rows = spark.createDataFrame([(p, True) for p in chosen] + [(5, False), (5, None)] + [(p, False) for p in chosen[:3]], "pix long, keep boolean")
    pixels = spark.range(0, 200_000).select(F.col("id").alias("pix"), F.lit("m").alias("map_id"))
    pixels = pixels.unionByName(spark.createDataFrame([(None, "m")], "pix long, map_id string"))
    options = {"proven": {"nside": 256}, "measured": {}, "join": {"most_bytes": -1}}[way]
    got = bitmap.in_set(pixels, rows, F.col("keep"), **options)
    assert got.count() == 200_001
    assert sorted(r.pix for r in got.filter("member").collect()) == sorted(p for p in chosen if p < 200_000)


def test_in_set_with_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 70_000)], "mask_id string, pix long")
    pixels = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 70_000), ("c", 1)], "mask_id string, pix long")
    got = bitmap.in_set(pixels, rows, F.lit(True), ["mask_id"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, True), ("a", 2, False), ("b", 2, True), ("b", 70_000, True), ("c", 1, False)]


def test_pixels_stay_where_they_are(spark):
    """The pixel table meets the mask without an exchange of its own."""
    pixels = spark.range(0, 3000, 1, 4).select(F.lit("m").alias("map_id"), F.col("id").alias("pix"), F.lit(1.0).alias("value"))
    mask = spark.range(0, 3000, 1, 4).select(F.col("id").alias("pix"), (F.col("id") % 3 == 0).alias("valid"))
    applied = masks.mask_apply(pixels, mask, nside=16)
    subtracted = fit.subtract_mono_dipole(pixels, 16, "RING", mask=mask, n_maps=1)
    for df in (applied, subtracted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        # The mask is dealt by block, the fit's fourteen numbers by map; pixels by nothing.
        assert dealt and not any("pix#" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)
    assert applied.filter("valid").count() == 1000


def test_bound_of_bytes(spark):
    """The proven size holds for the worst set: every word mixed."""
    rows = spark.range(npix_of(128)).select(F.col("id").alias("pix"))
    packed = bitmap.pack(rows, F.col("pix") % 2 == 0)
    assert bitmap.packed_bytes(packed) <= bitmap.bound_bytes(128)


@pytest.mark.parametrize("nside", [1, 2, 3, 8, 20])
def test_permutation(spark, nside):
    pixels = spark.range(npix_of(nside)).select(F.col("id").alias("pix"))
    images = [masks.with_permuted(pixels, nside, seed).orderBy("pix").toPandas().image for seed in (0, 7)]
    for image in images:
        assert sorted(image) == list(range(npix_of(nside)))
    assert nside < 3 or (images[0] != images[1]).mean() > 0.5
    hidden = masks.mask_random(spark, nside, 0.3, 7).filter("not valid").count()
    assert hidden == int(npix_of(nside) * 0.3)


def test_random_mask_is_even(spark):
    """Hidden pixels of a large map are spread like independent draws over the twelve faces."""
    hidden = masks.mask_random(spark, 64, 0.25, 3).filter("not valid")
    counts = hidden.groupBy(F.floor(F.col("pix") / 4096)).count().toPandas()["count"]
    assert len(counts) == 12 and abs(counts - 1024).max() < 5 * math.sqrt(1024 * 0.75)


@pytest.mark.parametrize("kind", [masks.BAND, masks.UNIFORM, masks.PATCH, masks.RANDOM])
def test_masks_of_specs(spark, kind):
    """A table of specifications gives what the single functions give."""
    amount = {masks.BAND: 12.5, masks.UNIFORM: 0.3, masks.PATCH: 40.0, masks.RANDOM: 0.4}[kind]
    single = {masks.BAND: masks.mask_band, masks.UNIFORM: masks.mask_uniform, masks.PATCH: masks.mask_patch, masks.RANDOM: masks.mask_random}[kind]
    specs = spark.createDataFrame([("p", 4, amount), ("q", 2, amount)], "mask_id string, nside long, amount double")
    got = masks.masks_of(specs, kind)
    for name, n in (("p", 4), ("q", 2)):
        own = sorted(map(tuple, got.filter(F.col("mask_id") == name).select("pix", "valid").collect()))
        assert own == sorted(map(tuple, single(spark, n, amount).collect()))
    with pytest.raises(ValueError, match="unknown kind"):
        masks.masks_of(specs, "spiral")


@pytest.mark.parametrize("ordering", ["RING", "NESTED"])
def test_pyramid_equals_full_means(spark, ordering):
    rows = [("m", int(p), float(RNG.normal()) if p % 5 else None) for p in range(npix_of(16)) if p % 7]
    rows += [("k", 3, None), ("k", 9, 2.0)]
    df = spark.createDataFrame(rows, "map_id string, pix long, value double")
    made = pyramid.build(df, 16, ordering)
    assert list(made.levels) == [8, 4, 2, 1]
    for n in made.levels:
        want = {(r.map_id, r.pix): r.value for r in degrade.degrade_best(df, 16, n, ordering).collect()}
        got = {(r.map_id, r.pix): r.value for r in pyramid.level(made, n, ordering).collect()}
        assert want.keys() == got.keys()
        assert all((a is None) == (got[k] is None) and (a is None or abs(a - got[k]) < 1e-12) for k, a in want.items())
    # Levels are read from what is stored; the map itself is not scanned again.
    assert "ExistingRDD" not in pyramid.level(made, 2)._jdf.queryExecution().executedPlan().toString()
    assert pyramid.level_for(made, 8) == 4 and pyramid.level_for(made, 1000) == 16 and pyramid.level_for(made, 1) == 1
    with pytest.raises(ValueError, match="no level"):
        pyramid.level(made, 16)


def test_mixed_geometries(spark):
    """Each map is treated by its own resolution and ordering."""
    rows = [(m, p, float(p)) for m, n in (("a", 8), ("b", 4), ("c", 4)) for p in range(npix_of(n))]
    df = spark.createDataFrame(rows, "map_id string, pix long, value double")
    maps = spark.createDataFrame([("a", 8, "RING"), ("b", 4, "NESTED"), ("c", 4, "RING")], "map_id string, nside long, ordering string")
    assert geometry.geometries(maps) == [(4, "NESTED"), (4, "RING"), (8, "RING")]
    got = geometry.degrade_maps(df, maps, 1)
    for m, n, o in (("a", 8, "RING"), ("b", 4, "NESTED"), ("c", 4, "RING")):
        want = sorted(map(tuple, degrade.degrade_best(df.filter(F.col("map_id") == m), n, n // 2, o).collect()))
        assert sorted(map(tuple, got.filter(F.col("map_id") == m).select("map_id", "pix", "value").collect())) == want
    fits = {r.map_id: r for r in geometry.fit_maps(df, maps).collect()}
    one = fit.fit_mono_dipole(df.filter("map_id = 'b'"), 4, "NESTED").first()
    assert fits["b"].m == pytest.approx(one.m) and fits["b"].dz == pytest.approx(one.dz) and len(fits) == 3
    with pytest.raises(ValueError, match="unknown geometry"):
        geometry.geometries(maps.withColumn("ordering", F.lit("SPIRAL")))


def test_frames_in_rows(spark):
    rows = [(a, b, 0.3, -0.5, 0.81) for a in "GCE" for b in "GCE"] + [("X", "G", 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "source string, target string, x double, y double, z double")
    got = {(r.source, r.target): (r.x, r.y, r.z) for r in frames.with_frames(df).collect()}
    for a, b, *v in rows[:9]:
        want = [sum(k * c for k, c in zip(row, v)) for row in frames.frame_matrix(a, b)]
        assert got[a, b] == pytest.approx(want, abs=1e-15)
    assert got["X", "G"] == (None, None, None)


@pytest.mark.parametrize("buckets", [1, 16])
@pytest.mark.parametrize("kind", ["linear", "histogram"])
def test_weighted_limits(spark, buckets, kind):
    """Values count as often as the grid hits them; a map without a hit takes its own."""
    proj = raster.Projection(P.GNOMONIC, 24, 24, 30.0, 40.0, 20.0, 0.4)
    hits = raster.unit_hits(spark, proj, 8, "RING")
    counts = {r.pix: r.hits for r in hits.collect()}
    assert sum(counts.values()) == 24 * 24
    rows = [("a", p, float(RNG.normal())) for p in range(npix_of(8))]
    missed = [p for p in range(npix_of(8)) if p not in counts][:50]
    rows += [("b", p, float(p)) for p in missed] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "map_id string, pix long, value double")
    got = {r.map_id: r for r in limits.fov_limits(df, hits, 24 * 24, npix_of(8), kind, buckets=buckets).collect()}
    each = np.sort([v for m, p, v in rows if m == "a" for _ in range(counts.get(p, 0))])
    want = (each[0], each[-1]) if kind == "histogram" else tuple(np.quantile(each, [0.05, 0.95]))
    assert (got["a"].minv, got["a"].maxv) == pytest.approx(want, abs=1e-12)
    assert got["b"].status == "ok" and got["c"].status == "empty"


def test_mask_needs_its_nside(spark):
    df = spark.createDataFrame([("m", 0, 1.0)], "map_id string, pix long, value double")
    maps = spark.createDataFrame([("m",)], "map_id string")
    lim = spark.createDataFrame([("m", 0.0, 1.0)], "map_id string, minv double, maxv double")
    mask = spark.createDataFrame([(0, True)], "pix long, valid boolean")
    with pytest.raises(ValueError, match="needs its mask_nside"):
        raster.reproject(df, maps, lim, raster.Projection(P.MOLLWEIDE, 8, 4), 1, "RING", mask=mask)


def test_sketches_merge_within_their_error(spark):
    """Parts of very different sizes and values; one map is empty."""
    from skymap.operators import sketch

    parts = [RNG.normal(size=60_000), RNG.exponential(size=3_000) + 5, np.full(20_000, 0.25)]
    values = np.concatenate(parts)
    rows = spark.createDataFrame([(float(v),) for v in values], "value double").withColumn("map_id", F.lit("m"))
    rows = rows.withColumn("part", F.floor(F.abs(F.hash("value")) % 7)).unionByName(
        spark.createDataFrame([("e", None, 0)], "map_id string, value double, part long")
    )
    made = sketch.merge_sketches(sketch.sketch_maps(rows, ("map_id", "part")))
    got = {r.map_id: r for r in sketch.quantiles(made, {f"q{i}": i / 20 for i in range(21)}).collect()}
    assert got["m"].n == len(values) and got["m"].q0 == values.min() and got["m"].q20 == values.max()
    for i in range(1, 20):
        q = got["m"][f"q{i}"]
        low, high = (values < q).mean(), (values <= q).mean()
        assert low - sketch.rank_error() <= i / 20 <= high + sketch.rank_error()
    limits_of = {r.map_id: r for r in sketch.sketch_limits(made).collect()}
    assert limits_of["e"].status == "empty" and limits_of["e"].minv is None and limits_of["m"].status == "ok"
    assert {r.maxv for r in sketch.sketch_limits(made, "histogram").collect()} == {None, values.max()}


@pytest.mark.parametrize("n,m", [(8, 2), (2, 8), (4, 4)])
@pytest.mark.parametrize("rule", ["any", "majority", "all"])
def test_turned_mask(spark, n, m, rule):
    """Against numpy: each fine pixel of the map asks the mask pixel that holds its centre."""
    from skymap.functions.frames import frame_matrix
    from skymap.functions.pixels import with_ang2pix_nest
    from skymap.operators import regions

    hidden = set(RNG.choice(npix_of(m), npix_of(m) // 3, replace=False).tolist())
    mask = spark.createDataFrame([(p, p not in hidden) for p in range(npix_of(m)) if p % 11], "pix long, valid boolean")
    got = masks.turn_mask(mask, m, "NESTED", "C", n, "NESTED", "G", rule)
    fine = max(n, m)
    v = regions.centres(np.arange(npix_of(fine)), fine.bit_length() - 1) @ np.array(frame_matrix("G", "C")).T
    angles = spark.createDataFrame(
        [(i, float(math.acos(max(-1, min(1, z)))), float(math.atan2(y, x))) for i, (x, y, z) in enumerate(v)], "i long, theta double, phi double"
    )
    at = with_ang2pix_nest(angles, m, out="at").orderBy("i").toPandas()["at"].to_numpy()
    bad = np.array([p in hidden and p % 11 != 0 for p in at]).reshape(npix_of(n), -1)
    want = {"any": bad.any(axis=1), "majority": bad.mean(axis=1) > 0.5, "all": bad.all(axis=1)}[rule]
    rows = {r.pix: r.valid for r in got.collect()}
    assert rows == {p: not b for p, b in enumerate(want.tolist())}


def test_figure_takes_a_foreign_mask(spark):
    """A mask of another resolution, ordering and frame is turned; one that fits is left."""
    from skymap.plans.figure import figure

    raw = spark.range(npix_of(8)).select(F.lit("m").alias("map_id"), F.col("id").alias("pix"), (F.col("id") + 1.0).alias("value"))
    maps = spark.createDataFrame([("m", 8)], "map_id string, nside long")
    mask = spark.range(npix_of(4)).select(F.col("id").alias("pix"), (F.col("id") % 2 == 0).alias("valid"))
    plain = figure(raw, maps, 8, "RING", width=32)
    turned = masks.turn_mask(mask, 4, "NESTED", "E", 8, "RING", "G")
    want = figure(raw, maps, 8, "RING", width=32, mask=turned, mask_nside=8)
    got = figure(raw, maps, 8, "RING", width=32, mask=mask, mask_nside=4, mask_ordering="NESTED", mask_frame="E", frame="G")
    key = lambda df: sorted(map(tuple, df.select("x", "y", "pix").collect()))
    assert key(got) == key(want) and 0 < len(key(got)) < plain.count()
