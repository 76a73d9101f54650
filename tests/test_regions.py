"""Sky regions, their covers, and the store that is read by them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymap.functions import projections as P
from skymap.functions.frames import camera_matrix, view_matrix
from skymap.functions.pixels import npix_of, with_pix2ang_nest
from skymap.operators import raster, regions
from skymap.sources import store

RNG = np.random.default_rng(11)


def some_regions():
    out = [regions.cone(0.0, math.pi / 2, 0.2), regions.cone(1.0, -math.pi / 2, 2.0), regions.cone(2.0, 0.1, 0.0)]
    for _ in range(12):
        lon, lat, r = RNG.uniform(0, 2 * math.pi), math.asin(RNG.uniform(-1, 1)), RNG.uniform(0.01, 1.2)
        out.append(regions.cone(lon, lat, r))
    for _ in range(8):
        lon, lat, r = RNG.uniform(0, 2 * math.pi), RNG.uniform(-1.2, 1.2), RNG.uniform(0.02, 0.4)
        turns = np.sort(RNG.uniform(0, 2 * math.pi, 3)) if RNG.random() < 0.3 else np.arange(5) * 2 * math.pi / 5
        if np.ptp(turns) < math.pi:
            continue
        out.append(regions.polygon([regions.direction(lon + r * math.cos(t), lat + r * math.sin(t) * 0.5) for t in turns]))
    return out


def inside(region, vectors):
    ok = np.ones(len(vectors), bool)
    for axis, least in region.caps:
        ok &= vectors @ np.array(axis) >= least
    return ok


def test_centres(spark):
    for order in (0, 1, 3, 5):
        n = 1 << order
        pix = spark.range(npix_of(n)).select(F.col("id").alias("pix"))
        got = with_pix2ang_nest(pix, n).orderBy("pix").toPandas()
        want = np.stack([np.sin(got.theta) * np.cos(got.phi), np.sin(got.theta) * np.sin(got.phi), np.cos(got.theta)], axis=1)
        assert np.allclose(regions.centres(np.arange(npix_of(n)), order), want, atol=1e-12)


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_radius(order):
    """No centre of a pixel six steps below lies farther away; the bound is nearly met."""
    cells = np.arange(npix_of(1 << order))
    below = regions.centres(np.arange(npix_of(1 << (order + 5))), order + 5).reshape(len(cells), -1, 3)
    far = np.arccos(np.clip(np.einsum("ijk,ik->ij", below, regions.centres(cells, order)), -1, 1)).max()
    assert far <= regions.radius_of(order) <= far * 1.25


@pytest.mark.parametrize("region", some_regions())
def test_cover_holds_the_region(region):
    order = 6
    vectors = regions.centres(np.arange(npix_of(1 << order)), order)
    want = np.flatnonzero(inside(region, vectors))
    for ranges in (regions.cover(region, order), regions.pixel_ranges(region, 1 << order, 8), regions.cover(region, order, most=20)):
        assert all(a < b for a, b in ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        held = np.zeros(len(vectors), bool)
        for a, b in ranges:
            held[a:b] = True
        assert held[want].all()
    near = regions.cover(region, order)
    # Besides the region only a rim of two pixels.
    spare = sum(b - a for a, b in near) - len(want)
    assert spare <= 12 * math.sqrt(max(len(want), 1)) * 4 + 60


def test_shortened():
    ranges = [(0, 2), (3, 4), (10, 11), (12, 20), (100, 101)]
    assert regions.shortened(ranges, 3) == [(0, 4), (10, 20), (100, 101)]
    assert regions.shortened(ranges, 1) == [(0, 101)] and regions.shortened([], 3) == []
    assert regions.shortened(ranges, 9) == ranges


def test_bad_polygons():
    points = [regions.direction(a, b) for a, b in ((0, 0), (0.4, 0), (0.1, 0.1), (0, 0.4))]
    with pytest.raises(ValueError, match="not convex"):
        regions.polygon(points)
    with pytest.raises(ValueError, match="three corners"):
        regions.polygon(points[:2])
    with pytest.raises(ValueError, match="fall together"):
        regions.polygon([points[0], points[0], points[1]])


@pytest.mark.parametrize("lon,lat,roll", [(266.4, -28.9, 0.25), (0.0, 89.5, 0.0), (180.0, 10.0, 1.0)])
def test_footprint_holds_all_hits(spark, lon, lat, roll):
    view = view_matrix("G", "C", camera_matrix(0.3, 0.2, 0.1))
    proj = raster.Projection(P.GNOMONIC, 60, 60, 20.0, lon, lat, roll)
    hits = {r.pix for r in raster.raster_index(spark, proj, 64, "NESTED", view).select("pix").distinct().collect()}
    ranges = regions.pixel_ranges(regions.footprint(proj, view), 64)
    held = {p for a, b in ranges for p in range(a, b)}
    assert hits <= held and len(held) < 4 * len(hits) + 100
    assert regions.footprint(raster.Projection(P.MOLLWEIDE, 60, 30)) is None


def test_cells_of_cones(spark):
    rows = [(i, float(RNG.uniform(0, 6.28)), float(math.asin(RNG.uniform(-1, 1))), float(RNG.uniform(0.01, 0.6))) for i in range(20)]
    cones = spark.createDataFrame(rows, "k long, lon double, lat double, radius double")
    got = regions.cells_of_cones(cones, 3).groupBy("k").agg(F.collect_set("cell").alias("c")).collect()
    held = {r.k: set(r.c) for r in got}
    fine = regions.centres(np.arange(npix_of(64)), 6)
    for k, lon, lat, radius in rows:
        touched = set((np.flatnonzero(inside(regions.cone(lon, lat, radius), fine)) >> 6).tolist())
        assert touched <= held[k]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Full maps of nside 64 and 16, one of each ordering, with row groups of a few thousand rows."""
    path = f"file://{tmp_path_factory.mktemp('store')}/s"
    parts = []
    for name, n in (("a", 64), ("b", 16)):
        parts.append(spark.range(npix_of(n)).select(F.lit(name).alias("map_id"), F.col("id").alias("pix"), (F.col("id") % 1000).cast("double").alias("value")))
    maps = spark.createDataFrame([("a", 64, "RING"), ("b", 16, "NESTED")], "map_id string, nside long, ordering string")
    store.write_store(parts[0].unionByName(parts[1]), maps, path, group_bytes=16 << 10)
    return path


def scan_rows(df):
    """Rows that the file scan of an executed plan gave out."""
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_row_groups_are_skipped(spark, stored):
    region = regions.cone(1.0, 0.3, 0.1)
    near = store.read_region(spark, stored, 64, region, exact=False)
    n = len(near.collect())
    plan = near._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(pix," in plan and "nside#" in plan.split("PartitionFilters")[1]
    assert 0 < n <= scan_rows(near) < npix_of(64) / 8
    exact = store.read_region(spark, stored, 64, region)
    want = np.flatnonzero(inside(region, regions.centres(np.arange(npix_of(64)), 6)))
    assert sorted(r.pix for r in exact.collect()) == want.tolist()


def test_store_keeps_all_maps(spark, stored):
    assert store.read_store(spark, stored, 64).count() == npix_of(64)
    b = {r.pix: r.value for r in store.read_store(spark, stored, 16).collect()}
    assert b == {p: float(p % 1000) for p in range(npix_of(16))}


def test_sample_stored(spark, stored):
    points = spark.createDataFrame([("a", 1.2, 0.5), ("a", 1.21, 0.52), ("b", 1.2, 0.5), ("a", float("nan"), 0.0)], "map_id string, theta double, phi double")
    flat = store.read_store(spark, stored, 64)
    got = store.sample_stored(points.filter("map_id = 'a'"), stored, 64)
    want = raster.sample_points(points.filter("map_id = 'a'"), flat, 64, "NESTED")
    key = lambda df: sorted(map(repr, df.select("theta", "pix", "value").collect()))
    assert key(got) == key(want)


def test_unknown_map_fails(spark, tmp_path):
    pixels = spark.createDataFrame([("x", 0, 1.0)], "map_id string, pix long, value double")
    maps = spark.createDataFrame([("y", 1, "RING")], "map_id string, nside long, ordering string")
    with pytest.raises(Exception, match="no ordering known for map x"):
        store.write_store(pixels, maps, f"file://{tmp_path}/s")
