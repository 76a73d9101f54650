"""Plans that hold when the tables grow: what is broadcast, how work is dealt."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import functions as F

from skymap.operators import raster, regions, tracks
from skymap.operators.raster import Projection


def _plan(df) -> str:
    """The plan that adaptive execution ended with."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_cells_of_maps_are_not_broadcast(spark):
    """A raster over every limit: its cells seem few before they are made of their rows."""
    proj = Projection("mollweide", 2900, 1450)
    index = raster.raster_cells(spark, proj.width, proj.height).select("x", "y", (F.col("x") + F.col("y")).cast("long").alias("pix"))
    maps = spark.createDataFrame([("a",), ("b",)], "map_id string").coalesce(1)
    placed = raster.index_of_maps(maps, index, proj)
    per_map = placed.groupBy("map_id").agg(F.count("*").alias("n"), F.sum("pix").alias("s"))
    text = _plan(per_map)
    assert "BroadcastHashJoin" not in text and "BuildRight" in text
    n = proj.width * proj.height
    want = proj.height * sum(range(proj.width)) + proj.width * sum(range(proj.height))
    assert sorted(tuple(r) for r in per_map.collect()) == [("a", n, want), ("b", n, want)]


def test_large_raster_has_the_same_cells(spark, monkeypatch):
    """Broadcast index, broadcast maps and neither: the same rows."""
    maps = spark.createDataFrame([("a",), ("b",), ("c",)], "map_id string")
    pixels = spark.createDataFrame([(m, p, float(p)) for m in "ab" for p in range(0, 192, 3)], "map_id string, pix long, value double")
    proj = Projection("mollweide", 16, 8)
    index = raster.raster_index(spark, proj, 4, "RING")
    found = []
    for limit in (1000, 100, 2):
        monkeypatch.setattr(raster, "BROADCAST_ROWS", limit)
        found.append(sorted(map(str, raster.raster_values(pixels, maps, index, proj).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 3 * index.count()


def _cones(spark):
    rows = [(i, 0.1 * i, 0.05 * i - 0.5, 0.05 + 0.01 * (i % 5)) for i in range(20)] + [(90 + i, 1.0, 0.2, 0.1) for i in range(30)]
    return spark.createDataFrame(rows, "cone_id long, lon double, lat double, radius double")


def test_cone_search_deals_pairs(spark, monkeypatch):
    """The join keeps its partitions, and cells of many pairs are cut without losing a pair."""
    n = 64
    pixels = spark.range(12 * n * n).select(F.lit("m").alias("map_id"), F.col("id").alias("pix"), F.col("id").cast("double").alias("value"))
    met = regions.cone_search(_cones(spark), pixels, n)
    assert met.rdd.getNumPartitions() == 8
    want = sorted((r.cone_id, r.pix) for r in met.collect())
    centre = regions.centres(np.arange(12 * n * n), 6)
    for c in (3, 95):
        r = _cones(spark).filter(F.col("cone_id") == c).first()
        near = centre @ regions.direction(r.lon, r.lat) >= math.cos(r.radius)
        assert [p for k, p in want if k == c] == near.nonzero()[0].tolist()
    monkeypatch.setattr(regions, "PAIRS", 50)
    assert sorted((r.cone_id, r.pix) for r in regions.cone_search(_cones(spark), pixels, n).collect()) == want


def test_short_tracks_are_shuffled_once(spark, monkeypatch):
    rows = spark.range(30).select(F.col("id").alias("track_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("seq"))
    jump = F.when((F.col("seq") + F.col("track_id")) % 13 == 0, 0.9).when(F.col("seq") % 17 < 2, 0.4).otherwise(0.03)
    points = rows.select("track_id", "seq", (F.col("seq") * jump - 1.5).alias("lon"), (F.sin(F.col("seq") * jump) * 1.2).alias("lat"))
    proj = Projection("mollweide", 64, 32)
    cells = tracks.draw_tracks(points, proj, "G", "G")
    assert _plan(cells).count("Exchange hashpartitioning") <= 1
    short = sorted(map(tuple, cells.collect()))
    monkeypatch.setattr(tracks, "SPAN", 10)
    assert sorted(map(tuple, tracks.draw_tracks(points, proj, "G", "G").collect())) == short and len(short) > 500
    monkeypatch.undo()
    gaps = points.withColumn("seq", F.col("seq") * 3 + 5)
    assert sorted(map(tuple, tracks.draw_tracks(gaps, proj, "G", "G").collect())) == short
