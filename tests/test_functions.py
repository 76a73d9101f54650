"""Whole-map round trips, frames, projections and stretch properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skymap.functions import frames, pixels, projections, stretch
from skymap.functions.values import is_seen

SIZES = [1, 2, 8, 16]


@pytest.mark.parametrize("n", SIZES)
def test_index_round_trips(spark, n):
    df = spark.range(12 * n * n).select(F.col("id").alias("pix"))
    df = pixels.with_xyf2ring(pixels.with_ring2xyf(df, n), n, out="via_xyf")
    df = pixels.with_nest2ring(pixels.with_ring2nest(df, n), n, "pix_nest", "via_nest")
    df = pixels.with_ang2pix_ring(pixels.with_pix2ang_ring(df, n), n, out="via_ang")
    df = pixels.with_pix2ang_nest(df, n, "pix_nest", ("tn", "pn"))
    df = pixels.with_ang2pix_nest(df, n, "tn", "pn", "nest_ang").toPandas()
    assert len(set(df.pix_nest)) == len(df)
    for col in ("via_xyf", "via_nest", "via_ang"):
        assert (df[col] == df.pix).all()
    assert (df.nest_ang == df.pix_nest).all()
    assert np.abs(df.theta - df.tn).max() < 1e-12 and np.abs(df.phi - df.pn).max() < 1e-12


def test_nside_may_be_a_column(spark):
    rows = [(n, p) for n in SIZES for p in range(12 * n * n)]
    df = spark.createDataFrame(rows, "n long, pix long")
    back = pixels.with_xyf2ring(pixels.with_ring2xyf(df, "n"), "n", out="p2")
    assert back.filter("pix <> p2").count() == 0


def test_nested_needs_power_of_two(spark):
    with pytest.raises(ValueError):
        pixels.with_ring2nest(spark.range(1).toDF("pix"), 3)


def test_filter_on_a_result_stays_small(spark):
    """A condition on a derived index must not write the formula out."""
    df = pixels.with_ring2nest(spark.range(768).toDF("pix"), 8)
    plan = df.filter("pix_nest > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_seen_rules(spark):
    cases = {
        -1.6375e30: False, -1.637499996306027e30: False, -2e30: False, -1.5e30: False,
        math.inf: False, -math.inf: False, math.nan: False,
        1.234e-5: True, -1e-6: True, 0.0: True, 1.0: True, -0.5e30: True,
    }
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    got = [r[0] for r in df.select(is_seen(F.col("v"))).collect()]
    assert got == list(cases.values())


@pytest.mark.parametrize("a", "GCE")
@pytest.mark.parametrize("b", "GCE")
def test_frame_round_trip(a, b):
    m = np.array(frames.matmul(frames.frame_matrix(b, a), frames.frame_matrix(a, b)))
    assert np.abs(m - np.eye(3)).max() < 1e-6


def test_galactic_pole(spark):
    v = frames.rotate(frames.frame_matrix("G", "C"), frames.lonlat_to_vec(F.lit(0.0), F.lit(math.pi / 2)))
    lon, lat = spark.range(1).select(*[F.degrees(c) for c in frames.vec_to_lonlat(*v)]).first()
    assert lon % 360 == pytest.approx(192.85948, abs=1e-4) and lat == pytest.approx(27.12825, abs=1e-4)


def test_camera():
    m = np.array(frames.camera_matrix(1.0, 0.4, 0.2))
    assert np.allclose(m @ m.T, np.eye(3), atol=1e-12)
    front = np.array(frames.camera_matrix(1.0, 0.0)) @ [math.cos(1.0), math.sin(1.0), 0.0]
    assert np.allclose(front, [1, 0, 0], atol=1e-12)
    tilt = np.array(frames.camera_matrix(0.0, 0.4)) @ [1.0, 0.0, 0.0]
    assert np.allclose(tilt, [math.cos(0.4), 0, math.sin(0.4)], atol=1e-12)


def _uv_grid(spark):
    k = F.col("id")
    return spark.range(10_000).select(((k % 100) + 0.5) .alias("a"), (F.floor(k / 100) + 0.5).alias("b")).select(
        (F.col("a") / 100).alias("u0"), (F.col("b") / 100).alias("v0")
    )


@pytest.mark.parametrize("kind", ["mollweide", "hammer"])
def test_projection_round_trip(spark, kind):
    inverse = projections.mollweide_inverse if kind == "mollweide" else projections.hammer_inverse
    lon, lat = inverse("u0", "v0")
    df = _uv_grid(spark).withColumns({"lon": lon, "lat": lat})
    if kind == "mollweide":
        df = projections.with_mollweide_forward(df)
    else:
        df = df.withColumns(dict(zip("uv", projections.hammer_forward("lon", "lat"))))
    out = df.toPandas()
    inside = (2 - 4 * out.u0) ** 2 / 4 + (1 - 2 * out.v0) ** 2 <= 1
    assert (out.lon.notna() == inside).all()
    # Newton converges slowly at the poles; compare away from them.
    ok = out[inside & ((out.v0 - 0.5).abs() < 0.45)]
    assert (ok.u - ok.u0).abs().max() < 1e-6 and (ok.v - ok.v0).abs().max() < 1e-6


def test_mollweide_pole_is_missing(spark):
    df = spark.createDataFrame([(0.0, math.pi / 2), (0.0, 0.0)], "lon double, lat double")
    rows = projections.with_mollweide_forward(df).collect()
    assert rows[0].u is None and rows[1].u == pytest.approx(0.5)


def test_gnomonic_centre(spark):
    lon, lat = projections.gnomonic_cell(F.lit(50), F.lit(50), 100, 1.0, 30.0, -20.0, 0.0)
    row = spark.range(1).select(F.degrees(lon), F.degrees(lat)).first()
    assert row[0] == pytest.approx(30.0) and row[1] == pytest.approx(-20.0)


STRETCHES = {
    "linear": lambda v, a, b: stretch.scale_linear(v, a, b),
    "asinh": lambda v, a, b: stretch.scale_asinh(v, a, b, 10.0),
    "linear_norm": lambda v, a, b: stretch.scale_linear_norm(v, a, b),
    "asinh_norm": lambda v, a, b: stretch.scale_asinh_norm(v, a, b, 10.0),
    "plancklog_norm": lambda v, a, b: stretch.scale_plancklog_norm(v, a, b, 10.0),
}


@pytest.fixture(scope="module")
def stretched(spark):
    """Random values and limits; every stretch on the same rows."""
    rng = np.random.default_rng(7)
    a, b = np.sort(rng.uniform(-1e6, 1e6, (2, 3000)), axis=0)
    v = np.sort(rng.uniform(-1e6, 1e6, 3000))
    df = spark.createDataFrame(pd.DataFrame({"v": v, "a": a, "b": b}))
    cols = {k: f("v", "a", "b") for k, f in STRETCHES.items()}
    ends = {f"{k}_{e}": f(e, "a", "b") for k, f in STRETCHES.items() for e in "ab"}
    fixed = {f"{k}_fixed": f("v", F.lit(-5e5), F.lit(5e5)) for k, f in STRETCHES.items()}
    return df.select("v", *[c.alias(k) for k, c in {**cols, **ends, **fixed}.items()]).toPandas()


@pytest.mark.parametrize("name", STRETCHES)
def test_stretch_properties(stretched, name):
    assert stretched[name].between(0, 1).all()
    assert np.abs(stretched[f"{name}_a"]).max() < 1e-9
    assert np.abs(stretched[f"{name}_b"] - 1).max() < 1e-9
    assert (np.diff(stretched.sort_values("v")[f"{name}_fixed"]) >= -1e-12).all()


def test_stretch_special_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(stretch.scale_linear(lit(50.0), lit(1.0), lit(100.0))) == pytest.approx(49 / 99)
    assert one(stretch.scale_log(lit(10.0), lit(1.0), lit(100.0))) == pytest.approx(0.5)
    assert one(stretch.scale_log(lit(-1.0), lit(1.0), lit(100.0))) is None
    assert one(stretch.scale_log(lit(-1.0), lit(1.0), lit(100.0), "zero")) == 0.0
    for bad in (math.nan, math.inf, -1.6375e30):
        assert one(stretch.scale_linear(lit(bad), lit(0.0), lit(1.0))) is None
    assert one(stretch.scale_linear(lit(3.0), lit(2.0), lit(2.0))) == 0.5
    assert one(stretch.scale_linear(lit(-5.0), lit(0.0), lit(10.0))) == 0.0
    # at the threshold the logarithm is -inf: 0 for positive, 1 for negative values
    assert one(stretch.scale_symlog(lit(2.0), lit(-50.0), lit(50.0), 2.0)) == 0.0
    assert one(stretch.scale_symlog(lit(-2.0), lit(-50.0), lit(50.0), 2.0)) == 1.0
    assert math.isnan(one(stretch.scale_plancklog(lit(5.0), lit(0.0), lit(1.0), 2.0)))
    assert one(stretch.cmap_index(lit(math.nan))) == 0
    assert one(stretch.scale_asinh_norm(lit(-1e6), lit(-1e6), lit(1e6), 1.0)) == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        stretch.gamma("t", 0.0)


def test_null_directions(spark):
    """A direction without colatitude or longitude has no pixel, in either ordering."""
    from skymap.functions.pixels import with_ang2pix

    df = spark.createDataFrame([(None, 1.0), (1.0, None), (1.0, 1.0)], "theta double, phi double")
    for ordering in ("RING", "NESTED"):
        assert [r.pix is None for r in with_ang2pix(df, 16, ordering).collect()] == [True, True, False]
