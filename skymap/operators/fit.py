"""Monopole and dipole: least-squares fit per map and its subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions.frames import sph_to_vec
from skymap.functions.pixels import with_pix2ang
from skymap.functions.staging import compute
from skymap.operators.bitmap import in_set
from skymap.operators.masks import one_mask
from skymap.plans.sizing import small_side

AXES = ("one", "x", "y", "z")
SINGULAR = 1e-15


def _with_axes(df: DataFrame, nside: int, ordering: str) -> DataFrame:
    df = with_pix2ang(df, nside, ordering, "pix", ("__th", "__ph"))
    x, y, z = sph_to_vec("__th", "__ph")
    return df.withColumns({"__x": x, "__y": y, "__z": z}).drop("__th", "__ph")


def _axis(name: str) -> Column:
    return F.lit(1.0) if name == "one" else F.col("__" + name)


def _with_good(df: DataFrame, mask: DataFrame, nside: int) -> DataFrame:
    """Add ``__good``: whether the mask lists the pixel as valid."""
    own, keys = one_mask(mask, df)
    return in_set(df, own, F.col("valid"), [k for k in keys if k != "pix"], nside, "__good")


def fit_sums(df: DataFrame, nside: int, ordering: str, mask: DataFrame | None = None) -> DataFrame:
    """The 10 distinct products of [1, x, y, z] and the 4 moments, per map.

    One aggregate with map-side sums: a map of any size costs 14 numbers per
    task. A mask keeps only its valid pixels, which travel as a bitmap.
    """
    seen = df.filter(F.col("value").isNotNull())
    if mask is not None:
        seen = _with_good(seen, mask, nside).filter("__good")
    rows = _with_axes(seen.select("map_id", "pix", "value"), nside, ordering)
    sums = []
    for i, a in enumerate(AXES):
        for b in AXES[i:]:
            sums.append(F.sum(_axis(a) * _axis(b)).alias(f"a_{a}_{b}"))
        sums.append(F.sum(F.col("value") * _axis(a)).alias(f"b_{a}"))
    return rows.groupBy("map_id").agg(*sums)


def solve_fit(sums: DataFrame) -> DataFrame:
    """(map_id, m, dx, dy, dz) from the sums; zeros when the system is singular.

    The 4x4 symmetric system is solved by the 2x2 minors of its row pairs (0, 1)
    and (2, 3), as plain columns on one row per map. Sums are divided by the pixel
    count first.
    """
    steps = {}
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES[i:], i):
            steps[f"m{i}{j}"] = steps[f"m{j}{i}"] = f"a_{a}_{b} / a_one_one"
        steps[f"r{i}"] = f"b_{a} / a_one_one"
    pairs = [(p, q) for p in range(4) for q in range(p + 1, 4)]
    for tag, top, low in (("s", 0, 1), ("c", 2, 3)):
        for p, q in pairs:
            steps[f"{tag}{p}{q}"] = f":m{top}{p} * :m{low}{q} - :m{low}{p} * :m{top}{q}"
    steps["det"] = (
        ":s01 * :c23 - :s02 * :c13 + :s03 * :c12 + :s12 * :c03 - :s13 * :c02 + :s23 * :c01"
    )
    out = {}
    for col, name in enumerate(("m", "dx", "dy", "dz")):
        rest = [k for k in range(4) if k != col]
        terms = []
        for row in range(4):
            # Cofactor of (row, col), expanded along the row paired with `row`: the
            # other two rows are then one pair, whose 2x2 minors are at hand.
            mate, other = row ^ 1, "c" if row < 2 else "s"
            parts = []
            for pos, k in enumerate(rest):
                p, q = [x for x in rest if x != k]
                parts.append(f"{'-' if pos % 2 else '+'} :m{mate}{k} * :{other}{p}{q}")
            terms.append(f"{'-' if (row + col) % 2 else '+'} ({' '.join(parts)}) * :r{row}")
        out[name] = f"CASE WHEN abs(:det) >= {SINGULAR}D THEN ({' '.join(terms)}) / :det ELSE 0.0D END"
    return compute(sums, steps, out).select("map_id", *out)


def fit_mono_dipole(
    df: DataFrame, nside: int, ordering: str, mask: DataFrame | None = None
) -> DataFrame:
    """Coefficients, dipole amplitude and direction (degrees) of each map.

    Pixel centres follow the ordering of the map.
    """
    fit = solve_fit(fit_sums(df, nside, ordering, mask))
    dx, dy, dz = F.col("dx"), F.col("dy"), F.col("dz")
    amp = F.sqrt(dx * dx + dy * dy + dz * dz)
    lon = F.degrees(F.atan2(dy, dx))
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dz, F.col("amplitude"))))
    return fit.withColumn("amplitude", amp).withColumns(
        {
            "lon": F.when(F.col("amplitude") > 0, F.when(lon < 0, lon + 360.0).otherwise(lon)),
            "lat": F.when(F.col("amplitude") > 0, F.degrees(F.asin(ratio))),
        }
    )


def subtract_mono_dipole(
    df: DataFrame,
    nside: int,
    ordering: str,
    dipole: bool = True,
    mask: DataFrame | None = None,
    n_maps: int | None = None,
) -> DataFrame:
    """Subtract the fitted monopole (and dipole) from the pixels that entered the fit.

    Seen pixels outside the mask keep their value. ``n_maps`` is a known number of
    maps; without it the coefficients are stored and counted.
    """
    fit = solve_fit(fit_sums(df, nside, ordering, mask))
    rows = df
    if mask is not None:
        rows = _with_good(rows, mask, nside)
    else:
        rows = rows.withColumn("__good", F.lit(True))
    rows = _with_axes(rows, nside, ordering)
    rows = rows.join(small_side(fit, n_maps), "map_id", "left")
    model = F.col("m")
    if dipole:
        model = model + F.col("dx") * F.col("__x") + F.col("dy") * F.col("__y") + F.col("dz") * F.col("__z")
    value = F.when(F.col("__good") & F.col("m").isNotNull(), F.col("value") - model).otherwise(F.col("value"))
    return rows.select("map_id", "pix", value.alias("value"))
