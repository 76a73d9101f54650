"""Operators over maps of several resolutions and orderings in one job.

Index formulas are planned for one nside and ordering. Here the plan is made from the ``maps`` table:
one branch for each geometry it holds, of which there are few however many maps there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymap.functions.pixels import NESTED, RING
from skymap.operators.degrade import degrade
from skymap.operators.fit import fit_mono_dipole
from skymap.plans.sizing import small_side

# Resolutions up to nside 2^29 in two orderings.
MOST_GEOMETRIES = 60


def geometries(maps: DataFrame) -> list[tuple[int, str]]:
    """Distinct (nside, ordering) of the maps; anything but RING and NESTED is refused."""
    found = maps.select("nside", "ordering").distinct().limit(MOST_GEOMETRIES + 1).collect()
    if len(found) > MOST_GEOMETRIES:
        raise ValueError("more geometries than resolutions and orderings exist")
    for r in found:
        if r.ordering not in (RING, NESTED) or r.nside is None:
            raise ValueError(f"unknown geometry nside {r.nside}, ordering {r.ordering!r}")
    return sorted((r.nside, r.ordering) for r in found)


def per_geometry(
    pixels: DataFrame, maps: DataFrame, f: Callable[[DataFrame, int, str], DataFrame]
) -> DataFrame:
    """``f(pixels, nside, ordering)`` for the maps of each geometry, with both columns added; ``maps`` is
    (map_id, nside, ordering). Maps that it lacks are left out."""
    known = small_side(maps.select("map_id", F.col("nside").alias("__n"), F.col("ordering").alias("__o")))
    tagged = pixels.join(known, "map_id")
    out = None
    for nside, ordering in geometries(maps):
        own = tagged.filter((F.col("__n") == nside) & (F.col("__o") == ordering)).drop("__n", "__o")
        part = f(own, nside, ordering)
        part = part.withColumns({"nside": F.lit(nside).cast("long"), "ordering": F.lit(ordering)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no maps")
    return out


def degrade_maps(pixels: DataFrame, maps: DataFrame, levels: int = 1, policy: str = "best") -> DataFrame:
    """Every map ``levels`` resolution steps lower, nside 1 at the lowest; ``nside`` is the new one."""
    lower = lambda n: max(1, n >> levels)
    made = per_geometry(pixels, maps, lambda df, n, o: degrade(df, n, lower(n), o, policy))
    return made.withColumn("nside", F.greatest(F.lit(1), F.shiftright("nside", levels)))


def fit_maps(pixels: DataFrame, maps: DataFrame) -> DataFrame:
    """Monopole and dipole of every map, by its own pixel centres."""
    return per_geometry(pixels, maps, fit_mono_dipole)
