"""All resolutions of a map from one pass over its pixels.

Each level holds, for every pixel, the sum and the count of the seen values below it, and comes from
the level above, so it equals the full mean of the map itself: nothing is averaged twice. Levels are
numbered NESTED, where a parent is a bit shift, and each is a quarter of the one before: all of them
together cost a third of the first. They are stored; a raster takes the level it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymap.functions.pixels import NESTED, is_ring, nest_parent, require_power_of_two, with_nest2ring, with_ring2nest
from skymap.operators.degrade import target_nside
from skymap.plans.sizing import stored_table


@dataclass(frozen=True)
class Pyramid:
    """``levels``: nside to its table (map_id, pix NESTED, total, n), finest first."""

    source_nside: int
    levels: dict[int, DataFrame]


def _above(finer: DataFrame, total: str, n) -> DataFrame:
    """The partial aggregate combines siblings before the shuffle."""
    parent = nest_parent("pix", 1).alias("pix")
    return finer.groupBy("map_id", parent).agg(F.sum(total).alias("total"), n.alias("n"))


def build(pixels: DataFrame, nside: int, ordering: str, smallest: int = 1) -> Pyramid:
    """Levels nside / 2, nside / 4, ... down to ``smallest``, each stored once."""
    require_power_of_two(nside)
    require_power_of_two(smallest)
    rows = pixels.select("map_id", "pix", "value")
    if is_ring(ordering):
        rows = with_ring2nest(rows, nside, "pix", "pix")
    levels: dict[int, DataFrame] = {}
    size, finer = nside, None
    while size > smallest:
        size //= 2
        made = _above(rows, "value", F.count("value")) if finer is None else _above(finer, "total", F.sum("n"))
        levels[size] = finer = stored_table(made)
    return Pyramid(nside, levels)


def level(pyramid: Pyramid, nside: int, ordering: str = NESTED) -> DataFrame:
    """(map_id, pix, value) of one level: the mean of all seen pixels below, NULL where none is seen."""
    if nside not in pyramid.levels:
        raise ValueError(f"the pyramid has no level of nside {nside}")
    rows = pyramid.levels[nside].select("map_id", "pix", (F.col("total") / F.nullif("n", F.lit(0))).alias("value"))
    return with_nest2ring(rows, nside, "pix", "pix") if is_ring(ordering) else rows


def level_for(pyramid: Pyramid, width: int, height: int | None = None) -> int:
    """The nside a raster of this size is drawn from: the coarsest level that is as fine as the
    raster, ``source_nside`` where none is."""
    goal = target_nside(width, height if height is not None else width // 2)
    fine = [n for n in pyramid.levels if n >= goal]
    return min(fine, default=pyramid.source_nside)
