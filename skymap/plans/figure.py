"""Whole pipelines: from raw pixels to the coloured raster of every map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymap.functions.frames import IDENTITY, Matrix, view_matrix
from skymap.functions.pixels import npix_of
from skymap.functions.projections import GNOMONIC, HAMMER, MOLLWEIDE
from skymap.functions.stretch import Scale
from skymap.operators.clean import clean_map
from skymap.operators.degrade import GNOMONIC_WIDTH, auto_degrade
from skymap.operators.histogram import hist_knots, knot_arrays
from skymap.operators.limits import auto_limits, fov_limits
from skymap.operators.masks import turn_mask
from skymap.operators.raster import GRAY, RGBA, Projection, raster_index, reproject
from skymap.plans.sizing import materialize, stored_table
from skymap.sources.fits import map_metadata, read_maps


def figure(
    raw: DataFrame,
    maps: DataFrame,
    nside: int,
    ordering: str,
    width: int = 1200,
    projection: str = MOLLWEIDE,
    lut: DataFrame | None = None,
    view: Matrix = IDENTITY,
    scale: Scale = Scale(),
    minv: float | None = None,
    maxv: float | None = None,
    gamma: float = 1.0,
    factor: float = 1.0,
    quality: str = "best",
    downgrade: bool = False,
    bad: RGBA = GRAY,
    mask: DataFrame | None = None,
    fill: RGBA | None = None,
    gnomonic: Projection | None = None,
    mask_nside: int | None = None,
    mask_id: str | None = None,
    cmap: str | None = None,
    mask_ordering: str | None = None,
    mask_frame: str | None = None,
    mask_rule: str = "any",
    frame: str = "G",
) -> DataFrame:
    """Clean, lower the resolution, find limits and draw maps of one resolution.

    ``raw`` is (map_id, pix, value) of any number of maps; ``maps`` lists them.
    What several steps read again is stored once: the lowered pixels, the raster
    index and the limits. Limits of a gnomonic cut-out come from its field of view.
    With ``downgrade`` large maps are lowered to what the raster needs. A mask comes
    with its own ``mask_nside`` and, where they are not those of the maps, its ordering and
    frame (``frame`` is the maps'): what differs from the maps as drawn is turned by
    ``masks.turn_mask`` and its rule. A map without values is drawn as bad cells.
    """
    if projection not in (MOLLWEIDE, HAMMER, GNOMONIC):
        raise ValueError(f"unknown projection {projection!r}")
    if projection == GNOMONIC and gnomonic is None:
        raise ValueError("a gnomonic figure needs its projection in ``gnomonic``")
    if mask is not None and mask_nside is None:
        raise ValueError("a mask needs its mask_nside")
    if gamma <= 0:
        raise ValueError("gamma must be > 0")
    pixels = clean_map(raw, factor)
    effective = GNOMONIC_WIDTH if projection == GNOMONIC else width
    lowered, n = auto_degrade(pixels, nside, ordering, effective, quality, downgrade)
    if n < nside:
        pixels = materialize(lowered)
    proj = gnomonic if projection == GNOMONIC else Projection(projection, width, width // 2)
    index = materialize(raster_index(raw.sparkSession, proj, n, ordering, view))
    if projection == GNOMONIC:
        lim = fov_limits(pixels, index, proj.width * proj.height, npix_of(n), scale.kind, minv, maxv)
    else:
        lim = auto_limits(pixels, npix_of(n), scale.kind, minv, maxv)
    lim = materialize(lim)
    knots = None
    if scale.kind == "histogram":
        given = lim if minv is not None and maxv is not None else None
        knots = materialize(knot_arrays(hist_knots(pixels, npix_of(n), scale.bins, given)))
    n_maps = lim.count()
    if mask is not None and (mask_nside, mask_ordering or ordering, mask_frame or frame) != (n, ordering, frame):
        own = mask.filter(F.col("mask_id") == mask_id) if "mask_id" in mask.columns and mask_id is not None else mask
        if "mask_id" in own.columns and mask_id is None:
            raise ValueError("the mask table has mask_id: name one")
        turned = turn_mask(own, mask_nside, mask_ordering or ordering, mask_frame or frame, n, ordering, frame, mask_rule)
        mask, mask_nside, mask_id = materialize(turned), n, None
    drawn = maps.join(lim.select("map_id"), "map_id", "left_semi")
    return reproject(
        pixels, drawn, lim, proj, n, ordering, lut, view, scale, gamma, bad,
        mask=mask, mask_nside=mask_nside, fill=fill, knots=knots, index=index,
        n_maps=n_maps, mask_id=mask_id, cmap=cmap,
    )


# Frames, orderings and resolutions there can be.
MOST_KINDS = 180


def figure_files(
    columns: DataFrame, value_cols: list[int] = [0], width: int = 1200, frame: str = "G", camera: Matrix | None = None, **options
) -> DataFrame:
    """Figures of map files, each map in its own resolution, ordering and sky frame, all shown in one
    frame: (the raster's columns, nside, ordering, coord).

    ``columns`` is the header table (``sources.fits.describe_maps``). Files are told apart by their
    headers, one branch for each kind found; a branch reads its files once and stores their pixels.
    Further options are those of ``figure``.
    """
    kind = ["nside", "ordering", "coord"]
    kinds = map_metadata(columns).select(*kind).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError("more kinds of maps than there are")
    out = None
    for nside, ordering, coord in sorted(kinds):
        own = columns.filter((F.col("nside") == nside) & (F.col("ordering") == ordering) & (F.col("coord") == coord))
        maps = map_metadata(own).filter(F.col("col").isin(value_cols)).select("map_id", "nside")
        raw = stored_table(read_maps(own, value_cols))
        part = figure(raw, maps, nside, ordering, width, view=view_matrix(coord, frame, camera), frame=coord, **options)
        part = part.withColumns({"nside": F.lit(nside).cast("long"), "ordering": F.lit(ordering), "coord": F.lit(coord)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no maps")
    return out
