"""Ordered point tracks: projection, breaks, segments, rasterisation.

``seq`` is the position of a point in its track: unique integers from 0, without
gaps (``dense_seq`` makes them so). Tracks are processed in chunks of ``span``
positions, keyed by (track_id, chunk): neighbours come from a halo of copied
border rows, running counts from chunk totals. One track may hold any share of
the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from skymap.functions.frames import IDENTITY, Matrix, grid_transform, rotate, vec_to_lonlat
from skymap.functions.pixels import idiv
from skymap.functions.projections import arcmin, plane_about_pole, plane_of_local
from skymap.functions.staging import as_col
from skymap.operators.raster import Projection
from skymap.plans.sizing import small_side

SPAN = 65_536
# Fixed values of the break rules.
FIRST_JUMP, LEAST_JUMP, GROWTH = 0.15, 0.05, 3.0
CELL_JUMP = 50.0

KEYS = ["track_id", "chunk"]


def _in_chunk(keys: list[str] = KEYS) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("seq")


def _so_far(keys: list[str] = KEYS) -> WindowSpec:
    return _in_chunk(keys).rowsBetween(W.unboundedPreceding, W.currentRow)


def _by_chunk() -> WindowSpec:
    return W.partitionBy("track_id").orderBy("chunk")


def _earlier() -> WindowSpec:
    return _by_chunk().rowsBetween(W.unboundedPreceding, -1)


def _chunk_of(span: int) -> Column:
    """Chunk of a position. Never NULL: a join key that may be NULL would get its own
    filter below the shuffle, and both sides of the join could not share it."""
    chunk = idiv(F.col("seq").cast("long"), F.lit(span).cast("long"))
    return F.coalesce(chunk, F.lit(0).cast("long"))


def dense_seq(df: DataFrame, span: int = SPAN) -> DataFrame:
    """Renumber unique integer positions 0, 1, 2, ... per track.

    A chunk counts its rows; a running total over chunks gives its start.
    """
    rows = df.withColumn("chunk", _chunk_of(span))
    counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cnt"))
    start = F.coalesce(F.sum("cnt").over(_earlier()), F.lit(0))
    starts = small_side(counts.select(*KEYS, start.alias("__start")))
    numbered = rows.withColumn("__at", F.row_number().over(_in_chunk()) - 1).join(starts, KEYS)
    return numbered.withColumn("seq", F.col("__start") + F.col("__at")).drop("chunk", "__start", "__at")


def with_halo(df: DataFrame, span: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy border rows into the neighbouring chunk; ``own`` marks the originals.

    A narrow step: windows over (track_id, chunk) then see the true neighbours.
    """
    home = _chunk_of(span)
    at = F.coalesce(F.col("seq") % span, F.lit(0))
    copies = [F.array(home)]
    if before:
        copies.append(F.array_repeat(home + 1, (at >= span - before).cast("int")))
    if after:
        copies.append(F.array_repeat(home - 1, ((at < after) & (home > 0)).cast("int")))
    out = df.withColumn("chunk", F.explode(F.concat(*copies)))
    return out.withColumn("own", F.col("chunk") == home)


# -------------------------------------------------------------------- projection


def track_project(
    df: DataFrame, proj: Projection, source: str, target: str, view: Matrix = IDENTITY
) -> DataFrame:
    """Track points: their frame -> map frame -> view -> plane (u, v), NULL if outside."""
    x, y, z = rotate(view, grid_transform("lon", "lat", source, target))
    df = df.withColumns({"__x": x, "__y": y, "__z": z})
    lon, lat = vec_to_lonlat("__x", "__y", "__z")
    df = df.withColumns({"__lon": lon, "__lat": lat})
    return proj.with_forward(df, "__lon", "__lat").drop("__x", "__y", "__z", "__lon", "__lat")


def track_project_gnomonic(
    df: DataFrame, width: int, res_arcmin: float, source: str, target: str, view: Matrix = IDENTITY
) -> DataFrame:
    """Track points on the plane about the view's +z axis, in cells; NULL behind it."""
    x, y, z = rotate(view, grid_transform("lon", "lat", source, target))
    df = df.withColumns({"__x": x, "__y": y, "__z": z})
    px, py = plane_about_pole("__x", "__y", "__z", arcmin(res_arcmin), width / 2.0, width / 2.0)
    return df.withColumns({"px": px, "py": py}).drop("__x", "__y", "__z")


def track_project_tangent(df: DataFrame, width: int, res_arcmin: float) -> DataFrame:
    """Local tangent angles (lon, lat) in cells; NULL behind the plane."""
    px, py = plane_of_local("lon", "lat", arcmin(res_arcmin), width / 2.0, width / 2.0)
    return df.withColumns({"px": px, "py": py})


# ------------------------------------------------------------------------ breaks


def _distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _break_rules(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows with a halo (``own``): the way each maps its predecessor's state, and the last way that
    fixes it (``anchor``, with the swaps up to it in ``turns``), within its chunk."""
    jump = _distance(
        F.col("u") - F.lag("u").over(_in_chunk(keys)), F.col("v") - F.lag("v").over(_in_chunk(keys))
    )
    rows = rows.withColumn("jump", jump)
    rows = rows.withColumns(
        {"prev": F.lag("jump").over(_in_chunk(keys)), "next": F.lead("jump").over(_in_chunk(keys))}
    ).filter("own")
    j = F.col("jump")
    from_one = F.coalesce(j > FIRST_JUMP, F.lit(True))
    from_two = F.coalesce(
        j > F.greatest(F.lit(LEAST_JUMP), F.col("prev") * GROWTH), j.isNull()
    )
    rows = rows.withColumns(
        {
            "fixed": F.when(from_one & from_two, F.lit(1)).when(~from_one & ~from_two, F.lit(2)),
            "swap": F.when(~from_one & from_two, F.lit(1)).otherwise(F.lit(0)),
        }
    ).withColumn("turns", F.sum("swap").over(_so_far(keys)))
    anchor = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    return rows.withColumn("anchor", F.last(anchor, ignorenulls=True).over(_so_far(keys)))


def _state(entering: Column) -> Column:
    """State of a row (stands alone: 1, not: 2), from the state its chunk is entered with."""
    since = F.col("turns") - F.coalesce(F.col("anchor.turns"), F.lit(0))
    base = F.coalesce(F.col("anchor.fixed"), entering)
    return F.when(since % 2 == 0, base).otherwise(F.lit(3) - base)


def _here() -> Column:
    return F.col("u").isNotNull() & F.col("v").isNotNull()


def track_breaks(df: DataFrame, span: int = SPAN) -> DataFrame:
    """(track_id, seg_id, seq, u, v): tracks split at jumps and missing points.

    A point joins the segment of its predecessor unless the jump exceeds 0.15
    (segment of one point) or max(0.05, 3 x previous step) (longer segment). So
    each point maps the state "predecessor stands alone (1) / not (2)" to its own
    state, in one of four ways: always 1, always 2, keep, swap. Such maps compose:
    the state is the last "always", turned over by every swap since. That needs
    running windows only, within a chunk and then over chunks. Segments of one
    point are dropped.
    """
    rows = _break_rules(with_halo(df.select("track_id", "seq", "u", "v"), span, before=2, after=1))
    here = _here()
    starts = lambda e: F.count_if(here & (_state(F.lit(e)) == 1))
    chunks = rows.groupBy(*KEYS).agg(
        F.max_by(F.when(F.col("anchor").isNotNull(), _state(F.lit(1))), "seq").alias("fixed"),
        F.max_by(F.when(F.col("anchor").isNull(), F.col("turns")), "seq").alias("turns"),
        starts(1).alias("starts1"),
        starts(2).alias("starts2"),
    )
    turned = chunks.withColumn(
        "turns", F.sum(F.coalesce("turns", F.lit(0))).over(_by_chunk().rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    anchor = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    entered = turned.withColumns(
        {
            "anchor": F.last(anchor, ignorenulls=True).over(_earlier()),
            "before": F.coalesce(F.lag("turns").over(_by_chunk()), F.lit(0)),
        }
    )
    since = F.col("before") - F.coalesce(F.col("anchor.turns"), F.lit(0))
    base = F.coalesce(F.col("anchor.fixed"), F.lit(1))
    entered = entered.withColumn(
        "enter", F.when(since % 2 == 0, base).otherwise(F.lit(3) - base)
    )
    opened = F.when(F.col("enter") == 1, F.col("starts1")).otherwise(F.col("starts2"))
    heads = entered.withColumn("opened", opened).select(
        *KEYS, "enter", F.coalesce(F.sum("opened").over(_earlier()), F.lit(0)).alias("opened")
    )
    out = rows.join(heads, KEYS)
    start = here & (_state(F.col("enter")) == 1)
    out = out.withColumn("start", start.cast("int"))
    out = out.withColumn("seg_id", F.col("opened") + F.sum("start").over(_so_far()) - 1)
    alone = (F.col("start") == 1) & ~F.coalesce(F.col("next") <= FIRST_JUMP, F.lit(False))
    return out.filter(here & ~alone).select(
        "track_id", F.col("seg_id").cast("long").alias("seg_id"), "seq", "u", "v"
    )


def track_breaks_px(df: DataFrame, span: int = SPAN) -> DataFrame:
    """(track_id, seg_id, seq, px, py): missing points removed, split at > 50 cells."""
    kept = df.filter(F.col("px").isNotNull() & F.col("py").isNotNull())
    kept = dense_seq(kept.select("track_id", "seq", "px", "py"), span)
    rows = with_halo(kept, span, before=1)
    far = _distance(
        F.col("px") - F.lag("px").over(_in_chunk()), F.col("py") - F.lag("py").over(_in_chunk())
    )
    rows = rows.withColumn("start", F.coalesce(far > CELL_JUMP, F.lit(True)).cast("int"))
    rows = rows.filter("own")
    totals = rows.groupBy(*KEYS).agg(F.sum("start").alias("opened"))
    heads = totals.select(*KEYS, F.coalesce(F.sum("opened").over(_earlier()), F.lit(0)).alias("opened"))
    out = rows.join(heads, KEYS).withColumn(
        "seg_id", F.col("opened") + F.sum("start").over(_so_far()) - 1
    )
    return out.select("track_id", F.col("seg_id").cast("long").alias("seg_id"), "seq", "px", "py")


def track_segments(df: DataFrame, a: str = "u", b: str = "v", span: int = SPAN) -> DataFrame:
    """Consecutive point pairs of each segment: (track_id, seg_id, seq, a0, b0, a1, b1)."""
    rows = with_halo(df.select("track_id", "seg_id", "seq", a, b), span, after=1)
    nxt = lambda c: F.lead(c).over(_in_chunk())
    rows = rows.withColumns(
        {"__s": nxt("seg_id"), "a1": nxt(a), "b1": nxt(b)}
    ).filter(F.col("own") & (F.col("__s") == F.col("seg_id")))
    return rows.select(
        "track_id", "seg_id", "seq", F.col(a).alias("a0"), F.col(b).alias("b0"), "a1", "b1"
    )


def short_lines(df: DataFrame) -> DataFrame:
    """(track_id, seq, a0, b0, a1, b1): the segments of ``track_breaks`` for tracks of one chunk, without
    their numbers. A point that joins its predecessor makes a segment with it, so one pass over the
    sorted track does; it leaves the rows dealt by track."""
    rows = _break_rules(df.select("track_id", "seq", "u", "v", F.lit(True).alias("own")), ["track_id"])
    before = lambda c: F.lag(c).over(_in_chunk(["track_id"]))
    rows = rows.withColumns({"a0": before("u"), "b0": before("v")})
    joined = rows.filter(_here() & (_state(F.lit(1)) == 2))
    return joined.select("track_id", (F.col("seq") - 1).alias("seq"), "a0", "b0", F.col("u").alias("a1"), F.col("v").alias("b1"))


def _track_ends(df: DataFrame) -> tuple[bool, int]:
    """(whether all tracks are numbered 0, 1, 2, ..., largest position)."""
    at = F.col("seq").cast("long")
    ends = df.groupBy("track_id").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"), F.sum(at).alias("s"))
    dense = (F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (2 * F.col("s") == F.col("n") * F.col("b"))
    uneven, last = ends.agg(F.count_if(~F.coalesce(dense, F.lit(False))), F.max("b")).first()
    return uneven == 0, last or 0


# ----------------------------------------------------------------- rasterisation


def _toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def track_raster_dda(segs: DataFrame, width: int, height: int) -> DataFrame:
    """Cells of each (u, v) segment by rounded linear steps; zero length gives none."""
    return _dda_cells(segs, width, height).select("track_id", "seg_id", "seq", "x", "y")


def _dda_cells(segs: DataFrame, width: int, height: int) -> DataFrame:
    ends = segs.withColumns(
        {
            "__x0": _toward_zero(F.col("a0") * (width - 1)),
            "__y0": _toward_zero(F.col("b0") * (height - 1)),
            "__x1": _toward_zero(F.col("a1") * (width - 1)),
            "__y1": _toward_zero(F.col("b1") * (height - 1)),
        }
    )
    steps = F.greatest(F.abs(F.col("__x1") - F.col("__x0")), F.abs(F.col("__y1") - F.col("__y0")))
    ends = ends.withColumn("__n", steps).filter(F.col("__n") > 0)
    walk = ends.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    share = F.col("__i") / F.col("__n")
    at = lambda p, q: F.round((F.lit(1.0) - share) * F.col(p) + share * F.col(q))
    cells = walk.withColumns(
        {"x": at("__x0", "__x1").cast("int"), "y": at("__y0", "__y1").cast("int")}
    )
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return cells.filter(inside)


def track_raster_bres(segs: DataFrame, width: int, height: int) -> DataFrame:
    """Cells of each segment in cell coordinates, by the integer line rule.

    With M the longer and m the shorter side, step i lies i cells along the long
    side and max(0, ceil(((2 i + 1) m - M) / (2 M))) along the short one, which is
    what the incremental error rule walks through. Steps outside the raster on
    the long side are cut before they are generated.
    """
    ends = segs.withColumns(
        {
            "__x0": _toward_zero(F.col("a0")),
            "__y0": _toward_zero(F.col("b0")),
            "__x1": _toward_zero(F.col("a1")),
            "__y1": _toward_zero(F.col("b1")),
        }
    )
    dx, dy = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    ends = ends.withColumns(
        {
            "__flat": F.abs(dx) >= F.abs(dy),
            "__long": F.greatest(F.abs(dx), F.abs(dy)),
            "__short": F.least(F.abs(dx), F.abs(dy)),
            "__sx": F.when(dx > 0, F.lit(1)).otherwise(F.lit(-1)),
            "__sy": F.when(dy > 0, F.lit(1)).otherwise(F.lit(-1)),
        }
    )
    flat = F.col("__flat")
    origin = F.when(flat, F.col("__x0")).otherwise(F.col("__y0"))
    ahead = F.when(flat, F.col("__sx")).otherwise(F.col("__sy")) > 0
    side = F.when(flat, F.lit(width)).otherwise(F.lit(height)).cast("long")
    zero = F.lit(0).cast("long")
    first = F.greatest(zero, F.when(ahead, -origin).otherwise(origin - side + 1))
    last = F.least(F.col("__long"), F.when(ahead, side - 1 - origin).otherwise(origin))
    ends = ends.withColumns({"__i0": first, "__i1": last}).filter(F.col("__i0") <= F.col("__i1"))
    walk = ends.withColumn("__i", F.explode(F.sequence(F.col("__i0"), F.col("__i1"))))
    i, big, small = F.col("__i"), F.col("__long"), F.col("__short")
    over = (i * 2 + 1) * small - big
    minor = F.when((i == 0) | (over <= 0), zero).otherwise(
        idiv(over + big * 2 - 1, F.greatest(big * 2, F.lit(1)))
    )
    along, across = F.when(flat, i).otherwise(minor), F.when(flat, minor).otherwise(i)
    cells = walk.withColumns(
        {
            "x": (F.col("__x0") + F.col("__sx") * along).cast("int"),
            "y": (F.col("__y0") + F.col("__sy") * across).cast("int"),
        }
    )
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return cells.filter(inside).select("track_id", "seg_id", "seq", "x", "y")


def draw_tracks(
    tracks: DataFrame, proj: Projection, source: str, target: str, view: Matrix = IDENTITY
) -> DataFrame:
    """Distinct raster cells covered by projected tracks, with the track they come from.

    ``seq`` orders the points of a track; gaps in it are closed first, where there are any. Tracks of
    one chunk each are sorted once and drawn where they lie.
    """
    dense, last = _track_ends(tracks)
    if not dense:
        tracks = dense_seq(tracks)
    if proj.kind == "gnomonic":
        placed = track_project_gnomonic(tracks, proj.width, proj.res, source, target, view)
        segs = track_segments(track_breaks_px(placed), "px", "py")
        cells = track_raster_bres(segs, proj.width, proj.height)
    else:
        placed = track_project(tracks, proj, source, target, view)
        segs = short_lines(placed) if dense and last < SPAN else track_segments(track_breaks(placed))
        cells = _dda_cells(segs, proj.width, proj.height)
    return cells.select("track_id", "x", "y").distinct()


def cells_as_layer(cells: DataFrame, rgba=(0, 0, 0, 255), map_id: Column | str = "map_id") -> DataFrame:
    """Track cells in one colour, ready for ``layer_union``."""
    colour = F.struct(*[F.lit(c).alias(n) for c, n in zip(rgba, "rgba")])
    return cells.select(as_col(map_id).alias("map_id"), "x", "y").distinct().withColumn("rgba", colour)
