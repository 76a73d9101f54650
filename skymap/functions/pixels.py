"""Equal-area pixel indices: RING and NESTED numbering, face coordinates, angles.

Two shapes of function:

* ``Column -> Column`` for short formulas;
* ``DataFrame -> DataFrame`` (``with_*``) for long ones, evaluated in steps.

``nside`` may be an int (constant for the whole table) or a column name, so one job can hold maps of different resolution. ``theta`` is the
colatitude in [0, pi], ``phi`` the longitude in radians.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions.staging import as_col, as_sql, compute

TWO_PI = 2.0 * math.pi
HALF_PI = 0.5 * math.pi

RING = "RING"
NESTED = "NESTED"


def npix_of(nside: int) -> int:
    """Pixels of a full map."""
    return 12 * nside * nside


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def require_power_of_two(nside) -> None:
    """NESTED numbering exists only for nside = 2^k."""
    if isinstance(nside, int) and not is_power_of_two(nside):
        raise ValueError("nside must be a power of two")


def idiv(a: Column, b: Column) -> Column:
    """Integer division, truncating towards zero."""
    return F.call_function("div", a, b)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


# ---------------------------------------------------------------- NESTED bits

# Shift and mask of each halving step of a bit interleave.
_HALVINGS = [
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
]


def _spread_steps(name: str, source: str) -> dict[str, str]:
    """Steps that put the bits of ``source`` on the even places; result ``:name``."""
    steps, last = {}, source
    for k, (shift, mask) in enumerate(_HALVINGS):
        steps[f"{name}{k}"] = f"({last} | shiftleft({last}, {shift})) & {mask}L"
        last = f":{name}{k}"
    return {**steps, name: last}


def _squeeze_steps(name: str, source: str) -> dict[str, str]:
    """Steps that gather the even bits of ``source``; result ``:name``."""
    wider = [m for _, m in _HALVINGS[-2::-1]] + [0x00000000FFFFFFFF]
    steps, last = {f"{name}s": f"{source} & {_HALVINGS[-1][1]}L"}, f":{name}s"
    for k, ((shift, _), mask) in enumerate(zip(_HALVINGS[::-1], wider)):
        steps[f"{name}{k}"] = f"({last} | shiftright({last}, {shift})) & {mask}L"
        last = f":{name}{k}"
    return {**steps, name: last}


def _nest_steps(n: str, x: str, y: str, face: str) -> dict[str, str]:
    """Steps to the NESTED index ``:nest`` of a face cell."""
    return {
        **_spread_steps("mx", x),
        **_spread_steps("my", y),
        "nest": f":mx + shiftleft(:my, 1) + {face} * {n} * {n}",
    }


def _unnest_steps(n: str, p: str) -> dict[str, str]:
    """Steps from a NESTED index to ``:x``, ``:y``, ``:f``."""
    return {
        "infc": f"{p} % ({n} * {n})",
        "f": f"{p} div ({n} * {n})",
        **_squeeze_steps("x", ":infc"),
        **_squeeze_steps("y", "shiftright(:infc, 1)"),
    }


def with_xyf2nest(df: DataFrame, nside, ix="ix", iy="iy", face="face", out="pix") -> DataFrame:
    """Add the NESTED index of cell (ix, iy) on a base face."""
    steps = _nest_steps(as_sql(nside), as_sql(ix), as_sql(iy), as_sql(face))
    return compute(df, steps, {out: ":nest"})


def with_nest2xyf(df: DataFrame, nside, pix="pix", out=("ix", "iy", "face")) -> DataFrame:
    """Add face coordinates of a NESTED index."""
    return compute(df, _unnest_steps(as_sql(nside), as_sql(pix)), dict(zip(out, (":x", ":y", ":f"))))


def is_ring(ordering: str) -> bool:
    """Whether the numbering is RING; anything but RING and NESTED is refused."""
    if ordering not in (RING, NESTED):
        raise ValueError(f"unknown ordering {ordering!r}")
    return ordering == RING


def nest_parent(pix, levels: int) -> Column:
    """NESTED index ``levels`` resolution steps up."""
    return F.shiftright(as_col(pix), 2 * levels)


# ------------------------------------------------------------ face arithmetic

# Of a base face: ring of its southern corner in units of nside (2, 3 or 4), and
# longitude of its centre in units of pi/4 (0..7).
_FACE = {
    "frow": "shiftright(:f, 2) + 2",
    "flon": "(:f & 3) * 2 + 1 - (shiftright(:f, 2) & 1)",
}


# The sphere is unrolled to a plane: columns are eighths of a turn, rows run from 0 at the north pole
# to 4 at the south pole, and toward a pole the columns of a quarter draw together. The faces are
# diamonds about their centres; a place in one is told by its offsets from that centre, and the two
# sides of the diamond are the sum and the difference of the offsets.


def _unring_steps(n: str, p: str) -> dict[str, str]:
    """Steps from a RING index to ``:x``, ``:y``, ``:f``: the centre of the pixel on the plane, in whole
    numbers (rows by 1/n, columns by 1/``wide``), then the face it lies in."""
    return {
        **_ring_number_steps(n, p),
        "row": f"IF(:cap AND :south, {n} * 4 - :i, :i)",
        "wide": f"IF(:cap, :i, {n})",
        "column": f":j * 2 - 1 - IF(:cap, 0L, (:row + {n}) & 1)",
        "middle": "(:column + :wide) div (:wide * 2)",
        "aside": ":column - :middle * :wide * 2",
        "below": f":row - {n} * 2",
        "belt": f"NOT :cap AND abs(:aside) + abs(:below) < {n}",
        "quarter": ":column div (:wide * 2)",
        "f": "IF(:belt, 4 + (:middle & 3), (:quarter & 3) + IF(:below > 0, 8, 0))",
        "dc": "IF(:belt, :aside, :column - (:quarter * 2 + 1) * :wide)",
        "dr": f"CASE WHEN :belt THEN :below WHEN :below > 0 THEN :below - {n} ELSE :below + {n} END",
        "x": f"shiftright({n} - 1 - :dr + :dc, 1)",
        "y": f"shiftright({n} - 1 - :dr - :dc, 1)",
    }


def _ring_number_steps(n: str, p: str) -> dict[str, str]:
    """Cap flags, ring number ``:i`` (counted from the nearer pole in a cap) and
    1-based position ``:j`` in the ring."""
    return {
        "ncap": f"{n} * ({n} - 1) * 2",
        "south": f"{p} >= {n} * {n} * 12 - :ncap",
        "q": f"CASE WHEN :south THEN {n} * {n} * 12 - 1 - {p} ELSE {p} END",
        "e": f"{p} - :ncap",
        "cap": ":q < :ncap",
        "i": f"""CASE WHEN :cap
                 THEN shiftright(CAST(floor(sqrt(CAST(:q * 2 + 1 AS DOUBLE))) AS BIGINT) + 1, 1)
                 ELSE :e div ({n} * 4) + {n} END""",
        "jn": ":q + 1 - :i * (:i - 1) * 2",
        "j": f"""CASE WHEN NOT :cap THEN :e % ({n} * 4) + 1
                 WHEN :south THEN :i * 4 + 1 - :jn ELSE :jn END""",
    }


def _cell_ring_steps(n: str, x: str, y: str) -> dict[str, str]:
    """From cell and ``:f``: ring ``:jr``, quarter length ``:nr``, half step ``:odd``
    and 1-based position ``:jp`` in the ring."""
    return {
        **_FACE,
        "jr": f":frow * {n} - {x} - {y} - 1",
        "nr": f"least(:jr, {n}, {n} * 4 - :jr)",
        "odd": f"CASE WHEN :nr = {n} THEN (:jr - {n}) & 1 ELSE 0L END",
        "jw": f"(:flon * :nr + {x} - {y} + 1 + :odd) div 2",
        "jp": f"CASE WHEN :jw > {n} * 4 THEN :jw - {n} * 4 WHEN :jw < 1 THEN :jw + {n} * 4 ELSE :jw END",
    }


def _ring_steps(n: str, x: str, y: str) -> dict[str, str]:
    """Steps to the RING index ``:ring_pix`` of a cell on face ``:f``."""
    return {
        **_cell_ring_steps(n, x, y),
        "ahead": f"""CASE WHEN :jr < {n} THEN :nr * (:nr - 1) * 2
                 WHEN :jr > {n} * 3 THEN {n} * {n} * 12 - :nr * (:nr + 1) * 2
                 ELSE {n} * ({n} - 1) * 2 + (:jr - {n}) * {n} * 4 END""",
        "ring_pix": ":ahead + :jp - 1",
    }


def with_ring2xyf(df: DataFrame, nside, pix="pix", out=("ix", "iy", "face")) -> DataFrame:
    """Add face coordinates of a RING index."""
    return compute(df, _unring_steps(as_sql(nside), as_sql(pix)), dict(zip(out, (":x", ":y", ":f"))))


def with_xyf2ring(df: DataFrame, nside, ix="ix", iy="iy", face="face", out="pix") -> DataFrame:
    """Add the RING index of a face cell."""
    steps = {"f": as_sql(face), **_ring_steps(as_sql(nside), as_sql(ix), as_sql(iy))}
    return compute(df, steps, {out: ":ring_pix"})


def with_nest2ring(df: DataFrame, nside, pix="pix", out="pix_ring") -> DataFrame:
    """Add the RING index of a NESTED index (a projection; no sort, no shuffle)."""
    require_power_of_two(nside)
    n = as_sql(nside)
    steps = {**_unnest_steps(n, as_sql(pix)), **_ring_steps(n, ":x", ":y")}
    return compute(df, steps, {out: ":ring_pix"})


def with_ring2nest(df: DataFrame, nside, pix="pix", out="pix_nest") -> DataFrame:
    """Add the NESTED index of a RING index."""
    require_power_of_two(nside)
    n = as_sql(nside)
    steps = {**_unring_steps(n, as_sql(pix)), **_nest_steps(n, ":x", ":y", ":f")}
    return compute(df, steps, {out: ":nest"})


# -------------------------------------------------------------- index -> angle


def with_pix2ang_ring(df: DataFrame, nside, pix="pix", out=("theta", "phi")) -> DataFrame:
    """Add the centre (theta, phi) of a RING pixel."""
    n = as_sql(nside)
    steps = {
        **_ring_number_steps(n, as_sql(pix)),
        "unit": f"4.0D / ({n} * {n} * 12)",
        "zn": f"CASE WHEN :cap THEN 1.0D - :i * :i * :unit ELSE ({n} * 2 - :i) * ({n} * 2) * :unit END",
        "z": "CASE WHEN :cap AND :south THEN -:zn ELSE :zn END",
        "half": f"CASE WHEN :cap OR ((:i + {n}) & 1) = 0 THEN 0.5D ELSE 1.0D END",
    }
    phi = f"(:j - :half) * {HALF_PI!r}D / CASE WHEN :cap THEN :i ELSE {n} END"
    return compute(df, steps, {out[0]: "acos(:z)", out[1]: phi})


def with_pix2ang_nest(df: DataFrame, nside, pix="pix", out=("theta", "phi")) -> DataFrame:
    """Add the centre (theta, phi) of a NESTED pixel."""
    require_power_of_two(nside)
    n = as_sql(nside)
    steps = {
        **_unnest_steps(n, as_sql(pix)),
        **_cell_ring_steps(n, ":x", ":y"),
        "unit": f"4.0D / ({n} * {n} * 12)",
        "zn": "1.0D - :nr * :nr * :unit",
        "z": f"""CASE WHEN :jr < {n} THEN :zn WHEN :jr > {n} * 3 THEN -:zn
             ELSE ({n} * 2 - :jr) * ({n} * 2) * :unit END""",
    }
    phi = f"(:jp - (:odd + 1) * 0.5D) * {HALF_PI!r}D / :nr"
    return compute(df, steps, {out[0]: "acos(:z)", out[1]: phi})


# -------------------------------------------------------------- angle -> index


def _angle_steps(n: str, theta: str, phi: str) -> dict[str, str]:
    """Steps from a direction to ``:x``, ``:y``, ``:f``: its place on the plane, the face whose diamond
    holds it, the sides ``u`` and ``v`` of that diamond. A place on a border belongs to the pixel north
    of it along the line, in the southern cap to the one south. NULL stays NULL."""
    return {
        "z": f"cos({theta})",
        "column": f"((({phi} % {TWO_PI!r}D) + {TWO_PI!r}D) % {TWO_PI!r}D) * {4.0 / math.pi!r}D",
        "level": f"abs(:z) <= {2.0 / 3.0!r}D",
        "pole": "IF(:level, 1.0D, sqrt(greatest(0.0D, 3.0D - 3.0D * abs(:z))))",
        "south": ":z < 0",
        "middle": "floor((:column + 1.0D) * 0.5D)",
        "aside": ":column - 2.0D * :middle",
        "below": "-1.5D * :z",
        "belt": ":level AND abs(:aside) + abs(:below) <= 1.0D",
        "quarter": "least(floor(:column * 0.5D), 3L)",
        "f": "IF(:belt, 4 + (:middle & 3), :quarter + IF(:south, 8, 0))",
        "dc": "IF(:belt, :aside, (:column - 2.0D * :quarter - 1.0D) * :pole)",
        "dr": """CASE WHEN :belt THEN :below WHEN NOT :level THEN IF(:south, 1.0D - :pole, :pole - 1.0D)
              WHEN :south THEN :below - 1.0D ELSE :below + 1.0D END""",
        "u": "(1.0D - :dr + :dc) * 0.5D",
        "v": "(1.0D - :dr - :dc) * 0.5D",
        "fu": f"IF(:level OR :south, floor({n} * :u), {n} - 1 - floor({n} * (1.0D - :u)))",
        "fv": f"IF(:level OR NOT :south, {n} - 1 - floor({n} * (1.0D - :v)), floor({n} * :v))",
        "x": f"IF(:u IS NULL, NULL, CAST(least(greatest(:fu, 0L), {n} - 1) AS BIGINT))",
        "y": f"IF(:v IS NULL, NULL, CAST(least(greatest(:fv, 0L), {n} - 1) AS BIGINT))",
    }


def with_ang2pix_ring(df: DataFrame, nside, theta="theta", phi="phi", out="pix") -> DataFrame:
    """Add the RING index of the pixel that holds a direction."""
    n = as_sql(nside)
    steps = {**_angle_steps(n, as_sql(theta), as_sql(phi)), **_ring_steps(n, ":x", ":y")}
    return compute(df, steps, {out: ":ring_pix"})


def with_ang2pix_nest(df: DataFrame, nside, theta="theta", phi="phi", out="pix") -> DataFrame:
    """Add the NESTED index of the pixel that holds a direction."""
    require_power_of_two(nside)
    n = as_sql(nside)
    steps = {**_angle_steps(n, as_sql(theta), as_sql(phi)), **_nest_steps(n, ":x", ":y", ":f")}
    return compute(df, steps, {out: ":nest"})


def with_ang2pix(
    df: DataFrame, nside, ordering: str, theta="theta", phi="phi", out="pix"
) -> DataFrame:
    """Pixel of a direction in the given numbering."""
    f = with_ang2pix_ring if is_ring(ordering) else with_ang2pix_nest
    return f(df, nside, theta, phi, out)


def with_pix2ang(
    df: DataFrame, nside, ordering: str, pix="pix", out=("theta", "phi")
) -> DataFrame:
    """Centre of a pixel in the given numbering."""
    f = with_pix2ang_ring if is_ring(ordering) else with_pix2ang_nest
    return f(df, nside, pix, out)


def with_xyf(df: DataFrame, nside, ordering: str, pix="pix", out=("ix", "iy", "face")) -> DataFrame:
    """Face coordinates of a pixel in the given numbering."""
    if is_ring(ordering):
        return with_ring2xyf(df, nside, pix, out)
    require_power_of_two(nside)
    return with_nest2xyf(df, nside, pix, out)


def with_pix_of_xyf(
    df: DataFrame, nside, ordering: str, ix="ix", iy="iy", face="face", out="pix"
) -> DataFrame:
    """Pixel of face coordinates in the given numbering."""
    if is_ring(ordering):
        return with_xyf2ring(df, nside, ix, iy, face, out)
    require_power_of_two(nside)
    return with_xyf2nest(df, nside, ix, iy, face, out)


# ------------------------------------------------------------ angular distance


def ang_dist(theta1, phi1, theta2, phi2) -> Column:
    """Angle between two directions; the cosine is clamped to [-1, 1]."""
    a, b, c, d = map(as_col, (theta1, phi1, theta2, phi2))
    cosine = F.sin(a) * F.sin(c) * F.cos(b - d) + F.cos(a) * F.cos(c)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def angular_sep(v1: tuple, v2: tuple) -> Column:
    """Angle between two unit vectors, clamped."""
    dot = sum((as_col(a) * as_col(b) for a, b in zip(v1[1:], v2[1:])), as_col(v1[0]) * as_col(v2[0]))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
