"""Sky frames and view rotations as column expressions.

Rotation matrices are plain 3x3 tuples built on the driver; each becomes nine
literals folded into the expression. ``C`` equatorial, ``G`` galactic,
``E`` ecliptic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions.staging import as_col

Matrix = tuple[tuple[float, float, float], ...]
Vec = tuple[Column, Column, Column]

# Active rotations between the three frames. The ecliptic ones are
# rounded in their source and are inverted by transposition.
GAL_TO_EQ: Matrix = (
    (-0.0548755604162154, 0.4941094278755837, -0.8676661490190047),
    (-0.873437090234885, -0.4448296299600112, -0.1980763734312015),
    (-0.4838350155487132, 0.746982244497219, 0.4559837761750669),
)
ECL_TO_GAL: Matrix = (
    (-0.0548756349, -0.9938213520, -0.0964768585),
    (0.4941095290, -0.1109909720, 0.8622857870),
    (-0.8676660870, -0.0003516551, 0.4971473000),
)
ECL_TO_EQ: Matrix = (
    (1.0, -8.6513146e-08, -9.8385835e-08),
    (4.0238655e-08, 0.917482168, -0.397776911),
    (1.2468018e-07, 0.397776911, 0.917482168),
)
IDENTITY: Matrix = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


def transpose(m: Matrix) -> Matrix:
    return tuple(zip(*m))


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3)
    )


def frame_matrix(source: str, target: str) -> Matrix:
    """Rotation from one frame to another; identity when equal."""
    known = {("G", "C"): GAL_TO_EQ, ("E", "G"): ECL_TO_GAL, ("E", "C"): ECL_TO_EQ}
    if source == target:
        return IDENTITY
    if (source, target) in known:
        return known[source, target]
    return transpose(known[target, source])


def _about_y(angle: float) -> Matrix:
    s, c = math.sin(angle), math.cos(angle)
    return ((c, 0.0, s), (0.0, 1.0, 0.0), (-s, 0.0, c))


def _about_z(angle: float) -> Matrix:
    s, c = math.sin(angle), math.cos(angle)
    return ((c, -s, 0.0), (s, c, 0.0), (0.0, 0.0, 1.0))


def camera_matrix(lon: float, lat: float, roll: float = 0.0) -> Matrix:
    """Camera rotation Rz(roll) Ry(-lat) Rz(-lon), angles in radians."""
    return matmul(matmul(_about_z(roll), _about_y(-lat)), _about_z(-lon))


def view_matrix(source: str = "G", target: str = "G", camera: Matrix | None = None) -> Matrix:
    """Map frame to view frame: change of frame first, camera after it."""
    frame = frame_matrix(source, target)
    return matmul(camera, frame) if camera is not None else frame


def rotate(m: Matrix, v: Vec) -> Vec:
    """Matrix times vector; zero terms are left out."""
    out = []
    for row in m:
        terms = [c * F.lit(float(k)) if k != 1.0 else c for k, c in zip(row, v) if k != 0.0]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        out.append(total)
    return tuple(out)


def rotate_inverse(m: Matrix, v: Vec) -> Vec:
    """Transpose times vector."""
    return rotate(transpose(m), v)


def with_frames(
    df: DataFrame, source: str = "source", target: str = "target", vec=("x", "y", "z"), out=("x", "y", "z")
) -> DataFrame:
    """Vectors of mixed frames: each row names the frame it is in and the one it goes to.

    The nine matrices are a table of nine rows, broadcast: one scan, whatever the mix. A frame that
    is not C, G or E gives NULL.
    """
    entries = [f"m{i}{j}" for i in range(3) for j in range(3)]
    rows = []
    for a in "CGE":
        for b in "CGE":
            flat = [float(v) for row in frame_matrix(a, b) for v in row]
            rows.append(F.struct(F.lit(a).alias("__a"), F.lit(b).alias("__b"), *(F.lit(v).alias(f"__{n}") for n, v in zip(entries, flat))))
    table = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    met = df.join(F.broadcast(table), (df[source] == table["__a"]) & (df[target] == table["__b"]), "left")
    x, y, z = (F.col(c) for c in vec)
    turned = [F.col(f"__m{i}0") * x + F.col(f"__m{i}1") * y + F.col(f"__m{i}2") * z for i in range(3)]
    keep = [c for c in df.columns if c not in out]
    return met.select(*keep, *(t.alias(n) for t, n in zip(turned, out)))


def sph_to_vec(theta, phi) -> Vec:
    """Unit vector of colatitude and longitude."""
    th, ph = as_col(theta), as_col(phi)
    return F.sin(th) * F.cos(ph), F.sin(th) * F.sin(ph), F.cos(th)


def vec_to_sph(x, y, z) -> tuple[Column, Column]:
    """(theta, phi) of a vector; z is clamped, phi lies in (-pi, pi]."""
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), as_col(z)))
    return F.acos(z), F.atan2(as_col(y), as_col(x))


def lonlat_to_vec(lon, lat) -> Vec:
    """Unit vector of longitude and latitude."""
    lo, la = as_col(lon), as_col(lat)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def vec_to_lonlat(x, y, z) -> tuple[Column, Column]:
    """(lon, lat) of a vector of any positive length."""
    x, y, z = as_col(x), as_col(y), as_col(z)
    r = F.sqrt(x * x + y * y + z * z)
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(z, r)))
    return F.atan2(y, x), F.asin(ratio)


def grid_transform(lon, lat, source: str, target: str, camera: Matrix | None = None) -> Vec:
    """Point of one frame as a vector in another, with an optional camera."""
    return rotate(view_matrix(source, target, camera), lonlat_to_vec(lon, lat))
