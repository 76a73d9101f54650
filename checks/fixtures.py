"""Pixel maps, masks, points, tracks and files derived from the driver tables.

Every fixture uses all rows of its table. ``nside`` is the smallest power of two
whose full map has a pixel for each row, so maps grow with the tables. Keys are
spread over the sky by a multiplication modulo the pixel count.
"""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.frames import camera_matrix, view_matrix
from skymap.functions.pixels import npix_of
from skymap.functions.values import UNSEEN
from skymap.plans.sizing import materialize, shared_dir, spread

SPREAD = 7919
VIEW = view_matrix("G", "C", camera_matrix(0.3, 0.2, 0.1))


@lru_cache
def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@lru_cache
def nside_of(spark: SparkSession, d: str, name: str) -> int:
    """Smallest 2^k with 12 nside^2 >= rows (row counts come from file footers)."""
    rows = table(spark, d, name).count()
    n = 1
    while npix_of(n) < rows:
        n *= 2
    return n


def r6(c: Column | str) -> Column:
    """Six decimals; the shift keeps exact halves away from the rounding edge."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * F.lit(1e6) + F.lit(0.033)) / F.lit(1e6) + F.lit(0.0)


def sky_orders(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """One map, value = order price."""
    n = nside_of(spark, d, "orders")
    df = table(spark, d, "orders").select(
        F.lit("orders").alias("map_id"),
        (F.col("o_orderkey") * SPREAD % npix_of(n)).alias("pix"),
        F.col("o_totalprice").alias("value"),
    )
    return df, n


def sky_orders_raw(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The same with sentinels, NaN, zeros and infinities mixed in."""
    df, n = sky_orders(spark, d)
    k = F.col("pix")
    value = (
        F.when(k % 17 == 0, F.lit(UNSEEN))
        .when(k % 19 == 0, F.lit(float("nan")))
        .when(k % 13 == 0, F.lit(0.0))
        .when(k % 23 == 0, F.lit(float("inf")))
        .when(k % 29 == 0, F.lit(-1.637499996306027e30))
        .otherwise(F.col("value"))
    )
    return df.withColumn("value", value), n


def sky_bipolar(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """One map with values of both signs: customer balances."""
    n = nside_of(spark, d, "customer")
    df = table(spark, d, "customer").select(
        F.lit("customer").alias("map_id"),
        (F.col("c_custkey") * SPREAD % npix_of(n)).alias("pix"),
        F.col("c_acctbal").alias("value"),
    )
    return df, n


def sky_lines(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Unmerged line items: several maps, repeated pixels."""
    n = nside_of(spark, d, "orders")
    pix = (F.col("l_orderkey") * SPREAD + F.col("l_linenumber") * 104729) % npix_of(n)
    df = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("map_id"),
        pix.alias("pix"),
        F.col("l_extendedprice").alias("value"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    return df, n


def sky_multi(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Several sparse maps: mean line price per pixel."""
    df, n = sky_lines(spark, d)
    return df.groupBy("map_id", "pix").agg(F.avg("value").alias("value")), n


def stored_multi(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The same as a stored pixel table, for operators that read it several times."""
    df, n = sky_multi(spark, d)
    return materialize(df), n


def multi_maps(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Metadata of the line-item maps."""
    ids = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("map_id"))
    return ids.distinct().select("map_id", F.lit(n).cast("long").alias("nside"))


def one_map(spark: SparkSession, name: str, n: int) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("map_id"), F.lit(n).cast("long").alias("nside"))


def sky_points(spark: SparkSession, d: str) -> DataFrame:
    """One direction per event, spread evenly; offsets keep off pixel borders."""
    k = F.col("event_id")
    z = ((k * 7919) % 1000003 + F.lit(0.5)) / 1000003.0 * 2.0 - 1.0
    phi = ((k * 15485863) % 1000033 + F.lit(0.5)) / 1000033.0 * F.lit(2 * math.pi)
    return table(spark, d, "events").select(
        k.alias("point_id"), F.acos(z).alias("theta"), phi.alias("phi")
    )


def tracks_users(spark: SparkSession, d: str) -> DataFrame:
    """One jumpy track per user; positions are event numbers (not dense)."""
    pts = sky_points(spark, d).withColumnRenamed("point_id", "seq")
    users = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("track_id"))
    return users.join(pts, "seq").select(
        "track_id",
        "seq",
        (F.col("phi") - F.lit(math.pi)).alias("lon"),
        (F.lit(math.pi / 2) - F.col("theta")).alias("lat"),
    )


def tracks_grid(spark: SparkSession, d: str) -> DataFrame:
    """One smooth parallel per supplier: 720 points, half a degree apart.

    Suppliers are spread over tasks, by track, before their points are generated.
    """
    k = F.col("s_suppkey")
    return spread(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(
        k.alias("track_id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("seq"),
    ).select(
        "track_id",
        "seq",
        F.radians(F.col("seq") * 0.5 - 179.75).alias("lon"),
        F.radians((F.col("track_id") * 37 % 149) - 74.13).alias("lat"),
    )


def mask_parts(spark: SparkSession, d: str, npix: int) -> DataFrame:
    """Mask from parts; several parts on a pixel: valid when all are."""
    return (
        table(spark, d, "part")
        .select((F.col("p_partkey") * 104729 % npix).alias("pix"), (F.col("p_size") > 10).alias("ok"))
        .groupBy("pix")
        .agg(F.min("ok").alias("valid"))
    )


def lut_gray(spark: SparkSession, cmap: str = "gray") -> DataFrame:
    """Grey ramp, or its reverse."""
    idx = F.col("id").cast("int")
    level = idx if cmap == "gray" else F.lit(255) - idx
    return spark.range(256).select(
        F.lit(cmap).alias("cmap"), idx.alias("idx"), level.alias("r"), level.alias("g"), level.alias("b")
    )


# ------------------------------------------------------------------ map files

FILE_NSIDE = 16


def _card(key: str, value) -> str:
    text = f"'{value}'" if isinstance(value, str) else str(value)
    return f"{key:<8}= {text:>20}".ljust(80)


def _unit(cards: list[str]) -> bytes:
    text = "".join(cards + ["END".ljust(80)])
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii")


def fits_bytes(rows: np.ndarray, forms: list[str], names: list[str], **keywords) -> bytes:
    """A primary unit and one binary table with the rows of a structured array."""
    primary = _unit(["SIMPLE  =                    T".ljust(80), _card("BITPIX", 8), _card("NAXIS", 0)])
    cards = ["XTENSION= 'BINTABLE'".ljust(80), _card("BITPIX", 8), _card("NAXIS", 2)]
    cards += [_card("NAXIS1", rows.dtype.itemsize), _card("NAXIS2", len(rows))]
    cards += [_card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(forms))]
    for i, (form, name) in enumerate(zip(forms, names), 1):
        cards += [_card(f"TTYPE{i}", name), _card(f"TFORM{i}", form)]
    cards += [_card(k, v) for k, v in keywords.items()]
    data = rows.tobytes()
    return primary + _unit(cards) + data + b"\0" * (-len(data) % 2880)


@lru_cache
def ship_code(spark: SparkSession) -> None:
    """Send the two packages to the Python workers, as a cluster job would."""
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "skymap_job.zip"
    with zipfile.ZipFile(target, "w") as z:
        for package in ("skymap", "checks"):
            for file in sorted((root / package).rglob("*.py")):
                z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place all executors share, for files the workers write."""
    ship_code(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    # A path without a scheme belongs to the session's own default file system.
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _save(path: str, data: bytes) -> None:
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        system, inner = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


def order_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Orders cut into maps of nside 16: (file_no, pix, value)."""
    npix = npix_of(FILE_NSIDE)
    return table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / npix).alias("file_no"),
        (F.col("o_orderkey") % npix).alias("pix"),
        F.col("o_totalprice").alias("value"),
    )


def write_dense(spark: SparkSession, d: str, kind: str, folder: str) -> str:
    """One dense file per chunk map (3072 pixels each); returns the folder.

    ``f32`` and ``f64``: 1024 pixels per row, a second column behind the first.
    ``mixed``: one pixel per row, an int32 column (rounded value) behind a text one.
    """
    npix = npix_of(FILE_NSIDE)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["file_no"].iloc[0])
        full = np.full(npix, UNSEEN)
        full[pdf["pix"].to_numpy()] = pdf["value"].to_numpy()
        keys = dict(NSIDE=FILE_NSIDE, ORDERING="RING" if number % 2 else "NESTED", COORDSYS="GCE"[number % 3], INDXSCHM="IMPLICIT")
        if kind == "mixed":
            rows = np.zeros(npix, dtype=[("tag", "S3"), ("v", ">i4")])
            rows["tag"], rows["v"] = b"abc", np.where(full > -1e30, np.rint(full), -1)
            forms, names = ["3A", "1J"], ["TAG", "COUNTS"]
        else:
            t, code = (">f4", "E") if kind == "f32" else (">f8", "D")
            rows = np.zeros(npix // 1024, dtype=[("v", t, 1024), ("w", t, 1024)])
            rows["v"] = full.reshape(-1, 1024)
            rows["w"] = np.arange(npix).reshape(-1, 1024)
            forms, names = [f"1024{code}"] * 2, ["SIGNAL", "NUMBER"]
        _save(f"{folder}/m{number:06d}.fits", fits_bytes(rows, forms, names, **keys))
        return pd.DataFrame({"file_no": [number]})

    chunks = order_chunks(spark, d)
    chunks.groupBy("file_no").applyInPandas(write, "file_no long").write.format("noop").mode("overwrite").save()
    return folder


def write_masks(spark: SparkSession, d: str, folder: str) -> str:
    """One dense mask file per chunk: 1 where the price is above 100 000, else 0."""
    npix = npix_of(FILE_NSIDE)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["file_no"].iloc[0])
        rows = np.zeros(npix, dtype=[("v", ">f8")])
        rows["v"][pdf["pix"].to_numpy()] = pdf["value"].to_numpy() > 100_000
        _save(f"{folder}/k{number:06d}.fits", fits_bytes(rows, ["D"], ["MASK"], NSIDE=FILE_NSIDE, ORDERING="RING"))
        return pd.DataFrame({"file_no": [number]})

    chunks = order_chunks(spark, d)
    chunks.groupBy("file_no").applyInPandas(write, "file_no long").write.format("noop").mode("overwrite").save()
    return folder


def write_sparse(spark: SparkSession, d: str, folder: str) -> str:
    """EXPLICIT files of the orders, split over tasks: index, value and a weight.

    Indices run past both ends of the map, so some rows must be dropped on read.
    """
    n = nside_of(spark, d, "orders")
    npix = npix_of(n)
    rows = table(spark, d, "orders").select(
        (F.col("o_orderkey") * SPREAD % npix - 100).alias("pix"),
        F.col("o_totalprice").alias("value"),
        F.col("o_custkey").alias("file_no"),
    )
    rows = rows.withColumn("file_no", F.col("file_no") % 8).repartition("file_no").sortWithinPartitions("file_no", "pix")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, part in batch.groupby("file_no"):
                out = np.zeros(len(part), dtype=[("p", ">i8"), ("v", ">f4"), ("w", ">f8")])
                out["p"], out["v"] = part["pix"], part["value"]
                out["w"] = part["value"]
                data = fits_bytes(out, ["K", "E", "D"], ["PIXEL", "SIGNAL", "WEIGHT"], NSIDE=n, ORDERING="NESTED", INDXSCHM="EXPLICIT")
                _save(f"{folder}/s{number}-{uuid.uuid4().hex}.fits", data)
                yield pd.DataFrame({"file_no": [number]})

    rows.mapInPandas(write, "file_no long").write.format("noop").mode("overwrite").save()
    return folder


def stem(col: str = "map_id") -> Column:
    """File name without folder and suffix of a file-based map id, and its column."""
    return F.regexp_replace(F.regexp_extract(F.col(col), r"([^/]*)$", 1), r"\.fits", "")
