"""Incremental ingest: decode a (path, column) once per modification time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.values import seen_or_null
from skymap.operators.sketch import sketch_limits, sketch_maps
from skymap.plans.sizing import materialize, small_side
from skymap.sources.fits import describe_maps, list_files, map_metadata, read_maps

# What tells a version of a file.
FILE_KEYS = ["path", "mtime"]

MANIFEST_KEYS = ["source", "col", "mtime"]


def pending(maps: DataFrame, manifest: DataFrame) -> DataFrame:
    """Maps whose (path, column, modification time) is not in the manifest."""
    return maps.join(manifest.select(*MANIFEST_KEYS), MANIFEST_KEYS, "left_anti")


def current(pixels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored pixels of the newest version of each (path, column), from the one run that the manifest names
    for it: what a lost job left belongs to no run there."""
    newest = manifest.groupBy("source", "col").agg(
        F.max_by(F.struct("version", "run"), F.struct("mtime", "run")).alias("v")
    )
    return pixels.join(small_side(newest.select("v.version", "v.run")), ["version", "run"], "left_semi")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None while it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def headers(spark: SparkSession, source: str, store: str) -> DataFrame:
    """Columns of all files under ``source``; headers are read of files that ``store`` does not know in
    this version, and kept there for the next time."""
    path = f"{store}/headers"
    files = list_files(spark, source)
    known = _stored(spark, path)
    new = files if known is None else files.join(known.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_anti")
    found = describe_maps(new)
    if known is not None:
        # File numbers go on where the stored ones end.
        last = known.agg(F.coalesce(F.max("file_no"), F.lit(-1))).first()[0]
        found = materialize(found.withColumn("file_no", F.col("file_no") + last + 1))
    found.write.mode("append").parquet(path)
    present = files.select(*FILE_KEYS)
    return spark.read.schema(found.schema).parquet(path).join(present, FILE_KEYS, "left_semi")


def ingest_incremental(
    spark: SparkSession, source: str, store: str, value_cols: list[int] = [0]
) -> DataFrame:
    """Bring ``store`` up to date with the files under ``source``; returns what was new.

    Pixels go to Parquet, one folder for each run, sorted by version (map and modification time) and
    pixel: a version or a range of its pixels is a few row groups, and folders and files follow the
    runs and their bytes, not the number of maps. The manifest is appended after the pixels are
    written, so a lost job is simply repeated; the folder it left is of no run in the manifest, and
    ``current`` passes it over. Headers are read of new files only.
    """
    manifest_path = f"{store}/manifest"
    known = _stored(spark, manifest_path)
    if known is not None and "run" not in known.columns:
        raise ValueError(f"{store} has a folder for each version, as before runs: ingest into a new store")
    columns = materialize(headers(spark, source, store))
    version = F.concat_ws("@", "map_id", F.unix_micros("mtime").cast("string"))
    run = f"r{uuid.uuid4().hex[:16]}"
    maps = map_metadata(columns).filter(F.col("col").isin(value_cols))
    maps = maps.withColumn("version", version).withColumn("run", F.lit(run))
    if known is not None:
        maps = pending(maps, known)
    maps = materialize(maps)
    if known is not None and maps.isEmpty():
        return maps
    wanted = maps.select(F.col("source").alias("path"), F.col("col").alias("value_col"))
    todo = materialize(columns.join(maps.select(F.col("source").alias("path")).distinct(), "path", "left_semi"))
    pixels = read_maps(todo, wanted).join(small_side(maps.select("map_id", "version"), stored=True), "map_id")
    own = f"{store}/pixels/run={run}"
    pixels.sortWithinPartitions("version", "pix").write.parquet(own)
    fresh = spark.read.schema(pixels.schema).parquet(own).withColumn("value", seen_or_null(F.col("value")))
    sketches = sketch_maps(fresh, ("map_id", "version")).withColumn("run", F.lit(run))
    sketches.write.mode("append").parquet(f"{store}/sketches")
    maps.write.mode("append").parquet(manifest_path)
    return maps


def stored_limits(spark: SparkSession, store: str, kind: str = "linear") -> DataFrame:
    """(map_id, minv, maxv, status) of the newest version of every map, from its stored sketch: no
    pixel is read. A version that a lost job wrote twice counts once."""
    sketches = spark.read.parquet(f"{store}/sketches")
    return sketch_limits(current(sketches, spark.read.parquet(f"{store}/manifest")), kind)
