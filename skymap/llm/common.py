"""What the operators of this subpackage share: words, storage, Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.plans.sizing import shared_dir

# Everything that separates words and is stripped from lines.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Compute once, keep as Parquet in the folder all executors share, read from there.

    A later reader loses nothing when an executor goes, and reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache
def _shipped(context) -> None:
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "skymap_llm.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((root / "skymap").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(target))


def ship_code(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a session."""
    _shipped(spark.sparkContext)
