"""Size checks and lineage cuts used by the operators.

A side of a join is broadcast only when its size is proven by its construction
(pass ``rows``) or counted here; beyond the limit the join is left to the
optimizer, which shuffles it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may hold (a few long/double columns each): some 40 MB in the driver, where
# several may be built at once.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the session's spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store in the shared folder, cut the lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = shared_dir(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """Compute once, keep as Parquet in the shared folder: later readers prune columns and row groups."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(
    df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, stored: bool = False
) -> DataFrame:
    """Broadcast hint for a side of proven or counted size; unchanged beyond the limit.

    ``rows`` is a proven bound. Without it the side is materialized (unless it is
    ``stored`` already) and counted, so it is computed once.
    """
    if rows is None:
        df = df if stored else materialize(df)
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Distribute few small rows that each stand for much work.

    The number of partitions is explicit: adaptive execution would merge them
    again, because it sees only the small rows and not what is made of them.
    """
    if tasks is None:
        spark = df.sparkSession
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(shuffle, spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
