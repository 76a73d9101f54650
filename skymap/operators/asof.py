"""As-of join: for each row the last row of another table, by key and value, that does not exceed it.

Both sides are sorted together by range partitions of (key, value), so a key of any size, even one
value that fills a third of all rows, is spread over as many partitions as it needs. Within a
partition the last row of the other side is carried forward; what a partition has to take over from
those before it is one row for each of its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymap.plans.sizing import stored_table


def asof_join(left: DataFrame, right: DataFrame, key: str, on: str, tie: str, out: str = "hit") -> DataFrame:
    """``left`` with ``out``, the row of ``right`` (a struct) of the same ``key`` with the greatest ``on``
    not above the left row's; of equals the one with the greatest ``tie``. NULL where there is none,
    for a null key and for a null value. Every left row stays, once."""
    hit, row = F.struct(*right.columns), F.struct(*left.columns)
    hit_type, row_type = right.select(hit.alias("s")).schema["s"].dataType, left.select(row.alias("s")).schema["s"].dataType
    knots = right.filter(F.col(on).isNotNull()).select(
        F.col(key).alias("__key"), F.col(on).alias("__on"), F.lit(0).alias("__kind"), F.col(tie).cast("long").alias("__tie"),
        hit.alias("__hit"), F.lit(None).cast(row_type).alias("__row"),
    )
    # The number only spreads rows of one value over partitions.
    rows = left.select(
        F.col(key).alias("__key"), F.col(on).alias("__on"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__tie"),
        F.lit(None).cast(hit_type).alias("__hit"), row.alias("__row"),
    )
    order = ["__key", "__on", "__kind", "__tie"]
    dealt = knots.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored_table(dealt.withColumn("__place", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__place", 33))
    in_part = Window.partitionBy("__part", "__key").orderBy("__place")
    inside = dealt.withColumn("__in", F.last("__hit", ignorenulls=True).over(in_part)).filter("__kind = 1")
    pieces = dealt.groupBy("__part", "__key").agg(F.max_by("__hit", F.when(F.col("__kind") == 0, F.col("__place"))).alias("__last"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("__part", "__key", F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    a, b = inside.alias("a"), pieces.alias("b")
    met = a.join(b, (F.col("a.__part") == F.col("b.__part")) & F.col("a.__key").eqNullSafe(F.col("b.__key")))
    found = F.when(F.col("a.__key").isNotNull() & F.col("a.__on").isNotNull(), F.coalesce(F.col("a.__in"), F.col("b.__before")))
    return met.select("a.__row.*", found.alias(out))
