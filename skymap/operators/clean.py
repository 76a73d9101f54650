"""Map cleaning: sentinels, zero-as-missing, unit factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skymap.functions.values import is_seen, seen_or_null, unit_scale, zero_to_unseen


def flag_seen(df: DataFrame, out: str = "seen") -> DataFrame:
    """Add whether each value is seen."""
    return df.withColumn(out, is_seen(F.col("value")))


def clean_map(
    df: DataFrame, factor: float = 1.0, zero_is_missing: bool = True, dtype: str = "double"
) -> DataFrame:
    """Sentinels, NaN and infinities to NULL, zeros to NULL, then the unit factor.

    One projection: filters and pruning still reach the scan below it.
    """
    value = seen_or_null(F.col("value").cast(dtype))
    if zero_is_missing:
        value = F.nullif(value, F.lit(0.0).cast(dtype))
    return df.withColumn("value", (value * F.lit(factor).cast(dtype)).cast(dtype))


def apply_zero_to_unseen(df: DataFrame) -> DataFrame:
    return df.withColumn("value", zero_to_unseen(F.col("value")))


def apply_unit_scale(df: DataFrame, factor: float, dtype: str = "double") -> DataFrame:
    return df.withColumn("value", unit_scale(F.col("value"), factor, dtype))
