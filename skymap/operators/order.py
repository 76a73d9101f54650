"""Ordering at scale: ranks and order statistics per key.

No function here brings a whole map into one task. Values are cut into buckets
by approximate quantiles; the bucket *counts* are exact, so ranks are exact
whatever the cut points are. Cut points are computed once and stored, so both
uses of them, and any retry, agree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skymap.functions.search import with_count_below
from skymap.plans.sizing import materialize, small_side

ROWS_PER_BUCKET = 1_000_000
# Cut points one broadcast may hold.
BROADCAST_CUTS = 8_000_000


def bucket_count(rows_per_key: int) -> int:
    """Buckets for the largest key; 1 means a key fits one task as it is."""
    return max(1, -(-rows_per_key // ROWS_PER_BUCKET))


def _cut(df: DataFrame, key: str, col: str, buckets: int) -> DataFrame:
    """Add ``bkt``, and ``top`` = whether ``col`` equals the bucket's upper cut.

    A bucket holds values in (previous cut, cut], so equal values share one.
    """
    qs = [i / buckets for i in range(1, buckets)]
    cuts = materialize(
        df.groupBy(key).agg(F.array_distinct(F.percentile_approx(col, qs, 10_000)).alias("cuts"))
    )
    joined = df.join(small_side(cuts, limit=BROADCAST_CUTS // buckets, stored=True), key)
    placed = with_count_below(joined, "cuts", col, buckets, "bkt", inclusive=False)
    return placed.withColumn(
        "top", F.coalesce(F.get("cuts", F.col("bkt")) == F.col(col), F.lit(False))
    ).drop("cuts")


def _offsets(cut: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per bucket: its rows ``cnt``, rows before it ``off``, rows of the key ``n``.

    Counting combines map-side, so the shuffle and the window hold bucket rows
    only.
    """
    counts = cut.groupBy(key, *order).agg(F.count(F.lit(1)).alias("cnt"))
    whole = W.partitionBy(key)
    before = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return materialize(
        counts.withColumns(
            {
                "off": F.coalesce(F.sum("cnt").over(before), F.lit(0)),
                "n": F.sum("cnt").over(whole),
            }
        )
    )


def value_rank(
    df: DataFrame,
    rows_per_key: int,
    key: str = "map_id",
    col: str = "value",
    tie: str = "pix",
    out: str = "rn",
    buckets: int | None = None,
) -> DataFrame:
    """1-based ascending rank of every seen row within its key, ties by ``tie``.

    ``rows_per_key`` bounds the largest key (12 nside^2 for a map). A small key
    takes one window. A large one is ranked bucket by bucket; a value repeated so
    often that it is a cut point is split further by ranges of ``tie`` (a
    non-negative integer below ``rows_per_key``).
    """
    df = df.filter(F.col(col).isNotNull())
    buckets = bucket_count(rows_per_key) if buckets is None else buckets
    if buckets <= 1:
        return df.withColumn(out, F.row_number().over(W.partitionBy(key).orderBy(col, tie)))
    stride = max(1, -(-rows_per_key // buckets))
    cut = _cut(df, key, col, buckets)
    share = F.floor(F.col(tie) / F.lit(float(stride))) + 1
    cut = cut.withColumn("sub", F.when(F.col("top"), share).otherwise(F.lit(0).cast("long"))).drop("top")
    offsets = small_side(_offsets(cut, key, ["bkt", "sub"]).drop("cnt", "n"), stored=True)
    inner = F.row_number().over(W.partitionBy(key, "bkt", "sub").orderBy(col, tie))
    return (
        cut.withColumn("__in", inner)
        .join(offsets, [key, "bkt", "sub"])
        .withColumn(out, F.col("off") + F.col("__in"))
        .drop("bkt", "sub", "off", "__in")
    )


def ranked_values(
    df: DataFrame,
    rows_per_key: int,
    key: str = "map_id",
    col: str = "value",
    buckets: int | None = None,
) -> DataFrame:
    """Distinct seen values with ``cnt``, 0-based first rank ``lo`` and total ``n``.

    Equal values collapse map-side, so a value that fills a third of a map costs
    one row.
    """
    df = df.filter(F.col(col).isNotNull()).select(key, col)
    buckets = bucket_count(rows_per_key) if buckets is None else buckets
    if buckets <= 1:
        counts = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("cnt"))
        whole = W.partitionBy(key)
        before = whole.orderBy(col).rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumns(
            {
                "lo": F.coalesce(F.sum("cnt").over(before), F.lit(0)),
                "n": F.sum("cnt").over(whole),
            }
        )
    cut = _cut(df, key, col, buckets).drop("top")
    offsets = small_side(_offsets(cut, key, ["bkt"]).drop("cnt"), stored=True)
    return _ranked_in_buckets(cut, offsets, key, col)


def _ranked_in_buckets(cut: DataFrame, offsets: DataFrame, key: str, col: str) -> DataFrame:
    counts = cut.groupBy(key, "bkt", col).agg(F.count(F.lit(1)).alias("cnt"))
    before = W.partitionBy(key, "bkt").orderBy(col).rowsBetween(W.unboundedPreceding, -1)
    inner = counts.withColumn("lo", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
    return inner.join(offsets, [key, "bkt"]).select(
        key, col, "cnt", (F.col("lo") + F.col("off")).alias("lo"), "n"
    )


def _target_ranks(q: float, method: str) -> tuple[Column, Column, Column]:
    """0-based ranks to read and the weight of the second one."""
    pos = F.lit(q) * (F.col("n") - 1)
    if method == "nearest":
        at = F.round(pos).cast("long")
        return at, at, F.lit(0.0)
    first = F.floor(pos)
    return first, F.least(first + 1, F.col("n") - 1), pos - first


def exact_quantiles(
    df: DataFrame,
    qs: Mapping[str, float],
    rows_per_key: int,
    key: str = "map_id",
    col: str = "value",
    method: str = "linear",
    buckets: int | None = None,
) -> DataFrame:
    """Exact quantiles per key: one row with ``n`` and a column per name.

    ``linear`` interpolates at q (n - 1); ``nearest`` rounds the rank half up.
    Large keys: two passes that shuffle only bucket counts, then only the few
    buckets that hold a wanted rank are ordered.
    """
    df = df.filter(F.col(col).isNotNull()).select(key, col)
    buckets = bucket_count(rows_per_key) if buckets is None else buckets
    if buckets <= 1:
        if method == "linear":
            return df.groupBy(key).agg(
                F.count(F.lit(1)).alias("n"),
                *[F.percentile(col, F.lit(q)).alias(name) for name, q in qs.items()],
            )
        ranked = ranked_values(df, rows_per_key, key, col, 1)
    else:
        cut = _cut(df, key, col, buckets).drop("top")
        offsets = _offsets(cut, key, ["bkt"])
        wanted = F.lit(False)
        for q in qs.values():
            for at in _target_ranks(q, method)[:2]:
                wanted = wanted | ((at >= F.col("off")) & (at < F.col("off") + F.col("cnt")))
        hit = small_side(offsets.filter(wanted).drop("cnt"), stored=True)
        ranked = _ranked_in_buckets(cut.join(hit.select(key, "bkt"), [key, "bkt"]), hit, key, col)
    picks = []
    for name, q in qs.items():
        first, second, _ = _target_ranks(q, method)
        for tag, at in (("0", first), ("1", second)):
            inside = (at >= F.col("lo")) & (at < F.col("lo") + F.col("cnt"))
            picks.append(F.max(F.when(inside, F.col(col))).alias(f"__{name}{tag}"))
    found = ranked.groupBy(key).agg(F.max("n").alias("n"), *picks)
    out = []
    for name, q in qs.items():
        weight = _target_ranks(q, method)[2]
        v0, v1 = F.col(f"__{name}0"), F.col(f"__{name}1")
        value = v0 if method == "nearest" else v0 * (F.lit(1.0) - weight) + v1 * weight
        out.append(value.alias(name))
    return found.select(key, "n", *out)


def smallest_k(df: DataFrame, col: str, k: int, rows: int, buckets: int | None = None) -> int:
    """The k-th smallest of a repeat-free integer column (one number, read back)."""
    if rows <= 1:
        return df.agg(F.min(col)).first()[0]
    one = df.select(F.lit(0).alias("__k"), col)
    # the rank k-1 as a share of rows-1, placed in the middle of its rounding cell
    q = (k - 1) / (rows - 1)
    return exact_quantiles(one, {"v": q}, rows, "__k", col, "nearest", buckets).first()["v"]
