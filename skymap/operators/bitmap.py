"""Sets of pixels as bitmaps: one row for 65 536 pixels, small enough to go to every task.

A block of 1024 words of 64 pixels keeps three things: which words are full, which are mixed, and
the bits of the mixed ones in order. Empty and full stretches cost nothing, so a row takes about
0.4 KB and 8 bytes for each mixed word. A pixel is looked up in constant time: the place of its
word among the mixed ones is a rank kept for every 64 words and a count of bits.

Membership is then a broadcast join of the pixel table on the block number: the pixels stay where
they are, whatever the size of the map. The size is proven, by nside for one set, or else counted
in bytes; past the limit ``in_set`` falls back to a join on the pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.functions.staging import compute
from skymap.plans.sizing import materialize

BLOCK_BITS, WORD_BITS = 16, 6
GROUPS = 1 << (BLOCK_BITS - 2 * WORD_BITS)
# Bytes of bitmaps that are sent to every task.
MOST_BYTES = 128 << 20
# Fixed part of a row (two arrays of 16 longs, one of 16 ints, their headers), and of a mixed word.
ROW_BYTES, MIXED_BYTES = 512, 8


def bound_bytes(nside: int) -> int:
    """The bitmap of one set of pixels of a map is never larger."""
    blocks = (12 * nside * nside >> BLOCK_BITS) + 1
    return blocks * (ROW_BYTES + (MIXED_BYTES << (BLOCK_BITS - WORD_BITS)))


def pack(rows: DataFrame, member: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, block, full, mixed, rank, bits): the pixels with ``member``, one set for each key.

    A pixel belongs to the set if any of its rows says so. Words are combined before the shuffle; a
    block's arrays have at most 1024 entries.
    """
    keys = list(keys or [])
    pix = F.col("pix").cast("long")
    inside = pix.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long"))
    members = rows.filter(member).select(*keys, F.shiftright(pix, BLOCK_BITS).alias("block"), inside.alias("at"))
    word = F.shiftright("at", WORD_BITS).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, CAST(at & {(1 << WORD_BITS) - 1}L AS INT))")
    words = members.groupBy(*keys, "block", word).agg(F.bit_or(bit).alias("bits"))
    # From here on rows lie by block, so both aggregations find them in place.
    words = words.repartition(*keys, "block").withColumn("own", F.expr(f"shiftleft(1L, word & {(1 << WORD_BITS) - 1})"))
    full = F.col("bits") == -1
    groups = words.groupBy(*keys, "block", F.shiftright("word", WORD_BITS).alias("grp")).agg(
        F.coalesce(F.bit_or(F.when(full, F.col("own"))), F.lit(0).cast("long")).alias("full"),
        F.coalesce(F.bit_or(F.when(~full, F.col("own"))), F.lit(0).cast("long")).alias("mixed"),
        F.array_sort(F.collect_list(F.when(~full, F.struct("word", "bits")))).alias("part"),
    )
    blocks = groups.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct("grp", "full", "mixed", "part"))).alias("of")
    )
    by_group = F.map_from_entries(F.transform("of", lambda g: F.struct(g["grp"], g)))
    blocks = blocks.withColumn("by", by_group)
    all_groups = F.sequence(F.lit(0), F.lit(GROUPS - 1))
    nothing = F.lit(0).cast("long")

    def dense(field: str) -> Column:
        return F.transform(all_groups, lambda g: F.coalesce(F.try_element_at("by", g)[field], nothing))

    before = lambda g: F.aggregate(
        F.filter("of", lambda x: x["grp"] < g), F.lit(0), lambda n, x: n + F.size(x["part"])
    )
    return blocks.select(
        *keys,
        "block",
        dense("full").alias("full"),
        dense("mixed").alias("mixed"),
        F.transform(all_groups, before).alias("rank"),
        F.flatten(F.transform("of", lambda g: g["part"]["bits"])).alias("bits"),
    )


def packed_bytes(packed: DataFrame) -> int:
    """Measured size of stored bitmaps."""
    row = F.lit(ROW_BYTES) + F.lit(MIXED_BYTES) * F.size("bits")
    return packed.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def _looked_up(pixels: DataFrame, packed: DataFrame, keys: list[str], out: str) -> DataFrame:
    names = {c: f"__{c}" for c in ("full", "mixed", "rank", "bits")}
    side = packed.select(*keys, F.col("block").alias("__block"), *(F.col(c).alias(n) for c, n in names.items()))
    placed = pixels.withColumn("__block", F.shiftright(F.col("pix").cast("long"), BLOCK_BITS))
    met = placed.join(F.broadcast(side), [*keys, "__block"], "left")
    low = (1 << WORD_BITS) - 1
    steps = {
        "at": f"CAST(pix & {(1 << BLOCK_BITS) - 1}L AS INT)",
        "word": f"shiftright(:at, {WORD_BITS})",
        "grp": f"shiftright(:word, {WORD_BITS})",
        "own": f"shiftleft(1L, :word & {low})",
        "some": "get(__mixed, :grp)",
        "place": f"get(__rank, :grp) + bit_count(:some & (shiftleft(-1L, :word & {low}) ^ -1L))",
        "bit": f"shiftright(get(__bits, :place), :at & {low}) & 1L",
    }
    found = "coalesce((get(__full, :grp) & :own) <> 0 OR ((:some & :own) <> 0 AND :bit = 1), false)"
    looked = compute(met, steps, {out: found})
    return looked.select(*pixels.columns, out)


def in_set(
    pixels: DataFrame, rows: DataFrame, member: Column, keys: list[str] | None = None, nside: int | None = None,
    out: str = "member", most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Add ``out``: whether a pixel is among the ``rows`` with ``member`` (of its own ``keys``).

    With ``nside`` and no keys the bitmap's size is proven and nothing runs ahead of the query;
    otherwise it is stored and measured. A null pixel is in no set.
    """
    keys = list(keys or [])
    if nside is not None and not keys and bound_bytes(nside) <= most_bytes:
        return _looked_up(pixels, pack(rows, member), keys, out)
    packed = materialize(pack(rows, member, keys))
    if packed_bytes(packed) <= most_bytes:
        return _looked_up(pixels, packed, keys, out)
    mine = rows.filter(member).select(*keys, "pix").distinct().withColumn("__in", F.lit(True))
    met = pixels.join(mine, [*keys, "pix"], "left")
    return met.withColumn(out, F.coalesce("__in", F.lit(False))).select(*pixels.columns, out)
