"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all sources equal)
and 1 (as they come), normalised. The exponent is bisected: the smallest that keeps every source
within ``max_repeats`` passes over its documents, or that which gives a wanted entropy. Both are
monotone in the exponent; a round evaluates 33 exponents on the table of source totals, so four
rounds narrow it to a millionth, and nothing but the two ends of the interval reaches the driver.

The weights are then realised: a source's budget is cut into whole passes and a rest. Documents
belong to hashed blocks of about ``block_tokens``; a pass takes all blocks of a source in a keyed
order of its own, the rest takes blocks in that order until the budget is met and the last block
in part, document by document. Work is keyed by (source, block), so a source with a third of all
rows is spread like any other; one window runs over block totals, one inside the last blocks.

Cases: a null source is the source of the empty name. A null or empty text has no tokens and goes
with its block. Repeated rows are taken alike. Null ids are hashed like values. An empty table gives
an empty table. Other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymap.llm.common import stored, words_of

BLOCK_TOKENS = 200_000
MAX_REPEATS = 1.25
ROUNDS = 4
POINTS = 32
SEED = 20_240_501


def exponent(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float = 1.0) -> float:
    """Smallest exponent at which no source repeats more than ``max_repeats`` times when
    ``budget`` times all tokens are drawn, or the largest whose entropy (nats) is at least ``entropy``.

    ``totals``: (source, tokens), tokens > 0. When even 1 repeats too often, or 1 is even enough,
    the answer is 1; when even 0 has too little entropy, it is 0.
    """
    whole = totals.agg(F.sum("tokens").cast("double").alias("t")).first()["t"]
    if not whole:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        share = F.col("tokens") / F.lit(whole)
        spread = totals.select(share.alias("p"), F.explode(F.array(*[F.lit(x) for x in grid])).alias("x"))
        sums = spread.groupBy("x").agg(
            F.sum(F.pow("p", "x")).alias("z"),
            F.max(F.pow("p", F.col("x") - 1)).alias("most"),
            F.sum(F.pow("p", "x") * F.col("x") * F.log("p")).alias("e"),
        )
        if entropy is None:
            fits = F.col("most") / F.col("z") * budget <= max_repeats
            at = sums.filter(fits).agg(F.min("x")).first()[0]
            if at is None:
                return 1.0
            low, high = max(low, at - (high - low) / POINTS), at
        else:
            fits = F.log("z") - F.col("e") / F.col("z") >= entropy
            at = sums.filter(fits).agg(F.max("x")).first()[0]
            if at is None:
                return 0.0
            low, high = at, min(high, at + (high - low) / POINTS)
    return high if entropy is None else low


def _order(*parts: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float = 1.0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Drawn documents: (row, source, tokens, epoch, block_order, doc_order), one row per draw.

    ``row`` is the struct of the input row. Epochs count from 0; (epoch, block_order, doc_order)
    is the training order of the mixture, blocks of all sources interleaved by hash.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(
        row.alias("row"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        F.size(words_of(F.col(f"`{text_col}`"))).cast("long").alias("tokens"),
        _order(F.lit("doc"), F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).alias("doc_order"),
    )
    slim = stored(base.drop("row"))
    totals = stored(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    power = exponent(totals.filter("tokens > 0"), max_repeats, entropy, budget)
    whole, z = totals.filter("tokens > 0").agg(
        F.sum("tokens").cast("double"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power)))
    ).first()
    # Whole passes over a source, and the tokens of the rest.
    wanted = F.pow(F.col("tokens").cast("double"), F.lit(power)) / F.lit(z or 1.0) * F.lit((whole or 0.0) * budget)
    plan = totals.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(wanted / F.col("tokens") + 1e-9)).otherwise(1))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, wanted - F.col("passes") * F.col("tokens")).otherwise(0.0))
    plan = stored(plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))).drop("tokens"))

    def blocked(rows: DataFrame) -> DataFrame:
        return rows.join(plan, "source").withColumn("block", F.pmod("doc_order", F.col("blocks")))

    blocks = stored(blocked(slim).groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("tokens")))
    running = Window.partitionBy("source").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    keyed = blocks.withColumn("key", _order(F.lit("block"), "source", "passes", "block"))
    keyed = keyed.withColumn("left", F.col("rest") - F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    keyed = stored(keyed.select("source", "block", "passes", "tokens", "left"))
    # Of the block in which the rest ends, documents in their order while they fit.
    last = keyed.filter("left > 0 and left < tokens").select("source", "block", "left")
    inside = blocked(slim).select("source", "block", "tokens", "doc_order").join(last, ["source", "block"])
    upto = Window.partitionBy("source", "block").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.sum("tokens").over(upto))
    cut = inside.filter("sum <= left").groupBy("source", "block").agg(F.max("doc_order").alias("cut"))
    draws = keyed.join(cut, ["source", "block"], "left")
    draws = draws.select("source", "block", "passes", ((F.col("left") > 0) & (F.col("left") >= F.col("tokens"))).alias("all"), "cut")

    out = blocked(base).drop("passes", "rest", "blocks").join(draws, ["source", "block"])
    again = F.col("all") | F.coalesce(F.col("doc_order") <= F.col("cut"), F.lit(False))
    copies = (F.col("passes") + again.cast("int")).cast("int")
    out = out.filter(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), copies - 1)))
    return out.select("row", "source", "tokens", "epoch", _order(F.lit("block"), "source", "epoch", "block").alias("block_order"), "doc_order")
