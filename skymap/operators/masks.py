"""Pixel masks: by value range, generated, applied by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.frames import frame_matrix, rotate, sph_to_vec, vec_to_sph
from skymap.functions.pixels import NESTED, nest_parent, npix_of, require_power_of_two, with_ang2pix, with_nest2ring, with_pix2ang
from skymap.functions.staging import as_sql, compute
from skymap.functions.values import UNSEEN
from skymap.operators.bitmap import in_set
from skymap.plans.sizing import small_side
from skymap.sources.generated import all_pixels


def mask_range(df: DataFrame, below: float | None = None, above: float | None = None) -> DataFrame:
    """valid = within the given inclusive bounds, on raw values.

    NULL stands for the sentinel: it fails ``below`` and passes ``above``. NaN
    fails any bound that is set.
    """
    raw = F.coalesce(F.col("value").cast("double"), F.lit(UNSEEN))
    number = ~F.isnan(raw)
    ok: Column = F.lit(True)
    if below is not None:
        ok = ok & number & (raw >= F.lit(below))
    if above is not None:
        ok = ok & number & (raw <= F.lit(above))
    return df.select(*[c for c in df.columns if c != "value"], ok.alias("valid"))


def _window_mask(spark: SparkSession, nside: int, start: int, end: int) -> DataFrame:
    """All pixels; those with start <= pix < end are masked."""
    hidden = (F.col("pix") >= start) & (F.col("pix") < end)
    return spark.range(npix_of(nside)).select(F.col("id").alias("pix")).withColumn("valid", ~hidden)


def mask_band(spark: SparkSession, nside: int, degrees: float = 10.0) -> DataFrame:
    """Hide the central index band of npix * degrees / 90 pixels."""
    npix = npix_of(nside)
    band = int(npix * degrees / 90)
    start = npix // 2 - band // 2
    return _window_mask(spark, nside, start, start + band)


def mask_uniform(spark: SparkSession, nside: int, fill: float = 0.5) -> DataFrame:
    """Hide the tail from index int(npix * (1 - fill))."""
    npix = npix_of(nside)
    return _window_mask(spark, nside, int(npix * (1 - fill)), npix)


def mask_patch(spark: SparkSession, nside: int, radius: float = 30.0) -> DataFrame:
    """Hide an index window of npix * (radius / 180)^2 pixels around the middle."""
    npix = npix_of(nside)
    size = int(npix * (radius / 180) ** 2)
    start = max(0, npix // 2 - size // 2)
    return _window_mask(spark, nside, start, min(npix, start + size))


# A prime below 2^31 and a multiplier for the rounds of the permutation.
_PRIME, _FACTOR, _ROUNDS = 2147483647, 1103515245, 4


def round_keys(seed: int) -> list[int]:
    """Two keys a round."""
    return [(seed * 1000003 + k * 7368787 + 12345) % _PRIME for k in range(2 * _ROUNDS)]


def with_permuted(df: DataFrame, nside, seed: int, pix: str = "pix", out: str = "image") -> DataFrame:
    """Add the image of a pixel under a keyed permutation of 0 .. 12 nside^2 - 1.

    A pixel is a pair of numbers below 3 nside and 4 nside; each in turn is moved, modulo its own
    range, by a scrambled value of the other. Every round can be undone, so the whole is one to one.
    """
    n, last = as_sql(nside), ("high", "low")
    steps = {"high": f"`{pix}` div ({n} * 4)", "low": f"`{pix}` % ({n} * 4)"}
    for r in range(_ROUNDS):
        keys = round_keys(seed)[2 * r : 2 * r + 2]
        for part, other, side, key in ((1, 0, 4, keys[0]), (0, 1, 3, keys[1])):
            name = f"{'low' if part else 'high'}{r}"
            steps[f"s{name}"] = f"(:{last[other]} * {_FACTOR}L + {key}L) % {_PRIME}L"
            steps[name] = f"(:{last[part]} + :s{name} * :s{name} % {_PRIME}L) % ({n} * {side})"
            last = (last[0], name) if part else (name, last[1])
    return compute(df, steps, {out: f":{last[0]} * {n} * 4 + :{last[1]}"})


def mask_random(spark: SparkSession, nside: int, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Hide exactly int(npix * fraction) random pixels: those whose image under a keyed permutation
    is below that. A projection: nothing is sorted, selected or counted."""
    k = int(npix_of(nside) * fraction)
    pixels = spark.range(npix_of(nside)).select(F.col("id").alias("pix"))
    return with_permuted(pixels, nside, seed).select("pix", (F.col("image") >= k).alias("valid"))


BAND, UNIFORM, PATCH, RANDOM = "band", "uniform", "patch", "random"


def masks_of(specs: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """(mask_id, pix, valid): a generated mask for each row (mask_id, nside, amount) of ``specs``.

    ``amount`` is the degrees of a band, the share of a uniform or random mask, the radius of a patch.
    """
    npix = F.col("nside") * F.col("nside") * 12
    amount, middle = F.col("amount"), F.expr("nside * nside * 6")
    size = {
        BAND: F.floor(npix * amount / 90.0),
        PATCH: F.floor(npix * F.pow(amount / 180.0, F.lit(2.0))),
        UNIFORM: npix - F.floor(npix * (1 - amount)),
        RANDOM: F.floor(npix * amount),
    }
    if kind not in size:
        raise ValueError(f"unknown kind of mask {kind!r}")
    first = F.greatest(F.lit(0), middle - F.floor(size[kind] / 2)) if kind in (BAND, PATCH) else npix - size[kind]
    sized = specs.select(
        F.col("mask_id").alias("map_id"), "nside", F.col("nside").alias("side"), size[kind].alias("size"), first.alias("first")
    )
    rows = all_pixels(sized, "side", "size", "first")
    if kind == RANDOM:
        hidden = F.col("image") < F.col("size")
        rows = with_permuted(rows, "side", seed)
    else:
        hidden = (F.col("pix") >= F.col("first")) & (F.col("pix") < F.col("first") + F.col("size"))
    return rows.select(F.col("map_id").alias("mask_id"), "pix", (~hidden).alias("valid"))


def mask_from_pixels(pixels: DataFrame, maps: DataFrame, coord: str | None = None) -> DataFrame:
    """Mask tables from ingested pixels: valid = value > 0.5.

    The size must be 12 nside^2; anything else fails the job. Where ``maps`` tells the sizes (``n_pix``,
    as the files' headers do) they are taken from there and pixels are read once; else they are counted.
    """
    if "n_pix" in maps.columns:
        sizes = maps.filter("n_pix is not null").select("map_id", F.col("n_pix").alias("n"))
        untold = maps.filter("n_pix is null").select("map_id")
        if not untold.isEmpty():
            rest = pixels.join(small_side(untold), "map_id", "left_semi")
            sizes = sizes.unionByName(rest.groupBy("map_id").agg(F.count(F.lit(1)).alias("n")))
    else:
        sizes = pixels.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))
    nside = F.floor(F.sqrt(F.col("n") / 12.0)).cast("long")
    exact = (nside * nside * 12 == F.col("n")) & (nside >= 1)
    checked = sizes.select(
        "map_id",
        F.when(exact, nside)
        .otherwise(F.raise_error(F.concat(F.lit("invalid mask size: "), F.col("n").cast("string"))).cast("long"))
        .alias("nside"),
    )
    frame = maps.select("map_id", (F.lit(coord) if coord else F.coalesce("coord", F.lit("G"))).alias("coord"))
    per_mask = checked.join(frame, "map_id")
    return (
        pixels.join(small_side(per_mask), "map_id")
        .select(
            F.col("map_id").alias("mask_id"),
            "pix",
            F.coalesce(F.col("value") > 0.5, F.lit(False)).alias("valid"),
            "nside",
            "coord",
        )
    )


def one_mask(mask: DataFrame, pixels: DataFrame, mask_id: str | None = None) -> tuple[DataFrame, list[str]]:
    """The mask rows that concern ``pixels``, and the columns to join them on.

    A table of several masks is either cut to ``mask_id`` or joined by the pixels'
    own ``mask_id``; anything else would mix masks and is refused.
    """
    if "mask_id" not in mask.columns:
        return mask, ["pix"]
    if mask_id is not None:
        return mask.filter(F.col("mask_id") == mask_id), ["pix"]
    if "mask_id" in pixels.columns:
        return mask, ["mask_id", "pix"]
    raise ValueError("the mask table has mask_id: name one, or give the pixels a mask_id")


def mask_apply(pixels: DataFrame, mask: DataFrame, mask_id: str | None = None, nside: int | None = None) -> DataFrame:
    """Add ``valid``: a pixel the mask lacks is valid, one that any of its rows hides is not.

    The hidden pixels travel as a bitmap, so the pixel table is not shuffled; with the ``nside`` of a
    single mask its size is proven and no job runs ahead.
    """
    own, keys = one_mask(mask, pixels, mask_id)
    hidden = ~F.coalesce(F.col("valid"), F.lit(True))
    found = in_set(pixels, own, hidden, [k for k in keys if k != "pix"], nside, "__hidden")
    return found.withColumn("valid", ~F.col("__hidden")).drop("__hidden")


def mask_fill(rgba: Column, valid: Column, fill: tuple[int, int, int, int] | None) -> Column:
    """Masked cells take the fill colour when one is set."""
    if fill is None:
        return rgba
    colour = F.struct(*[F.lit(c).alias(n) for c, n in zip(fill, "rgba")])
    return F.when(~valid, colour).otherwise(rgba)


def mask_frame_check(maps: DataFrame, masks: DataFrame) -> DataFrame:
    """Pairs of map and mask whose frames differ (the mask is never transformed).

    ``maps`` names its mask in ``mask_id``; both are one-row-per-map tables.
    """
    right = masks.select("mask_id", F.col("coord").alias("mask_coord"))
    return (
        maps.join(right, "mask_id")
        .filter(F.col("coord") != F.col("mask_coord"))
        .select("map_id", "mask_id", F.col("coord").alias("map_coord"), "mask_coord")
    )


RULES = ("any", "majority", "all")


def turn_mask(
    mask: DataFrame, mask_nside: int, mask_ordering: str, mask_frame: str,
    nside: int, ordering: str, frame: str, rule: str = "any",
) -> DataFrame:
    """(pix, valid) of a mask in the frame, resolution and ordering of a map, every pixel of it.

    Each pixel of the finer of the two resolutions, in the map's frame, asks the mask pixel that holds
    its centre; one the mask lacks is valid. A map pixel made of several is hidden if any of them is, if
    more than half are, or if all are, as ``rule`` says. The mask travels as a bitmap.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    require_power_of_two(nside)
    require_power_of_two(mask_nside)
    fine = max(nside, mask_nside)
    rows = mask.sparkSession.range(npix_of(fine)).select(F.col("id").alias("__fine"))
    rows = with_pix2ang(rows, fine, NESTED, "__fine", ("__t", "__p"))
    x, y, z = sph_to_vec("__t", "__p")
    rows = rows.select("__fine", x.alias("__x"), y.alias("__y"), z.alias("__z"))
    turned = rotate(frame_matrix(frame, mask_frame), (F.col("__x"), F.col("__y"), F.col("__z")))
    theta, phi = vec_to_sph(*turned)
    rows = rows.select("__fine", theta.alias("__t"), phi.alias("__p"))
    rows = with_ang2pix(rows, mask_nside, mask_ordering, "__t", "__p", "pix").select("__fine", "pix")
    rows = in_set(rows, mask, ~F.coalesce(F.col("valid"), F.lit(True)), nside=mask_nside, out="__hidden")
    levels = (fine // nside).bit_length() - 1
    pix = nest_parent("__fine", levels)
    if levels == 0:
        out = rows.select(pix.alias("pix"), (~F.col("__hidden")).alias("valid"))
    else:
        share = F.avg(F.col("__hidden").cast("double"))
        hidden = {"any": share > 0, "majority": share > 0.5, "all": share == 1}[rule]
        out = rows.groupBy(pix.alias("pix")).agg((~hidden).alias("valid"))
    return out if ordering == NESTED else with_nest2ring(out, nside, "pix", "pix").select("pix", "valid")


def mask_stats(mask: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and percentages of masked and valid pixels."""
    n = F.count(F.lit(1))
    masked, valid = F.count_if(~F.col("valid")), F.count_if(F.col("valid"))
    return mask.groupBy(*(keys or [])).agg(
        n.alias("total"),
        masked.alias("masked"),
        valid.alias("valid_count"),
        (masked * 100.0 / n).alias("masked_pct"),
        (valid * 100.0 / n).alias("valid_pct"),
    )
