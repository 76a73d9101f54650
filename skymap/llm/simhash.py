"""Near-duplicate documents by SimHash and pigeonhole blocks.

A fingerprint has 64 bits: bit b is 1 when it is set in over half of the XXH64 hashes of the
text's word shingles. Fingerprints that differ in at most three bits are linked; documents are
grouped by connected links.

* Documents of equal fingerprint are one row from the start, so copies cost nothing later.
* The 64 bits are cut into six blocks. Three differing bits touch at most three of them, so a
  linked pair agrees in at least three: a fingerprint is put under 20 keys, one for each choice
  of three blocks (about 32 bits), and pairs are sought within a key only.
* A key that more than ``BUCKET`` fingerprints share is split by the same principle: what is left
  free is cut into eight parts, a linked pair agrees in at least five, so 56 keys of another 20
  bits. At most 12 bits are then free: 4096 different fingerprints at the most. No bucket, no
  task and no output grows with the square of a group.
* Within a bucket a breadth-first walk over the members compares fingerprints exactly and gives
  a spanning forest, at most one link for a member, not all pairs.
* Components come from alternating large-star and small-star rounds on the links, each round
  stored in the shared folder.

Cases: a null text and a text without words have fingerprint zero and are linked like any other.
Repeated rows get one row each. A null doc_id keeps its row; the group's id is the smallest that
is not null. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm import minhash
from skymap.llm.common import ship_code, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
# Fingerprints handled in one bucket; the second split has at most 2^12 by construction.
BUCKET = 4096
SLICE = 1 << 15


def _ranges(widths: list[int]) -> list[tuple[int, int]]:
    """(first bit, width) of consecutive blocks."""
    out, at = [], 0
    for w in widths:
        out.append((at, w))
        at += w
    return out


BLOCKS = _ranges([11, 11, 11, 11, 10, 10])


def _mask(bits: list[int]) -> int:
    """The mask of these bits as a signed 64-bit number."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _bits(blocks) -> list[int]:
    return [b for at, width in blocks for b in range(at, at + width)]


def first_masks() -> list[int]:
    """Masks of three blocks of six."""
    return [_mask(_bits(c)) for c in combinations(BLOCKS, 3)]


def second_masks(first: int) -> list[int]:
    """Masks of ``first`` and five of eight parts of what it leaves free."""
    free = [b for b in range(64) if not first >> b & 1]
    parts = [free[i * len(free) // 8 : (i + 1) * len(free) // 8] for i in range(8)]
    fixed = [b for b in range(64) if first >> b & 1]
    return [_mask(fixed + [b for p in chosen for b in p]) for chosen in combinations(parts, 5)]


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        a, b = starts[at : min(n, at + SLICE)].tolist(), ends[at + size - 1 : min(n, at + SLICE) + size - 1].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in zip(a, b)), dtype="<u8", count=len(a))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(texts: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The last column of ``texts``, the text, replaced by ``fp``, its fingerprint as a signed number."""
    ship_code(texts.sparkSession)
    *kept, _ = texts.schema.fields
    names = [f.name for f in kept] + ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *cols, text = batch.columns
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in text), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names)

    return texts.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def spanning_links(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest over different fingerprints within ``max_bits`` of each other."""
    links, rest = [], members.view(np.uint64)  # bit counts of negative numbers are those of their amount
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= max_bits
            if near.any():
                found = rest[near]
                links += [(int(at.view(np.int64)), x) for x in found.view(np.int64).tolist()]
                frontier += list(found)
                rest = rest[~near]
    return links


def _search(bucket: int, max_bits: int):
    """Over rows (mask, key, fp) sorted by mask and key: (u, v, mask), links with mask null, else a
    fingerprint u of a bucket over the limit, to be split again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_n, key, over = 0, None, False
        out: list[tuple[int, int | None, int | None]] = []

        def flush():
            nonlocal held, held_n
            if over:
                out.extend((int(x), None, key[0]) for part in held for x in part)
            elif held_n > 1:
                out.extend((u, v, None) for u, v in spanning_links(np.unique(np.concatenate(held)), max_bits))
            held, held_n = [], 0

        def batch_out():
            cols = list(zip(*out)) if out else [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "mask"])

        for batch in batches:
            mask, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
            # Runs of one row cannot hold a link; only the first and last touch a neighbouring batch.
            worth = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))
            for i in worth:
                a, b = int(starts[i]), int(ends[i])
                own = (int(mask[a]), int(k[a]))
                if own != key:
                    flush()
                    key, over = own, False
                held.append(fp[a:b].copy())
                held_n += b - a
                if held_n > bucket:
                    over = True
                if over:
                    flush()
                if len(out) > 50_000:
                    yield batch_out()
        flush()
        yield batch_out()

    return run


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v", "mask")])


def _keyed(fps: DataFrame, masks: Column) -> DataFrame:
    out = fps.select("fp", F.explode(masks).alias("mask"))
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _buckets(keyed: DataFrame, bucket: int, max_bits: int) -> DataFrame:
    ship_code(keyed.sparkSession)
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_search(bucket, max_bits), _FOUND)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect what any two fingerprints within three bits connect.

    ``fps`` has one row for each different fingerprint.
    """
    first = first_masks()
    found = stored(_buckets(_keyed(fps, F.array(*[F.lit(m) for m in first])), bucket, MAX_BITS))
    over = found.filter(F.col("mask").isNotNull()).select(F.col("u").alias("fp"), F.col("mask").alias("first"))
    again = F.create_map(*[x for m in first for x in (F.lit(m), F.array(*[F.lit(k) for k in second_masks(m)]))])
    # Twelve free bits bound these buckets, so no limit is needed.
    split = _buckets(_keyed(over, F.element_at(again, F.col("first"))), 1 << 62, MAX_BITS)
    return found.filter(F.col("mask").isNull()).select("u", "v").unionByName(split.select("u", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node can reach; a root has no row of its own."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours go to the smallest; small star: smaller ones do.
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = now


def _rooted(prints: DataFrame, *aggregates: Column) -> DataFrame:
    """(fp, root, ...): the root of each fingerprint's component, and aggregates over its rows."""
    fps = stored(prints.groupBy("fp").agg(*aggregates))
    roots = components(links(fps.select("fp")))
    return fps.join(roots, fps["fp"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links.
    """
    prints = stored(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    rooted = _rooted(prints, F.min("doc_id").alias("least"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _fingerprint_links(pairs: DataFrame) -> DataFrame:
    """(u, v): from (fp, sim), links that connect the sets whose fingerprints are connected."""
    roots = components(links(pairs.select("sim").distinct().withColumnRenamed("sim", "fp")))
    rooted = pairs.join(roots, pairs["sim"] == roots["node"], "left").select("fp", F.coalesce("root", "sim").alias("root"))
    least = rooted.groupBy("root").agg(F.min("fp").alias("v"))
    return rooted.join(least, "root").select(F.col("fp").alias("u"), "v").filter("u <> v").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest doc_id (null last), then
    of the smallest hash of the text; of rows equal in both, any one.

    Candidates are what the fingerprints link, as in ``near_duplicates``, and, as farther copies differ
    in more than three bits, what shares a MinHash band; their shingles decide (see ``minhash``).
    """
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))
    slim = docs.select(F.col(id_col).alias("id"), text_hash.alias("h"), F.col(text_col).alias("text"))
    prints = stored(minhash.with_sets(slim, {"sim": simhash}))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("first")
    # Texts of equal sets are one row from here on; any of their bands are the same.
    sets = stored(prints.groupBy("fp").agg(first, F.any_value("bands").alias("bands")))
    close = _fingerprint_links(stored(prints.select("fp", "sim").distinct()))
    near = stored(components(minhash.candidates(sets).unionByName(close)))
    grouped = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    reps = sets.join(grouped, sets["fp"] == grouped["node"]).select("fp", "root", F.col("first.id").alias("r_id"), F.col("first.h").alias("r_h"))
    met = reps.join(slim, slim["id"].eqNullSafe(reps["r_id"]) & (slim["h"] == reps["r_h"]))
    # Rows equal in id and text come once.
    texts = stored(met.groupBy("fp").agg(F.any_value("root").alias("root"), F.any_value("text").alias("text")).select("root", "fp", "text"))
    roots = components(minhash.exact_links(texts))
    rooted = sets.select("fp", "first").join(roots, sets["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("w")).select(F.col("w.id").alias("w_id"), F.col("w.h").alias("w_h"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("row"), F.col(id_col).alias("id"), text_hash.alias("h"))
    kept = held.join(winners, held["id"].eqNullSafe(winners["w_id"]) & (held["h"] == winners["w_h"]), "left_semi")
    return kept.groupBy("id", "h").agg(F.first("row").alias("row")).select("row.*")
