"""Periodic stretches of words: where a text says the same again and again.

A run is a maximal stretch of words with smallest period q, at least 24 words and at least 3 q
long. Told by positions: with ``M_q(i)`` for "words i and i + q are equal", runs are maximal
stretches of positions where ``M_q`` holds, q longer.

1. Tiles. A document is exploded into overlapping tiles, per octave of periods [s, 2 s): the
   middle parts are 8 s words, with s words before and 3 s after. Octaves up to 1024 share one
   tiling, a document of at most 8192 words is one tile for all its octaves. The tiles of longer
   documents are shuffled by themselves, so one long document is solved by many tasks.
2. Solving. A stretch of ``M_q`` is so long that it holds a whole block of s positions at a multiple
   of s, its boundary. Names of blocks, hashes built by doubling, are compared at all boundaries
   and periods at once; they miss nothing, and what they report is decided by Z-functions: the
   words from the boundary on against themselves give how far ``M_q`` goes to the right for every
   period of the octave and whether the period has a shorter one inside, the words before it,
   reversed, how far to the left. Both are exact within the tile.
3. Stitching. A tile's stretches are fragments of the document's: shuffled by document and period,
   fragments that touch are joined. A stretch found under several periods belongs to the least.

Tiles overlap enough for that: a tile that owns a block sees s words before its middle part and a
period and a block after it, so the fragments of one stretch always touch.

Cases: a null text has no words, no run and an empty collapsed text. Documents are told apart by
id and a digest of the text, so rows that repeat an id are not mixed, and repeated rows get equal
results; a null id is a value like any other. An empty table gives an empty table. Texts may be as
long as a row can be; periods reach to a third of the text. Other columns are carried along; those
named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code, stored, words_of

MIN_LENGTH = 24
MIN_REPEATS = 3
BLOCK = 8
# Words of a tile's middle part, and the longest block of the octaves that share that tiling.
CORE = 8192
SHARED = 1024
BATCH_BYTES = 8 << 20
assert MIN_LENGTH - BLOCK + 1 >= 2 * BLOCK and MIN_REPEATS >= 3
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

TILE = "doc_id {id}, digest string, n long, first long, core_from long, core_to long, small long, large long, words binary"
FRAGMENT = "doc_id {id}, digest string, period long, lo long, hi long"


def tiles(n: int, core: int = CORE, shared: int = SHARED) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(first, end, core_from, core_to, smallest block, largest block) of the tiles of n words."""
    if n <= core:
        if n >= MIN_LENGTH:
            yield 0, n, 0, n, BLOCK, max(BLOCK, n)
        return
    small, large, size = BLOCK, shared, core
    while small == BLOCK or small <= n // MIN_REPEATS:
        for a in range(0, n, size):
            yield max(0, a - large), min(n, a + size + 3 * large), a, min(n, a + size), small, large
        small = large = large * 2
        size = 8 * large


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _ODD[0] + b
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def z_values(s: list, n: int) -> list[int]:
    """For each of the first n places: how many items from there equal the items from the start."""
    size = len(s)
    out = [size] + [0] * (n - 1)
    left = right = 0
    for i in range(1, min(n, size)):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < size and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _left_extents(s: list, b: int, reach: int) -> list[int]:
    """For each period below ``reach``: how far the words before b equal those a period later."""
    end = min(len(s), b + reach)
    before = s[:b][::-1]
    z = z_values([*before, -1, *s[:end][::-1]], b + 1 + end - b)
    # Reversed, place b + q - 1 stands end - b - q after the separator.
    return [z[b + 1 + end - b - q] if 0 < q <= end - b else 0 for q in range(reach)]


def solve(ids: np.ndarray, n: int, first: int, core: tuple[int, int], small: int, large: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi): where ``M_period`` holds, for blocks in the tile's middle part; places are
    the document's. ``ids`` are the words from ``first`` on, n words has the document."""
    size = len(ids)
    longest = n // MIN_REPEATS
    name = ids.astype(np.uint64) + np.uint64(1)
    words: list[int] | None = None
    out: list[tuple[int, int, int]] = []
    s = 1
    while 2 * s <= max(BLOCK, min(large, longest)):
        if size < 2 * s:
            break
        name = _joined(name[: size - 2 * s + 1], name[s : size - s + 1])
        s *= 2
        if s < max(small, BLOCK):
            continue
        a0 = core[0] - first
        m = -(-(core[1] - first - a0) // s)
        padded = np.zeros(max(0, a0 + (m + 1) * s), dtype=np.uint64)
        padded[: len(name)] = name[: len(padded)]
        own = padded[a0 : a0 + m * s].reshape(m, s)
        later = padded[a0 + s : a0 + (m + 1) * s].reshape(m, s)
        at, off = np.nonzero((later == own[:, :1]) & (own[:, :1] != 0))
        periods = off + s
        if s == BLOCK:
            near, q = np.nonzero((own[:, 1:] == own[:, :1]) & (own[:, :1] != 0))
            at, periods = np.concatenate((near, at)), np.concatenate((q + 1, periods))
        good = periods <= longest
        if not good.any():
            continue
        if words is None:
            words = ids.tolist()
        hits: dict[int, list[int]] = {}
        for j, q in zip(at[good].tolist(), periods[good].tolist()):
            hits.setdefault(a0 + j * s, []).append(q)
        done: dict[int, int] = {}
        for b in sorted(hits):
            fresh = sorted(q for q in hits[b] if done.get(q, 0) < b + s)
            if not fresh:
                continue
            right = z_values(words[b:], min(2 * s, size - b))
            squares = [d for d in range(1, len(right)) if right[d] >= d]
            whole = []
            for q in fresh:
                done[q] = b + right[q]
                # A period whose words are a shorter word sequence repeated is found under that.
                if right[q] >= s and not any(q % d == 0 and d + right[d] >= q for d in squares if d < q):
                    whole.append(q)
            if not whole:
                continue
            left = _left_extents(words, b, 2 * s)
            for q in whole:
                lo, hi = b - left[q], b + right[q]
                open_ended = (lo == 0 and first > 0) or (hi + q == size and first + size < n)
                if open_ended or hi - lo + q >= max(MIN_LENGTH, MIN_REPEATS * q):
                    out.append((q, first + lo, first + hi))
    return out


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _tile_rows(rows: DataFrame) -> DataFrame:
    """A row for each tile of (doc_id, digest, text)."""
    schema = T._parse_datatype_string(TILE.format(id=rows.schema["doc_id"].dataType.simpleString()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int64()] * 6, pa.binary()]
            out, size = [], 0
            for doc_id, digest, text in zip(*batch.columns):
                seen: dict[bytes, int] = {}
                words = [seen.setdefault(w, len(seen)) for w in _split(text.as_py())]
                ids = np.array(words, dtype="<u4")
                n = len(ids)
                for first, end, a, b, small, large in tiles(n):
                    out.append((doc_id.as_py(), digest.as_py(), n, first, a, b, small, large, ids[first:end].tobytes()))
                    size += 4 * (end - first)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, schema)


def _fragment_rows(tiled: DataFrame) -> DataFrame:
    schema = T._parse_datatype_string(FRAGMENT.format(id=tiled.schema["doc_id"].dataType.simpleString()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int64()] * 3]
            out = []
            for doc_id, digest, n, first, a, b, small, large, words in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(words, dtype="<u4")
                out += [(doc_id, digest, *x) for x in solve(ids, n, first, (a, b), small, large)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return tiled.mapInArrow(run, schema)


def stitched(fragments: DataFrame) -> DataFrame:
    """(doc_id, digest, start, length, period) of the runs, from fragments of their stretches."""
    own = ["doc_id", "digest"]
    # Equal fragments of repeated rows meet before the shuffle by document.
    pieces = fragments.distinct().repartition(*own)
    by_place = Window.partitionBy(*own, "period").orderBy("lo", "hi")
    pieces = pieces.withColumn("seen", F.max("hi").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when(F.col("seen").isNull() | (F.col("lo") > F.col("seen")), 1).otherwise(0)
    pieces = pieces.withColumn("nth", F.sum(begins).over(by_place))
    whole = pieces.groupBy(*own, "period", "nth").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    whole = whole.withColumn("length", length)
    whole = whole.filter(F.col("length") >= F.greatest(F.lit(MIN_LENGTH), MIN_REPEATS * F.col("period")))
    return whole.groupBy(*own, "start", "length").agg(F.min("period").alias("period"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, runs): documents with runs, an array of (start, length, period) by start,
    then period. Two rows of one id and one text are one row here."""
    ship_code(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    # Of so many bytes at most, a text has one tile: every word but the last takes two.
    long = F.octet_length("text") > 2 * CORE
    near = _fragment_rows(_tile_rows(rows.filter(~long)))
    far = _tile_rows(rows.filter(long)).repartition("doc_id", "digest", "small", "first")
    runs = stitched(near.unionByName(_fragment_rows(far)))
    each = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    found = runs.groupBy("doc_id", "digest").agg(each.alias("found"))
    in_order = F.transform("found", lambda r: F.struct(r["start"], r["length"], r["period"]))
    return found.select("doc_id", "digest", in_order.alias("runs"))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``runs`` and ``collapsed``: of every run the first period stays, the words that
    are kept are joined by a blank."""
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    # Stored, so that the size of this side is known when the join is planned.
    found = stored(find_runs(docs, id_col, text_col))
    found = found.select(F.col("doc_id").alias("_of"), F.col("digest").alias("_digest"), F.col("runs").alias("_runs"))
    text = F.coalesce(docs[text_col], F.lit(""))
    same = docs[id_col].eqNullSafe(found["_of"]) & (F.md5(text) == found["_digest"])
    columns = [docs[c] for c in kept] + [text.alias("_text"), found["_runs"].alias("runs")]
    rows = docs.join(found, same, "left").select(*columns)
    schema = T.StructType([*rows.schema.fields[:-2], rows.schema.fields[-1]]).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            others = [*batch.columns[:-2], runs]
            done = 0
            while done < batch.num_rows:
                out, size, a = [], 0, done
                while done < batch.num_rows and size < BATCH_BYTES:
                    words = texts[done].as_py().encode().split()
                    own = runs[done].as_py()
                    if own:
                        edges = np.zeros(len(words) + 1, dtype=np.int64)
                        for r in own:
                            edges[r["start"] + r["period"]] += 1
                            edges[r["start"] + r["length"]] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                    out.append(b" ".join(words).decode())
                    size += len(out[-1])
                    done += 1
                arrays = [c.slice(a, done - a) for c in others]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repetitions of the query's contract: of every tenth document the words
    from some place on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"))
    n = F.size("w")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rows = rows.withColumn("p", p)
    rest = F.col("n") - F.col("a")
    times = F.ceil(rest / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def describe_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run
    of greatest length over period, and digests of all runs and of the collapsed text."""
    rows = collapse_runs(docs)

    def order(x: Column, y: Column) -> Column:
        # Fractions compared by cross products, which are exact.
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        tie = F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"]))
        return F.when(a > b, -1).when(a < b, 1).otherwise(tie.cast("int"))

    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.coalesce(lines, F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
