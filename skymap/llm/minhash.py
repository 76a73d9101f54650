"""Near copies of similarity 0.8 or more: the Jaccard share of two texts' five-word shingles.

* Candidates come from MinHash bands: ``BANDS`` keys, each over ``ROWS`` minima. A pair at 0.8 has
  a band in common with probability 0.9999, more alike pairs surely enough.
* Texts with a band in common, directly or over others, form a candidate group. Within each group
  the shingle sets are compared exactly, every text with every other that is not linked to it yet,
  so a band decides nothing but who is compared.
* A group of more than ``GROUP`` texts is dealt into slices, and every pair of slices is one group
  of its own: no worker holds more than two slices. The comparisons of one group still grow with
  the square of its size where its texts do not link.

Texts of fewer than five words are one shingle; texts without words are all equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
GROUP = 2000
SLICE = 2048
_MEMO_WORDS = 500_000
_ODD = np.random.default_rng(42).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(43).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = code = xxhash.xxh64_intdigest(word, 42)
        return code


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, codes: dict) -> np.ndarray:
    """Sorted different hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(codes) > _MEMO_WORDS:
        codes.clear()
    c = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    h = np.full(n if size else 0, size, dtype=np.uint64)
    for k in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n])
    return np.unique(h)


def set_hash(hashes: np.ndarray) -> int:
    """One signed number for a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of the bands as signed numbers; the empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), SLICE):
        least = np.minimum(least, (_ODD[:, None] * low[at : at + SLICE] + _ADD[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def with_sets(texts: DataFrame, prints: dict[str, Callable[[str | None], int]] | None = None) -> DataFrame:
    """The last column of ``texts``, the text, replaced by ``fp``, the hash of its set, ``bands`` and a
    column of unsigned numbers, kept as signed ones, for each function of a text in ``prints``."""
    prints = prints or {}
    ship_code(texts.sparkSession)
    *kept, _ = texts.schema.fields
    names = [f.name for f in kept] + ["fp", "bands", *prints]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            *cols, text = batch.columns
            sets = [shingles(t.as_py(), codes) for t in text]
            fps = pa.array([set_hash(s) for s in sets], pa.int64())
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            own = [np.fromiter((f(t.as_py()) for t in text), np.uint64, len(text)).view(np.int64) for f in prints.values()]
            yield pa.RecordBatch.from_arrays([*cols, fps, keys, *map(pa.array, own)], names)

    made = [T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    made += [T.StructField(name, T.LongType()) for name in prints]
    return texts.mapInArrow(run, T.StructType([*kept, *made]))


def candidates(sets: DataFrame) -> DataFrame:
    """(u, v): from (fp, bands), one row a set, each set and the smallest that shares a band with it."""
    keyed = sets.select("fp", F.explode("bands").alias("key"))
    order = Window.partitionBy("key").orderBy("fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keyed.select(F.col("fp").alias("u"), F.first("fp").over(order).alias("v")).filter("u <> v").distinct()


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places (u, v) of a spanning forest over the sets of similarity ``SIMILARITY`` or more."""
    sizes = np.array([len(s) for s in sets])
    links, rest, frontier = [], np.arange(len(sets)), []
    values = owners = None
    indexed = 0
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            if values is None or 2 * len(rest) < indexed:
                values = np.concatenate([sets[i] for i in rest])
                owners = np.repeat(rest, sizes[rest])
                order = np.argsort(values, kind="stable")
                values, owners, indexed = values[order], owners[order], len(rest)
            at = frontier.pop()
            a, b = np.searchsorted(values, sets[at], "left"), np.searchsorted(values, sets[at], "right")
            n = b - a
            places = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(owners[places], minlength=len(sets))[rest]
            # In whole numbers: common / (all - common) >= 0.8.
            near = 9 * common >= 4 * (sizes[at] + sizes[rest])
            if near.any():
                found = rest[near].tolist()
                links += [(at, x) for x in found]
                frontier += found
                rest = rest[~near]
        frontier = []
    return links


def _compare():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, key, fps, sets = _Codes(), None, [], []

        def links():
            found = linked(sets) if len(sets) > 1 else []
            u, v = ([fps[pair[k]] for pair in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            root, pair, fp, text = batch.columns
            for r, p, f, t in zip(root.to_pylist(), pair.to_pylist(), fp.to_pylist(), text):
                if (r, p) != key:
                    yield links()
                    key, fps, sets = (r, p), [], []
                fps.append(f)
                sets.append(shingles(t.as_py(), codes))
        yield links()

    return run


def exact_links(texts: DataFrame, group: int | None = None) -> DataFrame:
    """(u, v) from (root, fp, text): links that connect what all pairs of 0.8 or more connect within a root."""
    ship_code(texts.sparkSession)
    group = group or GROUP
    sizes = texts.groupBy("root").agg(F.ceil(F.count("*") / group).cast("int").alias("k"))
    other = F.sequence(F.lit(0), F.col("k") - 1)
    own = texts.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    dealt = own.select("root", "k", "own", "fp", "text", F.explode(other).alias("other")).filter("k = 1 OR own <> other")
    pair = F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("root", pair.alias("pair"), "fp", "text")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "root", "pair").sortWithinPartitions("root", "pair")
    return dealt.mapInArrow(_compare(), T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v")]))
