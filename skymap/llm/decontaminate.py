"""Benchmark decontamination by template windows.

Words are brought to a template: numbers, names (capitalised words inside a sentence) and units
(after a number) become typed placeholders, everything else is lower-cased without the marks
around it. Windows of eight template words are hashed; documents and benchmark items are joined
on the hash. A question with other numbers or names has the same template, so the values in the
slots are compared next: within one alignment of item and document a value of the item stands for
the value of the document that it has in over half of its slots, and windows with another one do
not count. A name without such a value agrees with nothing; equal numbers may be independent and
then agree with all. Windows whose values are the item's own always count. Every window is also
hashed by its plain words, values kept; so exact copies are found whatever their words are, and
windows with fewer than four literal words, whose templates match too much, are found this way
only. A document is contaminated by an item when at least half of all the item's windows are found
in it.

Documents emit only windows whose hash the benchmark has, as long as the benchmark's hashes fit
``FILTER_HASHES`` (32 MB, counted); beyond that all windows go to the join, with equal results.
A passage in very many documents gives one row for each occurrence, summed before the shuffle.

Cases: a null or empty text has no windows. An item with fewer than eight words is one window of
its own length; of fewer than three words, it is found only in a document that holds nothing else.
An item without words matches nothing. Repeated rows are equal in every result. Null ids are
values like any other. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code, stored

WINDOW = 8
MIN_LITERALS = 4
MIN_WORDS = 3
MIN_SHARE = 0.5
FILTER_HASHES = 4_000_000

NUMBER, NAME, UNIT, LITERAL = 1, 2, 3, 0
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s min h hr hour hours minute minutes second seconds "
    "day days week weeks month months year years percent % degrees celsius fahrenheit dollars euros "
    "cents usd eur miles meters metres kilometers kilometres grams kilograms liters litres mph kmh".split()
)
_NUMBER = re.compile(r"[-+$€£#]*\d[\d.,:/-]*[a-z%°]{0,3}")
_AROUND = "\"'`.,;:!?()[]{}<>*#|_“”‘’«»…"
_MEMO_WORDS = 500_000
# Keeps plain windows apart from templates without placeholders.
PLAIN = 0x5851F42D4C957F2D
BREAK = "\n"


class Words(dict):
    """word -> row of the tables: hash of the plain form, kind, capitalised, ends a sentence."""

    def __init__(self):
        super().__init__()
        self.tables = tuple(np.zeros(1 << 16, t) for t in (np.uint64, np.int8, bool, bool))

    def __missing__(self, word: str) -> int:
        import xxhash

        plain = word.strip(_AROUND)
        low = plain.lower()
        kind = UNIT if low in UNITS else LITERAL
        if not low.isalpha() and _NUMBER.fullmatch(low):
            kind = NUMBER
        self[word] = at = len(self)
        if at == len(self.tables[0]):
            self.tables = tuple(np.concatenate((t, np.zeros_like(t))) for t in self.tables)
        codes, kinds, upper, ends = self.tables
        codes[at] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 7)
        kinds[at] = kind
        upper[at] = plain[:1].isupper()
        ends[at] = word[-1] in ".!?:" or word[-2:-1] in (".", "!", "?")
        return at

    def rows(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """The four columns for these words."""
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return tuple(t[at] for t in self.tables)


def template(text: str | None, memo: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(codes, plain, kinds, words): one entry per word; codes of placeholders are their kind."""
    words: list[str] = []
    first: list[int] = []
    for line in (text or "").split(BREAK):
        first.append(len(words))
        words += line.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), words
    codes, kinds, upper, ends = memo.rows(words)
    starts = np.zeros(len(words) + 1, dtype=bool)
    starts[first] = True
    starts[1:] |= ends
    kinds[(kinds == UNIT) & (np.concatenate(([0], kinds[:-1])) != NUMBER)] = LITERAL
    kinds[(kinds == LITERAL) & upper & ~starts[:-1]] = NAME
    plain = codes ^ np.uint64(PLAIN)
    codes[kinds != LITERAL] = kinds[kinds != LITERAL]
    return codes, plain, kinds, words


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for two side by side."""
    h = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> np.uint64(31))) + b) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def window_hashes(codes: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``size`` words, whether it has enough literal words).

    Runs of one, two, four and eight words are hashed once and put together.
    """
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    whole, at, width, runs = np.full(n, size, dtype=np.uint64), 0, 1, codes
    while width <= size:
        if size & width:
            whole = _pair(whole, runs[at : at + n])
            at += width
        if 2 * width <= size:
            runs = _pair(runs[:-width], runs[width:])
        width *= 2
    literals = np.concatenate(([0], np.cumsum(kinds == LITERAL)))
    return whole.view(np.int64), literals[size:] - literals[:-size] >= MIN_LITERALS


def _slots(kinds: np.ndarray, words: list[str], at: int, size: int) -> list[str]:
    """Offset, kind and value of each slot."""
    return [f"{i - at} {kinds[i]} {words[i].strip(_AROUND).lower()}" for i in range(at, at + size) if kinds[i] != LITERAL]


def _windows(texts: DataFrame, sizes: list[int], filter_hashes: np.ndarray | None, whole_short: bool) -> DataFrame:
    """Windows of the last column, the text: the other columns and (hash, pos, slots, n_windows, size).

    With ``whole_short`` a text is cut into windows of its own size only (the benchmark's side),
    else into windows of all ``sizes``.
    """
    ship_code(texts.sparkSession)
    *kept, _ = texts.schema.fields
    names = [f.name for f in kept]
    wanted = None if filter_hashes is None else texts.sparkSession.sparkContext.broadcast(filter_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            rows, hashes, places, slots, totals, widths = [], [], [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                codes, plain, kinds, words = template(text.as_py(), memo)
                own = [min(WINDOW, len(codes))] if whole_short else sizes
                for size in own:
                    if not size or (size < MIN_WORDS and size != len(codes)):
                        continue
                    h, good = window_hashes(codes, kinds, size)
                    exact, _ = window_hashes(plain, kinds, size)
                    for found, use, with_slots in ((h, good, True), (exact, np.ones(len(h), dtype=bool), False)):
                        if wanted is not None:
                            at = np.searchsorted(wanted.value, found)
                            use = use & (wanted.value[np.minimum(at, len(wanted.value) - 1)] == found)
                        for p in np.flatnonzero(use):
                            rows.append(i)
                            hashes.append(int(found[p]))
                            places.append(int(p))
                            slots.append(_slots(kinds, words, p, size) if with_slots else [])
                            totals.append(len(h))
                            widths.append(size)
            if len(memo) > _MEMO_WORDS:
                memo = Words()
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            made = [pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(totals, pa.int64()), pa.array(widths, pa.int64())]
            yield pa.RecordBatch.from_arrays([*taken, *made], [*names, "hash", "pos", "slots", "n_windows", "size"])

    made = [("hash", T.LongType()), ("pos", T.LongType()), ("slots", T.ArrayType(T.StringType())), ("n_windows", T.LongType()), ("size", T.LongType())]
    return texts.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in made]]))


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in cols])


def _conflicts(met: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., shift, pos): windows with a slot that differs from what its value stands for."""
    own = [*ids, "shift"]
    pairs = met.select(*own, "pos", (F.col("slots") == F.col("d_slots")).alias("equal"), F.explode(F.arrays_zip("slots", "d_slots")).alias("p"))
    offset, kind = (F.substring_index(F.col("p.slots"), " ", k) for k in (1, 2))
    # The value with its kind; a slot comes in up to eight windows and counts once.
    pairs = pairs.select(
        *own, "pos", "equal", (F.col("pos") + offset.cast("long")).alias("at"), F.substring_index(kind, " ", -1).cast("int").alias("kind"),
        F.expr("substring(p.slots, locate(' ', p.slots) + 1)").alias("v"), F.expr("substring(p.d_slots, locate(' ', p.d_slots) + 1)").alias("d"),
    )
    counted = pairs.select(*own, "at", "kind", "v", "d").distinct().groupBy(*own, "kind", "v", "d").agg(F.count("*").alias("n"))
    split = counted.groupBy(*own, "kind", "v").agg(F.count("*").alias("values"), F.max_by("d", "n").alias("best"), F.max("n").alias("most"), F.sum("n").alias("total"))
    major = F.col("most") * 2 > F.col("total")
    split = split.filter((F.col("values") > 1) & (major | (F.col("kind") != NUMBER))).select(*own, "v", F.when(major, F.col("best")).alias("best"))
    other = pairs.filter(~F.col("equal"))
    met_split = other.join(split, _same(other, split, [*own, "v"]))
    return met_split.filter(~other["d"].eqNullSafe(split["best"])).select(*[other[c] for c in own], other["pos"]).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, keys: dict, item_id: str = "item_id", text_col: str = "text", share: float = MIN_SHARE) -> DataFrame:
    """(keys..., item_id, n_matched, n_windows): documents with at least ``share`` of an item's windows.

    ``keys`` are named columns of ``docs`` that say which document a row is.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text_col).alias("text"))
    items = stored(_windows(items, [], None, whole_short=True))
    hashes = items.select("hash").distinct()
    few = hashes.limit(FILTER_HASHES + 1).count() <= FILTER_HASHES
    wanted = np.sort(hashes.toPandas()["hash"].to_numpy(dtype=np.int64)) if few else None
    if wanted is not None and not len(wanted):
        wanted = np.array([np.iinfo(np.int64).min], dtype=np.int64)
    texts = docs.select(*[c.alias(k) for k, c in keys.items()], F.col(text_col).alias("text"))
    # At most eight sizes, those that items have.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    found = _windows(texts, sizes, wanted, whole_short=False)
    found = found.select(*keys, "hash", F.col("pos").alias("d_pos"), F.col("slots").alias("d_slots"))
    side = F.broadcast(items) if few else items
    # Read twice below: stored, so that texts are gone through once.
    met = stored(found.join(side, "hash").withColumn("shift", F.col("d_pos") - F.col("pos")))
    ids = [*keys, "item_id"]
    bad = _conflicts(met, ids)
    sound = met.join(bad, _same(met, bad, [*ids, "shift", "pos"]), "left_anti")
    windows = sound.groupBy(*ids, "pos").agg(F.first("n_windows").alias("n_windows"))
    counted = windows.groupBy(*ids).agg(F.count("*").alias("n_matched"), F.first("n_windows").alias("n_windows"))
    return counted.filter(F.col("n_matched") >= share * F.col("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows)."""
    return leaks(docs, benchmark, {"doc_id": F.col(id_col)})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    keys = {"k_id": F.col(id_col), "k_hash": F.xxhash64(F.col(f"`{text_col}`"))}
    bad = leaks(docs, benchmark, keys, text_col=text_col).select(*keys).distinct()
    same = keys["k_id"].eqNullSafe(bad["k_id"]) & (keys["k_hash"] == bad["k_hash"])
    return docs.join(bad, same, "left_anti")
