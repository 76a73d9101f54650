"""Quality rules by distribution divergence (native DataFrame functions only).

A document's character-class histogram and its histogram over the most common words of a
language are compared with fixed language references by the Jensen-Shannon distance (base 2,
0 = equal, 1 = disjoint). A distance counts only from a minimum length on: short texts have
histograms too coarse to judge. Four base counts guard against empty and repetitive texts.

Nothing is shuffled: each row is judged from its own text, with array functions whose cost is
n log n in the text's length.

Cases: a null or empty text has no words, fails the base rule and is not kept. Repeated rows are
judged each on their own. An empty table gives an empty table. Input columns other than the two
named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymap.llm.common import SPACE, words_of

# The commonest words of four languages, and their shares among all words.
COMMON_WORDS = {
    "de": {
        "der": 0.035, "die": 0.035, "und": 0.030, "in": 0.020, "den": 0.014, "von": 0.012,
        "zu": 0.012, "das": 0.012, "mit": 0.010, "ist": 0.010, "für": 0.008, "im": 0.008,
    },
    "en": {
        "the": 0.062, "of": 0.032, "and": 0.029, "to": 0.026, "a": 0.023, "in": 0.020,
        "is": 0.011, "that": 0.010, "for": 0.010, "was": 0.009, "with": 0.008, "on": 0.008,
    },
    "es": {
        "de": 0.060, "la": 0.040, "que": 0.030, "el": 0.028, "en": 0.026, "y": 0.025,
        "a": 0.020, "los": 0.018, "se": 0.013, "del": 0.012, "las": 0.012, "un": 0.010,
    },
    "fr": {
        "de": 0.050, "la": 0.032, "le": 0.025, "et": 0.024, "les": 0.022, "des": 0.018,
        "en": 0.015, "un": 0.012, "du": 0.012, "une": 0.011, "que": 0.010, "est": 0.010,
    },
}
# Shares of ASCII letters, digits, white space, symbols, all other characters.
CHARACTER_CLASSES = {
    "de": (0.7900, 0.0100, 0.1450, 0.0005, 0.0545),
    "en": (0.7900, 0.0100, 0.1700, 0.0005, 0.0295),
    "es": (0.7700, 0.0100, 0.1650, 0.0005, 0.0545),
    "fr": (0.7600, 0.0100, 0.1650, 0.0005, 0.0645),
}
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_ALL_COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})
# Guards and limits of the two distances.
MIN_CHARS_FOR_CLASSES = 200
MAX_CLASS_DISTANCE = 0.30
MIN_WORDS_FOR_COMMON = 100
MAX_COMMON_DISTANCE = 0.32


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of equal length."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _occurrences(array: str, word: Column) -> Column:
    return F.size(F.filter(array, lambda x: x == word))


def _among(words):
    return lambda w: w.isin(sorted(words))


def _language(array: str) -> Column:
    """Language of whose common words the array holds most; the first by name among equals."""
    found = [
        F.struct(F.size(F.filter(array, _among(COMMON_WORDS[x]))).alias("n"), F.lit(-i).alias("i"))
        for i, x in enumerate(sorted(COMMON_WORDS))
    ]
    return -F.greatest(*found)["i"]


def _of_language(made) -> Column:
    """What ``made`` gives for the words of the document's language."""
    return F.element_at(F.array(*[made(COMMON_WORDS[x]) for x in sorted(COMMON_WORDS)]), F.col("language") + 1)


def _pair_hashes(words: str) -> Column:
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _window_hashes(pairs: str) -> Column:
    """Hashes of all runs of eight words, from the hashes of all runs of two."""
    whole = F.transform(pairs, lambda h, i: F.xxhash64(h, F.get(pairs, i + 2), F.get(pairs, i + 4), F.get(pairs, i + 6)))
    return F.slice(whole, 1, F.size(pairs) - (WINDOW - 1))


# Starts of the windows whose hash stands beside an equal one when sorted.
_STARTS = """array_sort(transform(
    filter(keyed, (x, k) -> x.h = get(keyed, k - 1).h or x.h = get(keyed, k + 1).h), x -> x.i))"""
# Words under those windows, each once.
_COVERED = f"""aggregate(starts, named_struct('last', -{WINDOW}, 'sum', 0L),
    (a, i) -> named_struct('last', i, 'sum', a.sum + least({WINDOW}, i - a.last)), a -> a.sum)"""


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: the base counts, both distances and the verdict; with ``carry`` also
    the whole input row, as a struct ``row``.

    ``class_distance`` is the smallest over the languages; ``common_distance`` is that to the
    language of whose common words the document holds most.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    base = base.withColumn("words", words_of(F.col("text")))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    n = F.col("n_words").cast("int")
    base = base.withColumns({
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long"),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "pairs": F.when(n >= WINDOW, _pair_hashes("words")),
        "common": F.filter("words", lambda w: w.isin(_ALL_COMMON)),
    })
    base = base.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    base = base.withColumn("windows", F.when(F.col("pairs").isNotNull(), _window_hashes("pairs")))
    # Only texts in which a window comes again are sorted.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    keyed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    base = base.withColumn("keyed", F.when(repeated, F.sort_array(keyed)))
    base = base.withColumn("starts", F.when(F.col("keyed").isNotNull(), F.expr(_STARTS)))
    covered = F.when(F.col("starts").isNotNull(), F.expr(_COVERED))
    base = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))

    chars = F.length("text").cast("double")
    base = base.withColumns({
        "letters": F.length(F.regexp_replace("text", "[^A-Za-z]+", "")),
        "digits": F.length(F.regexp_replace("text", "[^0-9]+", "")),
    })
    space = chars - F.col("word_chars")
    rest = F.col("word_chars") - F.col("letters") - F.col("digits") - F.col("n_symbols")
    shares = F.array(*[x / chars for x in (F.col("letters"), F.col("digits"), space, F.col("n_symbols"), rest)])
    base = base.withColumn("shares", F.when(chars > 0, shares))
    class_distance = F.least(*[js_distance(F.col("shares"), _doubles(CHARACTER_CLASSES[x])) for x in sorted(CHARACTER_CLASSES)])
    base = base.withColumn("language", _language("common"))
    tally = F.transform(_of_language(lambda words: F.array(*[F.lit(w) for w in words])), lambda w: _occurrences("common", w))
    base = base.withColumn("tally", tally)
    total = F.aggregate("tally", F.lit(0), lambda s, x: s + x)
    p = F.transform(F.concat("tally", F.array(F.col("n_words").cast("int") - total)), lambda x: x / F.col("n_words"))
    q = _of_language(lambda words: _doubles([*words.values(), 1 - sum(words.values())]))
    common_distance = F.when(F.col("n_words") > 0, js_distance(p, q))
    base = base.withColumns({"class_distance": class_distance, "common_distance": common_distance})

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    odd_classes = (chars >= MIN_CHARS_FOR_CLASSES) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_WORDS_FOR_COMMON) & (F.col("common_distance") > MAX_COMMON_DISTANCE)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce(odd_classes, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False))).alias("kept"),
        "class_distance", "common_distance", *(["row"] if carry else []),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    judged = quality_counts(docs, id_col, text_col, carry=True)
    # The verdict leaves through a one-element generator: a filter on the plain column would be
    # pushed below the whole chain and each of its steps written out again and again.
    once = judged.select("row", F.explode(F.array("kept")).alias("kept"))
    return once.filter("kept").select("row.*")
