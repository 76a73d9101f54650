"""Token counts by a deterministic transducer compiled from a BPE vocabulary.

The transducer reads a pre-token symbol by symbol. Its state is the prefix read so far, reduced to
what the next step needs: for each prefix, the last token of the prefix's own encoding. Byte-pair
encodings grow from the end: the encoding of a prefix is that of a shorter prefix and one more
token, and of all vocabulary entries that end the prefix exactly one stands compatibly after the
shorter prefix's last token (two tokens are compatible when their joined text encodes to just
them). So every transition carries a number, the change of the emitted-token count, and the sum
over a path is the count. Transitions are compiled when first taken and kept up to a bound; a
state thrown away is compiled again, the counts stay the same.

White space of ASCII resets the machine, whatever its state. A chunk of a text is therefore
summed up by its state map: the fragment before its first space, the tokens between, the fragment
after its last space. Maps compose associatively, so texts are cut into chunks of fixed length,
chunks are run in parallel, and a scan over each text's maps closes the fragments at the borders.

Special strings inside a text are one token each, as the library has it by default.

Cases: a null or empty text has 0 bytes and 0 tokens. Repeated rows get equal results, one each.
A null doc_id is a value like any other. An empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 1 << 16
# Kept states, and counted words of at most LONG bytes, of one Python worker.
MAX_STATES = 1_500_000
MAX_WORDS = 600_000
LONG = 64
END = "\x00"
NEVER = 1 << 60
# The pre-token pattern of the vocabulary file.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    symbol = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [symbol[b] for b in range(256)]


class Transducer:
    """Counts the tokens of pre-tokens; symbols are characters, the word's end is ``END``."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        suffix = model["end_of_word_suffix"]
        plain = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        special = set(self.special)
        self.vocabulary = {plain(t) for t in model["vocab"] if t not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for (a, b), i in self.rank.items():
            if a + b not in self.made:
                self.parts[a + b], self.made[a + b] = (a, b), i
        self.spines: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        self.longest = max(map(len, self.vocabulary))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.pre_tokens = regex.compile(PRE_TOKENS).findall
        self.symbols = byte_symbols()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        # Per state: the length of the last token and the tokens of the prefix; state 0 is empty.
        self.next: dict[tuple[int, str], int] = {}
        self.last: list[int] = [0]
        self.count: list[int] = [0]

    def spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """(symbol, rank of its making, rank of its end) of what stands at one end of ``token``
        while it is put together; ``side`` 0 is the left end, 1 the right."""
        known = self.spines.get((token, side))
        if known is None:
            known, end, symbol = [], NEVER, token
            while True:
                made = self.made.get(symbol, -1)
                known.append((symbol, made, end))
                if made < 0:
                    break
                end, symbol = made, self.parts[symbol][side]
            self.spines[token, side] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether the joined text of two tokens encodes to these two.

        It does unless two symbols that stand at the border at the same time merge before either
        of them is used up on its own side; of equal ranks the pair further left goes first.
        """
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            known = not any(
                self.rank.get((a, b), NEVER) < a_end and self.rank.get((a, b), NEVER) <= b_end and max(a_made, b_made) < min(a_end, b_end)
                for a, a_made, a_end in self.spine(left, 1)
                for b, b_made, b_end in self.spine(right, 0)
            )
            if len(self.compatible) > MAX_STATES:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def _step(self, text: str, end: int, lasts: list[int], counts: list[int], shortest: int) -> tuple[int, int]:
        """Last token's length and count of text[:end], from those of the shorter prefixes."""
        for size in range(min(end, self.longest), shortest - 1, -1):
            token = text[end - size : end]
            if token in self.vocabulary:
                before = end - size
                if not before or self.fits(text[before - lasts[before] : before], token):
                    return size, counts[before] + 1
        # A symbol the vocabulary lacks stands alone and counts nothing.
        return 1, counts[end - 1]

    def tokens(self, word: str) -> int:
        """Number of tokens of one pre-token, in byte symbols."""
        if len(self.last) > MAX_STATES:
            self.clear()
        state, lasts, counts = 0, [0], [0]
        kept = len(word) <= LONG
        for i in range(1, len(word)):
            to = self.next.get((state, word[i - 1])) if kept else None
            if to is None:
                size, count = self._step(word, i, lasts, counts, 1)
                if kept:
                    to = len(self.last)
                    self.next[state, word[i - 1]] = to
                    self.last.append(size)
                    self.count.append(count)
            else:
                size, count = self.last[to], self.count[to]
            lasts.append(size)
            counts.append(count)
            state = to
        # The last symbol and the end of the word are one.
        whole = word + END
        lasts.append(0)
        counts.append(0)
        return self._step(whole, len(whole), lasts, counts, 2)[1]

    def word(self, raw: bytes) -> int:
        """Number of tokens of text without ASCII white space."""
        total = 0
        for i, piece in enumerate(self.split_special(raw.decode("utf-8", "surrogatepass"))):
            if i % 2:
                total += 1
                continue
            # One character at a time, as the library does: no final form of sigma.
            plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            for pre in self.pre_tokens(plain):
                total += self.tokens("".join(map(self.symbols.__getitem__, pre.encode("utf-8", "surrogatepass"))))
        return total


class Counts(dict):
    """word -> tokens; long words are counted anew each time."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, raw: bytes) -> int:
        n = self.transducer.word(raw)
        if len(raw) <= LONG:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[raw] = n
        return n


@lru_cache(maxsize=2)
def compiled(path: str) -> Counts:
    """The transducer and its counted words, once a worker."""
    return Counts(Transducer(path))


SPACES = b" \t\n\x0b\x0c\r"


def state_map(chunk: bytes, counts: Counts) -> tuple[bytes, int, bytes | None]:
    """(fragment before the first space, tokens between, fragment after the last space); without
    any space the third is None and the first is the chunk."""
    words = chunk.split()
    if len(words) < 2 and not any(c in SPACES for c in (chunk[:1] + chunk[-1:])):
        if not words or len(words[0]) == len(chunk):
            return chunk, 0, None
    head = words.pop(0) if words and chunk[0] not in SPACES else b""
    tail = words.pop() if words and chunk[-1] not in SPACES else b""
    return head, sum(map(counts.__getitem__, words)), tail


def compose(a: tuple, b: tuple, counts: Counts) -> tuple[bytes, int, bytes | None]:
    """The state map of two chunks one after the other."""
    if a[2] is None and b[2] is None:
        return a[0] + b[0], 0, None
    if a[2] is None:
        return a[0] + b[0], b[1], b[2]
    if b[2] is None:
        return a[0], a[1], a[2] + b[0]
    joined = a[2] + b[0]
    return a[0], a[1] + b[1] + (counts[joined] if joined else 0), b[2]


def closed(m: tuple, counts: Counts) -> int:
    return m[1] + sum(counts[x] for x in (m[0], m[2]) if x)


_MAP = T.StructType([
    T.StructField("head", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("tail", T.BinaryType()),
])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of ``docs``."""
    ship_code(docs.sparkSession)
    path = path or vocabulary_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    pieces = F.when(F.length("text") <= chunk, F.array("text")).otherwise(
        F.transform(F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int")), lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)))
    )
    pieces = slim.select("doc_id", "th", "n_bytes", F.posexplode(pieces).alias("no", "piece"))
    kind = slim.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = compiled(path)
        for batch in batches:
            maps = [state_map(x.as_py().encode("utf-8", "surrogatepass"), counts) for x in batch.column(4)]
            made = [pa.array(c, t) for c, t in zip(zip(*maps), (pa.binary(), pa.int64(), pa.binary()))] if maps else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], ["doc_id", "th", "n_bytes", "no", "head", "n", "tail"])

    fields = [T.StructField("doc_id", kind), T.StructField("th", T.LongType()), T.StructField("n_bytes", T.LongType())]
    maps = pieces.mapInArrow(run, T.StructType([*fields, T.StructField("no", T.IntegerType()), *_MAP.fields]))
    # Rows equal in id and text share their maps and come back as often as they were.
    per_doc = maps.groupBy("doc_id", "th", "n_bytes").agg(
        F.array_sort(F.collect_set(F.struct("no", "head", "n", "tail"))).alias("maps"), F.count_if(F.col("no") == 0).alias("copies")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = compiled(path)
        for batch in batches:
            totals = []
            for row in batch.column(2):
                parts = [(m["head"], m["n"], m["tail"]) for m in row.as_py()]
                while len(parts) > 1:
                    parts = [compose(*parts[i : i + 2], counts) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
                totals.append(closed(parts[0], counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.int64()), batch.column(3)], ["doc_id", "n_bytes", "n_tokens", "copies"])

    scanned = per_doc.select("doc_id", "n_bytes", "maps", "copies").mapInArrow(
        scan, T.StructType([fields[0], fields[2], T.StructField("n_tokens", T.LongType()), T.StructField("copies", T.LongType())])
    )
    each = scanned.select("doc_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
