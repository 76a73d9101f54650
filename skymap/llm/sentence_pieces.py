"""Encoding and decoding with a sentencepiece BPE model, every piece with its span of source bytes.

1. Normalisation. The model's compiled character map, a double array, is unrolled once into its
   keys; a text is rewritten by the longest key at each place. While it is rewritten, every source
   byte gets the number of normalised bytes it stands for (a blank three, a byte inside a
   replaced key none): the alignment, from which any normalised offset goes back to the source.
2. Pieces. The library finds the pieces of the normalised text, its own normaliser switched off. No
   piece of a model that splits at white space has a blank mark after another symbol, so merges
   never cross the borders before blank marks, and long texts are handed over in parts cut there.
3. Spans. Running sums of the pieces' normalised lengths, taken through the alignment, give each
   piece's source bytes. Of the byte pieces of one symbol the last carries its span, those before
   are empty and stand at its start, as the library reports them.

Decoding joins the pieces' surfaces. Texts are independent, so there is no shuffle; each row's text
is gone through once and its pieces are kept packed, four bytes each.

Cases: a null text is empty; an empty text has the begin and end ids only and decodes to an empty
text. Repeated rows get equal results, one each; a null doc_id is a value like any other; an empty
table gives an empty table. A text may be as long as a row can be: memory grows with one row's
text, time with its length (a part without a blank takes a logarithm more). Other columns are
carried along; those named like results are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code

MODEL = "piece_bpe_32k.model"
MARK = "▁"
REPLACEMENT = "�"
# Symbols of a part that is encoded at a time, and bytes of text in one batch of results.
PART = 1 << 16
BATCH_BYTES = 2 << 20
# Field numbers and kinds of the published model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BPE = 3, 2
AS_SUFFIX, UNK_SURFACE, BYTE_FALLBACK, BOS_ID, EOS_ID = 24, 44, 35, 41, 42
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message; lengths give bytes, fixed values floats."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            at, out, shift = at + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield tag >> 3, value


def charsmap_keys(blob: bytes) -> dict[str, str]:
    """The replacements of a compiled character map: source string to normalised string."""
    if not blob:
        return {}
    (size,) = struct.unpack("<I", blob[:4])
    units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
    strings = blob[4 + size :]

    def below(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    out: dict[str, str] = {}
    todo = [(below(units[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or units[at] & 0x800000FF != c:
                continue
            unit, key = units[at], prefix + bytes([c])
            child = at ^ below(unit)
            if unit & 0x100:
                start = units[child] & 0x7FFFFFFF
                out[key.decode()] = strings[start : strings.index(b"\0", start)].decode()
            todo.append((child, key))
    return out


class Model:
    """A parsed BPE model: normaliser with alignment, encoder, decoder."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        trainer, normalizer = b"", b""
        for number, value in _fields(data):
            if number == PIECES:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.kinds.append(own.get(3, NORMAL))
            elif number == TRAINER:
                trainer = value
            elif number == NORMALIZER:
                normalizer = value
        made, rules = dict(_fields(trainer)), dict(_fields(normalizer))
        if self.pieces and made.get(MODEL_TYPE, 1) != BPE:
            raise ValueError("not a BPE model")
        self.bos, self.eos = made.get(BOS_ID, 1), made.get(EOS_ID, 2)
        self.suffix = bool(made.get(AS_SUFFIX, 0))
        self.dummy = bool(rules.get(DUMMY_PREFIX, 1))
        self.remove_extra = bool(rules.get(REMOVE_EXTRA, 1))
        self.space = MARK if rules.get(ESCAPE, 1) else " "
        self.keys = charsmap_keys(rules.get(CHARSMAP, b""))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.bytes = None
        if made.get(BYTE_FALLBACK, 0):
            at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
            self.bytes = [at[f"<0x{b:02X}>"] for b in range(256)]
        self.user = sorted((p for p, k in zip(self.pieces, self.kinds) if k == USER_DEFINED), key=len, reverse=True)
        self.model = data
        self.library = None
        self._prepare(made.get(UNK_SURFACE, " ⁇ ".encode()))

    def _prepare(self, unk_surface: bytes) -> None:
        for own in self.user:
            self.keys[own] = own
        self.longest = max(map(len, self.keys), default=0)
        firsts = sorted({k[0] for k in self.keys})
        found = ["[" + "".join(map(re.escape, firsts)) + "]"] if firsts else []
        if self.remove_extra:
            found += ["^ ", "  ", f"[ {MARK}]\\Z"]
        # A text without a match is copied as it is.
        self.special = re.compile("|".join(found)) if found else None
        crossing = re.compile(f"[^{MARK}]{MARK}")
        split = not any(crossing.search(p) for p in self.ids) and not self.suffix
        self.border = re.compile(f"(?<=[^{MARK}]){MARK}") if split else None
        surfaces = {CONTROL: lambda p: b"", UNKNOWN: lambda p: unk_surface, BYTE: lambda p: bytes([int(p[3:5], 16)])}
        plain = lambda p: p.replace(MARK, " ").encode()
        self.surfaces = [surfaces.get(k, plain)(p) for p, k in zip(self.pieces, self.kinds)]
        self.silent = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.value = np.array([int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(self.pieces, self.kinds)])
        self.size = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds)])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source offset of each of its bytes and of its end)."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        if not len(data):
            return "", np.zeros(1, np.int64)
        wide = len(self.space.encode())
        if self.special is not None and self.special.search(text):
            return self._rewritten(text, wide)
        out, sizes = text, None
        if self.space != " ":
            out = text.replace(" ", self.space)
            sizes = np.where(data == 0x20, wide, 1)
        origin = np.arange(len(data)) if sizes is None else np.repeat(np.arange(len(data)), sizes)
        end = np.full(1, len(data))
        if self.dummy and self.suffix:
            return out + self.space, np.concatenate((origin, np.repeat(end, wide), end))
        if self.dummy:
            return self.space + out, np.concatenate((np.zeros(wide, np.int64), origin, end))
        return out, np.concatenate((origin, end))

    def _longest(self, text: str, at: int) -> tuple[str, int]:
        """(normalised form of the longest key at this place, its length); else the symbol itself."""
        for size in range(min(self.longest, len(text) - at), 0, -1):
            found = self.keys.get(text[at : at + size])
            if found is not None:
                return found, size
        return text[at], 1

    def _rewritten(self, text: str, wide: int) -> tuple[str, np.ndarray]:
        """As normalise, place by place."""
        parts: list[str] = []
        origins: list[int] = []
        at = done = 0
        if self.remove_extra:
            while at < len(text):
                form, size = self._longest(text, at)
                if form != " ":
                    break
                done += len(text[at : at + size].encode())
                at += size
            if at == len(text):
                return "", np.zeros(1, np.int64)

        def add(c: str) -> None:
            parts.append(c)
            origins.extend([done] * len(c.encode()))

        if self.dummy and not self.suffix:
            add(self.space)
        after_space = self.remove_extra
        while at < len(text):
            form, size = self._longest(text, at)
            if after_space:
                form = form.lstrip(" ")
            for c in form:
                add(self.space if c == " " else c)
            if form:
                after_space = form.endswith(" ")
            done += len(text[at : at + size].encode())
            at += size
            after_space = after_space and self.remove_extra
        while self.remove_extra and parts and parts[-1] == self.space:
            parts.pop()
            done = origins[-wide]
            del origins[-wide:]
        if self.dummy and self.suffix:
            add(self.space)
        return "".join(parts), np.array([*origins, done], dtype=np.int64)

    def _parts(self, normal: str) -> list[str]:
        """The text cut at borders that no piece crosses, at least PART symbols apart."""
        out, done = [], 0
        while self.border is not None and len(normal) - done > PART:
            cut = self.border.search(normal, done + PART)
            if cut is None:
                break
            out.append(normal[done : cut.start()])
            done = cut.start()
        return [*out, normal[done:]]

    def _pieces(self, normal: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, normalised bytes of each) of a normalised text."""
        if self.library is None:
            import sentencepiece

            # A later message is merged into an earlier one: this one switches the normaliser off.
            off = bytes([CHARSMAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0, ESCAPE << 3, 0])
            model = self.model + bytes([NORMALIZER << 3 | 2, len(off)]) + off
            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.bytes is None:
            found = [p for part in self._parts(normal) for p in self.library.encode(part, return_type="proto").pieces]
            return np.array([p.id for p in found], "<u4"), np.array([p.end - p.begin for p in found], np.int64)
        ids = np.concatenate([np.array(self.library.encode(part), "<u4") for part in self._parts(normal)])
        return ids, self.size[ids]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends): pieces of a text and the source bytes of each, without begin and end."""
        normal, origin = self.normalise(text)
        ids, sizes = self._pieces(normal)
        after = np.cumsum(sizes)
        first, last = after - sizes, after.copy()
        value = self.value[ids]
        if (value >= 0).any():
            # All byte pieces of a symbol start with it; but for the last they end there, too.
            inner = (value >= 0x80) & (value < 0xC0)
            lead = np.maximum.accumulate(np.where(inner, 0, np.arange(len(ids))))
            first = first[lead]
            follows = np.append(inner[1:], False)
            last[(value >= 0) & follows] = first[(value >= 0) & follows]
        return ids, origin[first].astype("<u4"), origin[last].astype("<u4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; begin, end and other control ids are silent."""
        table = self.surfaces
        spoken = [i for i in ids if i not in self.silent]
        skip = 0
        if self.dummy or self.remove_extra:
            # Blanks of the first piece go: one if blanks are kept, else all up to the first symbol.
            for i in spoken:
                if self.kinds[i] in (BYTE, UNKNOWN) or not self.pieces[i].startswith(MARK):
                    break
                skip += 1
                if not self.remove_extra or self.pieces[i] != MARK:
                    break
        data = b"".join([table[i] for i in spoken])[skip:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._mended(spoken, skip)

    def _mended(self, ids: list[int], skip: int) -> str:
        """As decode, where byte pieces do not make symbols: each such byte becomes a replacement."""
        out: list[str] = []
        run = b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.surfaces[i]
                continue
            while run:
                for size in range(1, 5):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(REPLACEMENT)
                    size = 1
                run = run[size:]
            if i is not None:
                out.append(self.surfaces[i].decode())
        return "".join(out)[skip:]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


RESULTS = {"n_bytes": "long", "n_tokens": "long", "ids": "binary", "starts": "binary", "ends": "binary"}


def _carried(df: DataFrame, *names: str) -> DataFrame:
    lost = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() not in lost])


Batches = Iterator[pa.RecordBatch]


def _encoding(path: str, names: list[str], bos: bool, eos: bool) -> Callable[[Batches], Batches]:
    """Batches whose last column is the text to batches with the results in its place."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Batches) -> Batches:
        model = load(path)

        def packed(text: str | None) -> tuple[int, int, bytes, bytes, bytes]:
            text = text or ""
            ids, starts, ends = model.encode(text)
            n = len(text.encode())
            head, tail = (1 if bos else 0), (1 if eos else 0)
            around = lambda x, a, b: np.concatenate((np.full(head, a, "<u4"), x, np.full(tail, b, "<u4"))).tobytes()
            return n, len(ids) + head + tail, around(ids, model.bos, model.eos), around(starts, 0, n), around(ends, 0, n)

        for batch in batches:
            texts, others = batch.column(batch.num_columns - 1), batch.columns[:-1]
            done = 0
            while done < batch.num_rows:
                out, size, a = [], 0, done
                while done < batch.num_rows and size < BATCH_BYTES:
                    out.append(packed(texts[done].as_py()))
                    size += out[-1][0]
                    done += 1
                arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                kept = [c.slice(a, done - a) for c in others]
                yield pa.RecordBatch.from_arrays(kept + arrays, names)

    return run


def _decoding(path: str, names: list[str], ids_col: str) -> Callable[[Batches], Batches]:
    """Batches to batches with the decoded text behind."""

    def run(batches: Batches) -> Batches:
        model = load(path)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids_col))
            texts = [model.decode(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return run


def _with_text_last(docs: DataFrame, text_col: str, *lost: str) -> tuple[DataFrame, T.StructType]:
    """(rows with the text as last column, schema with the encoder's results in its place)."""
    text = docs[text_col]
    rows = docs.select(*(docs[c] for c in _carried(docs, *RESULTS, *lost, text_col).columns), text.alias(text_col))
    schema = T.StructType(rows.schema.fields[:-1])
    for name, kind in RESULTS.items():
        schema = schema.add(name, kind)
    return rows, schema


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, bos: bool = True, eos: bool = True) -> DataFrame:
    """The rows with n_bytes, n_tokens and ids, starts, ends: piece ids and the source bytes
    ``[start, end)`` of each piece, packed as little-endian unsigned 32-bit integers. Begin and end
    ids have empty spans. The text itself is not carried along."""
    path = path or model_path()
    ship_code(docs.sparkSession)
    rows, schema = _with_text_last(docs, text_col)
    return rows.mapInArrow(_encoding(path, list(schema.names), bos, eos), schema)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of their ids (packed as ``encode`` packs them; null: empty)."""
    path = path or model_path()
    ship_code(encoded.sparkSession)
    rows = _carried(encoded, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decoding(path, list(schema.names), ids_col), schema)


def encode_decode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """As ``decode(encode(docs))``, both in one pass of one worker."""
    path = path or model_path()
    ship_code(docs.sparkSession)
    rows, schema = _with_text_last(docs, text_col, "decoded")
    first = _encoding(path, list(schema.names), True, True)
    schema = schema.add("decoded", "string")
    second = _decoding(path, list(schema.names), "ids")
    return rows.mapInArrow(lambda batches: second(first(batches)), schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_sha256) of every document."""
    return encode_decode(docs.select("doc_id", "text"), path=path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_bytes",
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )
