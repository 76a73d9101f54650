"""Removal of byte strings that come twice, by difference-cover names of suffixes.

Only prefixes of 400 bytes matter, so the recursion stops there and needs no dense ranks: a name
is a 64-bit fingerprint, and equal names stand side by side when sorted.

1. Sort sampled triples. Suffixes at offsets in a difference cover of period 181 (16 residues,
   one offset in eleven) are named by triples: words of 8 bytes, triples of words (24 bytes),
   triples of those (72), triples of those (216). For any two equal strings of 400 bytes some
   shift below 181 brings both to sampled offsets, where their 216-byte names agree.
2. Recurse on names. Sampled names that come once cannot take part; what starts less than 181
   bytes before a repeated one is a remaining suffix and is named to depth 400, by its names at 0
   and 184, with 32 bits of an independent polynomial fingerprint beside.
3. Merge and compare adjacent prefixes. The remaining names are sorted by bucket; neighbours with
   equal names are equal strings. Every byte under such a string is removed.

Rounds run as in ``packed``: copies lie in the same chunk and send their names once.

Cases: a null text is empty, and an empty text or one under 400 bytes loses nothing. Strings never
cross documents. Repeated rows lose everything they share when they have 400 bytes or more. A null
doc_id is a value like any other. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skymap.llm.common import stored
from skymap.llm.packed import BUCKETS, Chunk, answer, pack, partitions, send, spread_answers, with_answers

LENGTH = 400
NAME = 216
# Positions named at a time: few enough that all levels of their names stay in a core's cache.
SLICE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


def difference_cover(r: int = 2) -> tuple[int, np.ndarray]:
    """(period, residues): the published cover of 6 r + 4 residues for 24 r^2 + 36 r + 13."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate(([0], np.cumsum(steps)))


PERIOD, COVER = difference_cover()
assert NAME + PERIOD - 1 <= LENGTH and 2 * NAME >= LENGTH
_SAMPLED = np.zeros(PERIOD, dtype=bool)
_SAMPLED[COVER] = True


def _joined(*names: np.ndarray) -> np.ndarray:
    """One name for a tuple of names, position by position."""
    h = np.full(len(names[0]), 0x243F6A8885A308D3, dtype=np.uint64)
    for x, odd in zip(names, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)):
        h ^= x
        h *= np.uint64(odd)
        h ^= h >> np.uint64(31)
    return h


def names_of(data: bytes) -> np.ndarray:
    """Names of the 216 bytes at every position of ``data`` that has so many."""
    if len(data) < NAME:
        return np.zeros(0, dtype=np.uint64)
    level = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    size = 8
    while size < NAME:
        n = len(level) - 2 * size
        level = _joined(level[:n], level[size : size + n], level[2 * size : 2 * size + n])
        size *= 3
    return level


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a value for each byte."""
    inverse = pow(_BASE, -1, 1 << 64)
    n = SLICE + 2 * LENGTH
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    values = _joined(np.arange(256, dtype=np.uint64))
    return np.cumprod(up), np.cumprod(down), values


def _polynomial(data: bytes, at: np.ndarray) -> np.ndarray:
    """Upper half of the polynomial fingerprint of the 400 bytes at each of ``at``."""
    up, down, values = _powers()
    sums = values[np.frombuffer(data, dtype=np.uint8)]
    sums *= up[: len(sums)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sums)))
    return (((sums[at + LENGTH] - sums[at]) * down[at]) >> np.uint64(32)).astype(np.uint32)


class Slices:
    """A chunk's positions in slices: (first, text of the slice and what follows, offset within the
    document, bytes left in the document)."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk

    def __iter__(self) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        c = self.chunk
        total = len(c.data)
        ends, starts = c.ends[c.lengths > 0], c.starts[c.lengths > 0]
        for a in range(0, total, SLICE):
            b = min(total, a + SLICE)
            p = np.arange(a, b)
            doc = np.searchsorted(ends, p, side="right")
            yield a, c.data[a : b + LENGTH], p - starts[doc], ends[doc] - p


def _samples(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the sampled suffixes with 216 bytes or more."""
    at, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, data, offset, left in Slices(chunk):
        own = np.flatnonzero(_SAMPLED[offset % PERIOD] & (left >= NAME))
        at.append(own + a)
        names.append(names_of(data)[own])
    return np.concatenate(at), np.concatenate(names) & ~np.uint64(1)


def _sampled_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    _, names = _samples(Chunk(row))
    keys, counts = np.unique(names, return_counts=True)
    return keys, keys | (counts > 1).astype(np.uint64)


def _repeated_names(bodies: list[bytes]) -> list[bytes]:
    """Of one bucket's names, the lowest bit says "more than once here": which come again."""
    found = np.frombuffer(b"".join(bodies), dtype=np.uint64)
    order = np.argsort(found, kind="stable")
    names, more = found[order] >> np.uint64(1), (found[order] & np.uint64(1)).astype(bool)
    return _adjacent(bodies, 8, order, names[1:] == names[:-1], more)


def _adjacent(bodies: list[bytes], width: int, order: np.ndarray, equal: np.ndarray, more: np.ndarray) -> list[bytes]:
    """Per body a bit for each entry: an equal neighbour in the sorted order, or ``more``."""
    again = more.copy()
    again[1:] |= equal
    again[:-1] |= equal
    out = np.zeros(len(order), dtype=bool)
    out[order] = again
    cuts = np.cumsum([len(b) // width for b in bodies])[:-1]
    return [np.packbits(part).tobytes() for part in np.split(out, cuts)]


_DEEP = np.dtype([("k", "<u8"), ("c", "<u4")])


def _emptied(parts: list[np.ndarray]) -> np.ndarray:
    """The parts end to end; they are freed as they are copied."""
    out = np.empty(sum(map(len, parts)), dtype=parts[-1].dtype)
    at = len(out)
    while parts:
        part = parts.pop()
        out[at - len(part) : at] = part
        at -= len(part)
    return out


def _grouped(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the names, where each different one begins in it)."""
    order = np.argsort(names, kind="stable").astype(np.uint32 if len(names) < 1 << 32 else np.int64)
    found = names[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = found[1:] != found[:-1]
    return order, np.flatnonzero(first)


def _remaining(row: dict, n_buckets: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, positions, names, other fingerprints) of what may start a repeated string."""
    chunk = Chunk(row)
    at, names = _samples(chunk)
    keys, of = np.unique(names, return_inverse=True)
    again = spread_answers(keys, row["answers"], n_buckets, "u1", bits=True)[of].astype(bool)
    hits = at[again]
    places, deep, other = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for a, data, offset, left in Slices(chunk):
        n = len(offset)
        # Starts less than a period before a repeated sampled suffix of the same document.
        near = hits[(hits >= a) & (hits < a + n + PERIOD)] - a
        edges = np.bincount(np.maximum(near - (PERIOD - 1), 0), minlength=n + 1)[: n + 1].astype(np.int64)
        edges -= np.bincount(np.minimum(near + 1, n), minlength=n + 1)
        own = np.flatnonzero((np.cumsum(edges)[:n] > 0) & (left >= LENGTH))
        if not len(own):
            continue
        level = names_of(data)
        places.append((own + a).astype(np.uint32 if len(chunk.data) < 1 << 32 else np.int64))
        deep.append(_joined(level[own], level[own + LENGTH - NAME]))
        del level
        other.append(_polynomial(data, own))
    return chunk, _emptied(places), _emptied(deep), _emptied(other)


def _remaining_keys(n_buckets: int):
    def keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
        deep, other = _remaining(row, n_buckets)[2:]
        order, begins = _grouped(deep)
        first, counts = order[begins], np.diff(begins, append=len(deep))
        del order
        names = deep[first]
        records = np.zeros(len(names), dtype=_DEEP)
        records["k"] = names
        records["c"] = other[first] & ~np.uint32(1) | (counts > 1).astype(np.uint32)
        return names, records

    return keys


def _equal_prefixes(bodies: list[bytes]) -> list[bytes]:
    found = np.frombuffer(b"".join(bodies), dtype=_DEEP)
    order = np.lexsort((found["c"], found["k"]))
    k, c = found["k"][order], found["c"][order]
    equal = (k[1:] == k[:-1]) & (c[1:] >> np.uint32(1) == c[:-1] >> np.uint32(1))
    return _adjacent(bodies, _DEEP.itemsize, order, equal, (c & np.uint32(1)).astype(bool))


def _removed(row: dict, n_buckets: int) -> tuple[Chunk, np.ndarray]:
    """(chunk, which bytes go)."""
    chunk, places, deep, _ = _remaining(row, n_buckets)
    order, begins = _grouped(deep)
    names = deep[order[begins]]
    del deep
    again = spread_answers(names, row["deep_answers"], n_buckets, "u1", bits=True).astype(bool)
    starts = places[order[np.repeat(again, np.diff(begins, append=len(order)))]]
    del places, order, names
    # Starts differ from each other, and so do ends.
    edges = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    edges[starts] += 1
    starts += LENGTH
    edges[starts] -= 1
    return chunk, np.cumsum(edges[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row per row of ``docs``;
    with ``texts`` also the remaining bytes."""
    n = partitions(docs)
    n_buckets = BUCKETS * n
    chunks = pack(docs, id_col, text_col)
    first = stored(answer(send(chunks, _sampled_keys, n_buckets), n, _repeated_names))
    met = with_answers(chunks.repartition(n, "chunk"), first)
    deep = answer(send(met, _remaining_keys(n_buckets), n_buckets), n, _equal_prefixes)
    both = met.join(deep.withColumnRenamed("answers", "deep_answers"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, gone = _removed(row, n_buckets)
                begun = np.diff(gone.astype(np.int8), prepend=0) > 0
                data = np.frombuffer(chunk.data, dtype=np.uint8)
                out = []
                for i, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist())):
                    own = gone[a:b]
                    # A run that goes on from the document before begins anew here.
                    spans = int(begun[a:b].sum()) + bool(a < b and own[0] and not begun[a])
                    kept = data[a:b][~own].tobytes()
                    out.append((chunk.id(i), b - a, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                columns = list(zip(*out)) if out else [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + texts], names[: 5 + texts])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return both.mapInArrow(run, schema)
