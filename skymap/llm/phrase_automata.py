"""Removal of phrases that an earlier document has, located by sharded Aho-Corasick automata.

A phrase is a window of 50 consecutive words; it leaves a document when its words also start in a
document with a smaller doc_id.

1. Find. Every window has an anchor, the smallest hash of the 16-word runs in it; equal windows
   have equal anchors, and about one run in eighteen is one. Anchors found in one document only
   cannot lie in a recurring passage.
2. Confirm. Windows whose anchor recurs are met by 96-bit names, and the smallest doc_id of each is
   sent back to its chunks. Windows of a document that begin in an earlier one are confirmed.
3. Locate. For each chunk of documents an automaton is compiled of the confirmed passages that
   occur there: from every run of confirmed windows those 50 words apart and the last one, which
   together cover the run's words. All texts of the chunk are streamed through it, and every
   occurrence in a document later than the phrase's first is marked.

Rounds run as in ``packed``: shards are chunks of documents, a chunk sends an anchor or a window
once, however often it holds it, so automata stay small (their phrases are part of a chunk's own
text) and a passage in a third of all documents costs one entry per chunk.

Cases: a null text has no words. Of rows with equal doc_id none is earlier. A null doc_id comes
after all others. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skymap.llm.common import stored
from skymap.llm.packed import BUCKETS, Chunk, answer, pack, partitions, send, spread_answers, with_answers

WINDOW = 50
RUN = 16
LATE = np.iinfo(np.int64).max
_WINDOW = np.dtype([("k", "<u8"), ("c", "<u4"), ("d", "<i8")])


def _joined(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """One name for two names side by side."""
    h = (a ^ np.uint64(0x243F6A8885A308D3 + seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = ((h ^ (h >> np.uint64(31))) + b) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, 50)
        self[word] = h
        return h


class Phrases:
    """The words of a chunk's documents and the names of their windows."""

    def __init__(self, row: dict):
        self.chunk = Chunk(row)
        hashes = _Hashes()
        self.words: list[list[bytes]] = [text.split() for _, text in self.chunk.texts()]
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        n = int(self.ends[-1]) if len(self.ends) else 0
        flat = np.fromiter((hashes[w] for own in self.words for w in own), dtype=np.uint64, count=n)
        del hashes
        self.starts = np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        self.flat = flat
        if n < WINDOW:
            return
        # Names of the runs of 2, 4, 8 and 16 words at every place.
        runs = flat
        for size in (1, 2, 4, 8):
            runs = _joined(runs[:-size], runs[size:])
        # The smallest in reach of a window: 35 runs start in it.
        low = runs
        for size in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-size], low[size:])
        rest = WINDOW - RUN + 1 - 32
        low = np.minimum(low[: len(low) - rest], low[rest:])
        doc = np.searchsorted(self.ends, np.arange(len(low)), side="right")
        good = np.flatnonzero(np.arange(len(low)) + WINDOW <= self.ends[doc])
        self.starts, self.docs = good, doc[good]
        # The lowest bit is kept free for "more than one document here".
        self.anchor = low[good] & ~np.uint64(1)

    def ids(self) -> np.ndarray:
        return np.where(self.chunk.missing, LATE, self.chunk.ids)

    def window_names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of the windows that start at ``at``."""
        out = []
        for seed in (0, 1):
            names, parts, at_part = self.flat, [], at + 0
            size = 1
            while size <= WINDOW:
                if WINDOW & size:
                    parts.append(names[at_part])
                    at_part = at_part + size
                if 2 * size <= WINDOW:
                    names = np.concatenate((_joined(names[:-size], names[size:], seed), np.zeros(size, np.uint64)))
                size *= 2
            whole = parts[0]
            for p in parts[1:]:
                whole = _joined(whole, p, seed)
            out.append(whole)
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def _first_ids(of: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of each of ``n`` groups."""
    least, most = np.full(n, LATE), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, of, ids)
    np.maximum.at(most, of, ids)
    return least, most


def _anchor_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
    phrases = Phrases(row)
    keys, of = np.unique(phrases.anchor, return_inverse=True)
    least, most = _first_ids(of, phrases.ids()[phrases.docs], len(keys))
    return keys, keys | (least != most).astype(np.uint64)


def _recurring(bodies: list[bytes]) -> list[bytes]:
    """Of one bucket's anchors: which are in more than one chunk or document."""
    found = np.frombuffer(b"".join(bodies), dtype=np.uint64)
    _, of, counts = np.unique(found >> np.uint64(1), return_inverse=True, return_counts=True)
    more = np.zeros(len(counts), dtype=bool)
    more[of[(found & np.uint64(1)).astype(bool)]] = True
    again = ((counts > 1) | more)[of]
    cuts = np.cumsum([len(b) // 8 for b in bodies])[:-1]
    return [np.packbits(part).tobytes() for part in np.split(again, cuts)]


def _candidates(row: dict, n_buckets: int) -> tuple[Phrases, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrases, places in the list of windows, names, other names, documents) with a recurring anchor."""
    phrases = Phrases(row)
    keys, of = np.unique(phrases.anchor, return_inverse=True)
    again = spread_answers(keys, row["answers"], n_buckets, "u1", bits=True)[of].astype(bool)
    own = np.flatnonzero(again)
    names, other = phrases.window_names(phrases.starts[own]) if len(own) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    return phrases, own, names, other, phrases.docs[own]


def _window_keys(n_buckets: int):
    def keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
        phrases, _, names, other, docs = _candidates(row, n_buckets)
        found, first, of = np.unique(names, return_index=True, return_inverse=True)
        records = np.zeros(len(found), dtype=_WINDOW)
        records["k"], records["c"] = found, other[first]
        records["d"] = _first_ids(of, phrases.ids()[docs], len(found))[0]
        return found, records

    return keys


def _first_documents(bodies: list[bytes]) -> list[bytes]:
    """Of one bucket's windows: the smallest document of each."""
    found = np.frombuffer(b"".join(bodies), dtype=_WINDOW)
    order = np.lexsort((found["d"], found["c"], found["k"]))
    k, c = found["k"][order], found["c"][order]
    begins = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))[: len(order)]
    out = np.zeros(len(order), dtype="<i8")
    out[order] = found["d"][order][np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    cuts = np.cumsum([len(b) // _WINDOW.itemsize for b in bodies])[:-1]
    return [part.tobytes() for part in np.split(out, cuts)]


def _automaton(phrases: Phrases, starts: np.ndarray, docs: np.ndarray, first: np.ndarray):
    """Of windows that together cover all confirmed ones; values are the first documents."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    begins = np.flatnonzero(np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (docs[1:] != docs[:-1]))))
    ends = np.concatenate((begins[1:], [len(starts)]))
    word0 = phrases.ends - phrases.counts
    for a, b in zip(begins.tolist(), ends.tolist()):
        for i in dict.fromkeys([*range(a, b, WINDOW), b - 1]):
            d = int(docs[i])
            at = int(starts[i] - word0[d])
            text = b" " + b" ".join(phrases.words[d][at : at + WINDOW]) + b" "
            machine.add_word(text.decode("latin-1"), (len(text), int(first[i])))
    if len(machine):
        machine.make_automaton()
    return machine


def _cleaned(row: dict, n_buckets: int) -> Iterator[tuple[int | None, int, int, bytes]]:
    """(doc_id, words, removed words, kept words) of a chunk's documents."""
    phrases, own, names, _, docs = _candidates(row, n_buckets)
    found, of = np.unique(names, return_inverse=True)
    first = spread_answers(found, row["first_answers"], n_buckets, "<i8")[of]
    ids = phrases.ids()
    sure = first < ids[docs]
    machine = _automaton(phrases, phrases.starts[own[sure]], docs[sure], first[sure]) if sure.any() else None
    for d, words in enumerate(phrases.words):
        kept = words
        if machine is not None and len(words) >= WINDOW:
            line = b" " + b" ".join(words) + b" "
            hits = [(end, n) for end, (n, f) in machine.iter(line.decode("latin-1")) if f < ids[d]]
            if hits:
                ends = np.cumsum([len(w) + 1 for w in words])
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                # A match ends on the space after its last word.
                last = np.searchsorted(ends, np.array([e for e, _ in hits]))
                gone += np.bincount(last - (WINDOW - 1), minlength=len(gone))
                gone -= np.bincount(last + 1, minlength=len(gone))
                gone = np.cumsum(gone[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
        yield phrases.chunk.id(d), len(words), len(words) - len(kept), b" ".join(kept)


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): one row per row of ``docs``."""
    n = partitions(docs)
    n_buckets = BUCKETS * n
    chunks = pack(docs, id_col, text_col)
    anchors = stored(answer(send(chunks, _anchor_keys, n_buckets), n, _recurring))
    met = with_answers(chunks.repartition(n, "chunk"), anchors)
    first = answer(send(met, _window_keys(n_buckets), n_buckets), n, _first_documents)
    both = met.join(first.withColumnRenamed("answers", "first_answers"), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = [(i, n_words, gone, hashlib.sha256(kept).hexdigest(), kept if texts else None) for i, n_words, gone, kept in _cleaned(row, n_buckets)]
                columns = list(zip(*out)) if out else [()] * 5
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays[: 4 + texts], names[: 4 + texts])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * texts
    return both.mapInArrow(run, schema)
