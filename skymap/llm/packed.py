"""Rounds of "which keys come more than once" over documents held in packed chunks.

Whole texts are dealt by range of a sketch, so that copies lie together, and packed into chunks of
about four megabytes, one row each. A round sends, for every chunk, its distinct keys once, dealt
into hashed buckets as one binary per chunk and bucket; a bucket's task finds what it needs (which
keys come again, the smallest document of a key) and answers with one binary for each it got, in
the same order. A key that is everywhere costs one entry per chunk. Answers meet the chunks in a
join on the chunk's number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code, stored

CHUNK_BYTES = 4 << 20
# Shuffled buckets for each shuffle partition; a chunk sends at most one row to each.
BUCKETS = 1
# Lines that short tell little of a document.
SKETCH_LINE = 100

# What documents are called within chunks: the id, and the rest of what orders equal ids.
_CHUNK = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("lengths", T.BinaryType()),
    T.StructField("no_id", T.BinaryType()), T.StructField("data", T.BinaryType()),
])
ANSWER = "chunk long, bucket long, answer binary"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sketch(text: Column) -> Column:
    """Smallest hash of a text's longer lines, of the whole text when it has none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) >= SKETCH_LINE)
    return F.coalesce(F.array_min(F.transform(lines, lambda x: F.xxhash64(x))), F.xxhash64(text))


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunk rows of all documents, stored. Ids are long; a null id is kept in ``no_id``."""
    ship_code(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), sketch(text).alias("s"))
    slim = slim.withColumn("h", F.xxhash64("text", "id"))
    dealt = slim.repartitionByRange(partitions(docs), "s", "h").sortWithinPartitions("s", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressed = zstandard.ZstdCompressor(level=3)
        first, ids, texts, size, count = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def made() -> pa.RecordBatch:
            own = np.array([i or 0 for i in ids], dtype="<i8")
            missing = np.array([i is None for i in ids], dtype=np.uint8)
            lengths = np.array([len(t) for t in texts], dtype="<i8")
            row = [[first + count], [own.tobytes()], [lengths.tobytes()], [missing.tobytes()], [pressed.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), *[pa.binary()] * 4))], _CHUNK.names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py().encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_BYTES:
                    yield made()
                    ids, texts, size, count = [], [], 0, count + 1
        if ids:
            yield made()

    return stored(dealt.mapInArrow(run, _CHUNK), compression="uncompressed")


class Chunk:
    """One row of ``pack`` in a task: ids, lengths and the texts' bytes end to end."""

    def __init__(self, row: dict):
        import zstandard

        self.number = row["chunk"]
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.missing = np.frombuffer(row["no_id"], dtype=np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], dtype="<i8")
        self.data = zstandard.ZstdDecompressor().decompress(row["data"])
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def texts(self) -> Iterator[tuple[int, bytes]]:
        for i, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist())):
            yield i, self.data[a:b]

    def id(self, i: int) -> int | None:
        return None if self.missing[i] else int(self.ids[i])


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key, in the narrowest type: short numbers are sorted by counting."""
    return ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)


def send(chunks: DataFrame, keys_of: Callable[[dict], tuple], n_buckets: int) -> DataFrame:
    """(chunk, bucket, body): for each chunk its sorted distinct records, cut by bucket.

    ``keys_of`` gives, for a chunk's row, (sorted distinct keys, record array in the same order).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, records = keys_of(row)
                at = buckets_of(keys, n_buckets)
                order = np.argsort(at, kind="stable")
                found, cut = np.unique(at[order], return_index=True)
                bodies = [records[part].tobytes() for part in np.split(order, cut[1:])] if len(order) else []
                columns = [pa.array(np.full(len(found), row["chunk"]), pa.int64()), pa.array(found, pa.int64()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "body"])

    return chunks.mapInArrow(run, "chunk long, bucket long, body binary")


def answer(sent: DataFrame, n: int, of_bucket: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, answers): all answers to a chunk by bucket, from a function of one bucket's bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks, bodies = None, [], []

        def made() -> pa.RecordBatch:
            out = of_bucket(bodies)
            columns = [pa.array(chunks, pa.int64()), pa.array([bucket] * len(out), pa.int64()), pa.array(out, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "answer"])

        for batch in batches:
            for c, b, body in zip(*(col.to_pylist() for col in batch.columns)):
                if b != bucket and chunks:
                    yield made()
                    chunks, bodies = [], []
                bucket = b
                chunks.append(c)
                bodies.append(body)
        if chunks:
            yield made()

    found = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWER)
    return found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))


def with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    return chunks.join(answers, "chunk", "left")


def spread_answers(keys: np.ndarray, answers: list | None, n_buckets: int, dtype: str, bits: bool = False) -> np.ndarray:
    """The answers in the order of the sorted distinct keys they were given for."""
    at = buckets_of(keys, n_buckets)
    order = np.argsort(at, kind="stable")
    out = np.zeros(len(keys), dtype=dtype)
    counts = np.bincount(at, minlength=n_buckets) if len(keys) else np.zeros(n_buckets, int)
    done = np.concatenate(([0], np.cumsum(counts)))
    for a in answers or []:
        b = a["bucket"]
        where = order[done[b] : done[b + 1]]
        body = np.frombuffer(a["answer"], dtype=np.uint8)
        out[where] = np.unpackbits(body, count=len(where)) if bits else body.view(dtype)
    return out
