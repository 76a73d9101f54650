"""Token ids in training order, as fixed-stride binary shards.

Texts are encoded with a byte-level BPE (the vocabulary's path is a parameter), ended by one end
token and cut into sequences of ``length`` ids, the last filled up with end tokens. Every sequence
gets a global slot: its dense index in the stored table of sequences goes through a keyed Feistel
network over the next even number of bits, walking the cycle until it falls below the number of
sequences. That is a permutation, needs no sort and no state, and the slot of any index can be
computed again from (key, number of sequences) alone.

A shard holds ``per_shard`` consecutive slots: record s % per_shard starts at byte
(s % per_shard) * length * 2 of shard s // per_shard, as little-endian 16-bit ids. A reader that
stopped at slot s goes on there without an index.

Sequences are stored once (nothing is encoded twice) and shuffled once, by shard. The indices'
offsets are one row per writing task.

Cases: a null or empty text is one sequence of end tokens. Texts may be as long as a row can be; long
runs of white space are cut out before the pattern sees them, with the same ids. Repeated rows are sequences of their
own. Ids may be null. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skymap.llm.common import ship_code, stored

LENGTH = 512
PER_SHARD = 4096
KEY = 0x5EED_0123_4567_89AB
ROUNDS = 6
VOCABULARY = "byte_bpe_50k.tiktoken"
# Texts encoded and rows given out at a time.
BATCH_ROWS = 2048
# Runs of white space from this length on are more than the pattern's engine can take.
LONG_RUN = 100_000
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str):
    """(function from text to ids, end token) of a rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")

    def encode(text: str) -> list[int]:
        """A run is one pre-token by itself, but for its last symbol if a word follows."""
        ids, done = [], 0
        for run in long_run.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            ids += encoding.encode_ordinary(text[done : run.start()])
            ids += encoding._encode_single_piece(text[run.start() : end])
            done = end
        return ids + encoding.encode_ordinary(text[done:])

    return encode, len(ranks)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the indices 0 <= index < n: a permutation of range(n)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(ROUNDS):
            round_key = np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
            left, right = right, left ^ (_mixed(right + round_key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.view(np.int64)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """(task, place, doc_id, part, n_tokens, ids): ids are ``length`` 16-bit numbers, n_tokens of
    them from the text and its end token."""
    ship_code(docs.sparkSession)
    path = path or vocabulary_path()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path)
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS // 8):
                piece = batch.slice(at, BATCH_ROWS // 8)
                row, part, n_tokens, ids = [], [], [], []
                for i, text in enumerate(piece.column(1)):
                    tokens = np.array(encode(text.as_py() or "") + [end], dtype="<u2")
                    for k in range(0, len(tokens), length):
                        own = tokens[k : k + length]
                        row.append(i)
                        part.append(k // length)
                        n_tokens.append(len(own))
                        ids.append(own.tobytes() + np.full(length - len(own), end, dtype="<u2").tobytes())
                        if len(row) == BATCH_ROWS:
                            yield _sequence_batch(piece, task, place, row, part, n_tokens, ids)
                            place += len(row)
                            row, part, n_tokens, ids = [], [], [], []
                if row:
                    yield _sequence_batch(piece, task, place, row, part, n_tokens, ids)
                    place += len(row)

    return slim.mapInArrow(run, T.StructType([
        T.StructField("task", T.LongType()), T.StructField("place", T.LongType()), T.StructField("doc_id", kind),
        T.StructField("part", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ]))


def _sequence_batch(piece, task, place, row, part, n_tokens, ids) -> pa.RecordBatch:
    n = len(row)
    cols = [
        pa.array(np.full(n, task)), pa.array(np.arange(place, place + n)), piece.column(0).take(pa.array(row)),
        pa.array(part, pa.int64()), pa.array(n_tokens, pa.int32()), pa.array(ids, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["task", "place", "doc_id", "part", "n_tokens", "ids"])


def with_slots(seqs: DataFrame, key: int = KEY) -> DataFrame:
    """``seqs``, a stored table, with ``slot`` for (task, place)."""
    ship_code(seqs.sparkSession)
    tasks = seqs.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    n = seqs.count()
    # One row for each task that wrote the table.
    indexed = seqs.join(F.broadcast(tasks), "task").withColumn("slot", F.col("offset") + F.col("place"))

    @F.pandas_udf("long")
    def permuted(index):
        import pandas as pd

        return pd.Series(slots_of(index.to_numpy(), n, key))

    return indexed.drop("task", "place", "offset").withColumn("slot", permuted("slot"))


def shards(slotted: DataFrame, per_shard: int = PER_SHARD, length: int = LENGTH) -> DataFrame:
    """(shard, first_slot, n_sequences, n_tokens, doc_ids, payload, sha256), a row per shard."""
    kind = slotted.schema["doc_id"].dataType
    dealt = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard))
    n = int(slotted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("shard", "slot", "doc_id", "n_tokens", "ids").repartition(n, "shard").sortWithinPartitions("slot")
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("first_slot", T.LongType()), T.StructField("n_sequences", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("payload", T.BinaryType()), T.StructField("sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            payload = b"".join(x.as_py() for x in whole["ids"])
            cols = [
                [whole["shard"][0].as_py()], [whole["slot"][0].as_py()], [whole.num_rows],
                [sum(whole["n_tokens"].to_pylist())], [whole["doc_id"].to_pylist()], [payload],
                [hashlib.sha256(payload).hexdigest()],
            ]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], [f.name for f in target])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != int(shard[a]):
                    yield made()
                held.append(batch.slice(a, b - a))
        if held:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_schema

    target = list(to_arrow_schema(schema))
    return dealt.mapInArrow(run, schema)


def training_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, path: str | None = None) -> DataFrame:
    """Shards of all documents in training order."""
    seqs = stored(sequences(docs, id_col, text_col, length, path), compression="zstd")
    return shards(with_slots(seqs, key), per_shard, length)


def read_from(shard_rows: DataFrame, slot: int, count: int, per_shard: int = PER_SHARD, length: int = LENGTH) -> DataFrame:
    """(slot, ids) of ``count`` slots from ``slot`` on; only the shards that hold them are read."""
    last = slot + count - 1
    near = shard_rows.filter(F.col("shard").between(slot // per_shard, last // per_shard))
    rows = near.select("payload", "first_slot", F.explode(F.sequence(F.lit(0), F.col("n_sequences") - 1)).alias("i"))
    rows = rows.withColumn("slot", F.col("first_slot") + F.col("i")).filter(F.col("slot").between(slot, last))
    return rows.select("slot", F.substring("payload", F.col("i") * (2 * length) + 1, F.lit(2 * length)).alias("ids"))
