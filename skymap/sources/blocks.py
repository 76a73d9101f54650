"""Row blocks of map files as a Spark data source.

``spark.read.format("skymap_blocks").option("blocks", table)`` reads the pixels of a stored table of
blocks (``fits.block_table``): a partition is a few blocks, a block is whole rows of one file with
all the columns wanted of it, so the bytes of a row are read once, whatever the number of columns.
Rows come as Arrow slices of at most 100 000; files and columns are numbers, their names are joined
later. A pixel range (options ``pixFrom`` and ``pixTo``, or a pushed filter where the session allows
it) leaves out blocks and seeks within them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

NAME = "skymap_blocks"
SCHEMA = "file_no long, value_col int, row_no long, pix long, value double"
SLICE_ROWS = 100_000
# Bytes of file rows held at a time.
READ_BYTES = 4 << 20
MAX_PIX = (1 << 63) - 1
# Fixed values of the format: numpy types of the codes.
VALUE_TYPES = {"E": ">f4", "D": ">f8", "J": ">i4"}
INDEX_TYPES = {"J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def file_system(path: str):
    """(file system, inner path) of a path or URI as listed by Spark."""
    from pyarrow import fs

    path = unquote(path)
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def open_file(path: str):
    """Random-access handle of a path or URI."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _field(raw: np.ndarray, offset: int, code: str, repeat: int, types: dict) -> np.ndarray:
    """Values of one column inside whole rows, row by row."""
    dtype = np.dtype(types[code])
    part = raw[:, offset : offset + repeat * dtype.itemsize]
    return np.ascontiguousarray(part).view(dtype).ravel()


def _pixels(block: dict, column: dict, raw: np.ndarray, first_row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row_no, pix, value) of a column in some rows."""
    repeat = column["repeat"]
    values = _field(raw, column["col_offset"], column["type"], repeat, VALUE_TYPES).astype("f8")
    row_no = np.arange(first_row * repeat, first_row * repeat + len(values), dtype="i8")
    if not block["explicit"]:
        return row_no, row_no, values
    if block["index_type"] not in INDEX_TYPES:
        return row_no[:0], row_no[:0], values[:0]
    index = _field(raw, block["index_offset"], block["index_type"], repeat, INDEX_TYPES)
    pix = np.nan_to_num(index, nan=0.0, posinf=2**62, neginf=-(2**62)).astype("i8")
    good = (pix >= 0) & (pix < 12 * block["nside"] ** 2)
    return row_no[good], pix[good], values[good]


def _needed(block: dict, low: int, high: int) -> tuple[int, int]:
    """First row and end of the rows that can hold pixels low..high."""
    first, end = block["first_row"], block["first_row"] + block["rows"]
    if block["explicit"]:
        return first, end
    repeats = [c["repeat"] for c in block["columns"]]
    return max(first, min(low // max(1, r) for r in repeats)), min(end, max(high // max(1, r) for r in repeats) + 1)


def decode(block: dict, low: int = 0, high: int = MAX_PIX) -> Iterator[pa.RecordBatch]:
    """Pixels low..high of one block, all its columns, in slices."""
    for column in block["columns"]:
        if column["type"] not in VALUE_TYPES:
            raise ValueError(f"unsupported column type {column['tform']!r} in {block['path']}")
    first, end = _needed(block, low, high)
    row_bytes = block["row_bytes"]
    step = max(1, READ_BYTES // max(1, row_bytes))
    with open_file(block["path"]) as handle:
        for at in range(first, end, step):
            rows = min(step, end - at)
            handle.seek(block["data_start"] + at * row_bytes)
            raw = np.frombuffer(handle.read(rows * row_bytes), np.uint8).reshape(rows, row_bytes)
            for column in block["columns"]:
                row_no, pix, values = _pixels(block, column, raw, at)
                if low > 0 or high < MAX_PIX:
                    good = (pix >= low) & (pix <= high)
                    row_no, pix, values = row_no[good], pix[good], values[good]
                for a in range(0, len(pix), SLICE_ROWS):
                    part = slice(a, a + SLICE_ROWS)
                    n = len(pix[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, block["file_no"], "i8")),
                            pa.array(np.full(n, column["value_col"], "i4")),
                            pa.array(row_no[part]),
                            pa.array(pix[part]),
                            pa.array(values[part]),
                        ],
                        ["file_no", "value_col", "row_no", "pix", "value"],
                    )


class Blocks(InputPartition):
    """Some blocks, one after the other."""

    def __init__(self, blocks: list[dict]):
        self.blocks = blocks


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options["blocks"]
        self.per_task = int(options.get("blocksPerTask", 16))
        self.tasks = int(options.get("tasks", 1))
        self.low, self.high = int(options.get("pixFrom", 0)), int(options.get("pixTo", MAX_PIX))

    def partitions(self) -> Sequence[InputPartition]:
        import pyarrow.parquet as pq

        system, inner = file_system(self.table)
        blocks = pq.read_table(inner, filesystem=system).to_pylist()
        kept = []
        for block in blocks:
            first, end = _needed(block, self.low, self.high)
            if first < end:
                kept.append(block)
        kept.sort(key=lambda b: (b["path"], b["first_row"]))
        size = max(1, min(self.per_task, len(kept) // max(1, self.tasks)))
        return [Blocks(kept[a : a + size]) for a in range(0, len(kept), size)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        for block in partition.blocks:
            yield from decode(block, self.low, self.high)


class FilteringReader(BlockReader):
    """Takes pixel ranges from the query's filters; Spark still applies them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("pix",):
                value = getattr(f, "value", None)
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, value)
                if isinstance(f, LessThan):
                    self.high = min(self.high, value - 1)
            yield f


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        pushed = self.options.get("pushdown", "false") == "true"
        return (FilteringReader if pushed else BlockReader)(self.options)
