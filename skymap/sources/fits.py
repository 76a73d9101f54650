"""Map files (FITS binary tables) to pixel tables, as Spark jobs over many files.

Three steps, none of which passes data through the driver:

1. Spark lists the files (path, size, modification time; content is not read);
2. a header pass reads each file's header blocks and yields one row per column;
3. the files are cut into row blocks, stored as a table with the columns wanted of each, and read
   by the data source in ``blocks``: a row's bytes once, whatever the number of columns.

Files are opened through ``pyarrow.fs``, so local, HDFS and object-store paths
work alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.functions.pixels import NESTED, RING
from skymap.plans.session import ship_package
from skymap.plans.sizing import materialize, shared_dir, small_side
from skymap.sources.blocks import NAME, BlockSource, open_file

BLOCK_BYTES = 64 << 20
BLOCKS_PER_TASK = 16

# Fixed values of the format: header unit, card size, bytes per type code.
UNIT, CARD = 2880, 80
TYPE_BYTES = {
    "L": 1, "B": 1, "A": 1, "I": 2, "J": 4, "E": 4, "K": 8, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16,
}
FRAME_OF = {
    "C": "C", "CEL": "C", "CELESTIAL": "C",
    "G": "G", "GAL": "G", "GALACTIC": "G",
    "E": "E", "ECL": "E", "ECLIPTIC": "E",
}

COLUMN_SCHEMA = (
    "file_no long, path string, mtime timestamp, hdu int, col int, name string, tform string, type string, "
    "repeat long, col_offset long, row_bytes long, n_rows long, data_start long, "
    "nside long, ordering string, coord string, indxschm string"
)


def _card_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1:].split("'", 1)[0].strip()
    text = text.split("/", 1)[0].strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    return text


def _read_header(handle, start: int) -> tuple[dict, int] | None:
    """Cards of the header unit at ``start`` and the position after it."""
    cards, pos = {}, start
    while True:
        handle.seek(pos)
        block = handle.read(UNIT)
        if len(block) < UNIT:
            return None
        pos += UNIT
        for i in range(0, UNIT, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, pos
            if card[8:10] == "= ":
                cards.setdefault(key, _card_value(card[10:]))


def _data_bytes(cards: dict) -> int:
    axes = [cards.get(f"NAXIS{i + 1}", 0) for i in range(cards.get("NAXIS", 0))]
    if not axes:
        return 0
    cells = cards.get("GCOUNT", 1) * (cards.get("PCOUNT", 0) + int(np.prod(axes)))
    size = abs(cards.get("BITPIX", 8)) // 8 * cells
    return -(-size // UNIT) * UNIT


def _columns_of(file_no: int, path: str, mtime) -> Iterator[dict]:
    """One row per column of every binary table of a file."""
    with open_file(path) as handle:
        pos, hdu = 0, 0
        while (unit := _read_header(handle, pos)) is not None:
            cards, data = unit
            pos = data + _data_bytes(cards)
            if cards.get("XTENSION") == "BINTABLE":
                offset = 0
                for c in range(cards.get("TFIELDS", 0)):
                    form = str(cards.get(f"TFORM{c + 1}", ""))
                    found = re.match(r"\s*(\d*)([A-Z])", form)
                    code = found[2] if found else "?"
                    repeat = int(found[1] or 1) if found else 0
                    width = -(-repeat // 8) if code == "X" else repeat * TYPE_BYTES.get(code, 0)
                    yield {
                        "file_no": file_no, "path": path, "mtime": mtime, "hdu": hdu, "col": c,
                        "name": str(cards.get(f"TTYPE{c + 1}", "")), "tform": form.strip(),
                        "type": code, "repeat": repeat, "col_offset": offset,
                        "row_bytes": cards.get("NAXIS1", 0), "n_rows": cards.get("NAXIS2", 0),
                        "data_start": data,
                        "nside": cards.get("NSIDE", 0) if isinstance(cards.get("NSIDE", 0), int) else 0,
                        "ordering": str(cards.get("ORDERING", "RING")),
                        "coord": FRAME_OF.get(str(cards.get("COORDSYS", "G")), "G"),
                        "indxschm": str(cards.get("INDXSCHM", "IMPLICIT")),
                    }
                    offset += width
            hdu += 1


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*.fits") -> DataFrame:
    """(path, mtime, length) of the files; Spark lists them, content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("modificationTime").alias("mtime"), "length")
    )


def describe_maps(files: DataFrame) -> DataFrame:
    """One row per file column: name, type, layout and map keywords.

    The table is stored: every reader of the files uses it several times, and by it each file has its
    number.
    """

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in COLUMN_SCHEMA.split(", ")]
        for batch in batches:
            files = zip(batch["file_no"], batch["path"], batch["mtime"])
            yield pd.DataFrame([r for f in files for r in _columns_of(*f)], columns=names)

    numbered = files.select(F.monotonically_increasing_id().alias("file_no"), "path", "mtime")
    return materialize(numbered.mapInPandas(headers, COLUMN_SCHEMA))


def map_name(path, col) -> Column:
    """Identifier of a map: its path, '#', the value column."""
    return F.concat(path, F.lit("#"), col.cast("string"))


def _first_table(columns: DataFrame) -> DataFrame:
    """Columns of the first binary table that has rows."""
    first = columns.filter("n_rows > 0").groupBy("path").agg(F.min("hdu").alias("hdu"))
    return columns.join(first, ["path", "hdu"])


def map_metadata(columns: DataFrame) -> DataFrame:
    """``maps`` table: one row per value column of each file that names an nside.

    In an EXPLICIT file column 0 holds the indices; value columns count from the
    next one. A file that names an nside and an ordering other than RING or NESTED
    fails the job.
    """
    explicit = F.col("indxschm") == "EXPLICIT"
    value_col = F.when(explicit, F.col("col") - 1).otherwise(F.col("col"))
    dtype = F.when(F.col("type") == "E", F.lit("float")).otherwise(F.lit("double"))
    rows = _first_table(columns).filter((F.col("nside") > 0) & (value_col >= 0))
    wrong = F.raise_error(F.concat(F.lit("unknown ordering "), "ordering", F.lit(" in "), "path")).cast("string")
    ordering = F.when(F.col("ordering").isin(RING, NESTED), F.col("ordering")).otherwise(wrong)
    return rows.select(
        map_name(F.col("path"), value_col).alias("map_id"),
        "nside",
        ordering.alias("ordering"),
        "coord",
        "indxschm",
        dtype.alias("dtype"),
        F.col("path").alias("source"),
        value_col.cast("int").alias("col"),
        "mtime",
        F.when(~explicit, F.col("n_rows") * F.col("repeat")).alias("n_pix"),
    )


def block_table(columns: DataFrame, value_cols: DataFrame | list[int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Row blocks of about ``block_bytes``, each with the wanted columns of its file.

    ``value_cols`` is a list of 0-based value columns read from every file, or a
    DataFrame (path, value_col).
    """
    table = _first_table(columns).withColumn("explicit", (F.col("indxschm") == "EXPLICIT") & (F.col("nside") > 0))
    table = table.withColumn(
        "value_col", F.when(F.col("explicit"), F.col("col") - 1).otherwise(F.col("col")).cast("int")
    )
    if isinstance(value_cols, DataFrame):
        wanted = table.join(value_cols.select("path", "value_col"), ["path", "value_col"], "left_semi")
    else:
        wanted = table.filter(F.col("value_col").isin(value_cols))
    index = table.filter("explicit and col = 0").select(
        "file_no", F.col("type").alias("index_type"), F.col("col_offset").alias("index_offset")
    )
    file = ["file_no", "path", "row_bytes", "data_start", "n_rows", "explicit", "nside"]
    own = F.struct("value_col", "tform", "type", "repeat", "col_offset")
    files = wanted.groupBy(*file).agg(F.array_sort(F.collect_list(own)).alias("columns"))
    files = files.join(index, "file_no", "left")
    per_block = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(block_bytes) / F.greatest("row_bytes", F.lit(1))))
    cut = files.withColumn("per_block", per_block)
    cut = cut.withColumn(
        "first_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.col("per_block")))
    )
    return cut.withColumn("rows", F.least("per_block", F.col("n_rows") - F.col("first_row"))).drop("per_block", "n_rows")


def read_blocks(
    columns: DataFrame, value_cols: DataFrame | list[int], block_bytes: int = BLOCK_BYTES,
    pix_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Raw rows (map_id, row_no, pix, value) of the chosen value columns.

    Blocks are spread over tasks, so one huge file is read by many. Sparse rows outside the map are
    dropped. With ``pix_range`` (first, end) only those pixels are read; where the session has
    ``spark.sql.python.filterPushdown.enabled``, filters on ``pix`` do the same by themselves.
    """
    spark = columns.sparkSession
    ship_package(spark)
    spark.dataSource.register(BlockSource)
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex[:16]}"
    block_table(columns, value_cols, block_bytes).write.parquet(path)
    reader = spark.read.format(NAME).option("blocks", path).option("blocksPerTask", BLOCKS_PER_TASK)
    reader = reader.option("tasks", spark.sparkContext.defaultParallelism)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if pix_range is not None:
        reader = reader.option("pixFrom", pix_range[0]).option("pixTo", pix_range[1] - 1)
    names = small_side(columns.select("file_no", "path").distinct(), stored=True)
    rows = reader.load().join(names, "file_no")
    return rows.select(map_name(F.col("path"), F.col("value_col")).alias("map_id"), "row_no", "pix", "value")


def read_maps(
    columns: DataFrame, value_cols: DataFrame | list[int] = [0], pix_range: tuple[int, int] | None = None
) -> DataFrame:
    """Pixel table (map_id, pix, value) of map files, dense and sparse alike.

    Dense pixels are numbered by position. Of repeated sparse pixels the last row
    wins.
    """
    explicit = F.expr("indxschm = 'EXPLICIT' and nside > 0")
    kinds = {r[0] for r in columns.select(explicit).distinct().collect()} or {False}
    parts = []
    if False in kinds:
        parts.append(read_blocks(columns.filter(~explicit), value_cols, pix_range=pix_range).select("map_id", "pix", "value"))
    if True in kinds:
        rows = read_blocks(columns.filter(explicit), value_cols, pix_range=pix_range)
        parts.append(rows.groupBy("map_id", "pix").agg(F.max_by("value", "row_no").alias("value")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
