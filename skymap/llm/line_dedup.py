"""Removal of lines that many documents share (native DataFrame functions only).

The corpus is taken in batches. A batch gives one row per line hash with the number of its
documents that hold the line. Such rows are kept in sorted runs, in levels: a new batch is
merge-anti-joined with the run of hashes that are settled (already found in enough documents),
what is left becomes a run of level 0, and when a level holds ``fan`` runs they are merged into
one of the next level; hashes that reach the limit there move to the settled run. In the end all
runs are summed, and every line whose hash is settled leaves every document.

Rows are counted per batch before any shuffle of hashes, so a line that is everywhere costs one
row per task. The texts are shuffled once, to meet the numbers of their dropped lines; a line
hash is 128 bits wide.

Cases: a null or empty text is one empty line. Empty keys are never dropped. Rows count as
documents, so repeated rows count each; they get equal results. A null doc_id is a value like any
other. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.llm.common import SPACE, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_POINTS = 1
MIN_DOCS = 10
BATCHES = 4
FAN = 2


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(SPACE))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs), each a stored table."""

    def __init__(self, min_docs: int = MIN_DOCS, fan: int = FAN):
        self.min_docs, self.fan = min_docs, fan
        self.levels: list[list[DataFrame]] = []
        self.settled: DataFrame | None = None

    def _sorted_run(self, rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).sortWithinPartitions("h1", "h2"))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, n_docs), a hash once or more."""
        if self.settled is not None:
            batch = batch.hint("merge").join(self.settled, ["h1", "h2"], "left_anti")
        run, level = self._sorted_run(batch), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan:
                return
            run = self._sorted_run(self._merged(self.levels[level]))
            self.levels[level] = []
            often = run.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            self.settled = stored(often if self.settled is None else self.settled.unionByName(often).distinct())
            run, level = run.filter(F.col("n_docs") < self.min_docs), level + 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of all hashes found in ``min_docs`` documents or more."""
        runs = [run for level in self.levels for run in level]
        rest = self._sorted_run(self._merged(runs)).filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        return stored(rest if self.settled is None else self.settled.unionByName(rest).distinct())


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS,
    min_docs: int = MIN_DOCS, batches: int = BATCHES,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): one row per row of ``docs``; kept is the text left."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("lines"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
    )
    # Each key once a document; counted per batch before the shuffle.
    keys = F.filter(F.array_distinct(F.transform("lines", line_key)), lambda k: F.length(k) >= min_points)
    batch_no = F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches))
    counted = base.select(batch_no.alias("batch"), F.explode(F.transform(keys, _hash)).alias("h"))
    counted = counted.groupBy("batch", "h.h1", "h.h2").agg(F.count("*").alias("n_docs"))
    counted = stored(counted)
    runs = LineRuns(min_docs)
    for b in range(batches):
        runs.add(counted.filter(F.col("batch") == b).drop("batch"))
    frequent = runs.frequent()

    placed = base.select("doc_id", "th", F.posexplode(F.transform("lines", line_key)).alias("line_no", "key"))
    placed = placed.filter(F.length("key") >= min_points)
    placed = placed.select("doc_id", "th", "line_no", _hash(F.col("key")).alias("h")).select("doc_id", "th", "line_no", "h.*")
    drops = placed.join(frequent, ["h1", "h2"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("drops"))
    drops = drops.select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"), "drops")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    met = slim.join(drops, slim["doc_id"].eqNullSafe(drops["d_id"]) & (slim["th"] == drops["d_th"]), "left")
    met = met.withColumn("lines", F.split("text", "\n"))
    met = met.withColumn("n_lines", F.size("lines"))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("drops")))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return met.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
