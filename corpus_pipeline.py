"""Documents to training shards: quality rules, near duplicates, benchmark leaks, mixing, output.

Every stage takes (spark, docs, sf_dir), works on all the stage before kept and returns a
DataFrame; all but the last return the columns of the documents. ``run`` applies them in order,
each result written as Parquet to the shared folder and read again.

Cases: null texts have no words and go in the first stage; of repeated rows one stays; an empty
table passes through as an empty table; further columns of the documents are carried along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skymap.llm.common import documents, stored
from skymap.llm.decontaminate import drop_contaminated
from skymap.llm.divergence import keep_good
from skymap.llm.mixing import mix
from skymap.llm.simhash import keep_one
from skymap.llm.token_output import training_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' weights: a document in several passes comes several times."""
    return mix(docs).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of token ids in training order."""
    return training_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("token_output", token_output),
]

# No SQL can say the components over fingerprints or the keyed permutation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
