"""One query per operator over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymap.llm import sql
from skymap.llm.common import documents
from skymap.llm.decontaminate import contaminated
from skymap.llm.divergence import quality_counts
from skymap.llm.licenses import scan_licenses
from skymap.llm.line_dedup import drop_common_lines
from skymap.llm.merkle import verify_documents
from skymap.llm.mixing import mix
from skymap.llm.periodic_runs import describe_runs, planted
from skymap.llm.phrase_automata import remove_phrases
from skymap.llm.sentence_pieces import round_trip
from skymap.llm.simhash import near_duplicates
from skymap.llm.suffix_dedup import remove_repeats
from skymap.llm.token_counts import count_tokens
from skymap.llm.token_output import training_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What is left, with bytes that no longer make a symbol replaced, stands behind the counts.
    out = remove_repeats(documents(spark, sf_dir), texts=True)
    return out.withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op4_license_scan", sql.licenses())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


@query("op5_token_output")
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_shards(documents(spark, sf_dir))


@query("op6_phrase_automata")
def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(documents(spark, sf_dir))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query("op8_divergence", sql.divergence())
def op8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_counts(documents(spark, sf_dir)).drop("class_distance", "common_distance")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix(documents(spark, sf_dir))
    return drawn.select("row.doc_id", "source", "tokens", "epoch", "block_order", "doc_order")


@query("op10_line_dedup", sql.common_lines())
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_runs(planted(documents(spark, sf_dir)))


@query("op12_sentence_pieces")
def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


@query("op13_merkle", sql.merkle())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(documents(spark, sf_dir))
