"""The training-data pipeline: documents in, packed sequences out. Each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neargrid.llm import packing, quality, secrets, simhash, winnowing
from neargrid.llm.common import read_table
from neargrid.sources.shared import drop, scratch, shared_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go.

    Null, empty and blank texts go; repeated rows stay or go together, as do rows that tie for the last place; texts
    of any length are read whole; without labels of good documents all other texts stay. An empty table gives no
    rows; all columns are kept, whatever their names.
    """
    return quality.select_good(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, by op6's links, the document of least id stays.

    Null, empty and blank texts are one component; a null id comes after all others; of equal rows one stays. An empty
    table gives no rows; all columns are kept, whatever their names.
    """
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words with a benchmark item, or hold a shorter item, go.

    Null and empty texts stay, as does everything without a benchmark; repeated rows stay or go together. An empty
    table gives no rows; all columns are kept, whatever their names.
    """
    return winnowing.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, repeated ones too.

    A null text stays null, an empty one empty; of overlapping secrets one mark stands for all. An empty table gives
    no rows; all columns are kept, whatever their names.
    """
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens.

    Null and empty texts are one token, the end; repeated rows are packed one by one; documents of equal length tie
    by their place in the input. An empty table gives no rows; other columns than doc_id and text are ignored.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("simhash_dedup", keep_one_of_a_kind),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Trained models, hashes and a tokenizer stand between input and output; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes when the next one's is written, and what a stage writes inside at its end."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_path(spark)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        if last:
            drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
