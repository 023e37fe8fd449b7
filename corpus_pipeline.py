"""Corpus pipeline over ``documents``: quality, near-duplicates, decontamination, mixing, token output.

Each stage takes what its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetcat.llm import op1, op3, op5, op7, op8
from fleetcat.llm.runtime import written
from fleetcat.session import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts (operator 3)."""
    return op3.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 8)."""
    return op8.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 1)."""
    return op1.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' target weights; a document taken twice is two rows (operator 7)."""
    return op7.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per row its place, length and checksum read back from them (operator 5)."""
    import public_tokenizers

    return op5.read_documents(op5.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix), ("token output", tokens)]

ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
