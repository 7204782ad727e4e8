"""Training-data pipeline over the documents table.

Each stage takes what its predecessor kept and returns the columns of documents, all but the last;
between stages the rows are written as Parquet and read again.

In all stages: rows with a null or empty text are kept as they are, texts of any length are processed
whole, a null doc_id is a doc_id like others, further columns may have any names and are carried
along, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm.decontaminate import without_overlaps
from docmill.llm.mixing import mix_sources
from docmill.llm.near_dedup import keep_one
from docmill.llm.secrets import redact
from docmill.llm.store import stored
from docmill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; repeated rows share their fate. Without labels all stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the smallest doc_id stays, once; two texts under one
    doc_id are two rows, each judged with its own class."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a passage of the benchmark go; repeated rows share their fate."""
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and n_chars is the new length."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their place in a mixture with weights by the square root of the source's size; a null
    source is one of its own, and repeated rows get a place each."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: Several stages have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}-{name}")  # texts go to Python in small batches
    return docs
