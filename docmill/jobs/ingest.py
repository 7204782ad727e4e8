"""One batch from received files to corpus rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import chunk_id, document_id
from docmill.operators.chunking import ChunkConfig, chunk
from docmill.operators.corpus import dedup_batch, new_documents
from docmill.operators.extraction import explode_blocks, screen
from docmill.sources.scratch import written_once


def extracted_once(received: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of a batch, and the table that both read is ``documents.table``: each file is judged and extracted once."""
    table = written_once(screen(received), "screened")
    documents = table.where("error_code is null")
    documents.table = table
    return documents, table.where("error_code is not null").select("doc_key", "stage", "error_code", "error_field")


def ingest_batch(
    received: DataFrame, corpus: DataFrame | Callable[[DataFrame], DataFrame], created_at: str, config: ChunkConfig = ChunkConfig(), kept: list[DataFrame] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks without vectors, rejected) of what is new in a batch. ``corpus(sha256, ...)`` are the
    documents that there are, or a function that tells them for the hashes of this batch. What is
    extracted and what is cut are tables in the shared folder, each written once; they are added to ``kept``, for the
    caller to forget. Null fields are judged as the contract says; an empty batch gives empty tables."""
    extracted, bad = extracted_once(received)
    first = dedup_batch(extracted)
    fresh = new_documents(extracted, corpus(first.select("sha256")) if callable(corpus) else corpus)
    drafts, worst = chunk(explode_blocks(fresh), config)
    narrow = fresh.drop("content", "blocks", "stage", "error_code", "error_field")
    worst = worst.select("doc_key", "stage", "error_code", "error_field")
    told = drafts.drop("spans").withColumn("stage", F.lit(None).cast("string")).unionByName(worst, allowMissingColumns=True)
    cut = written_once(told.join(narrow.select("doc_key", "sha256"), "doc_key"), "cut")
    drafts, worst = cut.where("stage is null"), cut.where("stage is not null").select("doc_key", "stage", "error_code", "error_field")
    if kept is not None:
        kept += [extracted.table, cut]
    counts = drafts.groupBy("doc_key").agg(F.count("*").cast("int").alias("chunks_count"))
    documents = narrow.join(counts, "doc_key").select(
        document_id(F.col("sha256")).alias("id"), F.lit("indexed").alias("status"), "title", "original_filename", "mime_type", "sha256", "page_count", "character_count",
        "chunks_count", "source_name", "source_url", "published_at", "metadata", F.lit(created_at).cast("timestamp").alias("created_at"),
    )
    chunks = drafts.select(
        chunk_id(F.col("sha256"), F.col("chunk_index")).alias("id"), document_id(F.col("sha256")).alias("document_id"), "chunk_index", "content", "character_count",
        F.lit(None).cast("int").alias("provider_token_count"), "page_index", "page_label", "section", "contains_table", F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("string").alias("embedding_model"), F.lit(None).cast("int").alias("embedding_dimensions"),
    )
    return documents, chunks, bad.unionByName(worst)
