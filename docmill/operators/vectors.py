"""Preparation of supplied vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def vector_error(vector: Column, dimensions: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull() | (F.size(vector) != dimensions), "wrong_dimension").when(bad, "non_finite_value").when(squared_norm(vector) == 0, "zero_norm")
    )


def l2_normalize(vector: Column) -> Column:
    """The vector divided by its norm, computed in double."""
    return F.transform(vector, lambda x: (x.cast("double") / F.sqrt(squared_norm(vector))).cast("float"))


def index_versions(chunks: DataFrame) -> DataFrame:
    """Models and dimensions with their number of chunks; a null is a value like others, and repeated chunks count each. No
    chunks have no version."""
    return chunks.groupBy("embedding_model", "embedding_dimensions").agg(F.count("*").alias("chunks"))


def assert_single_index(chunks: DataFrame, queries: DataFrame) -> None:
    """Fail before a search if chunks or queries mix models or dimensions."""
    versions = index_versions(chunks).select("embedding_model", "embedding_dimensions").union(index_versions(queries).select("embedding_model", "embedding_dimensions")).distinct()
    found = versions.limit(2).collect()  # two rows at most
    if len(found) > 1:
        raise ValueError(f"one index has one model and dimension; found {found}")


def attach_embeddings(drafts: DataFrame, vectors: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, withheld documents ``(document_id, missing)``): one missing or bad vector withholds its
    document. A null chunk_id has no vector; chunks with a null document_id are never told; repeated vectors of a chunk give repeated
    rows. Without drafts both are empty."""
    joined = drafts.join(vectors.select("chunk_id", "embedding", "embedding_model", "embedding_dimensions"), "chunk_id", "left")
    joined = joined.withColumn("valid", vector_error(F.col("embedding"), dimensions).isNull())
    whole = joined.groupBy("document_id").agg(F.bool_and("valid").alias("complete"), F.count_if(~F.col("valid")).alias("missing"))
    good = joined.join(whole.where("complete").select("document_id"), "document_id", "left_semi").withColumn("embedding", l2_normalize(F.col("embedding"))).drop("valid")
    return good, whole.where("not complete").select("document_id", "missing")


def pending_embeddings(chunks: DataFrame, vectors: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunks without a vector of the wanted model and dimension. A null chunk_id has none; repeated chunks are told each; without
    vectors all are pending."""
    done = vectors.where((F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions)).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti")


def content_key(content: Column, model: str, dimensions: int) -> Column:
    """What a vector depends on: the text, the model and its dimension. Place, document and chunk configuration are not in it."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(dimensions)), content), 256)


def reindex(old: DataFrame, new: DataFrame, model: str, dimensions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the chunks of one index, ``old(chunk_id, content, embedding, embedding_model, embedding_dimensions)``, to those of
    another chunking, ``new(chunk_id, content, ...)``: (chunks of new with the vectors of equal texts, texts to embed ``(content_key, content,
    chunks)``, keys of texts that no chunk has any more).

    The difference is one of sets of texts: a text that came with a good vector is not embedded again, wherever it now
    stands, and a new text is embedded once, however many chunks have it. Vectors of another model, or that cannot be
    searched, are none. A null content has no key: it is in none of the three. Repeated chunks of new are each told. Empty tables have empty results.
    """
    good = (F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions) & vector_error(F.col("embedding"), dimensions).isNull()
    had = old.where("content is not null").select(content_key(F.col("content"), model, dimensions).alias("content_key"), F.when(good, F.struct("chunk_id", "embedding")).alias("v"))
    had = had.groupBy("content_key").agg(F.min_by("v.embedding", "v.chunk_id").alias("embedding"))
    keyed = new.drop("embedding", "embedding_model", "embedding_dimensions").where("content is not null").withColumn("content_key", content_key(F.col("content"), model, dimensions))
    known = had.where("embedding is not null")
    moved = keyed.join(known, "content_key").withColumns({"embedding_model": F.lit(model), "embedding_dimensions": F.lit(dimensions)})
    pending = keyed.join(known.select("content_key"), "content_key", "left_anti").groupBy("content_key").agg(F.first("content").alias("content"), F.count("*").alias("chunks"))
    return moved, pending, had.select("content_key").join(keyed.select("content_key"), "content_key", "left_anti")
