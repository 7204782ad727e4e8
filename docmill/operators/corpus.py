"""Corpus maintenance: dedup by bytes, deletes, listings, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import document_id


def dedup_batch(extracted: DataFrame) -> DataFrame:
    """Of equal bytes the first arrival that passed validation and extraction stays. Partial
    aggregation of three narrow columns, so a file repeated millions of times is no hot key."""
    first = extracted.groupBy("sha256").agg(F.min(F.struct("arrival_seq", "doc_key")).alias("w")).select("sha256", F.col("w.doc_key").alias("doc_key"))
    return extracted.join(first, ["sha256", "doc_key"], "left_semi")


def resolve_against_corpus(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_key, sha256, document_id, deduplicated)``: an existing row keeps its id; of equal bytes
    in the batch the first arrival is new and the others are deduplicated."""
    known = documents.select("sha256", F.col("id").alias("known_id"))
    first = batch.groupBy("sha256").agg(F.min(F.struct("arrival_seq", "doc_key")).alias("w")).select("sha256", F.col("w.doc_key").alias("first_key"))
    told = batch.select("doc_key", "sha256").join(first, "sha256").join(known, "sha256", "left")
    return told.select(
        "doc_key", "sha256", F.coalesce("known_id", document_id(F.col("sha256"))).alias("document_id"),
        (F.col("known_id").isNotNull() | (F.col("doc_key") != F.col("first_key"))).alias("deduplicated"),
    )


def new_documents(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """The first arrivals of a batch whose bytes no document has. Rows without a hash are left out, repeated documents
    change nothing; an empty batch gives an empty table, and against no documents all are new."""
    return dedup_batch(batch).join(documents.select("sha256"), "sha256", "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents left, chunks left, ids that were not found); ``ids(id)``."""
    own = ids.select("id").distinct()
    gone = own.select(F.col("id").alias("document_id"))
    return documents.join(own, "id", "left_anti"), chunks.join(gone, "document_id", "left_anti"), own.join(documents.select("id"), "id", "left_anti")


PUBLIC = ("id", "status", "title", "original_filename", "mime_type", "created_at")


def list_documents(documents: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the public columns, newest first, then by id."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1..100 and offset 0 or more")
    return documents.select(*PUBLIC).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


#: Ranges of the order of the list, each inside those before it.
_PAGE_LEVELS = ("date_trunc('day', created_at)", "date_trunc('hour', created_at)", "date_trunc('minute', created_at)", "date_trunc('second', created_at)", "created_at", "substr(id, 1, 2)", "substr(id, 1, 4)")


def locate_page(documents: DataFrame, limit: int, offset: int, enough: int = 10_000) -> tuple[DataFrame, int]:
    """(the documents of the ranges of (created_at, id) that hold a page, the page's offset among them). Counts for each range tell
    which ones, from days on to parts of ids, as long as there are more than ``enough`` documents in them. A page meets
    no more ranges than it has rows, and their number alone comes to the driver."""
    rows, at = documents, offset
    for level in _PAGE_LEVELS:
        key = F.expr(level)
        counts = rows.groupBy(key.alias("range")).agg(F.count("*").alias("n"))
        if level.startswith("substr"):
            order = [F.asc_nulls_first("range")]
            if rows.select("created_at").distinct().limit(2).count() > 1:
                break  # ids are in order within one time alone
        else:
            order = [F.desc_nulls_last("range")]
        so_far = counts.withColumn("end", F.sum("n").over(Window.orderBy(*order))).withColumn("start", F.col("end") - F.col("n"))  # a row for each range
        met = so_far.where((F.col("start") < at + limit) & (F.col("end") > at)).select("range", "n", "start").collect()
        if not met:
            return rows.limit(0), 0
        values = [r.range for r in met]
        some = key.isin([v for v in values if v is not None])
        rows = rows.where(F.coalesce(some, F.lit(False)) | (key.isNull() if None in values else F.lit(False)))
        at -= min(r.start for r in met)
        if sum(r.n for r in met) <= enough:
            break
    return rows, at


def list_deep(documents: DataFrame, limit: int = 20, offset: int = 0, enough: int = 10_000) -> DataFrame:
    """The same page as ``list_documents``, for offsets of any depth: only the ranges that hold it are sorted."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1..100 and offset 0 or more")
    rows, at = locate_page(documents, limit, offset, enough)
    return list_documents(rows, limit, at)


def count_documents(documents: DataFrame) -> DataFrame:
    """``(total)``: how many documents all pages of the list have together. Repeated ids count once, null ones not;
    no documents are 0."""
    return documents.agg(F.count_distinct("id").alias("total"))


def get_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The public view of some documents: the source nested, neither content nor vectors."""
    source = F.struct(F.col("source_name").alias("name"), F.col("source_url").alias("url"), "published_at")
    return documents.join(ids.select("id").distinct(), "id", "left_semi").select(
        "id", "status", "title", "original_filename", "mime_type", "sha256", "page_count", "character_count", "chunks_count", source.alias("source"), "metadata", "created_at"
    )


def _failed(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is false; a condition on a null passes, as a CHECK does."""
    return F.array_compact(F.array(*[F.when(~cond, name) for name, cond in rules.items()]))


def _spaces(col: str) -> Column:
    return F.trim(F.col(col)) != ""


def document_rules() -> dict[str, Column]:
    c = F.col
    required = ("id", "status", "title", "original_filename", "mime_type", "sha256", "character_count", "chunks_count", "metadata", "created_at")
    limits = {"status": 20, "title": 200, "original_filename": 255, "mime_type": 100, "source_name": 200}
    return (
        {f"{n}_not_null": c(n).isNotNull() for n in required}
        | {f"{n}_length": F.length(n) <= most for n, most in limits.items()}
        | {
            "status_indexed": c("status") == "indexed", "title_not_blank": _spaces("title"), "filename_not_blank": _spaces("original_filename"),
            "mime_type_supported": c("mime_type").isin("text/markdown", "text/plain", "application/pdf"), "sha256_format": c("sha256").rlike(r"\A[0-9a-f]{64}\z"),
            "page_count_limit": c("page_count").between(1, 50), "character_count_limit": c("character_count").between(1, 500_000), "chunks_count_positive": c("chunks_count") > 0,
            "source_name_not_blank": _spaces("source_name"), "source_url_http": c("source_url").rlike("(?i)^https?://"),
            "metadata_object": F.when(c("metadata").isNotNull(), F.coalesce(F.schema_of_variant(F.try_parse_json("metadata")).startswith("OBJECT"), F.lit(False))),
        }
    )


def chunk_rules(dimensions: int) -> dict[str, Column]:
    c = F.col
    required = ("id", "document_id", "chunk_index", "content", "character_count", "contains_table", "embedding", "embedding_model", "embedding_dimensions")
    limits = {"page_label": 50, "section": 500, "embedding_model": 100}
    return (
        {f"{n}_not_null": c(n).isNotNull() for n in required}
        | {f"{n}_length": F.length(n) <= most for n, most in limits.items()}
        | {
            "index_non_negative": c("chunk_index") >= 0, "content_not_blank": _spaces("content"), "chunk_character_count_limit": c("character_count").between(1, 2400),
            "token_count_non_negative": c("provider_token_count") >= 0, "page_index_positive": c("page_index") >= 1, "page_label_not_blank": _spaces("page_label"),
            "section_not_blank": _spaces("section"), "embedding_model_not_blank": _spaces("embedding_model"), "embedding_dimensions_fixed": c("embedding_dimensions") == dimensions,
            "embedding_size": F.size("embedding") == dimensions,
        }
    )


_NO_KEY = "\0"


def _keys(documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What each kind of rule looks at: the rows, with the ``key`` whose rows it takes together."""

    def keyed(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumn("key", F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit(_NO_KEY)) for c in columns)))

    return {
        "document": keyed(documents, "id"), "document_sha256": keyed(documents, "sha256"), "chunk": keyed(chunks, "id"),
        "chunk_place": keyed(chunks, "document_id", "chunk_index"), "chunk_document": keyed(chunks, "document_id"),
    }


def _audit(own: dict[str, DataFrame], documents: DataFrame, dimensions: int) -> DataFrame:
    """Violations ``(table_name, row_id, rule, kind, key)`` of the rows of each kind; of a key all rows must be there."""

    def told(df: DataFrame, kind: str, row: Column, rule: Column | str) -> DataFrame:
        return df.select(F.lit(f"{kind.split('_')[0]}s").alias("table_name"), row.cast("string").alias("row_id"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.lit(kind).alias("kind"), "key")

    def repeated(kind: str, keys: list[str], rule: str) -> DataFrame:
        return told(own[kind].where(F.col(keys[0]).isNotNull()).groupBy("key", *keys).agg(F.count("*").alias("n")).where("n > 1"), kind, F.concat_ws("/", *keys), rule)

    parts = [
        told(own["document"].withColumn("rule", F.explode(_failed(document_rules()))), "document", F.col("id"), F.col("rule")),
        told(own["chunk"].withColumn("rule", F.explode(_failed(chunk_rules(dimensions)))), "chunk", F.col("id"), F.col("rule")),
        repeated("document", ["id"], "id_unique"), repeated("document_sha256", ["sha256"], "sha256_unique"), repeated("chunk", ["id"], "id_unique"),
        repeated("chunk_place", ["document_id", "chunk_index"], "document_index_unique"),
        told(own["chunk_document"].join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").where("document_id is not null"), "chunk_document", F.col("id"), "document_exists"),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_schema(documents: DataFrame, chunks: DataFrame, dimensions: int = 768) -> DataFrame:
    """Violations ``(table_name, row_id, rule)`` of the corpus schema: checks, keys and references. A null breaks only the
    rules that ask for a value. Empty tables have none."""
    return keyed_audit(documents, chunks, dimensions).select("table_name", "row_id", "rule")


def keyed_audit(documents: DataFrame, chunks: DataFrame, dimensions: int = 768) -> DataFrame:
    """``audit_schema`` with the ``kind`` of each rule and the ``key`` of the rows it was told for, to be patched later."""
    return _audit(_keys(documents, chunks), documents, dimensions)


def patch_audit(violations: DataFrame, documents: DataFrame, chunks: DataFrame, changed_documents: DataFrame, changed_chunks: DataFrame, dimensions: int = 768) -> DataFrame:
    """``keyed_audit`` of tables that have changed, from ``violations``, that of before. The changed rows are those that are
    new and those that are gone. Only rows that share a key with one of them are looked at again: the same row, the same hash, the same
    place in a document, the chunks of a document that came or went. All else stays as it was told. Without changes nothing is
    looked at."""
    changed = _keys(changed_documents, changed_chunks)
    touched = [df.select(F.lit(kind).alias("kind"), "key") for kind, df in changed.items()]
    touched.append(changed["document"].select(F.lit("chunk_document").alias("kind"), "key"))
    touched = reduce(DataFrame.union, touched).distinct()
    again = {kind: df.join(touched.where(F.col("kind") == kind).select("key"), "key", "left_semi") for kind, df in _keys(documents, chunks).items()}
    return violations.join(touched, ["kind", "key"], "left_anti").unionByName(_audit(again, documents, dimensions))


def reconcile_chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose chunks_count is not the number of their chunks, or which have none. A null count is not held
    against the number; repeated documents are each told."""
    actual = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("actual"))
    told = documents.select("id", F.col("chunks_count").cast("long").alias("declared")).join(actual, "id", "left")
    return told.select("id", "declared", F.coalesce("actual", F.lit(0).cast("long")).alias("actual")).where("declared <> actual or actual = 0")
