"""The registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.text import chunk_id, document_id, strip
from docmill.jobs import fixtures as X
from docmill.jobs.ingest import extracted_once
from docmill.operators import chunking, corpus, evaluation, extraction, retrieval, validation, vectors
from docmill.sources.scratch import written_once

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _doc(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_key").cast("long")).drop("doc_key")


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return extraction.extract(validation.validate(X.received(spark, sf_dir))[0])


@_query
def validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = validation.judge(X.received(spark, sf_dir))
    return judged.select("doc_id", "original_filename", F.col("declared_mime").alias("mime"), F.col("clean_title").alias("title"), "error_code", "error_field")


@_query
def rejection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rejection_summary(extraction.screen(X.received(spark, sf_dir)).where("error_code is not null"))


@_query
def mime_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.received(spark, sf_dir)
    return rows.select("doc_id", validation.normalized_mime(F.col("mime_type")).alias("mime"), validation.extension(F.col("filename")).alias("extension"), validation.content_sha256(F.col("content")).alias("sha256"))


@_query
def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.array("url", F.replace("url", F.lit("://"), F.lit(":///")), F.regexp_replace("url", "^(https?://[^/]*)", "$1:99999"), *(F.regexp_replace("url", "^(https?://)[^/?#]*", f"$1[{host}]") for host in ("1.2.3.4", "abc", "2001:db8::7", "v1.a")))).alias("url"))
    return pages.select("page_id", "url", F.coalesce(validation.source_url_error(F.col("url")), F.lit("ok")).alias("verdict"))


@_query
def date_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.received(spark, sf_dir)
    return rows.select("doc_id", validation.published_date(F.col("published_at")).alias("published_at"), validation.published_at_error(F.col("published_at")).alias("error_code"))


@_query
def metadata_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.when(F.col("event_id") % 5 == 0, F.replace("props", F.lit('"k"'), F.lit('" Title "'))).when(F.col("event_id") % 5 == 1, F.lit("[1]")).otherwise(F.col("props"))
    return events.select("event_id", validation.metadata_verdict(raw).alias("v")).select("event_id", "v.error_code", "v.canonical_json")


@_query
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.validate(X.received(spark, sf_dir))[0].withColumn("text", extraction.decode_text(F.col("content")))
    return _doc(rows.select("doc_key", extraction.extract_error(F.col("mime_type"), F.col("text")).alias("error_code"), F.length("text").cast("long").alias("characters"), F.md5(F.col("text").cast("binary")).alias("text_md5")))


@_query
def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.in_spark(spark, sf_dir, f"SELECT doc_id, replace(text, '.' || {X.NL}, '.' || {X.NL} || ' ' || {X.NL}) AS text FROM <documents>")
    each = docs.select("doc_id", F.posexplode(extraction.plain_text_blocks(F.col("text"))).alias("position", "b"))
    return each.select("doc_id", F.col("position").cast("long").alias("position"), extraction.block_kind(F.col("b")).alias("kind"), F.md5(F.col("b").cast("binary")).alias("content_md5"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.in_spark(spark, sf_dir, f"SELECT CAST(doc_id AS STRING) AS doc_key, {X.markdown_sql()} AS text FROM <documents>")
    return extraction.explode_blocks(docs.withColumn("blocks", extraction.blocks_of(F.lit("text/markdown"), F.col("text"))))


@_query
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _markdown(spark, sf_dir)
    return _doc(blocks.select("doc_key", F.col("position").cast("long").alias("position"), "kind", F.md5(F.col("content").cast("binary")).alias("content_md5"), "section", F.col("heading_level").cast("long").alias("heading_level")))


@_query
def section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = extraction.section_paths(_markdown(spark, sf_dir).drop("section"))
    return _doc(blocks.select("doc_key", F.col("position").cast("long").alias("position"), "section"))


@_query
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(_extracted(spark, sf_dir)[0].select("doc_key", "title"))


@_query
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.assemble_pages(X.in_spark(spark, sf_dir, X.pages_sql()))


@_query
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = extraction.strip_repeated_edges(X.in_spark(spark, sf_dir, X.edged_pages_sql()))
    return stripped.select("doc_key", F.col("page_index").cast("long").alias("page_index"), F.md5(F.col("content").cast("binary")).alias("content_md5"), "head_gone", "foot_gone")


@_query
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(chunking.segment_blocks(_markdown(spark, sf_dir)).select("doc_key", F.col("position").cast("long").alias("position"), F.col("segment").cast("long").alias("segment")))


@_query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = chunking.split_sentences(F.col("text"))
    return docs.select("doc_id", F.size(s).cast("long").alias("sentences"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences_md5"))


@_query
def hard_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = chunking.hard_cut(F.col("text"), 700)
    return docs.select("doc_id", F.size(cut).cast("long").alias("pieces"), F.md5(F.array_join(cut, "|").cast("binary")).alias("pieces_md5"))


@_query
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _ = chunking.chunk(_markdown(spark, sf_dir))
    return _doc(chunks.select("doc_key", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "character_count")), "section", "contains_table", F.md5(F.col("content").cast("binary")).alias("content_md5")))


@_query
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, _ = chunking.chunk(_markdown(spark, sf_dir))
    return _doc(chunks.groupBy("doc_key").agg(F.count("*").alias("chunks"), F.sum("overlap_characters").cast("long").alias("overlap"), F.max("overlap_characters").cast("long").alias("most_overlap")))


def _damaged(chunks: DataFrame) -> DataFrame:
    """Faults by the number of the document: no chunks at all, the first one missing, a table row cut out, the last
    chunk told twice."""
    m = F.col("doc_key").cast("long") % 12
    last = F.max("chunk_index").over(Window.partitionBy("doc_key"))
    some = chunks.where(~((m == 1) | ((m == 2) & (F.col("chunk_index") == 0))))
    some = some.withColumn("content", F.when(m == 3, F.replace("content", F.lit("\n| 1 | 2 |"), F.lit(""))).otherwise(F.col("content"))).withColumn("character_count", F.length("content"))
    again = chunks.withColumn("last", last).where((m == 4) & (F.col("chunk_index") == F.col("last"))).withColumn("chunk_index", F.col("last") + 1).drop("last")
    return some.unionByName(again)


@_query
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as they are cut, and damaged ones."""
    blocks = written_once(_markdown(spark, sf_dir), "blocks")
    chunks, rejected = chunking.parted(written_once(chunking.cut(blocks), "chunks"))
    cut, damaged = (chunking.audit_chunks(c, blocks=blocks, rejected=rejected) for c in (chunks, _damaged(chunks)))
    told = cut.withColumn("chunks", F.lit("cut")).unionByName(damaged.withColumn("chunks", F.lit("damaged")))
    return _doc(told.withColumns({c: F.col(c).cast("long") for c in ("chunk_index", "position")}))


@_query
def chunk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_config_sweep(_markdown(spark, sf_dir))


@_query
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one table of its lines, cut at 600 characters; rows that do not fit reject it."""
    rows = X.in_spark(spark, sf_dir, f"SELECT CAST(doc_id AS STRING) AS doc_key, '| text |' || {X.NL} || '|---|' || {X.NL} || '| ' || replace(text, '.', ' |' || {X.NL} || '| ') || ' |' AS content FROM <documents>")
    none = F.lit(None).cast("string")
    blocks = rows.select("doc_key", F.lit(0).alias("position"), F.lit(None).cast("int").alias("page_index"), none.alias("page_label"), F.lit("table").alias("kind"), "content", none.alias("section"), F.lit(None).cast("int").alias("heading_level"))
    chunks, rejected = chunking.chunk(blocks, chunking.ChunkConfig(600, 600, 0, 0))
    told = chunks.groupBy("doc_key").agg(F.count("*").alias("chunks"), F.count_if(F.col("content").startswith("| text |\n|---|")).alias("with_head"))
    return _doc(told.unionByName(rejected.select("doc_key", F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("with_head"))))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("doc_key"), F.col("doc_id").alias("arrival_seq"), "lang", validation.content_sha256(F.col("text").cast("binary")).alias("sha256"))


@_query
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(corpus.dedup_batch(_arrivals(spark, sf_dir)).select("doc_key", "sha256"))


def _corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_spark(spark, sf_dir, X.corpus_documents_sql(False))


def _corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_spark(spark, sf_dir, X.corpus_chunks_sql(False))


@_query
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive; those in English are known already."""
    known = _arrivals(spark, sf_dir).where("lang = 'en'").select("sha256", document_id(F.col("sha256")).alias("id")).distinct()
    return _doc(corpus.resolve_against_corpus(_arrivals(spark, sf_dir), known))


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = _corpus_documents(spark, sf_dir)
    ids = documents.where("doc_id % 6 = 0").select("id").union(documents.where("doc_id % 10 = 0").select(F.concat(F.lit("no-"), "id")))
    return corpus.delete_documents(documents, _corpus_chunks(spark, sf_dir), ids)


@_query
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, chunks, _ = _deleted(spark, sf_dir)
    return documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("row_id")).union(chunks.select(F.lit("chunk"), "id"))


@_query
def delete_not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[2]


@_query
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _corpus_documents(spark, sf_dir)
    first = documents.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    return corpus.list_documents(documents.join(first, ["id", "doc_id"], "left_semi"), 20, 40).select("id", "status", "mime_type")


def _dated(documents: DataFrame) -> DataFrame:
    return documents.withColumn("created_at", F.expr("created_at + make_dt_interval(0, 0, cast(doc_id % 997 as int))"))


@_query
def list_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page but one of the whole list."""
    documents = _corpus_documents(spark, sf_dir)
    first = documents.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    own = _dated(documents.join(first, ["id", "doc_id"], "left_semi"))
    return corpus.list_deep(own, 20, own.count() - 27, 50).select("id", "status", "mime_type", F.col("created_at").cast("string").alias("created_at"))


@_query
def list_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.count_documents(_corpus_documents(spark, sf_dir))


@_query
def get_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _corpus_documents(spark, sf_dir)
    told = corpus.get_documents(documents, documents.where("doc_id % 8 = 0").select("id"))
    return told.select("id", "title", "sha256", F.col("source.name").alias("source_name"), F.col("source.url").alias("source_url"))


@_query
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    return _doc(rows.select("doc_key", document_id(F.col("sha256")).alias("document_id"), chunk_id(F.col("sha256"), F.lit(3)).alias("chunk_id")))


@_query
def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.audit_schema(_corpus_documents(spark, sf_dir), _corpus_chunks(spark, sf_dir), 4)


@_query
def schema_audit_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all rows, from an older one of other rows: since then some were added, and others are gone."""
    documents, chunks = _corpus_documents(spark, sf_dir), _corpus_chunks(spark, sf_dir)
    of = F.floor(F.col("id").cast("long") / 2)
    ghosts = documents.where("doc_id % 11 = 5").withColumn("id", F.concat(F.lit("ghost-"), "id"))
    old = corpus.keyed_audit(documents.where("doc_id % 7 <> 3").unionByName(ghosts), chunks.where(of % 7 != 3), 4)
    now = corpus.patch_audit(old, documents, chunks, documents.where("doc_id % 7 = 3").unionByName(ghosts), chunks.where(of % 7 == 3), 4)
    return now.select("table_name", "row_id", "rule")


@_query
def reindex_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents before and after some of them got a paragraph more: which vectors move, which texts are new."""
    both = X.in_spark(spark, sf_dir, X.edited_sql()).select(F.col("doc_id").cast("string").alias("doc_key"), "text")
    blocks = extraction.explode_blocks(both.withColumn("blocks", extraction.blocks_of(F.lit("text/markdown"), F.col("text"))))
    cut = written_once(chunking.chunk(blocks)[0].select(F.concat_ws("/", "doc_key", "chunk_index").alias("chunk_id"), F.col("doc_key").cast("long").alias("version"), "content"), "versions")
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.lit(0.5).cast("float"))
    old = cut.where("version % 2 = 0").withColumns({"embedding": vector, "embedding_model": F.lit("m"), "embedding_dimensions": F.lit(4)})
    moved, pending, gone = vectors.reindex(old, cut.where("version % 2 = 1"), "m", 4)
    key = F.md5(F.col("content").cast("binary")).alias("content_md5")
    told = moved.groupBy(key).agg(F.lit("moved").alias("part"), F.count("*").alias("chunks")).unionByName(pending.select(key, F.lit("embed").alias("part"), "chunks"))
    return told.unionByName(gone.agg(F.lit("gone").alias("part"), F.count("*").alias("chunks")).withColumn("content_md5", F.lit(None).cast("string")))


@_query
def count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reconcile_chunk_counts(_corpus_documents(spark, sf_dir), _corpus_chunks(spark, sf_dir))


def _bad_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_spark(spark, sf_dir, X.bad_vectors_sql(False))


@_query
def vector_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad_vectors(spark, sf_dir).select("vec_id", vectors.vector_error(F.col("embedding"), 64).alias("error"))


@_query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tripled = F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))
    unit = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vectors.l2_normalize(tripled).alias("v"))
    return unit.select("vec_id", F.round(vectors.squared_norm(F.col("v")), 4).alias("squared_norm"), F.round(F.col("v")[0].cast("double"), 4).alias("first"))


@_query
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.index_versions(_corpus_chunks(spark, sf_dir).withColumn("embedding_dimensions", F.col("embedding_dimensions").cast("long")))


@_query
def attach_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _bad_vectors(spark, sf_dir)
    drafts = v.select("chunk_id", (F.floor(F.col("vec_id") / 7)).cast("string").alias("document_id"))
    good, withheld = vectors.attach_embeddings(drafts, v.where("vec_id % 90 <> 11"), 64)
    return good.groupBy("document_id").agg(F.count("*").alias("chunks")).withColumn("missing", F.lit(0).cast("long")).unionByName(withheld.withColumn("chunks", F.lit(0).cast("long")))


@_query
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _bad_vectors(spark, sf_dir)
    have = v.where("vec_id % 3 <> 0").withColumn("embedding_model", F.when(F.col("vec_id") % 5 == 0, "old").otherwise("m"))
    return vectors.pending_embeddings(v.select("chunk_id"), have, "m", 64)


@_query
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN '  ' WHEN item_id % 7 = 0 THEN repeat(text, 20) ELSE '  ' || text END AS question, CAST(CASE WHEN item_id % 11 = 0 THEN 11 END AS INT) AS top_k FROM <benchmark>"
    good, bad = retrieval.validate_queries(X.in_spark(spark, sf_dir, sql))
    return good.select("query_id", F.length("question").cast("long").alias("characters"), F.col("top_k").cast("long").alias("top_k"), F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("query_id", F.lit(None).cast("long").alias("characters"), F.lit(None).cast("long").alias("top_k"), "error_code")
    )


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_spark(spark, sf_dir, X.golden_sql(False))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_spark(spark, sf_dir, X.vector_chunks_sql())


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents but one, which was deleted."""
    return X.in_spark(spark, sf_dir, X.vector_documents_sql()).where("id <> '9'")


def _hits(spark: SparkSession, sf_dir: str, threshold: float = 0.60, documents: DataFrame | None = None) -> DataFrame:
    return retrieval.retrieve(_chunks(spark, sf_dir), _documents(spark, sf_dir) if documents is None else documents, _golden(spark, sf_dir), threshold)


def _hits_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits, for queries that read them several times."""
    return written_once(_hits(spark, sf_dir), "hits")


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_spark(spark, sf_dir, X.vector_documents_sql())


@_query
def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id", "similarity")


@_query
def query_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gate_queries(_golden(spark, sf_dir), _hits(spark, sf_dir))


def _context(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    return retrieval.build_context(hits, _chunks(spark, sf_dir), _documents(spark, sf_dir))


@_query
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, _hits(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "title", "section", "content")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = "(SELECT count(*) FROM <embeddings>)"
    sql = f"""SELECT vec_id AS query_id, CASE vec_id % 10 WHEN 0 THEN 'answered' WHEN 5 THEN 'clarification_needed' ELSE CASE WHEN vec_id % 20 = 7 THEN 'answered' ELSE 'insufficient_context' END END AS status,
      array(CAST(vec_id AS STRING), CAST((vec_id + 250) % {n} AS STRING)) AS cited_chunk_ids FROM <embeddings> WHERE vec_id % 10 IN (0, 5, 7)"""
    return X.in_spark(spark, sf_dir, sql)


def _checked(spark: SparkSession, sf_dir: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return retrieval.check_citations(_answers(spark, sf_dir), hits, _documents(spark, sf_dir))


@_query
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, invalid = _checked(spark, sf_dir, _hits_once(spark, sf_dir))
    return valid.withColumn("valid", F.lit(True)).unionByName(invalid.withColumn("valid", F.lit(False)))


@_query
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits_once(spark, sf_dir)
    rows = retrieval.build_citations(_checked(spark, sf_dir, hits)[0], _context(spark, sf_dir, hits))
    return rows.select("query_id", "chunk_id", "document_id", "title", "section", "excerpt", "similarity")


@_query
def answer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits_once(spark, sf_dir)
    return retrieval.check_answers(_answers(spark, sf_dir), _checked(spark, sf_dir, hits)[0], hits)


def _sweep(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    hits = _hits(spark, sf_dir, min(evaluation.THRESHOLDS), _every(spark, sf_dir) if documents is None else documents)
    return evaluation.threshold_sweep(hits, _golden(spark, sf_dir))


@_query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = ("hit_rate", "abstention", "alternatives")
    return _sweep(spark, sf_dir).select("threshold", *[F.round(c, 4).alias(c) for c in rates])


@_query
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.select_threshold(_sweep(spark, sf_dir))


@_query
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evaluation.compare_versions(_sweep(spark, sf_dir), _sweep(spark, sf_dir, _documents(spark, sf_dir)))
    return told.select("threshold", *[F.round(c, 4).alias(c) for c in told.columns if c != "threshold"])


@_query
def citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evaluation.citation_precision(*_checked(spark, sf_dir, _hits_once(spark, sf_dir)))
    return told.select("citations", "valid", F.round("precision", 4).alias("precision"))


@_query
def ingest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From received files to blocks by kind: validation, extraction and dedup in one job."""
    documents, _ = extracted_once(X.received(spark, sf_dir))
    blocks = extraction.explode_blocks(corpus.dedup_batch(documents))
    return blocks.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum(F.length(strip(F.col("content")))).alias("characters"))
