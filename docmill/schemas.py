"""Schemas, limits and codes of the document corpus."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits of the ingestion contract.
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_FILENAME_CHARS = 255
MAX_TITLE_CHARS = 200
MAX_SOURCE_NAME_CHARS = 200
MAX_METADATA_BYTES = 4096
MAX_METADATA_KEYS = 20
MAX_METADATA_ITEMS = 20
MAX_TEXT_CHARS = 500_000
MAX_PAGES = 50
TOP_K_DEFAULT, TOP_K_MAX, THRESHOLD = 5, 10, 0.60
MAX_QUESTION_CHARS = 2000
EXTENSIONS = {".md": "text/markdown", ".txt": "text/plain", ".pdf": "application/pdf"}
RESERVED_KEYS = (
    "character_count", "chunks_count", "created_at", "embedding", "embedding_dimensions", "embedding_model", "id", "mime_type",
    "original_filename", "page_count", "published_at", "sha256", "source", "source_name", "source_url", "status", "title",
)

#: The white space that str.strip() takes, for a character class. ASCII \s is not enough.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

RECEIVED = T.StructType(
    [
        T.StructField("doc_key", T.StringType()), T.StructField("arrival_seq", T.LongType()), T.StructField("filename", T.StringType()),
        T.StructField("mime_type", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("title", T.StringType()),
        T.StructField("source_name", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("published_at", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
DOCUMENTS_DDL = (
    "id string, status string, title string, original_filename string, mime_type string, sha256 string, page_count int, "
    "character_count int, chunks_count int, source_name string, source_url string, published_at date, metadata string, created_at timestamp"
)
CHUNKS_DDL = (
    "id string, document_id string, chunk_index int, content string, character_count int, provider_token_count int, page_index int, "
    "page_label string, section string, contains_table boolean, embedding array<float>, embedding_model string, embedding_dimensions int"
)
BLOCK_DDL = "array<struct<kind:string,content:string,section:string,heading_level:int>>"
