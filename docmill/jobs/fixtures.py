"""The given tables seen as received files, corpus, vectors and golden cases.

Each view is one SELECT in the SQL that Spark and DuckDB share; only hashing and lists differ, which
the dialect says. In the text a table stands in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"


def _sha(x: str, duck: bool) -> str:
    return f"sha256({x})" if duck else f"sha2({x}, 256)"


def _uuid(digest: str) -> str:
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def markdown_sql() -> str:
    """The Markdown text of a document."""
    v = "(CAST(floor(doc_id / 20) AS BIGINT) % 4)"
    fence = f"{NL} || {NL} || '```' || {NL} || '# not heading' || {NL} || {NL} || '- no' || {NL} || '```'"
    table = f"{NL} || {NL} || '| a | b |' || {NL} || '|---|---|' || {NL} || '| 1 | 2 |'"
    items = f"{NL} || {NL} || '#### deep' || {NL} || {NL} || '- one' || {NL} || '- two'"
    front = f"CASE WHEN {v} = 0 THEN '---' || {NL} || 'id: ' || CAST(doc_id AS STRING) || {NL} || '---' || {NL} ELSE '' END"
    body = f"'# ' || source || {NL} || {NL} || '## ' || lang || {NL} || {NL} || replace(text, {NL}, {NL} || {NL})"
    return f"({front} || {body} || CASE {v} WHEN 1 THEN {fence} WHEN 2 THEN {table} WHEN 3 THEN {items} ELSE '' END)"


def edited_sql() -> str:
    """Each document twice, before (even numbers) and after (odd ones): every ninth has a paragraph more at its end."""
    more = f"CASE WHEN n = 1 AND doc_id % 9 = 4 THEN {NL} || {NL} || 'A paragraph that was added to document ' || CAST(doc_id AS STRING) || '.' ELSE '' END"
    return f"SELECT doc_id * 2 + n AS doc_id, {markdown_sql()} || {more} AS text FROM <documents> CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) AS two"


def received_sql() -> str:
    m, i, md = "(doc_id % 20)", "CAST(doc_id AS STRING)", markdown_sql()
    back = "chr(92)"
    names = f"""CASE {m} WHEN 0 THEN 'C:' || {back} || 'uploads' || {back} || 'report_' || {i} || '.md' WHEN 1 THEN '../../r/notes_' || {i} || '.txt'
      WHEN 2 THEN 'report.exe' WHEN 3 THEN 'statement_' || {i} || '.PDF' WHEN 4 THEN '..' WHEN 5 THEN 'a' || {NL} || 'b_' || {i} || '.md'
      WHEN 6 THEN 'x_' || {i} || '.md' WHEN 7 THEN 'x_' || {i} || '.md' WHEN 8 THEN 'x_' || {i} || '.txt' WHEN 9 THEN 'x_' || {i} || '.txt'
      WHEN 10 THEN 'x_' || {i} || '.txt' WHEN 11 THEN 'x_' || {i} || '.pdf'
      ELSE CASE WHEN doc_id % 2 = 0 THEN 'annual-report_' || {i} || '.md' ELSE 'quarterly_results_' || {i} || '.txt' END END"""
    mimes = f"""CASE {m} WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'Text/Plain; charset=utf-8' WHEN 3 THEN 'application/pdf' WHEN 5 THEN 'text/markdown'
      WHEN 6 THEN 'application/octet-stream' WHEN 7 THEN 'application/pdf' WHEN 11 THEN 'application/pdf'
      ELSE CASE WHEN {m} >= 12 AND doc_id % 2 = 0 THEN 'text/markdown' ELSE 'text/plain' END END"""
    body = f"""CASE WHEN {m} IN (0, 5) OR ({m} >= 12 AND doc_id % 2 = 0) THEN {md} WHEN {m} = 3 THEN '%PDF-1.7' || {NL} || text WHEN {m} = 8 THEN ''
      WHEN {m} = 9 THEN 'a' || chr(0) || text WHEN {m} = 10 THEN '  ' || {NL} || ' '
      WHEN {m} >= 12 AND doc_id % 3 = 0 THEN replace(text, {NL}, chr(13) || {NL}) ELSE text END"""
    return f"""SELECT doc_id, {i} AS doc_key, doc_id AS arrival_seq, {names} AS filename, {mimes} AS mime_type, {body} AS body,
      CASE WHEN doc_id % 7 = 0 THEN '  ' || source || ' ' END AS title, CAST(NULL AS STRING) AS source_name,
      CASE WHEN doc_id % 13 = 0 THEN 'ftp://example.com/' || {i} ELSE 'https://example.com/d/' || {i} END AS source_url,
      CASE WHEN doc_id % 11 = 0 THEN '2026-02-30' ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') END AS published_at,
      '{{"lang":"' || lang || '",' || CASE WHEN doc_id % 17 = 0 THEN '"STATUS":1,' ELSE '' END || '"n":' || CAST(n_chars AS STRING) || '}}' AS metadata
    FROM <documents>"""


def corpus_documents_sql(duck: bool) -> str:
    """All documents as corpus rows, with schema faults by the number of the document."""
    sha = _sha("text", duck)
    return f"""SELECT doc_id, {_uuid(_sha("'document:' || " + _sha('text', duck), duck))} AS id,
      CASE WHEN doc_id % 50 = 2 THEN 'pending' ELSE 'indexed' END AS status, CASE WHEN doc_id % 50 = 4 THEN '  ' ELSE 'Title ' || source END AS title,
      'd_' || CAST(doc_id AS STRING) || '.txt' AS original_filename, CASE WHEN doc_id % 50 = 6 THEN 'image/png' ELSE 'text/plain' END AS mime_type, {sha} AS sha256,
      CAST(CASE WHEN doc_id % 50 = 8 THEN 51 END AS INT) AS page_count, CAST(n_chars AS INT) AS character_count, CAST(doc_id % 4 + 1 AS INT) AS chunks_count,
      source AS source_name, CASE WHEN doc_id % 50 = 10 THEN 'ftp://x' ELSE 'https://example.com' END AS source_url, DATE '2024-01-01' AS published_at,
      CASE doc_id % 50 WHEN 12 THEN '[1]' WHEN 13 THEN '{{bad' ELSE '{{}}' END AS metadata, TIMESTAMP '2024-01-01 00:00:00' AS created_at
    FROM <documents>"""


def corpus_chunks_sql(duck: bool) -> str:
    """Two chunks for each document, its two halves, with faults; a vector of four values."""
    vector = "CAST([0.5, 0.5, 0.5, 0.5] AS FLOAT[])" if duck else "CAST(array(0.5, 0.5, 0.5, 0.5) AS ARRAY<FLOAT>)"
    own, half = _uuid(_sha("'document:' || " + _sha("text", duck), duck)), "CAST(floor(length(text) / 2) AS INT)"
    return f"""SELECT CAST(doc_id * 2 + n AS STRING) AS id, CASE WHEN doc_id % 50 = 14 THEN 'orphan' ELSE {own} END AS document_id,
      CAST(CASE WHEN doc_id % 50 = 16 THEN -1 WHEN doc_id % 50 = 18 THEN 0 ELSE n END AS INT) AS chunk_index, CASE WHEN doc_id % 50 = 20 THEN ' ' WHEN n = 0 THEN substr(text, 1, {half}) ELSE substr(text, {half} + 1) END AS content,
      CAST(CASE WHEN doc_id % 50 = 22 THEN 2401 ELSE least(n_chars, 2400) END AS INT) AS character_count, CAST(NULL AS INT) AS provider_token_count, CAST(NULL AS INT) AS page_index,
      CAST(NULL AS STRING) AS page_label, CASE WHEN doc_id % 50 = 24 THEN '' END AS section, false AS contains_table, {vector} AS embedding, 'm' AS embedding_model,
      CAST(CASE WHEN doc_id % 50 = 26 THEN 3 ELSE 4 END AS INT) AS embedding_dimensions
    FROM <documents> CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) AS two"""


def pages_sql() -> str:
    return "SELECT CAST(conv_id AS STRING) AS doc_key, CAST(turn + 1 AS INT) AS page_index, role AS page_label, text AS content FROM <conversations>"


def edged_pages_sql() -> str:
    """Pages with edges of four kinds: equal lines and page numbers; numbers with their total; Roman numbers, and a foot whose number is no
    page number; a date that stays, and a foot whose words change."""
    page, conv, roman = "CAST(turn + 1 AS STRING)", "CAST(conv_id AS STRING)", "CASE turn + 1 WHEN 1 THEN 'i' WHEN 2 THEN 'ii' WHEN 3 THEN 'iii' WHEN 4 THEN 'iv' WHEN 5 THEN 'v' WHEN 6 THEN 'VI' WHEN 7 THEN 'vii' WHEN 8 THEN 'viii' WHEN 9 THEN 'ix' ELSE 'x' END"
    head = f"CASE conv_id % 4 WHEN 0 THEN 'Report ' || {conv} WHEN 1 THEN 'Report, page ' || {page} WHEN 2 THEN 'Annex ' || {roman} ELSE 'As of 2024-01-05, sheet ' || CAST(turn + 11 AS STRING) END"
    foot = f"CASE conv_id % 4 WHEN 0 THEN 'page ' || {page} WHEN 1 THEN {page} || '/' || CAST(max(turn) OVER (PARTITION BY conv_id) + 1 AS STRING) WHEN 2 THEN 'Sum ' || CAST(turn * 7 AS STRING) ELSE 'by ' || role END"
    return f"""SELECT CAST(conv_id AS STRING) AS doc_key, CAST(turn + 1 AS INT) AS page_index, {head} || {NL} || text || {NL} || {foot} AS content FROM <conversations>"""


def golden_sql(duck: bool) -> str:
    """Queries mixed from neighbouring vectors, with the chunks that they should find."""
    if duck:
        mixed = "list_transform(range(1, len(a.embedding) + 1), lambda k: CAST(a.embedding[k] AS DOUBLE) * x + CAST(coalesce(b.embedding[k], 0) AS DOUBLE) * y)"
        want = "CASE kind WHEN 'answerable' THEN [CAST(i AS STRING)] WHEN 'ambiguous' THEN [CAST(i AS STRING), CAST(i + 1 AS STRING)] ELSE CAST([] AS VARCHAR[]) END"
    else:
        mixed = "zip_with(a.embedding, b.embedding, (p, q) -> CAST(p AS DOUBLE) * x + CAST(coalesce(q, 0) AS DOUBLE) * y)"
        want = "CASE kind WHEN 'answerable' THEN array(CAST(i AS STRING)) WHEN 'ambiguous' THEN array(CAST(i AS STRING), CAST(i + 1 AS STRING)) ELSE CAST(array() AS ARRAY<STRING>) END"
    return f"""SELECT i AS query_id, kind, {want} AS expected_chunk_ids, CAST(5 AS INT) AS top_k, {mixed} AS embedding
    FROM (SELECT vec_id AS i, CASE vec_id % 10 WHEN 0 THEN 'answerable' WHEN 5 THEN 'ambiguous' ELSE 'out_of_corpus' END AS kind,
        CAST(CASE vec_id % 10 WHEN 0 THEN 0.8 WHEN 5 THEN 1 ELSE -1 END AS DOUBLE) AS x, CAST(CASE vec_id % 10 WHEN 0 THEN 0.6 WHEN 5 THEN 1 ELSE 0 END AS DOUBLE) AS y
      FROM <embeddings> WHERE vec_id % 10 IN (0, 5, 7)) AS c
    JOIN <embeddings> AS a ON a.vec_id = i JOIN <embeddings> AS b ON b.vec_id = i + 1"""


def vector_chunks_sql() -> str:
    return """SELECT CAST(vec_id AS STRING) AS chunk_id, CAST(label AS STRING) AS document_id, CAST(vec_id AS INT) AS chunk_index, embedding,
      'Text of ' || CAST(vec_id AS STRING) AS content, CAST(NULL AS INT) AS page_index, CAST(NULL AS STRING) AS page_label, 'Part ' || CAST(label AS STRING) AS section FROM <embeddings>"""


def vector_documents_sql() -> str:
    return "SELECT DISTINCT CAST(label AS STRING) AS id, 'Title ' || CAST(label AS STRING) AS title FROM <embeddings>"


def bad_vectors_sql(duck: bool) -> str:
    """Vectors of which some are short, zero or not a number."""
    if duck:
        cut, zero, nan = "embedding[1:63]", "list_transform(embedding, lambda e: CAST(0 AS FLOAT))", "list_concat([CAST('NaN' AS FLOAT)], embedding[2:])"
    else:
        cut, zero, nan = "slice(embedding, 1, 63)", "transform(embedding, e -> CAST(0 AS FLOAT))", "concat(array(CAST('NaN' AS FLOAT)), slice(embedding, 2, 63))"
    m = "vec_id % 50"
    return f"""SELECT vec_id, CAST(vec_id AS STRING) AS chunk_id, label, CASE {m} WHEN 1 THEN {cut} WHEN 2 THEN {zero} WHEN 3 THEN {nan} ELSE embedding END AS embedding,
      'm' AS embedding_model, 64 AS embedding_dimensions FROM <embeddings>"""


_TABLE = re.compile(r"<(documents|pages|events|embeddings|benchmark|conversations)>")


def in_duckdb(sql: str) -> str:
    return _TABLE.sub(r"\1", sql)


def in_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in sorted(set(_TABLE.findall(sql)))}
    if not tables:
        return spark.sql(sql)
    # spark.sql formats its text: other braces are doubled
    return spark.sql(_TABLE.sub(r"{\1}", sql.replace("{", "{{").replace("}", "}}")), **tables)


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_spark(spark, sf_dir, received_sql()).withColumn("content", F.encode("body", "UTF-8"))
