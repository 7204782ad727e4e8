"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from docmill.jobs import fixtures as X

_WS = r"[ \t\n\x0b\x0c\r]"
_D = X.in_duckdb


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


#: Judged and extracted files: r (received), j (with error_code), e (accepted, with text).
_RECEIVED = f"WITH RECURSIVE r AS ({_D(X.received_sql())})"
_JUDGED = f"""{_RECEIVED}, n AS (
  SELECT *, regexp_replace(regexp_extract(replace(filename, chr(92), '/'), '([^/]*)$', 1), '[\\x00-\\x1f\\x7f]', '_', 'g') AS original_filename,
    lower(trim(split_part(mime_type, ';', 1))) AS mime, trim(title) AS clean_title FROM r
), x AS (
  SELECT *, CASE lower(regexp_extract(original_filename, '[^.](\\.[^.]*)$', 1)) WHEN '.md' THEN 'text/markdown' WHEN '.txt' THEN 'text/plain' WHEN '.pdf' THEN 'application/pdf' END AS expected FROM n
), j AS (
  SELECT *, CASE WHEN original_filename IN ('', '.', '..') OR length(original_filename) > 255 THEN 'invalid_filename'
    WHEN body = '' THEN 'empty_file' WHEN expected IS NULL THEN 'unsupported_file_extension'
    WHEN mime NOT IN ('text/markdown', 'text/plain', 'application/pdf') THEN 'unsupported_mime_type' WHEN mime <> expected THEN 'file_type_mismatch'
    WHEN mime = 'application/pdf' AND NOT starts_with(body, '%PDF-') THEN 'file_type_mismatch' WHEN mime <> 'application/pdf' AND contains(body, chr(0)) THEN 'unsafe_file_content'
    WHEN contains(metadata, '"STATUS"') THEN 'metadata_reserved_key' WHEN clean_title = '' OR length(clean_title) > 200 THEN 'invalid_title'
    WHEN NOT regexp_matches(source_url, '^https?://[^/]') THEN 'invalid_source_url' WHEN try_cast(published_at AS DATE) IS NULL THEN 'invalid_published_at' END AS error_code FROM x
), e AS (
  SELECT *, replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content FROM j WHERE error_code IS NULL
), t AS (
  SELECT *, CASE WHEN mime = 'application/pdf' THEN 'unsupported_extraction_type' WHEN NOT regexp_matches(content, '[^ \\t\\n\\x0b\\x0c\\r]') THEN 'empty_extracted_text'
    WHEN length(content) > 500000 THEN 'extracted_text_too_large' END AS extract_code,
    coalesce(clean_title, CASE WHEN mime = 'text/markdown' THEN source_of(doc_id) END, replace(replace(regexp_replace(original_filename, '\\.[^.]*$', ''), '_', ' '), '-', ' ')) AS new_title FROM e
)"""
_JUDGED = _JUDGED.replace("source_of(doc_id)", "(SELECT d.source FROM documents AS d WHERE d.doc_id = e.doc_id)")
_FIELD = "CASE WHEN error_code = 'invalid_title' THEN 'title' WHEN error_code = 'invalid_source_url' THEN 'source_url' WHEN error_code = 'invalid_published_at' THEN 'published_at' WHEN starts_with(error_code, 'metadata') THEN 'metadata' WHEN error_code IS NOT NULL THEN 'file' END"


def _kind(block: str) -> str:
    cells = f"string_split(trim(trim(string_split({block}, chr(10))[2]), '|'), '|')"
    return f"""CASE WHEN len(string_split({block}, chr(10))) >= 2 AND contains(string_split({block}, chr(10))[1], '|') AND contains(string_split({block}, chr(10))[2], '|')
      AND list_bool_and(list_transform({cells}, lambda c: regexp_full_match(trim(c), ':?-{{3,}}:?'))) THEN 'table'
      WHEN regexp_matches({block}, '^[ \\t]*([-+*]|[0-9]+[.)])[ \\t]+[^ \\t\\n]') THEN 'list' ELSE 'paragraph' END"""


def _markdown(source: str) -> str:
    """Line by line, with the state of the fence: ``md(doc_id, position, kind, content, section, heading_level)``."""
    return f"""lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ({source}))
), front AS (
  SELECT a.doc_id, min(b.i) AS stop FROM lines AS a JOIN lines AS b ON a.doc_id = b.doc_id AND b.i > 1 WHERE a.i = 1 AND trim(a.line) = '---' AND trim(b.line) IN ('---', '...') GROUP BY a.doc_id
), walk(doc_id, i, fence, block, open, kind) AS (
  SELECT doc_id, coalesce(stop, 0), '', 0, false, 'skip' FROM (SELECT DISTINCT doc_id FROM lines) LEFT JOIN front USING (doc_id)
  UNION ALL
  SELECT doc_id, i, CASE WHEN fence <> '' THEN CASE WHEN mark <> '' AND mark[1] = fence[1] AND length(mark) >= length(fence) THEN '' ELSE fence END ELSE mark END,
    block + CASE WHEN fence <> '' THEN 0 WHEN mark <> '' OR head THEN 1 WHEN blank OR open THEN 0 ELSE 1 END,
    fence <> '' OR mark <> '' OR NOT (head OR blank), CASE WHEN fence <> '' OR mark <> '' THEN 'text' WHEN head THEN 'heading' WHEN blank THEN 'skip' ELSE 'text' END
  FROM (SELECT w.doc_id, l.i, w.fence, w.block, w.open, regexp_extract(l.line, '^[ \\t]*(`{{3,}}|~{{3,}})', 1) AS mark,
      regexp_matches(l.line, '^#{{1,6}}[ \\t]+.+$') AS head, trim(l.line) = '' AS blank FROM walk AS w JOIN lines AS l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
), raw AS (
  SELECT doc_id, 0 AS block, 'frontmatter' AS kind, string_agg(line, chr(10) ORDER BY i) AS content FROM lines JOIN front USING (doc_id) WHERE i <= stop GROUP BY doc_id
  UNION ALL
  SELECT doc_id, block, any_value(kind), string_agg(line, chr(10) ORDER BY i) FROM walk JOIN lines USING (doc_id, i) WHERE kind <> 'skip' GROUP BY doc_id, block
), leveled AS (
  SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(content, '^(#+)', 1)) END AS heading_level,
    CASE WHEN kind = 'heading' THEN trim(regexp_extract(content, '^#+[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)) END AS name FROM raw
), pathed AS (
  SELECT *, {", ".join(f"max(CASE WHEN heading_level = {k} THEN block END) OVER w AS p{k}, max(CASE WHEN heading_level <= {k} THEN block END) OVER w AS u{k}" for k in range(1, 7))}
  FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING)
), md AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS position, CASE WHEN kind = 'text' THEN {_kind('content')} ELSE kind END AS kind, content, heading_level,
    nullif(concat_ws(' > ', {", ".join(f"(SELECT nullif(h.name, '') FROM leveled AS h WHERE h.doc_id = p.doc_id AND h.block = p.p{k} AND p.p{k} = p.u{k})" for k in range(1, 7))}), '') AS section
  FROM pathed AS p
)"""


_MD_SOURCE = _D(f"SELECT doc_id, {X.markdown_sql()} AS text FROM <documents>")
_MD = "WITH RECURSIVE " + _markdown(_MD_SOURCE)
_PLAIN = _D(f"SELECT doc_id, replace(text, '.' || {X.NL}, '.' || {X.NL} || ' ' || {X.NL}) AS text FROM <documents>")
_SHA = "sha256(text)"
_ID = X._uuid("sha256('document:' || sha256(text))")
_CHUNK_ID = X._uuid("sha256('chunk:' || sha256(text) || ':3')")
_CORPUS = f"WITH d AS ({_D(X.corpus_documents_sql(True))}), c AS ({_D(X.corpus_chunks_sql(True))})"
_BAD = f"WITH v AS ({_D(X.bad_vectors_sql(True))})"
_ERROR = """CASE WHEN len(embedding) <> 64 THEN 'wrong_dimension' WHEN list_bool_or(list_transform(embedding, lambda e: isnan(e) OR isinf(e))) THEN 'non_finite_value'
  WHEN list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))) = 0 THEN 'zero_norm' END"""


def _hits(threshold: float, documents: str) -> str:
    return f"""WITH q AS ({_D(X.golden_sql(True))}), c AS ({_D(X.vector_chunks_sql())}), docs AS ({_D(X.vector_documents_sql())}), live AS (SELECT * FROM docs WHERE {documents}),
s AS (SELECT q.query_id, q.top_k, c.*, list_cosine_similarity(q.embedding, CAST(c.embedding AS DOUBLE[])) AS raw FROM q, c WHERE c.document_id IN (SELECT id FROM live)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, document_id, chunk_index, chunk_id) AS rank FROM s WHERE raw >= {threshold}) WHERE rank <= top_k)"""


_HITS = _hits(0.60, "id <> '9'")
_CITED = f"""{_HITS}, a AS (SELECT vec_id AS query_id, CASE vec_id % 10 WHEN 0 THEN 'answered' WHEN 5 THEN 'clarification_needed' ELSE CASE WHEN vec_id % 20 = 7 THEN 'answered' ELSE 'insufficient_context' END END AS status,
  unnest([CAST(vec_id AS VARCHAR), CAST((vec_id + 250) % (SELECT count(*) FROM embeddings) AS VARCHAR)]) AS chunk_id FROM embeddings WHERE vec_id % 10 IN (0, 5, 7)),
k AS (SELECT DISTINCT a.query_id, a.chunk_id, h.query_id IS NOT NULL AS valid FROM a LEFT JOIN h ON h.query_id = a.query_id AND h.chunk_id = a.chunk_id)"""


def _sweep(documents: str, name: str) -> str:
    levels = "(SELECT unnest([0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75])::DOUBLE AS threshold)"
    return f"""{name} AS (
  SELECT threshold, round(avg(CASE WHEN kind = 'answerable' THEN CAST(matched > 0 AS INT) END), 4) AS hit_rate, round(avg(CASE WHEN kind = 'out_of_corpus' THEN CAST(eligible = 0 AS INT) END), 4) AS abstention,
    round(avg(CASE WHEN kind = 'ambiguous' THEN CAST(matched = expected AS INT) END), 4) AS alternatives
  FROM (SELECT t.threshold, q.query_id, q.kind, len(q.expected_chunk_ids) AS expected, coalesce(eligible, 0) AS eligible, coalesce(matched, 0) AS matched
    FROM q CROSS JOIN {levels} AS t LEFT JOIN (
      SELECT t.threshold, h.query_id, count(*) AS eligible, count_if(list_contains(q.expected_chunk_ids, h.chunk_id)) AS matched
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, document_id, chunk_index, chunk_id) AS rank FROM s0 WHERE {documents}) AS h
      JOIN q ON q.query_id = h.query_id JOIN {levels} AS t ON h.raw >= t.threshold WHERE rank <= 5 GROUP BY 1, 2) AS n ON n.query_id = q.query_id AND n.threshold = t.threshold) GROUP BY threshold)"""


_SWEEP_BASE = f"""WITH q AS ({_D(X.golden_sql(True))}), c AS ({_D(X.vector_chunks_sql())}),
s0 AS (SELECT q.query_id, c.chunk_id, c.document_id, c.chunk_index, list_cosine_similarity(q.embedding, CAST(c.embedding AS DOUBLE[])) AS raw FROM q, c)"""


def _rules(table: str) -> str:
    """Rows of the audit for the faults that the fixtures hold."""
    if table == "d":
        rules = {
            "status_indexed": "status <> 'indexed'", "title_not_blank": "trim(title) = ''", "mime_type_supported": "mime_type NOT IN ('text/markdown', 'text/plain', 'application/pdf')",
            "page_count_limit": "page_count NOT BETWEEN 1 AND 50", "source_url_http": "NOT regexp_matches(source_url, '^https?://')", "metadata_object": "CASE WHEN json_valid(metadata) THEN json_type(metadata) <> 'OBJECT' ELSE metadata IS NOT NULL END",
            "character_count_limit": "character_count NOT BETWEEN 1 AND 500000", "chunks_count_positive": "chunks_count <= 0",
        }
        return " UNION ALL ".join(f"SELECT 'documents' AS table_name, id AS row_id, '{n}' AS rule FROM d WHERE {c}" for n, c in rules.items())
    rules = {
        "index_non_negative": "chunk_index < 0", "content_not_blank": "trim(content) = ''", "chunk_character_count_limit": "character_count NOT BETWEEN 1 AND 2400",
        "section_not_blank": "trim(section) = ''", "embedding_dimensions_fixed": "embedding_dimensions <> 4", "document_exists": "document_id NOT IN (SELECT id FROM d)",
    }
    return " UNION ALL ".join(f"SELECT 'chunks' AS table_name, id AS row_id, '{n}' AS rule FROM c WHERE {c}" for n, c in rules.items())


#: Accepted files, the first of equal bytes, seen as blocks.
_INGESTED = f"""{_JUDGED}, w AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(body) ORDER BY doc_id) AS copy FROM t WHERE extract_code IS NULL AND new_title <> '' AND length(new_title) <= 200) WHERE copy = 1
), {_markdown("SELECT doc_id, content AS text FROM w WHERE mime = 'text/markdown'")}, plain AS (
  SELECT unnest(list_filter(string_split_regex(content, '\\n[ \\t]*\\n([ \\t]*\\n)*'), lambda x: trim(x) <> '')) AS content FROM w WHERE mime = 'text/plain'
)"""


_SEGMENTED = """SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
  SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN 0 WHEN section IS NOT DISTINCT FROM lag(section) OVER w AND kind <> 'frontmatter' AND lag(kind) OVER w <> 'frontmatter' THEN 0 ELSE 1 END AS new
  FROM md WINDOW w AS (PARTITION BY doc_id ORDER BY position))"""


_EDGE_DATE, _EDGE_NUMBER, _EDGE_ROMAN = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b", r"\b[0-9]{1,18}\b", r"\b[ivxlIVXL]+\b"
_EDGE_TEMPLATE = f"regexp_replace(regexp_replace(regexp_replace(line, '{_EDGE_DATE}', chr(1), 'g'), '{_EDGE_NUMBER}', chr(2), 'g'), '{_EDGE_ROMAN}', chr(3), 'g')"
#: Roman numerals up to 89 from tens and ones.
_ROMAN = """SELECT n, list_extract(['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx'], CAST(n // 10 + 1 AS INT)) || list_extract(['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'], CAST(n % 10 + 1 AS INT)) AS r FROM range(1, 90) AS t(n)"""


def _sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([.!?…])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def _chunked(*configs: tuple[str, int, int], source: str = "") -> str:
    """Greedy packing unit by unit, for configurations (name, target, overlap) with the limit 2400 and the fragment
    300: ``k(config, doc_id, segment, chunk_index, content, section, tab, overlap)``. Tables fit into a chunk here."""
    gap, rows = "chr(10) || chr(10)", ", ".join(f"('{name}', {target}, {overlap})" for name, target, overlap in configs)
    md = "WITH RECURSIVE " + _markdown(source) if source else _MD
    return f"""{md}, seg AS ({_SEGMENTED}), headed AS (
  SELECT *, dense_rank() OVER (ORDER BY doc_id, segment) AS sid, row_number() OVER w AS nth, count(*) OVER (PARTITION BY doc_id, segment) AS blocks,
    first_value(kind) OVER w AS first_kind, first_value(content) OVER w AS first_content FROM seg WINDOW w AS (PARTITION BY doc_id, segment ORDER BY position)
), roomed AS (
  SELECT *, first_kind = 'heading' AND length(first_content) > 300 AS cut, CASE WHEN first_kind = 'heading' THEN substr(first_content, 1, 300) ELSE '' END AS prefix,
    2400 - CASE WHEN first_kind = 'heading' THEN least(length(first_content), 300) + 2 ELSE 0 END AS room FROM headed
), place AS (SELECT sid, doc_id, segment, section, first_kind, first_content, cut, prefix, room, blocks FROM roomed WHERE nth = 1
), body AS (SELECT * FROM roomed WHERE nth > 1 OR first_kind <> 'heading' OR cut
), pieces AS (
  SELECT sid, room, position, 0 AS s, 0 AS p, content AS unit, {gap} AS joiner, kind = 'table' AS tab FROM body WHERE length(content) <= room
  UNION ALL
  SELECT sid, room, position, s, p, substr(told[s], p * room + 1, room), CASE WHEN p > 0 THEN '' WHEN s > 1 THEN ' ' ELSE {gap} END, false
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(told[s]) / room) AS BIGINT))) AS p FROM (
    SELECT *, unnest(range(1, len(told) + 1)) AS s FROM (SELECT sid, room, position, {_sentences('content')} AS told FROM body WHERE length(content) > room)))
), units AS (SELECT *, length(unit) AS size, row_number() OVER (PARTITION BY sid ORDER BY position, s, p) AS u FROM pieces
), cfg AS (SELECT * FROM (VALUES {rows}) AS c(config, target, most_overlap)
), pack(config, target, sid, u, part, size, tab, cont) AS (
  SELECT config, target, sid, u, CAST(1 AS BIGINT), size, tab, joiner = '' FROM units CROSS JOIN cfg WHERE u = 1
  UNION ALL
  SELECT config, target, sid, u, CASE WHEN joins THEN part ELSE part + 1 END, CASE WHEN joins THEN total ELSE own END, own_tab OR (joins AND tab),
    CASE WHEN joins THEN cont AND NOT (tab OR own_tab) ELSE joiner = '' END
  FROM (SELECT *, (least(size, own) < 300 AND total <= room) OR (NOT (tab OR own_tab) AND total <= least(target, room)) AS joins FROM (
    SELECT k.config, k.target, k.sid, x.u, k.part, k.size, k.tab, k.cont, x.joiner, x.room, x.size AS own, x.tab AS own_tab, k.size + length(x.joiner) + x.size AS total
    FROM pack AS k JOIN units AS x ON x.sid = k.sid AND x.u = k.u + 1))
), packed AS (
  SELECT config, sid, part, any_value(room) AS room, string_agg(CASE WHEN u = low THEN '' ELSE joiner END || unit, '' ORDER BY u) AS text, arg_max(size, u) AS size, arg_max(tab, u) AS tab, arg_max(cont, u) AS cont
  FROM (SELECT k.config, k.sid, k.part, k.u, k.size, k.tab, k.cont, x.joiner, x.unit, x.room, min(k.u) OVER (PARTITION BY k.config, k.sid, k.part) AS low FROM pack AS k JOIN units AS x ON x.sid = k.sid AND x.u = k.u)
  GROUP BY config, sid, part
), folded AS (
  SELECT *, coalesce(part > 1 AND lead(part) OVER w IS NULL AND size < 300 AND lag(size) OVER w + 2 + size <= room, false) AS folds FROM packed WINDOW w AS (PARTITION BY config, sid ORDER BY part)
), parts AS (
  SELECT config, sid, CASE WHEN folds THEN part - 1 ELSE part END AS pos, string_agg(CASE WHEN folds AND NOT cont THEN {gap} ELSE '' END || text, '' ORDER BY part) AS text, bool_or(tab) AS tab FROM folded GROUP BY ALL
), paired AS (
  SELECT *, lag(text) OVER w AS before, lag(tab) OVER w AS before_tab FROM parts WINDOW w AS (PARTITION BY config, sid ORDER BY pos)
), tailed AS (
  SELECT *, CASE WHEN tab OR before_tab OR first_kind = 'frontmatter' THEN NULL ELSE {_sentences('before')} END AS ends, least(most_overlap, room - length(text) - 1) AS most FROM paired JOIN place USING (sid) JOIN cfg USING (config)
), ended AS (
  SELECT *, coalesce(nullif(list_filter(list_transform(range(1, len(ends) + 1), lambda j: array_to_string(ends[j:], ' ')), lambda t: length(t) <= most)[1], before), '') AS tail FROM tailed
), k AS (
  SELECT config, sid, pos, doc_id, segment, row_number() OVER (PARTITION BY config, doc_id ORDER BY segment, pos) - 1 AS chunk_index, content, CASE WHEN trim(section) <> '' THEN substr(section, 1, 500) END AS section, tab, overlap FROM (
    SELECT config, sid, doc_id, segment, pos, section, tab, length(tail) AS overlap,
      CASE WHEN prefix <> '' AND (pos > 1 OR NOT cut) THEN prefix || {gap} ELSE '' END || CASE WHEN tail <> '' THEN tail || ' ' ELSE '' END || text AS content FROM ended
    UNION ALL SELECT config, sid, doc_id, segment, 1, section, false, 0, first_content FROM place CROSS JOIN cfg WHERE first_kind = 'heading' AND blocks = 1 AND NOT cut))"""


_CHUNKS = _chunked(("1800/300", 1800, 300))


def oracle_sql() -> dict[str, str]:
    return {
        "validate_verdicts": f"{_JUDGED} SELECT doc_id, original_filename, mime, clean_title AS title, error_code, {_FIELD} AS error_field FROM j",
        "rejection_summary": f"""{_JUDGED} SELECT 'validation' AS stage, error_code, {_FIELD} AS error_field, count(*) AS n FROM j WHERE error_code IS NOT NULL GROUP BY ALL
          UNION ALL SELECT 'extraction', extract_code, 'file', count(*) FROM t WHERE extract_code IS NOT NULL GROUP BY ALL""",
        "ingest_blocks": f"""{_INGESTED} SELECT kind, count(*) AS blocks, CAST(sum(length({_strip('content')})) AS BIGINT) AS characters
          FROM (SELECT kind, content FROM md UNION ALL SELECT {_kind('content')}, content FROM plain) GROUP BY kind""",
        "mime_and_hash": f"{_RECEIVED} SELECT doc_id, lower(trim(split_part(mime_type, ';', 1))) AS mime, lower(regexp_extract(filename, '[^.](\\.[^.]*)$', 1)) AS extension, sha256(body) AS sha256 FROM r",
        "url_check": """SELECT page_id, u AS url, CASE WHEN regexp_matches(u, '^https?://([^/?#:@\\[\\]]+|\\[2001:db8::7\\]|\\[v1[.]a\\])(:[0-9]*)?([/?#]|$)') AND coalesce(try_cast(nullif(regexp_extract(u, '^https?://[^/?#:@]+:([0-9]*)', 1), '') AS INT), 0) <= 65535
          THEN 'ok' ELSE 'invalid_source_url' END AS verdict FROM (SELECT page_id, unnest([url, replace(url, '://', ':///'), regexp_replace(url, '^(https?://[^/]*)', '\\1:99999'),
            regexp_replace(url, '^(https?://)[^/?#]*', '\\1[1.2.3.4]'), regexp_replace(url, '^(https?://)[^/?#]*', '\\1[abc]'), regexp_replace(url, '^(https?://)[^/?#]*', '\\1[2001:db8::7]'), regexp_replace(url, '^(https?://)[^/?#]*', '\\1[v1.a]')]) AS u FROM pages)""",
        "date_check": f"{_RECEIVED} SELECT doc_id, try_cast(published_at AS DATE) AS published_at, CASE WHEN try_cast(published_at AS DATE) IS NULL THEN 'invalid_published_at' END AS error_code FROM r",
        "metadata_check": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'metadata_reserved_key' WHEN 1 THEN 'invalid_metadata' END AS error_code,
          CASE WHEN event_id % 5 > 1 THEN replace(props, ' ', '') END AS canonical_json FROM events""",
        "text_normalize": f"{_JUDGED} SELECT doc_id, extract_code AS error_code, CAST(length(content) AS BIGINT) AS characters, md5(content) AS text_md5 FROM t",
        "plain_blocks": f"""SELECT doc_id, position, {_kind('b')} AS kind, md5(b) AS content_md5 FROM (
          SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS position, b FROM (
            SELECT doc_id, i, l[i] AS b FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
              SELECT doc_id, list_filter(string_split_regex(regexp_replace(regexp_replace(text, '^(\\s*\\n)+', ''), '(\\n\\s*)+$', ''), '\\n[ \\t]*\\n([ \\t]*\\n)*'), lambda x: trim(x) <> '') AS l FROM ({_PLAIN})))))""",
        "markdown_blocks": f"{_MD} SELECT doc_id, position, kind, md5(content) AS content_md5, section, CAST(heading_level AS BIGINT) AS heading_level FROM md",
        "section_windows": f"{_MD} SELECT doc_id, position, section FROM md",
        "titles": f"{_JUDGED} SELECT doc_id, new_title AS title FROM t WHERE extract_code IS NULL",
        "page_assembly": """SELECT CAST(conv_id AS VARCHAR) AS doc_key, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS character_count,
          CASE WHEN count(*) > 50 OR min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*) THEN 'page_limit_exceeded' WHEN bool_and(trim(coalesce(text, '')) = '') THEN 'no_extractable_text' END AS error_code
          FROM conversations GROUP BY conv_id""",
        "page_edges": f"""WITH p AS ({_D(X.edged_pages_sql())}), l AS (SELECT *, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS lines, count(*) OVER (PARTITION BY doc_key) AS total FROM p),
          e AS (SELECT doc_key, page_index, total, 'head' AS side, trim(lines[1]) AS line FROM l WHERE len(lines) > 0 UNION ALL SELECT doc_key, page_index, total, 'foot', trim(lines[-1]) FROM l WHERE len(lines) > 1),
          t AS (SELECT *, {_EDGE_TEMPLATE} AS template, regexp_extract_all(line, '{_EDGE_DATE}|{_EDGE_NUMBER}|{_EDGE_ROMAN}', 0) AS tokens FROM e),
          v AS (SELECT doc_key, page_index, side, template, nth, tokens[nth] AS token, coalesce(try_cast(tokens[nth] AS BIGINT), (SELECT n FROM roman WHERE r = lower(tokens[nth]))) AS value FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS nth FROM t)),
          f AS (SELECT doc_key, side, template, bool_and(fixed OR counts) AS steady FROM (SELECT doc_key, side, template, nth, min(token) = max(token) AS fixed, coalesce(count(value) = count(*) AND min(value - page_index) = max(value - page_index), false) AS counts FROM v GROUP BY ALL) GROUP BY ALL),
          g AS (SELECT doc_key, side, template FROM t LEFT JOIN f USING (doc_key, side, template) WHERE coalesce(steady, true) GROUP BY ALL HAVING count(*) >= 3 AND count(*) >= max(total) * 0.6),
          told AS (SELECT doc_key, page_index, bool_or(side = 'head') AS head_gone, bool_or(side = 'foot') AS foot_gone FROM t SEMI JOIN g USING (doc_key, side, template) GROUP BY ALL)
          SELECT doc_key, CAST(page_index AS BIGINT) AS page_index, md5(array_to_string(lines[(CASE WHEN coalesce(head_gone, false) THEN 2 ELSE 1 END):(len(lines) - CASE WHEN coalesce(foot_gone, false) THEN 1 ELSE 0 END)], chr(10))) AS content_md5,
            coalesce(head_gone, false) AS head_gone, coalesce(foot_gone, false) AS foot_gone FROM l LEFT JOIN told USING (doc_key, page_index)""".replace("FROM roman WHERE", f"FROM ({_ROMAN}) AS roman WHERE"),
        "segments": f"{_MD} SELECT doc_id, position, segment FROM ({_SEGMENTED})",
        "chunk_pack": f"{_CHUNKS} SELECT doc_id, chunk_index, length(content) AS character_count, section, tab AS contains_table, md5(content) AS content_md5 FROM k",
        "chunk_overlap": f"{_CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(overlap) AS BIGINT) AS overlap, CAST(max(overlap) AS BIGINT) AS most_overlap FROM k GROUP BY doc_id",
        # which block has how many pieces in which chunk; by them what each damage breaks
        "chunk_audit": f"""{_CHUNKS}, j AS (SELECT * FROM k JOIN place USING (doc_id, segment)), own AS (
            SELECT sid, position, CASE WHEN folds THEN part - 1 ELSE part END AS pos, count(*) AS n FROM pack JOIN units USING (sid, u) JOIN (SELECT config, sid, part, folds FROM folded) USING (config, sid, part) GROUP BY ALL
            UNION ALL SELECT sid, position, 1, 1 FROM roomed WHERE nth = 1 AND first_kind = 'heading' AND NOT cut
          ), cover AS (
            SELECT doc_id, position, chunk_index, CAST(sum(n) AS BIGINT) AS n, max(chunk_index) OVER (PARTITION BY doc_id) AS last, sum(sum(n)) OVER (PARTITION BY doc_id, position) AS all_n FROM own JOIN k USING (sid, pos) GROUP BY doc_id, position, chunk_index
          )
          SELECT 'cut' AS chunks, doc_id, chunk_index, NULL AS position, unnest(list_filter([CASE WHEN trim(content) = '' THEN 'blank' END, CASE WHEN length(content) > 2400 THEN 'too_long' END, CASE WHEN overlap > 300 THEN 'overlap' END,
            CASE WHEN NOT starts_with(content, prefix) THEN 'heading' END, CASE WHEN tab AND NOT regexp_matches(content, '(?m)^[ \\t]*\\|?[ \\t]*:?-{{3,}}') THEN 'table_head' END], lambda r: r IS NOT NULL)) AS rule FROM j
          UNION ALL SELECT 'cut', doc_id, NULL, NULL, 'index_gap' FROM k GROUP BY doc_id HAVING count(*) <> max(chunk_index) + 1 OR count(DISTINCT chunk_index) <> count(*)
          UNION ALL SELECT 'damaged', doc_id, NULL, position, 'lost_block' FROM md WHERE doc_id % 12 = 1
          UNION ALL SELECT 'damaged', doc_id, NULL, position, CASE WHEN n = all_n THEN 'lost_block' ELSE 'gap' END FROM cover WHERE doc_id % 12 = 2 AND chunk_index = 0
          UNION ALL SELECT DISTINCT 'damaged', doc_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'index_gap' FROM k WHERE doc_id % 12 = 2 AND chunk_index > 0
          UNION ALL SELECT 'damaged', doc_id, NULL, position, 'not_lossless' FROM md WHERE doc_id % 12 = 3 AND contains(content, chr(10) || '| 1 | 2 |')
          UNION ALL SELECT 'damaged', doc_id, NULL, position, unnest(CASE WHEN n > 1 THEN ['double_cover', 'order'] ELSE ['double_cover'] END) FROM cover WHERE doc_id % 12 = 4 AND chunk_index = last""",
        "reindex_diff": f"""{_chunked(("1800/300", 1800, 300), source=_D(X.edited_sql()))}, old AS (SELECT DISTINCT md5(content) AS h FROM k WHERE doc_id % 2 = 0), new AS (SELECT md5(content) AS h, count(*) AS n FROM k WHERE doc_id % 2 = 1 GROUP BY 1)
          SELECT h AS content_md5, CASE WHEN h IN (SELECT h FROM old) THEN 'moved' ELSE 'embed' END AS part, n AS chunks FROM new
          UNION ALL SELECT NULL, 'gone', count(*) FROM old WHERE h NOT IN (SELECT h FROM new)""",
        "chunk_sweep": f"""{_chunked(("1200/200", 1200, 200), ("1800/300", 1800, 300), ("2400/400", 2400, 400))}
          SELECT config, count(*) AS chunks, CAST(max(length(content)) AS BIGINT) AS longest, CAST(sum(length(content)) AS BIGINT) AS characters, CAST(max(overlap) AS BIGINT) AS most_overlap FROM k GROUP BY config""",
        "sentences": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
        "hard_cut": """SELECT doc_id, CAST(len(p) AS BIGINT) AS pieces, md5(array_to_string(p, '|')) AS pieces_md5 FROM (
          SELECT doc_id, list_transform(range(0, CAST(ceil(length(text) / 700) AS BIGINT)), lambda i: substr(text, i * 700 + 1, 700)) AS p FROM documents)""",
        "table_split": """WITH RECURSIVE b AS (SELECT doc_id, content, string_split(content, chr(10)) AS l FROM (
            SELECT doc_id, '| text |' || chr(10) || '|---|' || chr(10) || '| ' || replace(text, '.', ' |' || chr(10) || '| ') || ' |' AS content FROM documents)),
          walk(doc_id, i, used, n) AS (SELECT doc_id, 2, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM b
            UNION ALL SELECT w.doc_id, w.i + 1, CASE WHEN w.used > 0 AND 15 + w.used + length(b.l[w.i + 1]) > 600 THEN 0 ELSE w.used END + length(b.l[w.i + 1]) + 1,
              w.n + CASE WHEN w.used = 0 OR 15 + w.used + length(b.l[w.i + 1]) > 600 THEN 1 ELSE 0 END FROM walk AS w JOIN b ON b.doc_id = w.doc_id WHERE w.i < len(b.l)),
          told AS (SELECT b.doc_id, CASE WHEN length(b.content) <= 600 THEN 1 WHEN list_max(list_transform(b.l[3:], lambda x: length(x))) + 15 > 600 THEN 0 ELSE (SELECT max(n) FROM walk AS w WHERE w.doc_id = b.doc_id) END AS chunks FROM b)
          SELECT doc_id, CAST(chunks AS BIGINT) AS chunks, CAST(chunks AS BIGINT) AS with_head FROM told""",
        "dedup_first": f"SELECT doc_id, sha256 FROM (SELECT doc_id, {_SHA} AS sha256, row_number() OVER (PARTITION BY {_SHA} ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
        "dedup_report": f"""WITH b AS (SELECT doc_id, {_SHA} AS sha256, {_ID} AS document_id, row_number() OVER (PARTITION BY {_SHA} ORDER BY doc_id) AS n FROM documents)
          SELECT doc_id, sha256, document_id, n > 1 OR sha256 IN (SELECT {_SHA} FROM documents WHERE lang = 'en') AS deduplicated FROM b""",
        "delete_cascade": f"""{_CORPUS}, gone AS (SELECT id FROM d WHERE doc_id % 6 = 0) SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS row_id FROM d WHERE id NOT IN (SELECT id FROM gone)
          UNION ALL SELECT 'chunk', id FROM c WHERE document_id NOT IN (SELECT id FROM gone)""",
        "delete_not_found": f"{_CORPUS} SELECT DISTINCT 'no-' || id AS id FROM d WHERE doc_id % 10 = 0",
        "list_page": f"{_CORPUS} SELECT id, arg_min(status, doc_id) AS status, arg_min(mime_type, doc_id) AS mime_type FROM d GROUP BY id ORDER BY id LIMIT 20 OFFSET 40",
        "list_deep_page": f"""{_CORPUS}, own AS (SELECT *, created_at + to_minutes(CAST(doc_id % 997 AS INTEGER)) AS made FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1)
          SELECT id, status, mime_type, strftime(made, '%Y-%m-%d %H:%M:%S') AS created_at FROM own ORDER BY made DESC, id LIMIT 20 OFFSET (SELECT count(*) - 27 FROM own)""",
        "list_total": f"{_CORPUS} SELECT count(DISTINCT id) AS total FROM d",
        "get_public": f"{_CORPUS} SELECT id, title, sha256, source_name, source_url FROM d WHERE id IN (SELECT id FROM d WHERE doc_id % 8 = 0)",
        "stable_ids": f"SELECT doc_id, {_ID} AS document_id, {_CHUNK_ID} AS chunk_id FROM documents",
        "schema_audit": f"""{_CORPUS} {_rules('d')} UNION ALL {_rules('c')}
          UNION ALL SELECT 'documents', id, 'id_unique' FROM d GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'documents', sha256, 'sha256_unique' FROM d GROUP BY sha256 HAVING count(*) > 1
          UNION ALL SELECT 'chunks', document_id || '/' || chunk_index, 'document_index_unique' FROM c GROUP BY document_id, chunk_index HAVING count(*) > 1""",
        "schema_audit_patched": f"""{_CORPUS} {_rules('d')} UNION ALL {_rules('c')}
          UNION ALL SELECT 'documents', id, 'id_unique' FROM d GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'documents', sha256, 'sha256_unique' FROM d GROUP BY sha256 HAVING count(*) > 1
          UNION ALL SELECT 'chunks', document_id || '/' || chunk_index, 'document_index_unique' FROM c GROUP BY document_id, chunk_index HAVING count(*) > 1""",
        "count_reconcile": f"""{_CORPUS} SELECT d.id, CAST(chunks_count AS BIGINT) AS declared, coalesce(n, 0) AS actual FROM d LEFT JOIN (SELECT document_id, count(*) AS n FROM c GROUP BY 1) AS k ON k.document_id = d.id
          WHERE chunks_count <> coalesce(n, 0) OR coalesce(n, 0) = 0""",
        "vector_errors": f"{_BAD} SELECT vec_id, {_ERROR} AS error FROM v",
        "vector_norms": """SELECT vec_id, 1.0::DOUBLE AS squared_norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))), 4) AS first FROM embeddings""",
        "index_versions": f"{_CORPUS} SELECT embedding_model, CAST(embedding_dimensions AS BIGINT) AS embedding_dimensions, count(*) AS chunks FROM c GROUP BY 1, 2",
        "attach_all_or_nothing": f"""{_BAD} SELECT document_id, CASE WHEN bad = 0 THEN n ELSE 0 END AS chunks, CAST(bad AS BIGINT) AS missing FROM (
          SELECT CAST(CAST(floor(vec_id / 7) AS BIGINT) AS VARCHAR) AS document_id, count(*) AS n, count_if(vec_id % 90 = 11 OR {_ERROR} IS NOT NULL) AS bad FROM v GROUP BY 1)""",
        "pending_embeddings": f"{_BAD} SELECT chunk_id FROM v WHERE vec_id % 3 = 0 OR vec_id % 5 = 0",
        "query_validation": """SELECT query_id, CASE WHEN error_code IS NULL THEN CAST(length(question) AS BIGINT) END AS characters, CASE WHEN error_code IS NULL THEN CAST(5 AS BIGINT) END AS top_k, error_code FROM (
          SELECT item_id AS query_id, question, CASE WHEN length(question) NOT BETWEEN 1 AND 2000 THEN 'invalid_question' WHEN item_id % 11 = 0 THEN 'invalid_top_k' END AS error_code FROM (
            SELECT item_id, trim(CASE WHEN item_id % 5 = 0 THEN '  ' WHEN item_id % 7 = 0 THEN repeat(text, 20) ELSE text END, ' ' || chr(10)) AS question FROM benchmark))""",
        "topk_exact": f"{_HITS} SELECT query_id, rank, chunk_id, document_id, round(raw, 4) AS similarity FROM h",
        "query_gate": f"{_HITS} SELECT q.query_id, count(h.query_id) AS hits, CASE WHEN count(h.query_id) = 0 THEN 'insufficient_context' END AS status FROM q LEFT JOIN h ON h.query_id = q.query_id GROUP BY 1",
        "context": f"{_HITS} SELECT query_id, rank, chunk_id, title, section, content FROM h JOIN live ON live.id = h.document_id",
        "citation_check": f"{_CITED} SELECT query_id, chunk_id, valid FROM k",
        "citations": f"{_CITED} SELECT k.query_id, k.chunk_id, h.document_id, title, section, substr(content, 1, 200) AS excerpt, round(raw, 4) AS similarity FROM k JOIN h ON h.query_id = k.query_id AND h.chunk_id = k.chunk_id JOIN live ON live.id = h.document_id WHERE valid",
        "answer_rules": f"""{_CITED}, n AS (SELECT a.query_id, a.status, (SELECT count(*) FROM k WHERE k.query_id = a.query_id AND k.valid) AS cited, (SELECT count(*) FROM h WHERE h.query_id = a.query_id) AS found FROM (SELECT DISTINCT query_id, status FROM a) AS a)
          SELECT query_id, 'answered_without_citation' AS rule FROM n WHERE status = 'answered' AND cited = 0 UNION ALL SELECT query_id, 'insufficient_with_citation' FROM n WHERE status = 'insufficient_context' AND cited > 0
          UNION ALL SELECT query_id, 'more_citations_than_hits' FROM n WHERE cited > found""",
        "threshold_sweep": f"{_SWEEP_BASE}, {_sweep('true', 'w')} SELECT * FROM w",
        "threshold_choice": f"{_SWEEP_BASE}, {_sweep('true', 'w')} SELECT max(threshold) FILTER (WHERE hit_rate >= 0.9 AND abstention = 1 AND alternatives = 1) AS threshold, count(*) FILTER (WHERE hit_rate >= 0.9 AND abstention = 1 AND alternatives = 1) > 0 AS chosen FROM w",
        "version_compare": f"""{_SWEEP_BASE}, {_sweep('true', 'w')}, {_sweep("document_id <> '9'", 'z')}
          SELECT threshold, round(z.hit_rate - w.hit_rate, 4) AS hit_rate_delta, round(z.abstention - w.abstention, 4) AS abstention_delta, round(z.alternatives - w.alternatives, 4) AS alternatives_delta FROM w JOIN z USING (threshold)""",
        "citation_precision": f"{_CITED} SELECT count(*) AS citations, CAST(count_if(valid) AS BIGINT) AS valid, round(avg(CAST(valid AS INT)), 4) AS precision FROM k",
    }
