"""Text extraction: decoding, checks, blocks, sections and titles of validated files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill import schemas as S
from docmill.functions.text import is_blank, settled, strip
from docmill.operators.validation import content_sha256, judge, published_date, quarantine

# Line patterns of the Markdown subset.
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})")
LIST_LINE = rf"\A[ \t]*(?:[-+*]|\p{{Nd}}+[.)])[ \t]+[^{S.WS}]"
DELIMITER_CELL = r"\A:?-{3,}:?\z"


def decode_text(content: Column) -> Column:
    """Strict UTF-8 without one leading byte order mark; CRLF and CR become LF. Null if not UTF-8."""
    body = F.when(F.startswith(content, F.lit(b"\xef\xbb\xbf")), F.substr(content, F.lit(4))).otherwise(content)
    text = body.cast("string")
    return F.when(F.is_valid_utf8(text), F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def extract_error(mime: Column, text: Column) -> Column:
    """Checks on decoded text, before the title."""
    return (
        F.when(mime == "application/pdf", "unsupported_extraction_type")
        .when(text.isNull(), "invalid_text_encoding")
        .when(is_blank(text), "empty_extracted_text")
        .when(F.length(text) > S.MAX_TEXT_CHARS, "extracted_text_too_large")
    )


def plain_text_blocks(text: Column) -> Column:
    """Runs of lines that are not blank, as ``array<string>``."""
    blank = rf"[{S.WS}&&[^\n]]*"
    body = F.regexp_replace(F.regexp_replace(text, rf"\A(?:{blank}\n)+", ""), rf"(?:\n{blank})+\z", "")
    return F.filter(F.split(body, rf"\n(?:{blank}\n)+"), lambda b: ~is_blank(b))


def block_kind(block: Column) -> Column:
    """table (two lines with pipes, the second all delimiter cells), list (by the first line), else
    paragraph."""
    lines = F.split(block, "\n")
    second = F.regexp_replace(F.regexp_replace(strip(F.get(lines, F.lit(1))), r"\A\|+", ""), r"\|+\z", "")
    cells = F.forall(F.split(second, r"\|"), lambda c: strip(c).rlike(DELIMITER_CELL))
    table = (F.size(lines) >= 2) & F.contains(lines[0], F.lit("|")) & F.contains(F.get(lines, F.lit(1)), F.lit("|")) & cells
    return F.when(F.coalesce(table, F.lit(False)), "table").when(lines[0].rlike(LIST_LINE), "list").otherwise("paragraph")


def _markdown(text: str) -> Iterator[tuple[str, str, str | None, int | None]]:
    """(kind or '', content, section, level) of the blocks of one document; '' = told by its lines."""
    lines, at, path = text.split("\n"), 0, [""] * 6
    if lines[0].strip() == "---":
        close = next((i for i, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), 0)
        if close:
            yield "frontmatter", "\n".join(lines[: close + 1]), None, None
            at = close + 1
    begin, fence = at, ""  # the block that is open has the lines begin .. i - 1

    def section() -> str | None:
        return " > ".join(p for p in path if p) or None

    for i in range(at, len(lines) + 1):
        line = lines[i] if i < len(lines) else ""
        mark = _FENCE.match(line)
        if fence and i < len(lines):
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
            continue
        heading = _HEADING.fullmatch(line)
        if i < len(lines) and not mark and not heading and line.strip():
            continue
        if begin < i:
            yield "", "\n".join(lines[begin:i]), section(), None
        begin = i if mark and i < len(lines) else i + 1
        if mark:
            fence = mark[1]
        elif heading:
            level, name = len(heading[1]), heading[2].strip()
            path[level - 1 :] = [name, *[""] * (6 - level)]
            yield "heading", line, section() or "", level


#: So many documents are Python objects at once; those around them stay in Arrow.
AT_ONCE = 64
_BLOCKS = pa.list_(pa.struct({"kind": pa.string(), "content": pa.string(), "section": pa.string(), "heading_level": pa.int32()}))


def _markdown_blocks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fences carry state from line to line, which no built-in function over arrays does in linear time."""
    names = _BLOCKS.value_type.names
    for whole in texts:
        for at in range(0, max(len(whole), 1), AT_ONCE):
            some = whole.slice(at, AT_ONCE).to_pylist()
            yield pa.array([None if t is None else [dict(zip(names, b, strict=True)) for b in _markdown(t)] for t in some], _BLOCKS)


def blocks_of(mime: Column, text: Column) -> Column:
    """The ordered blocks of a document."""
    markdown = F.transform(
        F.arrow_udf(_markdown_blocks, S.BLOCK_DDL)(F.when(mime == "text/markdown", text)),
        lambda b: F.struct(F.when(b["kind"] == "", block_kind(b["content"])).otherwise(b["kind"]).alias("kind"), b["content"].alias("content"), b["section"].alias("section"), b["heading_level"].alias("heading_level")),
    )
    none = F.lit(None)
    plain = F.transform(
        plain_text_blocks(text),
        lambda b: F.struct(block_kind(b).alias("kind"), b.alias("content"), none.cast("string").alias("section"), none.cast("int").alias("heading_level")),
    )
    return F.when(mime == "text/markdown", markdown).otherwise(plain)


def heading_text(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"\A#{1,6}[ \t]+([^\n]+?)[ \t]*#*[ \t]*\z", 1))


def resolve_title(title: Column, filename: Column, blocks: Column) -> Column:
    """The given title, else the first heading that is not empty, else the name of the file."""
    named = F.filter(F.transform(F.filter(blocks, lambda b: b["kind"] == "heading"), lambda b: heading_text(b["content"])), lambda t: t != "")
    stem = F.regexp_replace(filename, r"(?s)(?<=[^.])\.[^.]*\z", "")
    plain = strip(F.regexp_replace(F.translate(stem, "_-", "  "), rf"[{S.WS}]+", " "))
    return F.coalesce(title, F.get(named, F.lit(0)), plain)


def extract(validated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, blocks, rejected). The raw content goes once it is decoded."""
    decoded = validated.withColumn("text", decode_text(F.col("content"))).drop("content")
    early = decoded.withColumn("error_code", extract_error(F.col("mime_type"), F.col("text")))
    full = early.withColumn("blocks", F.when(F.col("error_code").isNull(), blocks_of(F.col("mime_type"), F.col("text"))))
    titled = full.withColumn("new_title", resolve_title(F.col("title"), F.col("original_filename"), F.col("blocks")))
    bad = (F.col("new_title") == "") | (F.length("new_title") > S.MAX_TITLE_CHARS)
    judged = titled.withColumn("error_code", F.coalesce("error_code", F.when(bad, "invalid_title"))).withColumn("error_field", F.lit("file"))
    good = judged.where("error_code is null")
    documents = good.select(
        "doc_key", "arrival_seq", "sha256", "original_filename", "mime_type", F.col("new_title").alias("title"), F.col("text").alias("content"),
        F.length("text").alias("character_count"), F.lit(None).cast("int").alias("page_count"), "source_name", "source_url", "published_at", "metadata", "blocks",
    )
    return documents, explode_blocks(documents), quarantine(judged, "extraction")


def screen(received: DataFrame) -> DataFrame:
    """``received`` judged and extracted in one projection, without a filter or a shuffle: the columns of a document,
    null where it is rejected, and ``stage``, ``error_code`` and ``error_field``, null where it is not. Nothing of a
    rejected file is told but its doc_key and arrival_seq."""
    judged = judge(received).withColumnRenamed("title", "given_title")
    judged = settled(judged, early_code=F.col("error_code"), early_field=F.col("error_field")).drop("error_code", "error_field")
    fine = F.col("early_code").isNull()
    decoded = settled(judged, text=F.when(fine, decode_text(F.col("content"))))
    late = settled(decoded, late_code=F.when(fine, extract_error(F.col("declared_mime"), F.col("text"))))
    full = late.withColumn("text", F.when(F.col("late_code").isNull(), F.col("text")))
    full = settled(full, blocks=blocks_of(F.col("declared_mime"), F.col("text")))
    titled = settled(full, title=resolve_title(F.col("clean_title"), F.col("original_filename"), F.col("blocks")))
    bad = fine & F.col("late_code").isNull() & ((F.col("title") == "") | (F.length("title") > S.MAX_TITLE_CHARS))
    code = F.coalesce("early_code", "late_code", F.when(bad, "invalid_title"))
    told = titled.withColumn("error_code", code)
    good = F.col("error_code").isNull()
    own = {
        "sha256": content_sha256(F.col("content")), "original_filename": F.col("original_filename"), "mime_type": F.col("declared_mime"), "title": F.col("title"), "content": F.col("text"),
        "character_count": F.length("text"), "page_count": F.lit(None).cast("int"), "source_name": F.col("clean_source"), "source_url": strip(F.col("source_url")),
        "published_at": published_date(F.col("published_at")), "metadata": F.col("verdict.canonical_json"), "blocks": F.col("blocks"),
    }
    stage = F.when(F.col("early_code").isNotNull(), "validation").when(~good, "extraction")
    field = F.coalesce("early_field", F.when(~good, "file"))
    return told.select("doc_key", "arrival_seq", *(F.when(good, c).alias(n) for n, c in own.items()), stage.alias("stage"), "error_code", field.alias("error_field"))


def explode_blocks(documents: DataFrame) -> DataFrame:
    """One row for each block; text has a single page without a number."""
    return documents.select("doc_key", F.posexplode("blocks").alias("position", "b")).select(
        "doc_key", "position", F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("string").alias("page_label"), "b.kind", "b.content", "b.section", "b.heading_level"
    )


def section_paths(blocks: DataFrame) -> DataFrame:
    """Sections from ``blocks(doc_key, position, kind, content, heading_level)`` by windows alone: a
    heading of level k holds as long as none of a lower level follows it."""
    so_far = Window.partitionBy("doc_key").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {k: F.max(F.when(F.col("heading_level") == k, F.struct("position", heading_text(F.col("content")).alias("name")))).over(so_far) for k in range(1, 7)}
    out = blocks
    for k, col in last.items():
        out = out.withColumn(f"_h{k}", col)
    parts = []
    for k in range(1, 7):
        upper = [F.coalesce(F.col(f"_h{j}.position"), F.lit(-1)) for j in range(1, k)]
        holds = F.col(f"_h{k}").isNotNull() & ((F.col(f"_h{k}.position") > F.greatest(F.lit(-1), *upper)) if upper else F.lit(True))
        parts.append(F.when(holds & (F.col(f"_h{k}.name") != ""), F.col(f"_h{k}.name")))
    path = F.concat_ws(" > ", *parts)
    section = F.when((path == "") & (F.col("kind") != "heading"), None).otherwise(path)
    return out.withColumn("section", section).drop(*[f"_h{k}" for k in last])


def assemble_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_key, page_index, page_label, content)`` -> one row for each document: page_count,
    character_count and error_code (``page_limit_exceeded`` is over 50 pages or indexes not 1..n)."""
    told = pages.groupBy("doc_key").agg(
        F.count("*").alias("page_count"), F.sum(F.length("content")).cast("long").alias("character_count"),
        F.bool_and(is_blank(F.coalesce("content", F.lit("")))).alias("blank"), F.min("page_index").alias("low"), F.max("page_index").alias("high"),
        F.count_distinct("page_index").alias("places"),
    )
    ordered = (F.col("low") == 1) & (F.col("high") == F.col("page_count")) & (F.col("places") == F.col("page_count"))
    error = F.when((F.col("page_count") > S.MAX_PAGES) | ~ordered, "page_limit_exceeded").when(F.col("blank"), "no_extractable_text")
    return told.select("doc_key", "page_count", "character_count", error.alias("error_code"))


#: What may vary in an edge: dates, numbers, Roman numerals.
_EDGE_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}\b"
_EDGE_NUMBER, _EDGE_ROMAN = r"\b[0-9]{1,18}\b", r"\b[ivxlIVXL]+\b"


def _roman(n: int) -> str:
    """A Roman numeral under 90."""
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]
    return ("xl" if n // 10 == 4 else "l" * (n >= 50) + "x" * (n // 10 % 5)) + ones


def edge_template(line: Column) -> Column:
    """``line`` with a mark for each date, number and Roman numeral."""
    for mark, pattern in (("\1", _EDGE_DATE), ("\2", _EDGE_NUMBER), ("\3", _EDGE_ROMAN)):
        line = F.regexp_replace(line, pattern, mark)
    return line


def strip_repeated_edges(pages: DataFrame, min_pages: int = 3, min_share: float = 0.6) -> DataFrame:
    """``pages(doc_key, page_index, content)`` without first and last lines that stand on at least
    ``min_pages`` pages and ``min_share`` of the pages of a document: ``(doc_key, page_index, content, head_gone, foot_gone)``.

    Lines are the same if they differ in dates, numbers and Roman numerals alone, and each of these is either the same on
    all of them or counts the pages (its distance to page_index is the same). A line whose number does something else stays, and so do all
    lines between the first and the last. Null contents are empty pages; repeated page numbers are pages each.
    """
    rows = pages.withColumn("lines", F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: ~is_blank(x)))
    head, foot = F.get("lines", F.lit(0)), F.element_at(F.when(F.size("lines") > 1, F.col("lines")), -1)
    ends = rows.select("doc_key", "page_index", F.explode(F.array(*(F.struct(F.lit(n).alias("side"), strip(x).alias("line")) for n, x in (("head", head), ("foot", foot))))).alias("e"))
    ends = ends.select("doc_key", "page_index", "e.side", "e.line").where("line is not null").withColumn("template", edge_template(F.col("line")))
    numerals = F.create_map(*[F.lit(x) for n in range(1, 90) for x in (_roman(n), n)])
    place = ["doc_key", "side", "template"]
    tokens = ends.select(*place, "page_index", F.posexplode(F.regexp_extract_all("line", F.lit(f"({_EDGE_DATE}|{_EDGE_NUMBER}|{_EDGE_ROMAN})"), F.lit(1))).alias("at", "token"))
    off = F.coalesce(F.col("token").try_cast("bigint"), numerals[F.lower("token")].cast("long")) - F.col("page_index")
    counts = (F.count("off") == F.count("*")) & (F.min("off") == F.max("off"))
    steady = tokens.withColumn("off", off).groupBy(*place, "at").agg(((F.min("token") == F.max("token")) | F.coalesce(counts, F.lit(False))).alias("steady"))
    loose = steady.groupBy(*place).agg(F.bool_and("steady").alias("steady")).where("not steady")
    total = pages.groupBy("doc_key").agg(F.count("*").alias("total"))
    often = ends.groupBy(*place).agg(F.count("*").alias("times")).join(loose, place, "left_anti").join(total, "doc_key")
    often = often.where((F.col("times") >= min_pages) & (F.col("times") >= F.col("total") * min_share))
    gone = ends.join(often.select(*place), place, "left_semi").groupBy("doc_key", "page_index").agg(*(F.bool_or(F.col("side") == n).alias(f"{n}_gone") for n in ("head", "foot")))
    told = rows.join(gone, ["doc_key", "page_index"], "left").withColumns({f"{n}_gone": F.coalesce(f"{n}_gone", F.lit(False)) for n in ("head", "foot")})
    first = F.when(F.col("head_gone"), 2).otherwise(1)
    count = F.size("lines") - first + 1 - F.when(F.col("foot_gone"), 1).otherwise(0)
    kept = F.slice("lines", first, F.greatest(count, F.lit(0)))
    return told.select("doc_key", "page_index", F.array_join(kept, "\n").alias("content"), "head_gone", "foot_gone")
