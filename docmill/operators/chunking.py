"""Structure-aware chunking: segments, units, greedy packing and overlap.

Runs of blocks of one page and section are a segment; frontmatter is one of its own. The heading
line begins the first chunk of its segment and prefixes the others. A block that does not fit is cut
at sentences, then hard; a table by rows with its two head lines repeated. Each chunk tells by spans
which characters of which blocks it has, and where: what lies outside of them is repeated from elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a heading so many characters go before each chunk of its segment.
LONGEST_PREFIX = 300
SENTENCE_END = r"(?<=[.!?…])[ \t\n]+"


@dataclass(frozen=True)
class ChunkConfig:
    """Characters: what a chunk aims at, its limit, overlap and the size under which it is merged."""

    target: int = 1800
    most: int = 2400
    overlap: int = 300
    fragment: int = 300


#: Fixed value: the configurations to compare.
SWEEP = {"1200/200": ChunkConfig(1200, 2400, 200), "1800/300": ChunkConfig(1800, 2400, 300), "2400/400": ChunkConfig(2400, 2400, 400)}

CHUNK_DDL = "array<struct<segment:int,content:string,page_index:int,page_label:string,section:string,contains_table:boolean,overlap_characters:int,spans:array<struct<at:int,position:int,start:int,length:int>>,error_code:string>>"
_SPAN = pa.struct({n: pa.int32() for n in ("at", "position", "start", "length")})
_CHUNKS = pa.list_(pa.struct({
    "segment": pa.int32(), "content": pa.string(), "page_index": pa.int32(), "page_label": pa.string(), "section": pa.string(), "contains_table": pa.bool_(),
    "overlap_characters": pa.int32(), "spans": pa.list_(_SPAN), "error_code": pa.string(),
}))
_SIZES = ("chunks", "longest", "characters", "most_overlap")
#: So many documents are Python objects at once; those around them stay in Arrow.
AT_ONCE = 64
#: An audit cuts a block into pieces of so many characters, so that a place in it is found without counting from its begin.
PIECE = 1024


def segment_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``segment``: 0 for the first run of one page and section, and so on."""
    by_place = Window.partitionBy("doc_key").orderBy("position")
    same = F.col("page_index").eqNullSafe(F.lag("page_index").over(by_place)) & F.col("section").eqNullSafe(F.lag("section").over(by_place))
    front = F.col("kind") == "frontmatter"
    after_front = F.lag("kind").over(by_place) == "frontmatter"
    new = F.when(F.row_number().over(by_place) == 1, 0).when(same & ~front & ~after_front, 0).otherwise(1)
    return blocks.withColumn("_new", new).withColumn("segment", F.sum("_new").over(by_place).cast("int")).drop("_new")


def split_sentences(text: Column) -> Column:
    """Sentences, without the white space between them. A null text has null, an empty one none."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def hard_cut(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last one shorter. A null or empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def _sentences(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for gap in re.finditer(SENTENCE_END, text):
        if gap.start() > at:
            yield at, gap.start()
        at = gap.end()
    if at < len(text):
        yield at, len(text)


def _units(kind: str, text: str, room: int) -> list[tuple[str, str, bool, tuple[int, int, int]]] | None:
    """(joiner before it, text, is a table, span) of one block; None if a table row does not fit. A span is (place in
    the unit, place in the block, length)."""
    if len(text) <= room:
        return [("\n\n", text, kind == "table", (0, 0, len(text)))]
    if kind == "table":
        lines = text.split("\n")
        head = "\n".join(lines[:2])
        if len(head) > room:
            return None
        out, rows, begin, at = [], [], len(head) + 1, len(head) + 1
        for row in [*lines[2:], None]:
            if row is not None and len(head) + 1 + len(row) > room:
                return None
            if row is None or (rows and at - begin + len(row) + len(head) + 1 > room):
                unit = "\n".join([head, *rows])
                out.append(("\n\n", unit, True, (len(head) + 1, begin, len(unit) - len(head) - 1) if out else (0, 0, len(unit))))
                rows, begin = [], at
            if row is not None:
                rows.append(row)
                at += len(row) + 1
        return out
    out, joiner = [], "\n\n"
    for begin, end in _sentences(text):
        for i in range(begin, end, room):
            piece = text[i : min(i + room, end)]
            out.append((joiner if i == begin else "", piece, False, (0, i, len(piece))))
        joiner = " "
    return out


def _tail(text: str, most: int) -> str:
    """The longest run of whole sentences at the end, of ``most`` characters at most."""
    tail = ""
    for begin, end in reversed([*_sentences(text)]):
        longer = text[begin:end] if not tail else f"{text[begin:end]} {tail}"
        if len(longer) > most:
            break
        tail = longer
    return "" if tail == text else tail


def _pack(blocks: list[dict], config: ChunkConfig) -> tuple[list[tuple[str, bool, int, list[tuple[int, int, int, int]]]], str | None]:
    """Chunks (content, holds a table, characters of overlap, spans) of one segment, or an error."""
    first = blocks[0]["content"] if blocks[0]["kind"] == "heading" else ""
    heading = first[:LONGEST_PREFIX]
    room = config.most - (len(heading) + 2 if heading else 0)
    parts: list[list] = []  # text without the prefix, holds a table, goes on without a joiner, spans
    # a heading that is longer than a prefix is text of the first chunk, and prefixes the others cut
    cut = first != heading
    body = blocks[1:] if first and not cut else blocks

    def join(part: list, joiner: str, text: str, table: bool, spans: list, goes_on: bool) -> list:
        shift = len(part[0]) + len(joiner)
        return [part[0] + joiner + text, table, goes_on, part[3] + [(at + shift, *rest) for at, *rest in spans]]

    for block in body:
        units = _units(block["kind"], block["content"], room)
        if units is None:
            return [], "indivisible_table_row"
        for joiner, text, table, (at, start, length) in units:
            spans = [(at, block["position"], start, length)]
            if parts:
                size = len(parts[-1][0]) + len(joiner) + len(text)
                small = min(len(parts[-1][0]), len(text)) < config.fragment
                limit = min(config.target, room)
                if not (table or parts[-1][1]) and (size <= limit or (small and size <= room)):
                    parts[-1] = join(parts[-1], joiner, text, False, spans, parts[-1][2])
                    continue
                if (table or parts[-1][1]) and small and size <= room:
                    parts[-1] = join(parts[-1], joiner, text, True, spans, False)
                    continue
            parts.append([text, table, joiner == "", spans])
    if len(parts) > 1 and len(parts[-1][0]) < config.fragment and len(parts[-2][0]) + 2 + len(parts[-1][0]) <= room:
        text, table, goes_on, spans = parts.pop()
        parts[-1] = join(parts[-1], "" if goes_on else "\n\n", text, parts[-1][1] or table, spans, parts[-1][2])
    own = [(0, blocks[0]["position"], 0, len(first))]
    if not parts:
        return [(first, False, 0, own)], None
    out, front = [], body[0]["kind"] == "frontmatter"
    for i, (text, table, _, spans) in enumerate(parts):
        tail = ""
        if i and not table and not parts[i - 1][1] and not front:
            tail = _tail(parts[i - 1][0], min(config.overlap, room - len(text) - 1))
        content = (tail + " " if tail else "") + text
        content = f"{heading}\n\n{content}" if heading and (i or not cut) else content
        shift = len(content) - len(text)
        spans = [(at + shift, *rest) for at, *rest in spans]
        out.append((content, table, len(tail), spans if i or cut or not heading else own + spans))
    return out, None


def _chunk_document(rows: list[dict] | None, config: ChunkConfig) -> Iterator[dict]:
    """Packing is greedy, so a chunk depends on the one before it in its segment."""
    start, rows = 0, rows or []
    for i in range(1, len(rows) + 1):
        if i < len(rows) and rows[i]["segment"] == rows[start]["segment"]:
            continue
        own = rows[start:i]
        chunks, error = _pack(own, config)
        place = {"segment": own[0]["segment"], "page_index": own[0]["page_index"], "page_label": own[0]["page_label"]}
        section = own[0]["section"][:500] if own[0]["section"] and own[0]["section"].strip() else None
        for content, table, overlap, spans in chunks:
            told = [dict(zip(("at", "position", "start", "length"), s, strict=True)) for s in spans]
            yield {**place, "content": content, "section": section, "contains_table": table, "overlap_characters": overlap, "spans": told, "error_code": None}
        if error:
            yield {**place, "content": None, "section": section, "contains_table": True, "overlap_characters": 0, "spans": [], "error_code": error}
        start = i


def _by_document(whole: pa.ListArray) -> Iterator[list[list[dict]]]:
    """The blocks of AT_ONCE documents after each other, read column by column; an empty list if there are none."""
    for at in range(0, max(len(whole), 1), AT_ONCE):
        some = whole.slice(at, AT_ONCE)
        flat = some.flatten()
        names = [f.name for f in flat.type]
        rows = (dict(zip(names, r, strict=True)) for r in zip(*(flat.field(n).to_pylist() for n in names), strict=True))
        yield [[*islice(rows, n)] for n in some.value_lengths().fill_null(0).to_pylist()]


def _chunker(config: ChunkConfig):
    @F.arrow_udf(CHUNK_DDL)
    def chunk_document(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in blocks:
            for some in _by_document(whole):
                yield pa.array([list(_chunk_document(rows, config)) for rows in some], _CHUNKS)

    return chunk_document


def _sizer(configs: list[ChunkConfig]):
    kind = pa.list_(pa.struct({n: pa.int64() for n in _SIZES}))

    def sizes(rows: list[dict], config: ChunkConfig) -> dict:
        told = [(c["error_code"], len(c["content"] or ""), c["overlap_characters"]) for c in _chunk_document(rows, config)]
        if not told or any(error for error, _, _ in told):
            return dict.fromkeys(_SIZES)
        _, lengths, overlaps = zip(*told, strict=True)
        return dict(zip(_SIZES, (len(told), max(lengths), sum(lengths), max(overlaps)), strict=True))

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:long' for n in _SIZES)}>>")
    def chunk_sizes(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in blocks:
            for some in _by_document(whole):
                yield pa.array([[sizes(rows, c) for c in configs] for rows in some], kind)

    return chunk_sizes


def _whole(blocks: DataFrame) -> DataFrame:
    """The blocks of each document, in order, with their segments."""
    fields = ("position", "segment", "kind", "content", "page_index", "page_label", "section")
    return segment_blocks(blocks).groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("blocks"))


def cut(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The chunks of ``blocks``, and of a document that is rejected one row with ``rejected``: one shuffle brings the blocks of a
    document, at most 500,000 characters, together. ``parted`` tells the two apart."""
    told = _whole(blocks).select("doc_key", _chunker(config)("blocks").alias("chunks"))
    bad = F.exists("chunks", lambda c: c["error_code"].isNotNull())
    rows = told.select("doc_key", bad.alias("rejected"), F.posexplode(F.when(bad, F.slice("chunks", 1, 1)).otherwise(F.col("chunks"))).alias("chunk_index", "c"))
    return rows.select(
        "doc_key", "rejected", "chunk_index", "c.content", F.length("c.content").alias("character_count"), "c.page_index", "c.page_label", "c.section", "c.contains_table", "c.overlap_characters", "c.segment", "c.spans"
    )


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of the rows of ``cut``."""
    rejected = rows.where("rejected").select("doc_key", F.lit("chunking").alias("stage"), F.lit("indivisible_table_row").alias("error_code"), F.lit("file").alias("error_field"))
    return rows.where("not rejected").drop("rejected"), rejected


def chunk(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected) of ``blocks``: contiguous chunk_index from 0. A document with a table row
    that fits into no chunk is rejected as a whole. A job that reads both writes the rows of ``cut`` once and parts them.

    ``spans`` are the parts ``(at, position, start, length)`` of a chunk: its characters from ``at`` on are those of
    the block ``position`` from ``start`` on. In all chunks of a document they tell each character of its blocks
    once, in order, but for white space between sentences and rows."""
    return parted(cut(blocks, config))


def audit_chunks(chunks: DataFrame, config: ChunkConfig = ChunkConfig(), blocks: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Violations ``(doc_key, chunk_index, position, rule)``: blank, too_long, overlap, character_count and index_gap
    from the chunks alone; with their ``blocks`` also page_crossing, section, heading, table_head and
    foreign_text (text that no block, prefix or overlap accounts for) of chunks, and what a sweep over the
    spans finds in each block (``position``; chunk_index is null): lost_block (no chunk has any of it), gap (some text is in no
    chunk), double_cover (some is in several), order, not_lossless (a chunk's text is not that of its span), unknown_block
    and table_head (rows that go on without their head lines). Blocks of documents in ``rejected(doc_key)`` need no chunks.
    All are decided by what the text is, not by what it says. Null contents break no rule of their own; empty tables have no
    violations."""
    rules = F.array_compact(
        F.array(
            F.when(F.trim("content") == "", "blank"), F.when(F.length("content") > config.most, "too_long"),
            F.when(F.col("overlap_characters") > config.overlap, "overlap"), F.when(F.col("character_count") != F.length("content"), "character_count"),
        )
    )
    no = F.lit(None).cast("int")
    own = chunks.select("doc_key", "chunk_index", no.alias("position"), F.explode(rules).alias("rule"))
    places = chunks.groupBy("doc_key").agg(F.count("*").alias("n"), F.max("chunk_index").alias("high"), F.count_distinct("chunk_index").alias("places"))
    gaps = places.where("n <> high + 1 or places <> n").select("doc_key", no.alias("chunk_index"), no.alias("position"), F.lit("index_gap").alias("rule"))
    out = own.unionByName(gaps)
    if blocks is None:
        return out
    expected = blocks if rejected is None else blocks.join(rejected.select("doc_key").distinct(), "doc_key", "left_anti")
    return out.unionByName(_audit_places(chunks, blocks)).unionByName(_audit_cover(chunks, expected))


def _audit_places(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """What is wrong with chunks as parts of their segment. What a text says by itself is told before the chunks move, so that no more
    than LONGEST_PREFIX characters of it do; of blocks only headings have text here."""
    line = F.when(F.col("kind") == "heading", F.substring("content", 1, LONGEST_PREFIX)).alias("line")
    heads = segment_blocks(blocks.select("doc_key", "position", "page_index", "section", "kind", line))
    heads = heads.groupBy("doc_key", "segment").agg(F.min_by(F.struct("page_index", "section", "kind", "line"), "position").alias("first"))
    begin, end = F.get("spans", F.lit(0))["at"], F.element_at("spans", -1)["at"] + F.element_at("spans", -1)["length"]
    between = F.transform("spans", lambda s, i: F.coalesce(F.substr("content", F.get("spans", i - 1)["at"] + F.get("spans", i - 1)["length"] + 1, s["at"] - F.get("spans", i - 1)["at"] - F.get("spans", i - 1)["length"]), F.lit("")))
    loose = (F.size("spans") == 0) | (end != F.length("content")) | F.exists(between, lambda x: x.rlike(r"\S"))
    headless = ~F.col("content").rlike(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}")
    own = chunks.select(
        "doc_key", "segment", "chunk_index", "page_index", "section", "contains_table", "overlap_characters", F.substring("content", 1, LONGEST_PREFIX).alias("start"),
        begin.alias("begin"), F.when(F.col("contains_table"), headless).alias("headless"), F.when(~F.col("contains_table"), loose).alias("loose"),
    )
    joined = own.join(heads, ["doc_key", "segment"]).withColumn("prefix", F.when(F.col("first.kind") == "heading", F.col("first.line")))
    section = F.when(F.trim("first.section") != "", F.substring("first.section", 1, 500))
    repeated = F.coalesce(F.length("prefix") + 2, F.lit(0)) + F.when(F.col("overlap_characters") > 0, F.col("overlap_characters") + 1).otherwise(0)
    rules = F.array_compact(
        F.array(
            F.when(~F.col("page_index").eqNullSafe(F.col("first.page_index")), "page_crossing"), F.when(~F.col("section").eqNullSafe(section), "section"),
            F.when(~F.startswith("start", F.col("prefix")), "heading"),
            F.when(F.col("contains_table") & F.col("headless"), "table_head"),
            F.when(~F.col("contains_table") & (~F.col("begin").isin(0, repeated) | F.col("loose")), "foreign_text"),
        )
    )
    return joined.select("doc_key", "chunk_index", F.lit(None).cast("int").alias("position"), F.explode(rules).alias("rule"))


def _pieces(source: Column) -> Column:
    return F.when(F.length(source) > PIECE, F.regexp_extract_all(source, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array(source))


def _part(source: Column, pieces: Column, start: Column, length: Column) -> Column:
    """``length`` characters of ``source`` from ``start`` on, looked up in its ``pieces``: in a string of many pieces a substring is found by
    counting from its begin, and a block has as many spans as sentences."""
    size, within = F.lit(PIECE), start % PIECE
    some = F.slice(pieces, F.floor(start / size).cast("int") + 1, F.floor((within + F.greatest(length, F.lit(0))) / size).cast("int") + 1)
    return F.when((F.size(pieces) > 1) & (start >= 0), F.substr(F.array_join(some, ""), within + 1, length)).otherwise(F.substr(source, start + 1, length))


def _audit_cover(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a sweep over the spans of each block finds. The spans of a block, with their texts, are about as large as
    the block, and the sweep takes as long as they are. What stands before a span goes with it where it ends a line, as the head of a table does."""
    at = F.col("s.at")
    before = F.when(F.substr("content", at, F.lit(1)) == "\n", at).otherwise(at * 0)
    spans = chunks.select("doc_key", "chunk_index", "content", F.explode("spans").alias("s")).select(
        "doc_key", F.col("s.position").alias("position"),
        F.struct(
            "chunk_index", "s.at", "s.start", "s.length", F.substr("content", F.col("s.at") + 1, F.col("s.length")).alias("text"),
            F.when(F.col("s.start") > 0, F.substr("content", F.lit(1), before)).alias("before"),
        ).alias("span"),
    )
    spans = spans.groupBy("doc_key", "position").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    own = blocks.select("doc_key", "position", "kind", F.col("content").alias("source"))
    both = own.join(spans, ["doc_key", "position"], "full")
    source, pieces, text = F.col("source"), F.col("pieces"), r"\S"
    both = both.withColumn("pieces", _pieces(source))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(False).alias("gap"), F.lit(False).alias("twice"))
    swept = F.aggregate(
        by_start, start,
        lambda state, s: F.struct(
            F.greatest(state["end"], s["start"] + s["length"]).alias("end"),
            (state["gap"] | ((s["start"] > state["end"]) & _part(source, pieces, state["end"], s["start"] - state["end"]).rlike(text))).alias("gap"),
            (state["twice"] | ((s["start"] < state["end"]) & (s["length"] > 0))).alias("twice"),
        ),
    )
    both = both.withColumn("swept", swept)
    head = F.concat(F.array_join(F.slice(F.split(source, "\n"), 1, 2), "\n"), F.lit("\n"))
    rules = F.array_compact(
        F.array(
            F.when(source.isNull(), "unknown_block"), F.when(F.col("spans").isNull() & source.rlike(text), "lost_block"),
            F.when(F.col("swept.gap") | F.substr(source, F.col("swept.end") + 1).rlike(text), "gap"), F.when(F.col("swept.twice"), "double_cover"),
            F.when(F.exists(F.transform("spans", lambda s, i: s["start"] < F.get("spans", i - 1)["start"]), lambda x: x), "order"),
            F.when(F.exists("spans", lambda s: s["text"] != _part(source, pieces, s["start"], s["length"])), "not_lossless"),
            F.when((F.col("kind") == "table") & F.exists("spans", lambda s: ~F.endswith(s["before"], head)), "table_head"),
        )
    )
    return both.select("doc_key", F.lit(None).cast("int").alias("chunk_index"), F.col("position").cast("int").alias("position"), F.explode(rules).alias("rule"))


def chunk_config_sweep(blocks: DataFrame, configs: dict[str, ChunkConfig] = SWEEP) -> DataFrame:
    """Number and sizes of chunks under each configuration. The blocks of a document come together once, for all of them."""
    told = _whole(blocks).select(_sizer(list(configs.values()))("blocks").alias("s"))
    sums = [F.coalesce(F.sum(F.col("s")[i]["chunks"]), F.lit(0).cast("long")).alias(f"chunks{i}") for i in range(len(configs))]
    for i in range(len(configs)):
        sums += [f(F.col("s")[i][n]).alias(f"{n}{i}") for n, f in zip(_SIZES[1:], (F.max, F.sum, F.max), strict=True)]
    each = [F.struct(F.lit(name).alias("config"), *(F.col(f"{n}{i}").alias(n) for n in _SIZES)) for i, name in enumerate(configs)]
    return told.agg(*sums).select(F.inline(F.array(*each)))
