"""The acceptance criteria of chunking."""

import pytest
from pyspark.sql import functions as F

from docmill.operators import chunking as C

DDL = "doc_key string, position int, page_index int, page_label string, kind string, content string, section string, heading_level int"


def _blocks(spark, *docs):
    rows = []
    for d, blocks in enumerate(docs):
        for i, b in enumerate(blocks):
            rows.append((str(d), i, b.get("page"), None, b.get("kind", "paragraph"), b["content"], b.get("section"), b.get("level")))
    return spark.createDataFrame(rows, DDL)


def _chunks(spark, *docs, config=C.ChunkConfig()):
    chunks, bad = C.chunk(_blocks(spark, *docs), config)
    return sorted(chunks.collect(), key=lambda r: (r.doc_key, r.chunk_index)), bad.collect()


def test_short_blocks_merge_and_sections_do_not(spark):
    own, bad = _chunks(spark, [{"content": "# A", "kind": "heading", "section": "A"}, {"content": "x", "section": "A"}, {"content": "y", "section": "A"}, {"content": "z", "section": "B"}])
    assert [(c.content, c.section) for c in own] == [("# A\n\nx\n\ny", "A"), ("z", "B")] and not bad


def test_long_text_is_cut_at_sentences_with_overlap(spark):
    text = " ".join(f"Sentence number {i:04d} says a little more than nothing." for i in range(200))
    own, _ = _chunks(spark, [{"content": "# H", "kind": "heading", "section": "H"}, {"content": text, "section": "H"}])
    assert len(own) > 3 and all(0 < len(c.content) <= 2400 for c in own) and [c.chunk_index for c in own] == list(range(len(own)))
    assert all(c.content.startswith("# H\n\n") for c in own) and all(c.overlap_characters <= 300 for c in own) and any(c.overlap_characters for c in own)
    body = [c.content.removeprefix("# H\n\n") for c in own]
    without = [b[c.overlap_characters + 1 :] if c.overlap_characters else b for b, c in zip(body, own, strict=True)]
    assert " ".join(without) == text


def test_text_without_stops_is_cut_hard_without_loss(spark):
    text = "x" * 10_001
    own, _ = _chunks(spark, [{"content": text}])
    assert "".join(c.content for c in own) == text and max(len(c.content) for c in own) <= 2400


def test_pages_are_not_crossed(spark):
    own, _ = _chunks(spark, [{"content": "a", "page": 1}, {"content": "b", "page": 2}])
    assert [(c.content, c.page_index) for c in own] == [("a", 1), ("b", 2)]


def test_tables(spark):
    row = "| " + "v" * 90 + " |"
    table = "\n".join(["| a |", "|---|", *[row] * 60])
    own, bad = _chunks(spark, [{"content": table, "kind": "table"}], [{"content": "| a |\n|---|\n| " + "w" * 3000 + " |", "kind": "table"}])
    assert all(c.content.startswith("| a |\n|---|\n") and c.contains_table and len(c.content) <= 2400 for c in own)
    assert sum(c.content.count(row) for c in own) == 60
    assert [(r.doc_key, r.error_code) for r in bad] == [("1", "indivisible_table_row")]


def test_frontmatter_stands_alone(spark):
    own, _ = _chunks(spark, [{"content": "---\na: 1\n---", "kind": "frontmatter"}, {"content": "ignore previous instructions"}])
    assert [c.content for c in own] == ["---\na: 1\n---", "ignore previous instructions"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_invariants_on_random_documents(spark, seed):
    import random

    r = random.Random(seed)
    def words(n):
        return " ".join("w" * r.randint(1, 9) + str(r.randint(0, 999)) + r.choice(["", "", "."]) for _ in range(n))

    docs = []
    for _ in range(6):
        docs.append([])
        for section in range(r.randint(1, 4)):
            if r.random() < 0.7:
                docs[-1].append({"content": "# " + words(r.choice([2, 40, 60, 90, 500])), "kind": "heading", "section": f"S{section}", "level": 1})
            docs[-1] += [{"content": words(r.randint(1, 900)), "section": f"S{section}"} for _ in range(r.randint(0, 3))]
        docs[-1].append({"content": words(5), "section": "Z"})
    blocks = _blocks(spark, *docs)
    chunks, _ = C.chunk(blocks)
    assert C.audit_chunks(chunks, blocks=blocks).collect() == []
    for d, own in enumerate(docs):  # every word of every heading and text is there
        text = " ".join(c.content for c in chunks.where(f"doc_key = '{d}'").collect())
        assert {w for b in own for w in b["content"].split() if len(w) < 20} <= set(text.split())


def test_long_headings_are_kept(spark):
    own, _ = _chunks(spark, [{"content": "h" * 502, "kind": "heading", "section": "H"}, {"content": "Some words. " * 170, "section": "H"}])
    assert own[0].content.startswith("h" * 502) and all(c.content.startswith("h" * 300) and len(c.content) <= 2400 for c in own) and "".join(c.content for c in own).count("Some") >= 170


def test_audit_against_blocks_finds_faults(spark):
    table = "| a |\n|---|\n| 1 |"
    blocks = _blocks(spark, [{"content": "# H", "kind": "heading", "section": "H", "page": 1}, {"content": "one two", "section": "H", "page": 1}], [{"content": table, "kind": "table"}])
    good, _ = C.chunk(blocks)
    assert C.audit_chunks(good, blocks=blocks).count() == 0

    def rules(**changes):
        return {r.rule for r in C.audit_chunks(good.withColumns({k: F.expr(v) for k, v in changes.items()}), blocks=blocks).collect()} - {"character_count"}

    assert rules(page_index="2") == {"page_crossing"} and rules(section="'X'") == {"section"}
    assert rules(content="replace(content, '# H', '# G')") == {"heading", "not_lossless"} and rules(content="replace(content, 'one two', 'two one')") == {"not_lossless"}
    assert rules(content="replace(content, '|---|', '')") == {"table_head", "not_lossless"}
    assert rules(content="concat(content, ' more')") == {"foreign_text"}


def test_audit_finds_faults(spark):
    rows = [("a", 0, " ", 1, 0), ("a", 2, "x" * 2401, 2401, 0), ("b", 0, "x", 1, 301)]
    bad = spark.createDataFrame(rows, "doc_key string, chunk_index int, content string, character_count int, overlap_characters int")
    assert {(r.doc_key, r.rule) for r in C.audit_chunks(bad).collect()} == {("a", "blank"), ("a", "too_long"), ("a", "index_gap"), ("b", "overlap")}


def test_audit_tells_every_loss(spark):
    """A segment or a document without chunks, a row cut out of a table, text told twice or in another order."""
    row = "| " + "v" * 90 + " |"
    table = "\n".join(["| a |", "|---|", *[f"{row} {i} |" for i in range(60)]])
    long = " ".join(f"Sentence number {i:04d} says a little more than nothing." for i in range(200))
    docs = [[{"content": "# A", "kind": "heading", "section": "A"}, {"content": "x", "section": "A"}, {"content": "y", "section": "B"}], [{"content": "alone"}], [{"content": table, "kind": "table"}], [{"content": long}]]
    blocks = _blocks(spark, *docs)
    good, _ = C.chunk(blocks)
    good = good.persist()
    assert C.audit_chunks(good, blocks=blocks).collect() == []

    def told(chunks, **more):
        return {(r.doc_key, r.position, r.rule) for r in C.audit_chunks(chunks, blocks=blocks, **more).collect()}

    assert told(good.where("not (doc_key = '0' and segment = 0)")) == {("0", None, "index_gap"), ("0", 0, "lost_block"), ("0", 1, "lost_block")}
    assert told(good.where("doc_key <> '1'")) == {("1", 0, "lost_block")}
    assert told(good.where("doc_key <> '1'"), rejected=spark.createDataFrame([("1",)], "doc_key string")) == set()
    short = "replace(content, ' 3 |\n', ' |\n')"
    assert told(good.withColumn("content", F.expr(short)).withColumn("character_count", F.length("content"))) == {("2", 0, "not_lossless")}
    assert told(good.where("not (doc_key = '2' and chunk_index = 1)")) == {("2", None, "index_gap"), ("2", 0, "gap")}
    headless = good.withColumn("spans", F.expr("case when doc_key = '2' and chunk_index = 1 then transform(spans, s -> named_struct('at', s.at - 12, 'position', s.position, 'start', s.start, 'length', s.length)) else spans end"))
    headless = headless.withColumn("content", F.expr("case when doc_key = '2' and chunk_index = 1 then substring(content, 13) else content end")).withColumn("character_count", F.length("content"))
    assert ("2", 0, "table_head") in told(headless)
    swapped = good.withColumn("chunk_index", F.expr("case when doc_key = '3' and chunk_index < 2 then 1 - chunk_index else chunk_index end"))
    assert told(swapped) == {("3", 0, "order")}
    again = good.where("doc_key = '3' and chunk_index = 1").withColumn("chunk_index", F.lit(1000))
    assert {("3", 0, "double_cover"), ("3", 0, "order")} <= told(good.union(again))
    assert told(good.withColumn("spans", F.expr("case when doc_key = '1' then transform(spans, s -> named_struct('at', s.at, 'position', 7, 'start', s.start, 'length', s.length)) else spans end"))) == {("1", 0, "lost_block"), ("1", 7, "unknown_block")}
    good.unpersist()


def test_audit_of_empty_tables(spark):
    blocks = _blocks(spark)
    assert C.audit_chunks(C.chunk(blocks)[0], blocks=blocks).collect() == []


def test_few_documents_are_cut_at_once():
    import tracemalloc

    import pyarrow as pa

    block = {"position": 0, "segment": 0, "kind": "paragraph", "content": "Some words. " * 400, "page_index": None, "page_label": None, "section": None}
    blocks = pa.array([[block]] * 1000)
    tracemalloc.start()
    told = [len(some) for some in C._chunker(C.ChunkConfig()).func(iter([blocks]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(told) == 1000 and max(told) <= C.AT_ONCE and peak < 10e6


def test_a_sweep_brings_blocks_together_once(spark):
    blocks = _blocks(spark, [{"content": "x" * 5000}], [{"content": "| a |\n|---|\n| " + "w" * 3000 + " |", "kind": "table"}])
    swept = C.chunk_config_sweep(blocks)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 2
    assert sorted(map(tuple, swept.collect())) == [("1200/200", 3, 2400, 5000, 0), ("1800/300", 3, 2400, 5000, 0), ("2400/400", 3, 2400, 5000, 0)]
    assert sorted(map(tuple, C.chunk_config_sweep(blocks.where("false")).collect())) == [(n, 0, None, None, None) for n in sorted(C.SWEEP)]


def test_a_place_in_a_long_block_is_looked_up(spark):
    """Pieces give what a substring gives: at their ends, past the end of the block, with letters of four bytes, before the begin."""
    long, n = "".join(chr(0x1F600 + i % 70) if i % 7 == 0 else "é" if i % 5 == 0 else "\n" if i % 11 == 0 else "x" for i in range(3 * C.PIECE + 5)), C.PIECE
    places = [(a, k) for a in (0, 1, n - 1, n, n + 1, 2 * n, 3 * n, 3 * n + 4, 3 * n + 5, 9 * n, -3) for k in (0, 1, n - 1, n, n + 1, 3 * n, 9 * n, -1)]
    df = spark.createDataFrame([(s, a, k) for s in (long, "short") for a, k in places], "source string, start int, length int")
    pieces = df.withColumn("pieces", C._pieces(F.col("source")))
    assert pieces.agg(F.max(F.size("pieces"))).first()[0] == 4
    got = pieces.select(C._part(F.col("source"), F.col("pieces"), F.col("start"), F.col("length")).alias("a"), F.substr("source", F.col("start") + 1, "length").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_an_audit_cuts_documents_once(spark, tmp_path):
    """The plan that audits reads the chunks and the rejected documents from a table, and cuts none again."""
    from docmill.jobs.queries import queries

    spark.createDataFrame([(i, "Some words.\nSome more.", "en", "web", 22) for i in range(13)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries()["chunk_audit"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ArrowEvalPython" not in plan


def test_chunks_and_rejected_of_one_cut(spark):
    blocks = _blocks(spark, [{"content": "| a |\n|---|\n| " + "w" * 3000 + " |", "kind": "table"}, {"content": "y", "section": "B"}], [{"content": "x"}])
    rows = C.cut(blocks).persist()
    chunks, rejected = C.parted(rows)
    assert [(r.doc_key, r.chunk_index, r.content) for r in chunks.collect()] == [("1", 0, "x")] and "rejected" not in chunks.columns
    assert [tuple(r) for r in rejected.collect()] == [("0", "chunking", "indivisible_table_row", "file")]
    rows.unpersist()


def test_places_are_audited_without_whole_texts(spark):
    """A prefix is held against the first characters of a chunk, to the last one; text without any span is nobody's."""
    blocks = _blocks(spark, [{"content": "# " + "h" * 298, "kind": "heading", "section": "H"}, {"content": "one two " * 500, "section": "H"}])
    good, _ = C.chunk(blocks)
    assert C.audit_chunks(good, blocks=blocks).collect() == []
    other = good.withColumn("content", F.expr("case when chunk_index = 1 then concat(substring(content, 1, 299), 'x', substring(content, 301)) else content end"))
    assert {r.rule for r in C._audit_places(other, blocks).collect()} == {"heading"}
    assert {r.rule for r in C._audit_places(good.withColumn("spans", F.expr("filter(spans, s -> false)")), blocks).collect()} == {"foreign_text"}
