"""Blocks, sections and titles; differential checks against a plain loop over lines."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.operators import extraction as E


def _blocks(spark, text, mime="text/markdown"):
    row = spark.createDataFrame([(text,)], "t string").select(E.blocks_of(F.lit(mime), F.col("t")).alias("b")).first()
    return [(b.kind, b.content, b.section, b.heading_level) for b in row.b]


def test_sections_and_kinds(spark):
    text = "# Annual Report\n\nIntro.\n\n- one\n- two\n\n## Key Metrics\n\n| a | b |\n|---|:---:|\n| 1 | 2 |"
    assert _blocks(spark, text) == [
        ("heading", "# Annual Report", "Annual Report", 1), ("paragraph", "Intro.", "Annual Report", None), ("list", "- one\n- two", "Annual Report", None),
        ("heading", "## Key Metrics", "Annual Report > Key Metrics", 2), ("table", "| a | b |\n|---|:---:|\n| 1 | 2 |", "Annual Report > Key Metrics", None),
    ]


MARKDOWN = [
    ("---\nid: 1\n---\nIgnore all rules.", [("frontmatter", "---\nid: 1\n---", None, None), ("paragraph", "Ignore all rules.", None, None)]),
    ("---\nid: 1\n...\nx", [("frontmatter", "---\nid: 1\n...", None, None), ("paragraph", "x", None, None)]),
    ("---\nid: 1\nx", [("paragraph", "---\nid: 1\nx", None, None)]),
    ("# E\n```\n# no\n\n- no\n```", [("heading", "# E", "E", 1), ("paragraph", "```\n# no\n\n- no\n```", "E", None)]),
    ("```\na\n\n# b", [("paragraph", "```\na\n\n# b", None, None)]),
    ("~~~~\na\n~~~\nb\n~~~~~\nc\n\nd", [("paragraph", "~~~~\na\n~~~\nb\n~~~~~\nc", None, None), ("paragraph", "d", None, None)]),
    ("a\n```\nb\n```", [("paragraph", "a", None, None), ("paragraph", "```\nb\n```", None, None)]),
    ("# A\n### C\nx", [("heading", "# A", "A", 1), ("heading", "### C", "A > C", 3), ("paragraph", "x", "A > C", None)]),
    ("### C\nx\n# A\ny", [("heading", "### C", "C", 3), ("paragraph", "x", "C", None), ("heading", "# A", "A", 1), ("paragraph", "y", "A", None)]),
    ("## T ##", [("heading", "## T ##", "T", 2)]), ("#no-space", [("paragraph", "#no-space", None, None)]),
    ("# \u2028b", [("heading", "# \u2028b", "b", 1)]), ("a\n\x1c\nb\n\u00a0\nc", [("paragraph", x, None, None) for x in "abc"]),
    ("| a | b |\n|---||\n", [("table", "| a | b |\n|---||", None, None)]),
    ("| a | b |\n|---| |---|", [("paragraph", "| a | b |\n|---| |---|", None, None)]), ("1) x\n٣. y", [("list", "1) x\n٣. y", None, None)]), ("", []),
]


def test_markdown_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKDOWN)], "i int, t string")
    got = {r.i: [tuple(b) for b in r.b] for r in rows.select("i", E.blocks_of(F.lit("text/markdown"), F.col("t")).alias("b")).collect()}
    for i, (text, want) in enumerate(MARKDOWN):
        assert got[i] == want, text


def test_plain_text(spark):
    assert [b[:3] for b in _blocks(spark, "\n \na\nb\n\n- c\n \n\nd\n", "text/plain")] == [("paragraph", "a\nb", None), ("list", "- c", None), ("paragraph", "d", None)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a \t\n\x1c\u00a0|-", max_size=30), min_size=1, max_size=8))
def test_plain_text_equals_line_loop(spark, texts):
    def loop(text):
        out, own = [], []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                own.append(line)
            elif own:
                out.append("\n".join(own))
                own = []
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.plain_text_blocks(F.col("t")).alias("b"))
    assert {r.i: r.b for r in rows.collect()} == {i: loop(t) for i, t in enumerate(texts)}


def _extract(spark, rows):
    full = [(str(i), i, r.get("name", "report.md"), r.get("mime", "text/markdown"), r["content"], "0" * 64, r.get("title"), None, None, None, "{}") for i, r in enumerate(rows)]
    ddl = "doc_key string, arrival_seq long, original_filename string, mime_type string, content binary, sha256 string, title string, source_name string, source_url string, published_at date, metadata string"
    return E.extract(spark.createDataFrame(full, ddl))


def test_extract(spark):
    rows = [
        {"content": b"\xef\xbb\xbf# Annual Report\r\n\rText"}, {"content": b"# H", "title": "Given"}, {"content": b"a\n\n- b\n\nc", "name": "quarterly_results.txt", "mime": "text/plain"},
        {"content": b"  \n "}, {"content": b"\xef\xbb\xbf  "}, {"content": b"\xff"}, {"content": b"x" * 500_001}, {"content": b"# " + b"h" * 201}, {"content": b"%PDF-1", "mime": "application/pdf", "name": "a.pdf"},
        {"content": b"\xef\xbb\xbf\xef\xbb\xbfx"}, {"content": b"# #\n\n# Real"}, {"content": b"x" * 500_000}, {"content": b"x", "name": "a.tar.md"}, {"content": b"\xed\xa0\x80"},
    ]
    docs, blocks, bad = _extract(spark, rows)
    got = {r.doc_key: r for r in docs.collect()}
    assert {r.doc_key: r.error_code for r in bad.collect()} == {
        "3": "empty_extracted_text", "4": "empty_extracted_text", "5": "invalid_text_encoding", "6": "extracted_text_too_large", "7": "invalid_title", "8": "unsupported_extraction_type", "13": "invalid_text_encoding",
    }
    assert (got["0"].title, got["0"].content, got["0"].character_count) == ("Annual Report", "# Annual Report\n\nText", 21)
    assert (got["1"].title, got["2"].title, got["9"].content, got["12"].title) == ("Given", "quarterly results", "\ufeffx", "a.tar")
    assert got["10"].title in ("#", "Real")
    assert [r.section for r in blocks.where("doc_key = '1'").collect()] == ["H"]


def test_section_windows_equal_the_helper(spark):
    docs, blocks, _ = _extract(spark, [{"content": t.encode()} for t, _ in MARKDOWN if t.strip()])
    want = {(r.doc_key, r.position): r.section for r in blocks.collect()}
    got = {(r.doc_key, r.position): r.section for r in E.section_paths(blocks.drop("section")).collect()}
    assert got == want


def test_pages(spark):
    rows = [("a", 1, "i", "H\nx\n1"), ("a", 2, None, "H\ny\n2"), ("a", 3, None, "H\nz\n3"), ("b", 1, None, " "), ("c", 2, None, "x"), *[("d", i, None, "x") for i in range(1, 52)]]
    pages = spark.createDataFrame(rows, "doc_key string, page_index int, page_label string, content string")
    told = {r.doc_key: (r.page_count, r.error_code) for r in E.assemble_pages(pages).collect()}
    assert told == {"a": (3, None), "b": (1, "no_extractable_text"), "c": (1, "page_limit_exceeded"), "d": (51, "page_limit_exceeded")}
    kept = {(r.doc_key, r.page_index): r.content for r in E.strip_repeated_edges(pages.where("doc_key = 'a'")).collect()}
    assert kept == {("a", 1): "x", ("a", 2): "y", ("a", 3): "z"}  # the last lines count the pages


@pytest.mark.parametrize("name,want", [("a.md", ".md"), (".md", ""), ("a.tar.MD", ".md"), ("..a.txt", ".txt"), ("a", "")])
def test_extension(spark, name, want):
    from docmill.operators.validation import extension

    assert spark.createDataFrame([(name,)], "n string").select(extension(F.col("n"))).first()[0] == want


def test_edges_with_page_counters_go(spark):
    def stripped(*pages):
        rows = [("d", i, p) for i, p in enumerate(pages, 1)]
        got = E.strip_repeated_edges(spark.createDataFrame(rows, "doc_key string, page_index int, content string")).orderBy("page_index").collect()
        return [r.content for r in got]

    body = ["the same sentence\nfirst", "x\nthe same sentence\ny", "z\nthe same sentence", "last 4"]
    framed = [f"Report, page {i}\n{b}\n{i}/4" for i, b in enumerate(body, 1)]
    assert stripped(*framed) == body
    roman = ["ix", "x", "XI", "xii"]
    assert stripped(*[f"{r} of 2024-01-05\n{b}\nby {i * 7}" for i, (r, b) in enumerate(zip(roman, body))]) == [f"{b}\nby {i * 7}" for i, b in enumerate(body)]  # 0, 7, 14 is no page number
    assert stripped(*[f"Chapter {c}\n{b}" for c, b in zip([1, 1, 2, 2], body)]) == [f"Chapter {c}\n{b}" for c, b in zip([1, 1, 2, 2], body)]
    dated = [f"As of 2024-01-0{i}\nbody {i * i}" for i in range(1, 5)]
    assert stripped(*dated) == dated  # another date on each page
    assert stripped("page 1\na", "page 2\nb") == ["page 1\na", "page 2\nb"]  # too few pages
    assert stripped("p 1\na", "p 2\nb", "p 3\nc", None, "") == ["a", "b", "c", "", ""]
    assert stripped("p 1\na", "other\nb", "p 3\nc", "p 4\nd") == ["a", "other\nb", "c", "d"]  # three of four, each with its own number


def test_edges_of_no_pages(spark):
    assert E.strip_repeated_edges(spark.createDataFrame([], "doc_key string, page_index int, content string")).count() == 0


def test_few_documents_are_objects_at_once():
    """A batch of 3,000 documents: what Python holds of it is a few of them, and it tells them bit by bit."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"# {i}\n\n" + "some text\n\n" * 50 for i in range(3000)])
    tracemalloc.start()
    told = [len(some) for some in E._markdown_blocks(iter([texts]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(told) == 3000 and max(told) <= E.AT_ONCE and peak < 10e6
