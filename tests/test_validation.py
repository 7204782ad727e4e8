"""Accept and reject tables of the input contract."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docmill import schemas as S
from docmill.operators import validation as V

BASE = {"filename": "report.md", "mime_type": "text/markdown", "content": b"# Quarterly report\n\nRevenue increased."}
PDF = {"filename": "statement.PDF", "mime_type": "application/pdf", "content": b"%PDF-1.7\n"}

CASES = [
    ({}, None), ({"filename": "notes.txt", "mime_type": "text/plain; charset=utf-8", "content": b"a"}, None), (PDF, None),
    ({"content": b"x" * (5 * 1024 * 1024)}, None), ({"content": b"x" * (5 * 1024 * 1024 + 1)}, "file_too_large"),
    ({"content": b""}, "empty_file"), ({"filename": "report.exe"}, "unsupported_file_extension"), ({"mime_type": "application/octet-stream"}, "unsupported_mime_type"),
    ({"mime_type": "application/pdf"}, "file_type_mismatch"), (PDF | {"content": b"no"}, "file_type_mismatch"),
    ({"filename": "a.txt", "mime_type": "text/plain", "content": b"a\x00b"}, "unsafe_file_content"), ({"content": None}, "unsafe_file_content"),
    ({"filename": None}, "invalid_filename"), ({"mime_type": None}, "unsupported_mime_type"), ({"filename": ".."}, "invalid_filename"), ({"filename": ".md"}, "unsupported_file_extension"),
    ({"filename": "x" * 252 + ".md"}, None), ({"filename": "x" * 253 + ".md"}, "invalid_filename"),
    ({"title": "t" * 200}, None), ({"title": "t" * 201}, "invalid_title"), ({"title": "a\nb"}, "invalid_title"), ({"title": " \u00a0 "}, "invalid_title"), ({"source_name": "a\rb"}, "invalid_source_name"),
    ({"source_url": "http://127.0.0.1:1/private-document"}, None), ({"source_url": " HTTPS://a "}, None), ({"source_url": "http://my_host/p"}, None), ({"source_url": "http://u:p@h:65535/x"}, None),
    ({"source_url": "ftp://example.com/report"}, "invalid_source_url"), ({"source_url": "https:///missing-host"}, "invalid_source_url"), ({"source_url": "http://h:99999"}, "invalid_source_url"),
    ({"source_url": "http://h:" + "9" * 60}, "invalid_source_url"), ({"source_url": "http://h/\x07"}, "invalid_source_url"), ({"source_url": ""}, "invalid_source_url"),
    ({"published_at": "2026-06-25"}, None), ({"published_at": "25-06-2026"}, "invalid_published_at"), ({"published_at": "2026-02-30"}, "invalid_published_at"), ({"published_at": "20260625"}, "invalid_published_at"),
    ({"published_at": "0000-01-01"}, "invalid_published_at"), ({"published_at": "2026-06-25\n"}, "invalid_published_at"),
    ({"metadata": '{"external_id":"EXT-2026","reviewed":true,"quarters":[1,2,3,4]}'}, None), ({"metadata": json.dumps({f"k{i}": i for i in range(20)})}, None),
    ({"metadata": json.dumps({f"k{i}": i for i in range(21)})}, "metadata_too_many_keys"), ({"metadata": json.dumps({"k": "v" * 4096})}, "metadata_too_large"), ({"metadata": " " * 4097}, "metadata_too_large"),
    *[({"metadata": json.dumps({k: 1})}, "metadata_reserved_key") for k in ("id", "sha256", "STATUS", " chunks_count ", "created_at")],
    ({"metadata": '{"region":1," region ":2}'}, "invalid_metadata"), ({"metadata": "not-json"}, "invalid_metadata"), ({"metadata": '{"a":1,"a":2}'}, "invalid_metadata"), ({"metadata": '{"a":{"b":1,"b":2}}'}, "invalid_metadata"),
    ({"metadata": '{"a\\n":1}'}, "invalid_metadata"), ({"metadata": "[1]"}, "invalid_metadata"), ({"metadata": '{"a":{"b":1}}'}, "invalid_metadata"), ({"metadata": '{"a":[[1]]}'}, "invalid_metadata"),
    ({"metadata": json.dumps({"a": list(range(21))})}, "invalid_metadata"), ({"metadata": '{"a":NaN}'}, "invalid_metadata"), ({"metadata": '{"a":1e999}'}, "invalid_metadata"), ({"metadata": '{"a":"\\ud800"}'}, "invalid_metadata"),
    # two faults: the earlier check decides
    ({"filename": "..", "content": b""}, "invalid_filename"), ({"content": b"", "filename": "a.exe"}, "empty_file"), ({"metadata": "[", "title": ""}, "invalid_metadata"), ({"title": "", "source_url": "x"}, "invalid_title"),
]


def _received(spark, rows):
    full = [tuple(({"doc_key": str(i), "arrival_seq": i} | dict.fromkeys(S.RECEIVED.fieldNames()[2:]) | r)[n] for n in S.RECEIVED.fieldNames()) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, S.RECEIVED)


def test_verdicts(spark):
    rows = _received(spark, [BASE | c for c, _ in CASES])
    got = {int(r.doc_key): r.error_code for r in V.judge(rows).select("doc_key", "error_code").collect()}
    wrong = [({k: str(v)[:40] for k, v in c.items()}, want, got[i]) for i, (c, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


def test_normalized_fields_and_quarantine(spark):
    rows = [
        BASE | {"filename": "../../reports/report.md", "title": "  A ｔitle ", "source_name": " s ", "source_url": " https://x/y ", "published_at": "2026-06-25", "metadata": '{"b": 1, "a": "é"}'},
        BASE | {"filename": "C:\\uploads\\report.md"}, BASE | {"filename": "report\n.md"}, BASE | {"filename": "ｒeport.md"}, BASE | {"title": "secret\x00value"},
    ]
    good, bad = V.validate(_received(spark, rows))
    got = {r.doc_key: r for r in good.collect()}
    assert [got[str(i)].original_filename for i in range(4)] == ["report.md", "report.md", "report_.md", "report.md"]
    first = got["0"]
    assert (first.title, first.source_name, first.source_url, str(first.published_at), first.metadata) == ("A title", "s", "https://x/y", "2026-06-25", '{"a":"é","b":1}')
    assert first.sha256 == hashlib.sha256(BASE["content"]).hexdigest() and got["1"].metadata == "{}"
    (rejected,) = bad.collect()
    assert rejected.asDict() == {"doc_key": "4", "stage": "validation", "error_code": "invalid_title", "error_field": "title"}
    assert "secret" not in str(rejected)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rows = _received(spark, [BASE | c for c, _ in CASES[:12]]).repartition(parts)
    assert sorted(r.error_code or "" for r in V.judge(rows).select("error_code").collect()) == sorted(w or "" for _, w in CASES[:12])


def _plain_url(url):
    """What the standard library's parser makes of it."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        return parts.scheme in ("http", "https") and bool(parts.hostname) and (parts.port is None or 0 <= parts.port <= 65535)
    except ValueError:
        return False


def test_bracketed_hosts_as_the_standard_parser_judges_them(spark):
    import random

    r = random.Random(0)
    hosts = ["abc", "1.2.3.4", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "::01.2.3.4", "fe80::1%eth0", "12345::", "g::", "v1.a", "v1F.x:y", "v.a", "vz.a", "v1.", "", ":", ":::", "1:", ":1", "::%"]
    for _ in range(400):
        groups = [r.choice(["", "0", "a", "ffff", "12345", "1.2.3.4", "g"] + ["1"] * 6) for _ in range(r.randint(1, 10))]
        hosts.append(":".join(groups))
    urls = [f"http://[{h}]{end}" for h in hosts for end in ("/", ":80", "")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {u: e is None for u, e in df.select("url", V.source_url_error(F.col("url"))).collect()}
    assert [u for u in urls if got[u] != _plain_url(u)] == []
