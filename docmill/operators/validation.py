"""Validation of received files: one projection, the first failure decides, no shuffle.

Order: filename, file type, metadata, title, source_name, source_url, published_at.
"""

from __future__ import annotations

import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill import schemas as S
from docmill.functions.text import CONTROL, nfkc, strip


def normalize_filename(name: Column) -> Column:
    """The last part of a path as a display name; control and format characters become ``_``."""
    last = F.substring_index(F.translate(nfkc(name), "\\", "/"), "/", -1)
    return F.regexp_replace(strip(last), CONTROL, "_")


def filename_error(display: Column) -> Column:
    bad = display.isNull() | display.isin("", ".", "..") | (F.length(display) > S.MAX_FILENAME_CHARS)
    return F.when(bad, "invalid_filename")


def extension(display: Column) -> Column:
    """What follows the last dot that is not a leading one, with the dot, in lower case."""
    bare = F.regexp_replace(display, r"\A\.+", "")
    return F.when(F.contains(bare, F.lit(".")), F.lower(F.concat(F.lit("."), F.substring_index(bare, ".", -1)))).otherwise("")


def normalized_mime(mime: Column) -> Column:
    return F.lower(strip(F.substring_index(mime, ";", 1)))


def file_type_error(display: Column, mime: Column, content: Column, length: Column | None = None) -> Column:
    """``length`` is that of the file where its content was not read."""
    expected = F.coalesce(*[F.when(extension(display) == e, m) for e, m in S.EXTENSIONS.items()])
    declared, size = normalized_mime(mime), F.octet_length(content).cast("long")
    size = size if length is None else F.coalesce(size, length)
    pdf = declared == "application/pdf"
    return (
        F.when(content.isNull() & (size.isNull() | (size <= S.MAX_FILE_BYTES)), "unsafe_file_content")
        .when(size == 0, "empty_file")
        .when(size > S.MAX_FILE_BYTES, "file_too_large")
        .when(expected.isNull(), "unsupported_file_extension")
        .when(declared.isNull() | ~declared.isin(*S.EXTENSIONS.values()), "unsupported_mime_type")
        .when(declared != expected, "file_type_mismatch")
        .when(pdf & ~F.startswith(content, F.lit(b"%PDF-")), "file_type_mismatch")
        .when(~pdf & F.contains(content, F.lit(b"\x00")), "unsafe_file_content")
    )


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def optional_text(value: Column) -> Column:
    return strip(nfkc(value))


def optional_text_error(stripped: Column, most: int, code: str) -> Column:
    """Of an ``optional_text``: null passes; a blank one, a long one or control characters fail."""
    return F.when((stripped == "") | (F.length(stripped) > most) | stripped.rlike(CONTROL), code)


def _ipv6() -> str:
    """An address of eight groups, of which one run of zeros may be left out, its last two as an IPv4 one."""
    group, byte = "[0-9a-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"(?:{group}:{group}|{byte}(?:\.{byte}){{3}})"
    whole = [f"(?:{group}:){{6}}{tail}"]
    for before in range(8):  # groups before the run that is left out
        some = f"(?:{group}(?::{group}){{0,{before - 1}}})?" if before else ""
        if before <= 5:
            whole += [f"{some}::(?:{group}:){{0,{5 - before}}}{tail}"] if before < 5 else [f"{some}::{tail}"]
        whole.append(f"{some}::" + (f"(?:{group})?" if before < 7 else ""))
    return rf"(?:{'|'.join(whole)})(?:%[^\]/?#%]+)?"


_BRACKETS = rf"\[(?:{_ipv6()}|v[0-9a-f]+\.[^\]/?#]+)\]"
_URL = rf"(?i)\Ahttps?://(?:[^/?#]*@)?(?:{_BRACKETS}|[^:/?#@\[\]]+)(?::[0-9]*)?(?:[/?#]|\z)"
_PORT = r"(?i)\Ahttps?://(?:[^/?#]*@)?(?:\[[^\]/?#]+\]|[^:/?#@\[\]]+):([0-9]*)"


def source_url_error(url: Column) -> Column:
    """An absolute http(s) URL with a host and a possible port; brackets hold an IPv6 address or one of a future version. It is
    never fetched. A null URL passes."""
    clean = strip(url)
    port = F.regexp_extract(clean, _PORT, 1)
    good = clean.rlike(_URL) & ~clean.rlike(r"\p{Cc}") & ((port == "") | (F.coalesce(port.try_cast("decimal(38,0)"), F.lit(10**9)) <= 65535))
    return F.when(url.isNotNull() & ~good, "invalid_source_url")


def published_date(value: Column) -> Column:
    """A real calendar day in the form dddd-dd-dd, else null."""
    return F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~value.startswith("0000"), F.try_to_date(value, "yyyy-MM-dd"))


def published_at_error(value: Column) -> Column:
    return F.when(value.isNotNull() & published_date(value).isNull(), "invalid_published_at")


class _Rejected(Exception):
    pass


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Rejected("invalid_metadata")
    return dict(pairs)


def _plain(value: object) -> bool:
    return value is None or isinstance(value, (str, int)) or (isinstance(value, float) and math.isfinite(value))


def _metadata(raw: str | None) -> tuple[str | None, str | None]:
    """(error code, canonical JSON): exactly one of them is set."""
    if raw is None:
        return None, "{}"
    try:
        if len(raw.encode("utf-8", "surrogatepass")) > S.MAX_METADATA_BYTES:
            raise _Rejected("metadata_too_large")
        told = json.loads(raw, object_pairs_hook=_unique)
        if not isinstance(told, dict):
            raise _Rejected("invalid_metadata")
        if len(told) > S.MAX_METADATA_KEYS:
            raise _Rejected("metadata_too_many_keys")
        clean: dict[str, object] = {}
        for name, value in told.items():
            short = name.strip()
            if not short or any(unicodedata.category(c) in ("Cc", "Cf") for c in name):
                raise _Rejected("invalid_metadata")
            if short.lower() in S.RESERVED_KEYS:
                raise _Rejected("metadata_reserved_key")
            items = value if isinstance(value, list) else [value]
            if short in clean or len(items) > S.MAX_METADATA_ITEMS or not all(map(_plain, items)):
                raise _Rejected("invalid_metadata")
            clean[short] = value
        canonical = json.dumps(clean, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
        if len(canonical.encode()) > S.MAX_METADATA_BYTES:
            raise _Rejected("metadata_too_large")
        return None, canonical
    except _Rejected as e:
        return str(e), None
    except (ValueError, RecursionError):  # bad JSON, a lone surrogate, numbers or nesting beyond limits
        return "invalid_metadata", None


def _verdicts(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_metadata(x) for x in raw], columns=["error_code", "canonical_json"])


def metadata_verdict(raw: Column) -> Column:
    """``struct<error_code, canonical_json>``, one of them null. The rules depend on the order of keys
    and on duplicates, which Spark's JSON functions hide."""
    return F.pandas_udf(_verdicts, "error_code string, canonical_json string")(raw)


FIELDS = {
    "invalid_title": "title", "invalid_source_name": "source_name", "invalid_source_url": "source_url", "invalid_published_at": "published_at",
    "invalid_metadata": "metadata", "metadata_too_large": "metadata", "metadata_too_many_keys": "metadata", "metadata_reserved_key": "metadata",
}


def field_of(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    return F.when(code.isNotNull(), F.coalesce(known[code], F.lit("file")))


def judge(received: DataFrame) -> DataFrame:
    """``received`` with the normalized fields, ``error_code`` and ``error_field`` (null: accepted)."""
    rows = received.withColumns(
        {
            "original_filename": normalize_filename(F.col("filename")), "declared_mime": normalized_mime(F.col("mime_type")),
            "verdict": metadata_verdict(F.col("metadata")), "clean_title": optional_text(F.col("title")), "clean_source": optional_text(F.col("source_name")),
        }
    )
    code = F.coalesce(
        filename_error(F.col("original_filename")),
        file_type_error(F.col("original_filename"), F.col("mime_type"), F.col("content"), F.col("length") if "length" in received.columns else None),
        F.col("verdict.error_code"),
        optional_text_error(F.col("clean_title"), S.MAX_TITLE_CHARS, "invalid_title"),
        optional_text_error(F.col("clean_source"), S.MAX_SOURCE_NAME_CHARS, "invalid_source_name"),
        source_url_error(F.col("source_url")),
        published_at_error(F.col("published_at")),
    )
    return rows.withColumn("error_code", code).withColumn("error_field", field_of(F.col("error_code")))


def validate(received: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(validated, rejected). Rejected rows carry keys and codes, never what was rejected."""
    judged = judge(received)
    good = judged.where("error_code is null").select(
        "doc_key", "arrival_seq", "original_filename", F.col("declared_mime").alias("mime_type"), "content", content_sha256(F.col("content")).alias("sha256"),
        F.col("clean_title").alias("title"), F.col("clean_source").alias("source_name"), strip(F.col("source_url")).alias("source_url"),
        published_date(F.col("published_at")).alias("published_at"), F.col("verdict.canonical_json").alias("metadata"),
    )
    return good, quarantine(judged, "validation")


def quarantine(judged: DataFrame, stage: str) -> DataFrame:
    return judged.where("error_code is not null").select("doc_key", F.lit(stage).alias("stage"), "error_code", "error_field")


def rejection_summary(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("stage", "error_code", "error_field").agg(F.count("*").alias("n"))
