"""Column functions for text that follow Unicode, as untrusted input needs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.schemas import WS

CONTROL = r"[\p{Cc}\p{Cf}]"


def strip(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(col, rf"\A[{WS}]+", ""), rf"[{WS}]+\z", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(rf"[^{WS}]")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that what follows reads as they are: a generator of one row stands between, which the
    optimizer does not write them through again and again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(col: Column) -> Column:
    """Compatibility normalization, for which Spark has no function. ASCII passes untouched."""
    return F.pandas_udf(_nfkc, "string")(col)


def uuid_of(digest: Column) -> Column:
    """The first 128 bits of a hex digest in the form of a UUID: the same on every recomputation."""
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def document_id(sha256: Column) -> Column:
    return uuid_of(F.sha2(F.concat(F.lit("document:"), sha256), 256))


def chunk_id(sha256: Column, index: Column) -> Column:
    return uuid_of(F.sha2(F.concat(F.lit("chunk:"), sha256, F.lit(":"), index.cast("string")), 256))
