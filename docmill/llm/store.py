"""Shared scratch tables and membership filters of bounded size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []

#: Shuffle files go as soon as the table is there; texts go to Python in small batches.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. A session that names none gets a
    folder of its own if it runs on one machine, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="docmill-"))
        base = _fallback[0]
    return f"{base.rstrip('/')}/docmill"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back: the lineage ends there, so that a
    lost executor costs no more than the tasks it ran. Tables that a returned plan still reads stay
    until the folder is cleared; others may be given to forget."""
    conf, path = df.sparkSession.conf, f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = {k: conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that no plan needs any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_by_filter(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose 64-bit key may be in ``keys(key)``, rows whose key is not): only the former need a join,
    so whole rows of the others are not shuffled."""
    bloom = df.sparkSession.sparkContext.broadcast(Bloom.sized(keys, F.col("key")).words)

    @F.pandas_udf("boolean")
    def maybe(values: pd.Series) -> pd.Series:
        return pd.Series(Bloom(bloom.value).has(values.to_numpy(np.int64).view(np.uint64)))

    return df.where(maybe(key)), df.where(~maybe(key))


class Bloom:
    """A filter over 64-bit values. It may say yes wrongly, never no; a full one says yes to all, which
    costs time and changes no result."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(df: DataFrame, column: Column, log2_bits: int) -> Bloom:
        mask = (1 << log2_bits) - 1
        value = column.cast("long")
        bits = df.select(
            F.explode(F.array(value.bitwiseAND(mask), F.shiftrightunsigned(value, 32).bitwiseAND(mask))).alias("bit")
        )
        # the key is the 64-bit word of the filter: at most 2**(log2_bits - 6) rows reach the driver
        rows = (
            bits.groupBy(F.shiftright("bit", 6).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
            .toPandas()
        )
        words = np.zeros(1 << (log2_bits - 6), np.uint64)
        words[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64).view(np.uint64)
        return Bloom(words)

    @staticmethod
    def sized(df: DataFrame, column: Column) -> Bloom:
        """With some 16 bits for each row, 2**14 bits at least and 2**27 (16 MB) at most."""
        return Bloom.of(df, column, min(max(int(16 * df.count()).bit_length(), 14), 27))

    def has(self, values: np.ndarray) -> np.ndarray:
        v = values.astype(np.uint64, copy=False)
        mask = np.uint64(len(self.words) * 64 - 1)
        out = np.ones(len(v), bool)
        for bit in (v & mask, (v >> np.uint64(32)) & mask):
            out &= ((self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out
