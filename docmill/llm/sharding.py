"""Sharding by sampled splitters.

A record's key is the hash of its text, so equal texts lie side by side. From key samples whose chance
grows with the size of their records, quantiles of the bytes are taken as splitters, and records are
partitioned by range. A range that turns out overfull is subdivided: a key with more than its share gets a
range of its own, the rest is cut evenly. The range of a large group of equal texts is subdivided by doc_id, and
rows that are equal in that too by their place in the table; its parts stay together, unless the group is over half
a shard. The ranges, many more than shards, are given to the shards largest first, each to the one with the
fewest bytes.

The driver holds samples, splitters and totals of ranges: their number is bounded, whatever the
number of rows. Places within a range are counted by a task for each range.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docmill.llm.store import stored, unused

#: Ranges at first: one for 2**20 rows, but within these bounds; samples for each range.
LEAST_RANGES, MOST_RANGES, SAMPLES = 1 << 11, 1 << 16, 16
_RESULT = ("size", "text_crc32", "shard", "slot")


def quantile_splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Keys that begin a new range, so that the weights of the ranges are about equal."""
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], np.cumsum(weights[order])
    if not len(keys):
        return keys
    at = np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def subdivided(splitters: np.ndarray, overfull: pd.DataFrame, heavy: np.ndarray, share: float) -> np.ndarray:
    """``splitters`` with further ones: each heavy key is a range of its own, and overfull ranges ``(range,
    bytes)`` are cut evenly into parts of about ``share`` bytes."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    more = [heavy, heavy[heavy < high] + 1]
    for number, size in zip(overfull["range"], overfull["bytes"], strict=True):
        begin = int(splitters[number - 1]) if number else low
        end = int(splitters[number]) if number < len(splitters) else high
        parts = min(int(size // share) + 1, max(end - begin, 1))
        more.append(np.array([begin + (end - begin) * i // parts for i in range(1, parts)], np.int64))
    return np.unique(np.concatenate([splitters, *more]))


def packed(units: pd.DataFrame, shards: int) -> np.ndarray:
    """A shard for each of ``units(bytes)``: the largest first, to the shard with the fewest bytes."""
    out = np.zeros(len(units), np.int64)
    room = [(0, s) for s in range(shards)]
    for i in np.argsort(-units["bytes"].to_numpy(np.int64), kind="stable"):
        size, shard = heapq.heappop(room)
        out[i] = shard
        heapq.heappush(room, (size + int(units["bytes"].iloc[i]), shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` with ``size`` (UTF-8 bytes of the text, and 1), ``text_crc32``
    (unsigned), ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The shards have about equal bytes: they differ by no more than the smaller ranges, if no single record is
    larger than that. Equal texts are in one shard, unless they are over half a shard's bytes. A null text has no bytes
    and the checksum 0; it is a group apart from the empty text. A null doc_id is a doc_id like others, repeated rows
    are placed each. Other columns are kept, but for those with the names of result columns, which are
    replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in _RESULT]
    key, tie, where, cell = (unused(docs, f"shard_{x}") for x in ("key", "tie", "row", "range"))
    data = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    table = stored(
        docs.select(
            *own, (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
            F.xxhash64(F.col("text").isNull(), "text").alias(key), F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias(tie),
        ),
        "shard-rows",
    )
    table = table.withColumn(where, F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or min(max(rows >> 20, LEAST_RANGES), MOST_RANGES)
    share, most_rows, half = max(total / ranges, 1.0), max(1 << 20, 4 * rows // ranges), total / shards / 2

    # a record is drawn with a chance of its size in steps of this many bytes, by a hash of what
    # it is: repeated records are drawn together, and are one sample
    step = max(total // (SAMPLES * ranges), 1)
    chance = F.shiftrightunsigned(F.xxhash64(key, tie), 11) / float(1 << 53)
    drawn = table.where(chance * step < F.col("size")).groupBy(F.col(key).alias("key")).agg(F.sum(F.greatest("size", F.lit(step))).alias("weight")).toPandas()
    splitters = quantile_splitters(drawn["key"].to_numpy(np.int64), drawn["weight"].to_numpy(np.float64), ranges)

    def numbered(splitters: np.ndarray):
        sent = spark.sparkContext.broadcast(splitters)

        @F.pandas_udf("long")
        def number(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(sent.value, keys.to_numpy(np.int64), "right"))

        return number(F.col(key))

    totals = (F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    filled = table.groupBy(numbered(splitters).alias("range")).agg(*totals).toPandas()
    overfull = filled[(filled["bytes"] > 2 * share) | (filled["rows"] > most_rows)]
    heavy = pd.DataFrame({"key": [], "bytes": [], "rows": []}).astype(np.int64)
    if len(overfull):
        inside = spark.createDataFrame(overfull[["range"]].astype(np.int64))
        suspects = table.withColumn("range", numbered(splitters)).join(F.broadcast(inside), "range", "left_semi")
        # as many as fit into all bytes and rows at the most
        heavy = suspects.groupBy(F.col(key).alias("key")).agg(*totals).where((F.col("bytes") > share) | (F.col("rows") > most_rows // 2)).toPandas()
        splitters = subdivided(splitters, overfull, heavy["key"].to_numpy(np.int64), share)
    # a task counts the rows of a part; only of a group over half a shard the parts may go to several shards
    cut = np.maximum(heavy["rows"].to_numpy(np.int64) // (most_rows // 2), (heavy["bytes"] // share).to_numpy().astype(np.int64)) + 1
    split = heavy.assign(parts=cut, number=np.searchsorted(splitters, heavy["key"].to_numpy(np.int64), "right"))
    split = split[split["parts"] > 1]
    parts, twins = np.ones(len(splitters) + 1, np.int64), []
    parts[split["number"].to_numpy(np.int64)] = split["parts"]
    if len(split):
        few = spark.createDataFrame(split[["key"]].rename(columns={"key": key}))
        same = table.join(F.broadcast(few), key, "left_semi").groupBy(key, tie).agg(*totals).where((F.col("bytes") > share) | (F.col("rows") > most_rows // 2))
        twins = [tuple(r) for r in same.select(key, tie).collect()]
    # the parts of a range have numbers in a row
    begins = np.concatenate(([0], np.cumsum(parts)))
    sent = spark.sparkContext.broadcast((splitters, parts, begins, set(twins)))

    @F.pandas_udf("long")
    def placed(keys: pd.Series, ties: pd.Series, places: pd.Series) -> pd.Series:
        splitters, parts, begins, twins = sent.value
        k, t = keys.to_numpy(np.int64), ties.to_numpy(np.int64)
        if twins:
            at = np.array([x in twins for x in zip(k.tolist(), t.tolist(), strict=True)], bool)
            t = np.where(at, places.to_numpy(np.int64), t)
        number = np.searchsorted(splitters, k, "right")
        part = (t.view(np.uint64) >> np.uint64(32)).astype(np.int64) * parts[number] >> 32
        return pd.Series(begins[number] + part)

    table = table.withColumn(cell, placed(key, tie, where))
    cells = table.groupBy(F.col(cell).alias("cell")).agg(*totals).toPandas().sort_values("cell", ignore_index=True)
    number = np.searchsorted(begins, cells["cell"].to_numpy(np.int64), "right") - 1
    apart = np.isin(number, split["number"][split["bytes"] > half])
    cells["unit"] = np.where(apart, -1 - cells["cell"].to_numpy(np.int64), number)  # a range, or a part of a group that is too large
    units = cells.groupby("unit", as_index=False)["bytes"].sum()
    units["shard"] = packed(units, shards)
    cells = cells.merge(units[["unit", "shard"]], "left", "unit")
    cells["first"] = cells.groupby("shard")["rows"].cumsum() - cells["rows"]
    names = {"cell": cell, "first": unused(docs, "shard_first"), "shard": "shard"}
    told = spark.createDataFrame(cells[[*names]].astype(np.int64).rename(columns=names), f"`{cell}` long, `{names['first']}` long, shard long")
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(key, tie, where)) - 1
    ranked = table.withColumn("slot", rank).join(F.broadcast(told), cell)  # a row for each range
    return ranked.select(*own, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") + F.col(names["first"])).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the rows with their shard and slot to ``path/shard=<n>``, in files of slots in a row."""
    sharded = shard_documents(docs, shards)
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of shard_documents."""
    told = shard_documents(docs.select("doc_id", "text"), shards)
    return told.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
