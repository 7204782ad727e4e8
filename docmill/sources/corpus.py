"""Reading raw files, and the corpus: versions with their documents, chunks, rejected files and deletes.

A version is written as an attempt and seen once its commit row is there. The first commit of a version
gives it the next number of a sequence, which its replays keep. A delete names ids and the number up to
which they are gone; what is ingested later lives again, and a replay of an older version does not bring
anything back.

The hashes of a version lie in files by range of sha256, and each file has a summary, a filter of 32
bits a hash. A batch is held against the summaries first, and reads those files alone that may hold one
of its hashes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas as S

COMMITS = "version string, attempt string, sequence long"
HASHES = "sha256 string, id string"
SUMMARIES = "range int, ranges int, n long, bits binary"
#: Hashes of a file of hashes, about; of a batch that is held against the summaries (16 bytes each go to all tasks): a
#: larger one reads all files.
RANGE, MOST_PROBES = 1 << 18, 1 << 20
_BITS_EACH, _PROBES = 32, 8


def read_received(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files under ``path``, nested folders too, with their declared fields: ``manifest(path (below the
    folder), doc_key, arrival_seq, filename,
    mime_type, title, source_name, source_url, published_at, metadata)``. All extensions are read, so
    that bad ones reach the quarantine. Files over the limit are not read: they have their ``length`` and no content. A file
    that the manifest does not name has its path as doc_key and its name as filename."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= S.MAX_FILE_BYTES  # reaches the reader, which leaves longer files closed
    read = files.where(fits).select("path", "content", "length").unionByName(files.where(~fits).select("path", F.lit(None).cast("binary").alias("content"), "length"))
    root = re.sub(r"\A[a-zA-Z]+:/*|\A/+", "", path.rstrip("/")) + "/"
    below = F.substr("path", F.locate(root, F.col("path")) + len(root))  # after the first place where the folder is named
    joined = read.withColumn("path", below).join(manifest, "path", "left")
    named = joined.withColumns({"doc_key": F.coalesce("doc_key", "path"), "filename": F.coalesce("filename", F.substring_index("path", "/", -1))})
    return named.select(*S.RECEIVED.fieldNames(), "length")


def _read(spark: SparkSession, path: str, schema: str, files: list[str] | None = None) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(*(files or [path]))
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last(spark: SparkSession, root: str) -> DataFrame:
    """``(version, attempt, sequence)`` of the last committed attempt of each version."""
    commits = spark.read.schema(COMMITS).parquet(f"{root}/commits")
    return commits.groupBy("version").agg(F.max("attempt").alias("attempt"), F.min("sequence").alias("sequence"))


def _attempt(spark: SparkSession, root: str, version: str) -> tuple[str, int]:
    """A new attempt of a version, later than its committed ones, and the sequence of the version."""
    commits = _read(spark, f"{root}/commits", COMMITS)
    own = F.col("version") == version
    done, known, last = commits.agg(F.count_if(own), F.min(F.when(own, F.col("sequence"))), F.coalesce(F.max("sequence"), F.lit(-1))).first()
    return f"{done:09d}-{uuid.uuid4().hex}", last + 1 if known is None else known


def _commit(spark: SparkSession, root: str, version: str, attempt: str, sequence: int) -> None:
    spark.createDataFrame([(version, attempt, sequence)], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _range_of(sha256: Column, ranges: int) -> Column:
    """The number of the range of a hash, of so many equal ones."""
    return F.shiftright(F.conv(F.substring(sha256, 1, 8), 16, 10).cast("long") * ranges, 32).cast("int")


def _probes(words: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places in a filter of so many bits, a power of two, from 64 bits of a hash."""
    low, step = words & np.uint64(0xFFFFFFFF), (words >> np.uint64(32)) | np.uint64(1)
    for k in range(_PROBES):
        yield (low + np.uint64(k) * step) & np.uint64(bits - 1)


def _words(hashes: pd.Series) -> np.ndarray:
    """64 bits of each hash, not those that decide its range."""
    return np.array([int(h[16:32], 16) for h in hashes], np.uint64)


def _summary(ranges: int):
    def summary(key: tuple, hashes: pd.DataFrame) -> pd.DataFrame:
        bits = 1 << max(int(_BITS_EACH * len(hashes) - 1).bit_length(), 10)
        told = np.zeros(bits, bool)
        for places in _probes(_words(hashes["sha256"]), bits):
            told[places.astype(np.int64)] = True
        return pd.DataFrame({"range": [key[0]], "ranges": [ranges], "n": [len(hashes)], "bits": [np.packbits(told).tobytes()]})

    return summary


def publish(documents: DataFrame, chunks: DataFrame, root: str, version: str, rejected: DataFrame | None = None) -> None:
    """Write a version as a new attempt, and a commit row last: until it is there readers see the attempt
    before or nothing, and a run that breaks off shows nothing. ``rejected(doc_key, stage, error_code, error_field)`` is part
    of the version, so a replay tells each rejected file once. Files of replaced attempts stay for readers that have begun.
    Null hashes are in no index."""
    spark = documents.sparkSession
    attempt, sequence = _attempt(spark, root, version)

    def at(table: str) -> str:
        return f"{root}/{table}/version={version}/attempt={attempt}"

    chunks.write.parquet(at("chunks"))
    documents.write.parquet(at("documents"))
    if rejected is not None:
        rejected.select("doc_key", "stage", "error_code", "error_field").write.parquet(at("rejected"))
    # the index is made from what was written
    own = spark.read.schema(S.DOCUMENTS_DDL).parquet(at("documents")).where("sha256 is not null").select("sha256", "id")
    ranges = -(-own.count() // RANGE)
    if ranges:
        own.withColumn("range", _range_of(F.col("sha256"), ranges)).repartition(ranges, "range").write.partitionBy("range").parquet(at("hashes"))
        hashes = spark.read.schema(f"{HASHES}, range int").parquet(at("hashes"))
        hashes.groupBy("range").applyInPandas(_summary(ranges), SUMMARIES).write.parquet(at("summaries"))
    _commit(spark, root, version, attempt, sequence)


def delete_published(spark: SparkSession, root: str, ids: DataFrame, version: str) -> DataFrame:
    """Delete documents ``ids(id)`` with their chunks from all that is published now, as a version of its own;
    tells the ids that were not found. A replay of the delete (the same version) deletes no more than the first one
    meant to. Its name must be no version of a stream. What a batch that runs meanwhile takes for a known document is not ingested again. A null id deletes nothing."""
    attempt, sequence = _attempt(spark, root, version)
    # a delete takes no number of its own: it holds up to the last one there was when it was first told
    known = _last(spark, root).where(F.col("version") == version).select("sequence").first()
    upto = known[0] if known else sequence - 1
    own = ids.select("id").where("id is not null").distinct()
    lost = f"{root}/not_found/version={version}/attempt={attempt}"
    # written before the delete is seen: afterwards no id would be found
    own.join(read_corpus(spark, root)[0].select("id"), "id", "left_anti").write.parquet(lost)
    own.withColumn("upto", F.lit(upto).cast("long")).write.parquet(f"{root}/tombstones/version={version}/attempt={attempt}")
    _commit(spark, root, version, attempt, upto)
    return spark.read.schema("id string").parquet(lost)


def _rows(spark: SparkSession, root: str, table: str, columns: str, last: DataFrame) -> DataFrame:
    """The rows of a table that belong to the committed attempts ``last``, with their version and its sequence."""
    rows = _read(spark, f"{root}/{table}", f"{columns}, version string, attempt string")
    return rows.join(F.broadcast(last), ["version", "attempt"]).drop("attempt")  # a row for each version


def _living(rows: DataFrame, column: str, tombstones: DataFrame) -> DataFrame:
    """Without rows that were deleted after their version."""
    gone = tombstones.groupBy(F.col("id").alias("gone_id")).agg(F.max("upto").alias("upto"))
    return rows.join(gone, (F.col(column) == F.col("gone_id")) & (F.col("sequence") <= F.col("upto")), "left_anti")


def _without(last: DataFrame, version: str | None) -> DataFrame:
    return last if version is None else last.where(F.col("version") != version)


def _tombstones(spark: SparkSession, root: str, last: DataFrame) -> DataFrame:
    return _rows(spark, root, "tombstones", "id string, upto long", last).select("id", "upto")


def read_corpus(spark: SparkSession, root: str, without_version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of all versions, or all but one, in their last committed attempt. Deleted documents and
    chunks without their document are left out; a null id is never deleted."""
    last = _last(spark, root)  # listed before what it names
    own, tombstones = _without(last, without_version), _tombstones(spark, root, last)
    documents = _living(_rows(spark, root, "documents", S.DOCUMENTS_DDL, own), "id", tombstones).drop("sequence")
    chunks = _rows(spark, root, "chunks", S.CHUNKS_DDL, own).drop("sequence")
    return documents, chunks.join(documents.select(F.col("id").alias("document_id"), "version"), ["document_id", "version"], "left_semi")


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    """``(doc_key, stage, error_code, error_field, version)`` of all rejected files, each once."""
    return _rows(spark, root, "rejected", "doc_key string, stage string, error_code string, error_field string", _last(spark, root)).drop("sequence")


def index_files(spark: SparkSession, root: str, batch: DataFrame, without_version: str | None = None) -> list[str]:
    """The folders of the hash index that may hold a hash of ``batch(sha256)``: told by the summaries, which alone grow
    with the corpus (4 bytes for each hash). A batch of more than MOST_PROBES hashes is not sent to the
    summaries: it may be in all."""
    last = _without(_last(spark, root), without_version)
    rows = _read(spark, f"{root}/summaries", f"{SUMMARIES}, version string, attempt string").join(F.broadcast(last.select("version", "attempt")), ["version", "attempt"])
    path = F.concat_ws("", F.lit(f"{root}/hashes/version="), "version", F.lit("/attempt="), "attempt", F.lit("/range="), F.col("range").cast("string"))
    place, high, low = (F.conv(F.substring("sha256", at, 8), 16, 10).cast("long") for at in (1, 17, 25))
    probes = batch.where("sha256 is not null").select(place.alias("place"), F.shiftleft(high, 32).bitwiseOR(low).alias("word")).distinct().limit(MOST_PROBES + 1).toPandas()
    if len(probes) <= MOST_PROBES:
        places, words = probes["place"].to_numpy(np.int64).astype(np.uint64), probes["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(places, kind="stable")
        sent = spark.sparkContext.broadcast((places[order], words[order]))

        def may_hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            places, words = sent.value
            for some in batches:
                good = []
                for number, ranges, bits in zip(some["range"], some["ranges"], some["bits"], strict=True):
                    low, high = (np.searchsorted(places, np.uint64(-(-(x << 32) // ranges)), "left") for x in (int(number), int(number) + 1))
                    own, told = words[low:high], np.frombuffer(bits, np.uint8)
                    here = np.ones(len(own), bool)
                    for at in _probes(own, len(told) * 8):
                        here &= (told[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    good.append(bool(here.any()))
                yield some.loc[good, ["path"]]

        rows = rows.select("range", "ranges", "bits", path.alias("path")).mapInPandas(may_hold, "path string")
    else:
        rows = rows.select(path.alias("path"))
    return sorted(r.path for r in rows.collect())


def known_documents(spark: SparkSession, root: str, batch: DataFrame, without_version: str | None = None) -> DataFrame:
    """``(sha256, id)`` of those hashes of ``batch(sha256)`` that documents of the corpus have, in all versions or all but one;
    deleted ones are not known. It reads only the parts of the index that may hold them."""
    files = index_files(spark, root, batch, without_version)
    if not files:
        return spark.createDataFrame([], HASHES)
    last = _last(spark, root)
    found = _read(spark, f"{root}/hashes", f"{HASHES}, range int, version string, attempt string", files).join(batch.select("sha256").distinct(), "sha256", "left_semi")
    found = found.join(F.broadcast(last.select("version", "sequence")), "version")
    return _living(found, "id", _tombstones(spark, root, last)).select("sha256", "id").distinct()
