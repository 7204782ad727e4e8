"""Media columns with content-defined payload chunking.

A payload of 8-bit samples is cut where a rolling gear hash of the last 32 bytes has its low bits
zero, so equal stretches are cut alike wherever they stand. A chunk is named by its digest. A stored
column has two tables: a manifest, with a recipe (the ordered list of digests and lengths) for each
row, and chunks. A chunk that occurs once stays beside its recipe; those that occur again are kept
once, in the table of chunks, and are brought back by a join. Which chunks occur again is told by a
filter of fixed size: a wrong yes only moves a lone chunk to the table of chunks.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.store import Bloom, forget, scratch_dir, stored
from docmill.llm.text import mix, slices

BLOCK = 576
LEAST, MOST, MASK = 256, 8192, (1 << 10) - 1
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MAGIC = b"CDC1"
_ENTRY = "<16sI"
_ENTRY_SIZE = struct.calcsize(_ENTRY)
#: Digests that a task remembers.
_REMEMBERED = 1 << 19


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with 255 to a positive multiple of the block, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def cut_points(data: bytes) -> np.ndarray:
    """Places after which the gear hash of the last 32 bytes asks for a cut."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift].copy() << np.uint32(shift)
    return np.flatnonzero((h & np.uint32(MASK << 21)) == 0) + 1


def chunk_ends(length: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of a payload, of LEAST to MOST bytes (the last may have fewer)."""
    ends, start = [], 0
    while length - start > LEAST:
        k = int(np.searchsorted(cuts, start + LEAST))
        end = min(int(cuts[k]) if k < len(cuts) else length, start + MOST, length)
        ends.append(end)
        start = end
    if start < length:
        ends.append(length)
    return ends


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunked(texts: list[str | None]) -> Iterator[tuple[bytes, int, list[bytes], list[bytes]]]:
    """Payload, its bytes before filling, chunks and digests of each text."""
    payloads = [payload_of(t) for t in texts]
    # hashed together: within LEAST bytes of a start no cut is asked for, so neighbours do not matter
    cuts, at = cut_points(b"".join(p for p, _ in payloads)), 0
    for payload, n in payloads:
        low, high = np.searchsorted(cuts, (at, at + len(payload)), "right")
        ends = chunk_ends(len(payload), cuts[low:high] - at)
        at += len(payload)
        chunks = [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        yield payload, n, chunks, [digest_of(c) for c in chunks]


def _lane(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def write_media(docs: DataFrame, path: str) -> None:
    """Store the texts of ``docs(doc_id, text)`` as payloads under ``path`` (``built`` with the rows, and chunks), in two
    passes over the texts: one finds the chunks that occur again, one builds both tables."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts):
                lanes = _lane([d for *_, digests in _chunked(texts[i:j]) for d in digests])
                yield pa.RecordBatch.from_arrays([pa.array(lanes.view(np.int64))], ["lane"])

    again = docs.select("text").mapInArrow(names, "lane long").groupBy("lane").agg(F.count("*").alias("n")).where("n > 1")
    again = stored(again.select("lane"), "repeated-chunks")
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.sized(again, F.col("lane")).words)
    forget(again)
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("recipe", pa.binary()), ("own", pa.list_(pa.binary())), ("shared", pa.list_(pa.binary())),
            ("digest", pa.binary()), ("chunk", pa.binary()), ("kind", pa.string()),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each chunk that may occur again; a task tells a chunk once, while it
        remembers it."""
        bloom, told = Bloom(shared.value), set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                rows, found = [], {}
                for payload, n, chunks, digests in _chunked(texts[i:j]):
                    kept = bloom.has(_lane(digests)).tolist()
                    recipe = _MAGIC + struct.pack("<QI", n, len(chunks)) + b"".join(struct.pack(_ENTRY, d, len(c)) for d, c in zip(digests, chunks, strict=True))
                    found.update((d, c) for c, d, k in zip(chunks, digests, kept, strict=True) if k and d not in told)
                    rows.append((digest_of(payload), n, recipe, [c for c, k in zip(chunks, kept, strict=True) if not k], [d for d, k in zip(digests, kept, strict=True) if k]))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:6], strict=True)]
                none = [pa.nulls(j - i, pa.binary())] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *columns, *none, pa.array(["row"] * (j - i))], schema=schema)
                if found:
                    none = [pa.nulls(len(found), f.type) for f in list(schema)[:6]]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary()), pa.array(["chunk"] * len(found))], schema=schema)
                    told = told | found.keys() if len(told) < _REMEMBERED else set(found)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = "doc_id long, key binary, n_bytes long, recipe binary, own array<binary>, shared array<binary>, digest binary, chunk binary, kind string"
    rows.mapInArrow(build, kinds).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/built")
    spark = docs.sparkSession
    built = spark.read.schema(kinds).parquet(f"{path}/built")
    built.where("kind = 'chunk'").groupBy("digest").agg(F.first("chunk").alias("chunk")).write.option("compression", "zstd").parquet(f"{path}/chunks")


def rebuild(recipe: bytes, own: list[bytes], kept: dict[bytes, bytes]) -> tuple[bytes, int]:
    """Payload and its bytes before filling, from a recipe; every chunk is verified."""
    n, count = struct.unpack_from("<QI", recipe, len(_MAGIC))
    parts, rest = [], iter(own)
    for k in range(count):
        digest, length = struct.unpack_from(_ENTRY, recipe, len(_MAGIC) + 12 + k * _ENTRY_SIZE)
        chunk = kept[digest] if digest in kept else next(rest, b"")
        if len(chunk) != length or digest_of(chunk) != digest:
            raise ValueError("a chunk does not match its digest")
        parts.append(chunk)
    return b"".join(parts), n


def features(samples: bytes, chunks: int) -> str:
    """Mean, deviation and entropy of the samples, in thousandths, and the number of chunks."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={round(float(x.mean()) * 1000)};std={round(float(x.std()) * 1000)};entropy={round(entropy * 1000)};chunks={chunks}"


_READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Read every stored payload back: ``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature)``. The stored form of a row is its recipe and its chunks."""
    import zlib

    kinds = "doc_id long, key binary, n_bytes long, recipe binary, own array<binary>, shared array<binary>, kind string"
    manifest, chunks = spark.read.schema(kinds).parquet(f"{path}/built").where("kind = 'row'"), spark.read.schema("digest binary, chunk binary").parquet(f"{path}/chunks")

    def reader(by: str):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                recipes, owns = batch.column("recipe").to_pylist(), batch.column("own").to_pylist()
                kept = batch.column("kept").to_pylist() if "kept" in batch.schema.names else [[]] * len(recipes)
                out = []
                for recipe, own, found in zip(recipes, owns, kept, strict=True):
                    payload, n = rebuild(recipe, own, {k["digest"]: k["chunk"] for k in found})
                    out.append(
                        (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(recipe) + len(payload), hashlib.sha256(recipe + payload).hexdigest(), features(payload, struct.unpack_from("<I", recipe, len(_MAGIC) + 8)[0]))
                    )
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(by), *columns], [by, *(c.split()[0] for c in _READ.split(", "))])

        return read

    lone = manifest.where(F.size("shared") == 0).select("doc_id", "recipe", "own").mapInArrow(reader("doc_id"), f"doc_id long, {_READ}")
    rest = manifest.where(F.size("shared") > 0)
    each = rest.select("key", "recipe", "own", "shared").dropDuplicates(["key"])
    wanted = each.select("key", F.explode(F.array_distinct("shared")).alias("digest"))
    kept = wanted.join(chunks, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "chunk")).alias("kept"))  # the chunks of one payload
    built = each.join(kept, "key").select("key", "recipe", "own", "kept").mapInArrow(reader("key"), f"key binary, {_READ}")
    return lone.unionByName(rest.select("doc_id", "key").join(built, "key").drop("key"))


def media_report(docs: DataFrame) -> DataFrame:
    """Store the texts in the shared folder and read them back.

    A null or empty text is one block of 255s. A null doc_id stays null; repeated rows keep a row
    each; other columns are ignored; an empty table gives an empty result.
    """
    path = f"{scratch_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write_media(docs, path)
    return read_media(docs.sparkSession, path)
