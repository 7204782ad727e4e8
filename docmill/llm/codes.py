"""Vector code compression: product codes whose codebooks are found by Lloyd rounds with Hamerly's bounds.

A vector is cut into parts, and each part is replaced by the number of the nearest entry of its
position's codebook. Between rounds a table keeps for each part its entry, an upper bound of the distance to
it and a lower bound of the distance to the second nearest. A part keeps its entry without a look
at the others if the upper bound lies strictly under the lower one, or under half of the entry's distance to its
nearest neighbour; so equal distances always end in a full scan, where the lower number wins. Bounds are rounded
outwards, and all distances that decide are whole numbers.

A round is one pass over the vectors. A task also tells how the sums of the entries have changed (all
in the first round, parts that moved later), a row for each entry; these rows alone are
added up, and the new codebooks are the only thing that goes to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.store import forget, stored

#: Components are whole numbers of this many steps for each unit, and lie within this range: the squares of
#: a vector of 64 of them then fit into a long.
SCALE, RANGE = 1024, 1 << 27
_SOME = 1 << 16


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """A float32 that is no smaller (up) or no larger than the root."""
    return _outwards(np.sqrt(squares.astype(np.float64)), up)


def _outwards(x: np.ndarray, up: bool) -> np.ndarray:
    x = np.asarray(x, np.float64) * (1 + 1e-12 if up else 1 - 1e-12)
    return np.nextafter(x.astype(np.float32), np.float32(np.inf if up else -np.inf))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:  # whole numbers of this size are exact in float64
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


@dataclass
class Codebook:
    """The entries of one part position, half of each entry's distance to the nearest other one, and how far
    the entries have moved: the entry itself, and the farthest of the others."""

    entries: np.ndarray
    half: np.ndarray
    moved: np.ndarray
    others: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, before: np.ndarray | None = None) -> Codebook:
        near = np.full(len(entries), np.inf)
        gaps = _root(_squares(entries, entries), False).astype(np.float64)
        if len(entries) > 1:
            np.fill_diagonal(gaps, np.inf)
            near = gaps.min(1) / 2
        moved = np.zeros(len(entries)) if before is None else _root(((entries - before) ** 2).sum(1), True).astype(np.float64)
        others = np.zeros(len(entries))
        if len(entries) > 1:
            order = np.argsort(-moved, kind="stable")
            others[:] = moved[order[0]]
            others[order[0]] = moved[order[1]]
        return Codebook(entries, _outwards(near, False), moved, others)


def nearest(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the number of the nearest entry (the lower of equal ones) and both bounds."""
    squares = _squares(x, book.entries)
    code = squares.argmin(1)
    first = squares[np.arange(len(x)), code]
    squares[np.arange(len(x)), code] = np.iinfo(np.int64).max
    lower = _root(squares.min(1), False) if len(book.entries) > 1 else np.full(len(x), np.inf, np.float32)
    return code, _root(first, True), lower


def reassign(x: np.ndarray, book: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved, with the bounds of the round before; and the number of full scans."""
    upper = _outwards(upper + book.moved[code], True)
    lower = _outwards(lower - book.others[code], False)
    bound = np.maximum(lower, book.half[code])
    doubt = np.flatnonzero(~(upper < bound))
    upper[doubt] = _root(((x[doubt] - book.entries[code[doubt]]) ** 2).sum(1), True)
    doubt = doubt[~(upper[doubt] < bound[doubt])]
    code = code.copy()
    code[doubt], upper[doubt], lower[doubt] = nearest(x[doubt], book)
    return code, upper, lower, len(doubt)


def _add(sums: np.ndarray, counts: np.ndarray, code: np.ndarray, x: np.ndarray, sign: int) -> None:
    if len(code):
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        sums[code[order][first]] += sign * np.add.reduceat(x[order], first)
        counts[code[order][first]] += sign * np.diff(np.append(first, len(code)))


def _round(books: list[Codebook], first: bool, last: bool, schema: pa.Schema):
    parts, width, size = len(books), books[0].entries.shape[1], len(books[0].entries)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        some = False
        for whole in batches:
            for at in range(0, whole.num_rows, _SOME):
                batch, some = whole.slice(at, _SOME), True
                n = batch.num_rows
                x = batch.column(2).flatten().to_numpy().astype(np.int64).reshape(n, parts, width)
                codes, uppers, lowers = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
                if not first:
                    before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                    bounds = batch.column(4).flatten().to_numpy().reshape(n, 2, parts)
                error = np.zeros(n, np.int64)
                for p, book in enumerate(books):
                    own = x[:, p]
                    if first:
                        code, uppers[:, p], lowers[:, p] = nearest(own, book)
                        _add(sums[p], counts[p], code, own, 1)
                    else:
                        code, uppers[:, p], lowers[:, p], _ = reassign(own, book, before[:, p].astype(np.int64), bounds[:, 0, p], bounds[:, 1, p])
                        if not last:
                            moved = np.flatnonzero(code != before[:, p])
                            _add(sums[p], counts[p], before[moved, p].astype(np.int64), own[moved], -1)
                            _add(sums[p], counts[p], code[moved], own[moved], 1)
                    codes[:, p] = code
                    if last:
                        error += ((own - book.entries[code]) ** 2).sum(1)
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], schema=schema)
                    continue
                bounds = np.stack([uppers, lowers], axis=1).reshape(n, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2 * parts), pa.array(bounds.ravel())),
                        pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )
        if some and not last:
            p, e = np.nonzero((counts != 0) | (sums != 0).any(2))
            n = len(p)
            told = [pa.nulls(n, f.type) for f in list(schema)[:5]]
            yield pa.RecordBatch.from_arrays([*told, pa.array((p * size + e).astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], schema=schema)

    return assign


def whole_vectors(vectors: DataFrame, vector: str, parts: int, entries: int) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, x)`` of the rows that can be coded, x with whole components and padded to a multiple of
    parts; and the first codebooks: parts x entries x width."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | ~(F.abs(c) <= RANGE // SCALE))
    kept = vectors.where(F.col(vector).isNotNull()).where(~bad).select("vec_id", "label", F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("x"))
    size = kept.orderBy(F.asc_nulls_last("vec_id"), "x").select(F.size("x")).first()
    if size is None:
        return kept, np.zeros((parts, 0, 0), np.int64)
    pad = -size[0] % parts
    kept = kept.where(F.size("x") == size[0])
    first = np.array([r.x for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()], np.int64).reshape(-1, size[0])
    if pad:
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), pad)))
        first = np.pad(first, ((0, 0), (0, pad)))
    return kept, first.reshape(len(first), parts, -1).transpose(1, 0, 2)


def product_codes(vectors: DataFrame, vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of the rows of ``vectors(vec_id, label, <vector>)``, and the final codebooks
    (parts x entries x width). A component c is floor(1024 c); code has two hex digits for each part, error is
    the squared distance to the entries, summed over the parts.

    Left out are rows whose vector is null, has a null or non-finite component, one over 131,072 either way (its
    squares do not fit into a long), or another length than that of the smallest vec_id's vector. A
    length that is no multiple of ``parts`` (an empty one, too) is padded with zeros. The codebooks start as the
    parts of the ``entries`` (256 at most) smallest vec_ids, null ones last, equal ones by vector; if there are fewer rows, the
    codebooks have fewer entries. Repeated rows count each. A null label is one like others; other columns are ignored. An empty table gives an
    empty result, and codebooks without entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    kept, books = whole_vectors(vectors, vector, parts, entries)
    ids = [kept.schema["vec_id"], kept.schema["label"]]
    out = T.StructType([*ids, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.shape[1]:
        return kept.sparkSession.createDataFrame([], out), books
    state = T.StructType(
        [
            *ids, T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType()), T.StructField("bounds", T.ArrayType(T.FloatType())),
            T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType())),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    told, before, table = kept, None, None
    totals, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for k in range(rounds + 1):
        last = k == rounds
        own = [Codebook.of(books[p], None if before is None else before[p]) for p in range(parts)]
        schema = out if last else state
        told = stored(told.mapInArrow(_round(own, k == 0, last, to_arrow_schema(schema)), schema), "codes")
        if table is not None:
            forget(table)
        if last:
            break
        table, changes = told, told.where("entry is not null")
        told = told.where("entry is null").select("vec_id", "label", "x", "code", "bounds")
        size = books.shape[1]
        for r in changes.groupBy("entry").agg(F.sum("n").alias("n")).collect():
            counts[r.entry // size, r.entry % size] += r.n
        for r in changes.select("entry", F.posexplode("sums")).groupBy("entry", "pos").agg(F.sum("col").alias("s")).collect():
            totals[r.entry // size, r.entry % size, r.pos] += r.s
        before, used = books, counts > 0
        books = books.copy()
        books[used] = totals[used] // counts[used][:, None]
    return told, books


def code_report(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: product_codes with the error of all rows of
    the same label (null ones together) and the digest of the final codebooks' numbers."""
    told, books = product_codes(vectors, vector)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = told.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"))
    both = told.join(sums, F.col("label").eqNullSafe(F.col("same_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    def nearest_to(book: str) -> str:
        dist = "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i])))"
        return f"SELECT vec_id, p, min(({dist}, e)) AS best FROM parts q JOIN {book} b USING (p) GROUP BY vec_id, p"

    rounds = []
    for k in range(4):
        floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
        rounds.append(
            f""", a{k} AS MATERIALIZED ({nearest_to(f'c{k}')}
), m{k} AS (SELECT p, e, list({floor} ORDER BY i) AS v FROM (
    SELECT p, best[2] AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{k} JOIN parts USING (vec_id, p)) GROUP BY ALL) GROUP BY p, e
), c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (p, e))"""
        )
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS (SELECT vec_id, label, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS v FROM kept, range(4) AS t(p)
), c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 256){''.join(rounds)}
, a4 AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM ({nearest_to('c4')}) GROUP BY vec_id
), digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM a4 JOIN kept USING (vec_id), digest
"""


#: The codes of the embeddings table in DuckDB (vec_ids are unique there), with the default arguments.
ORACLE_SQL = _oracle()
