"""Exact cosine retrieval of many queries at once, contexts and citations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill import schemas as S
from docmill.functions.text import strip
from docmill.operators.vectors import assert_single_index, vector_error
from docmill.sources.scratch import written_once

#: Queries and chunks meet in groups and cells of at most so many, and of at most so many values (32 MB).
QUERY_BLOCK = CHUNK_BLOCK = 1 << 14
_VALUES = 1 << 22
#: Chunks that stand for the places around them, at most (12 MB of 768 floats); rings around each of them, at most.
PIVOTS, RINGS = 4096, 8
#: Bounds are taken to be larger by this, for what rounding may do to them.
_SLACK = 1e-6
#: Products of unit vectors differ by less than this for any order of summing.
_EQUAL = 1e-9
#: Pairs that are multiplied at once (8 MB), and the chunks among them.
_PRODUCTS, _TILE = 1 << 20, 1 << 10


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): trimmed question of 1..2000 characters, top_k 1..10 with 5 by default."""
    own = queries.withColumn("question", strip(F.col("question"))).withColumn("top_k", F.coalesce(F.col("top_k"), F.lit(S.TOP_K_DEFAULT)))
    size = F.length("question")
    own = own.withColumn(
        "error_code", F.when(F.col("question").isNull() | ~size.between(1, S.MAX_QUESTION_CHARS), "invalid_question").when(~F.col("top_k").between(1, S.TOP_K_MAX), "invalid_top_k")
    )
    return own.where("error_code is null").drop("error_code"), own.where("error_code is not null").select("query_id", "error_code")


HITS = "query_id long, chunk_id string, document_id string, chunk_index int, raw double"
LIVE = "chunk_id string, document_id string, chunk_index int, embedding array<float>"


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Row ``i`` of a by row ``j`` of b, row by row. In a matrix product the last bits of a value depend on the rows around it; here equal
    vectors have equal values in all tasks, so that ties are ties."""
    step = max(_VALUES // a.shape[1], 1)
    return np.concatenate([(a[i[k : k + step]] * b[j[k : k + step]]).sum(axis=1) for k in range(0, max(len(i), 1), step)])


def _best(q: np.ndarray, c: np.ndarray, raw: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, chunk, value, rank from 0) of the ``k[q]`` best hits of each query; of equal ones the first chunks."""
    order = np.lexsort((c, -raw, q))
    q, c, raw = q[order], c[order], raw[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    good = rank < k[q]
    return q[good], c[good], raw[good], rank[good]


def _scorer(threshold: float):
    def score(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        """The best hits of a meeting. Whatever the vectors are, there are never more than _PRODUCTS pairs at once and top_k hits of
        a query: a query's k-th hit so far is the least that later chunks must reach."""
        if not len(queries) or not len(chunks):
            kinds = {"query_id": "int64", "chunk_id": object, "document_id": object, "chunk_index": "int32", "raw": "float64"}
            return pd.DataFrame({n: pd.Series(dtype=k) for n, k in kinds.items()})
        chunks = chunks.sort_values(["document_id", "chunk_index", "chunk_id"], na_position="first")
        asked, least = _unit(queries["asked"]), np.maximum(queries["least"].to_numpy(), threshold)
        k = np.minimum(queries["top_k"].to_numpy(), S.TOP_K_MAX)
        most, hits = int(k.max()), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for at in range(0, len(chunks), _TILE):
            units, found = _unit(chunks["embedding"].iloc[at : at + _TILE]), [hits]
            step = _PRODUCTS // len(units)
            for begin in range(0, len(asked), step):
                own, low = asked[begin : begin + step], least[begin : begin + step]
                near, cut = own @ units.T, low - _EQUAL
                many = np.flatnonzero((near >= cut[:, None]).sum(1) > most)
                if len(many):
                    cut[many] = np.maximum(cut[many], np.partition(near[many], -most, axis=1)[:, -most] - 2 * _EQUAL)
                q, c = np.nonzero(near >= cut[:, None])
                raw = _products(own, q, units, c)
                good = raw >= low[q]
                found.append(_best(q[good] + begin, c[good] + at, raw[good], k)[:3])
            *hits, rank = _best(*map(np.concatenate, zip(*found, strict=True)), k)
            last = rank == k[hits[0]] - 1
            least[hits[0][last]] = hits[2][last]
        q, c, raw = hits
        own = chunks.iloc[c]
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[q], "chunk_id": own["chunk_id"].to_numpy(), "document_id": own["document_id"].to_numpy(), "chunk_index": own["chunk_index"].to_numpy(), "raw": raw})

    return score


def _packed(counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of neighbours with so many rows, in cells of ``size`` rows at most. What has
    more rows than a cell has cells of its own, over which it is spread."""
    first, parts, at, room = [], [], 0, size
    for n in counts:
        if n > room and room < size:
            at, room = at + 1, size
        first.append(at)
        parts.append(max(-(-n // size), 1))
        at, room = (at + parts[-1], size) if parts[-1] > 1 else (at, room - n)
    return np.array(first, np.int64), np.array(parts, np.int64)


def _pivots(live: DataFrame, total: int) -> np.ndarray:
    """The chunks with the smallest hashes, each text's vector once: more than there will be clusters, so that rings are narrow. Those that lie
    near each other stand near each other."""
    rows = live.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(max(2 * total // CHUNK_BLOCK, 2 * math.isqrt(total)), PIVOTS)).collect()
    pivots = np.unique(_unit(pd.Series([r.embedding for r in rows])), axis=0)
    sims, order, left = pivots @ pivots.T, [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, sims[order[-1]], -2).argmax()))
        left[order[-1]] = False
    return pivots[order]


def _nearest(rows: DataFrame, column: str, pivots: np.ndarray, schema: str) -> DataFrame:
    """``rows`` with the ``pivot`` that is nearest and the ``angle`` to it."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(_PRODUCTS // len(sent.value), 1)
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.iloc[at : at + step]
                sims = _unit(batch[column]) @ sent.value.T
                yield batch.assign(pivot=sims.argmax(1).astype(np.int32), angle=np.arccos(np.clip(sims.max(1), -1, 1)))

    return rows.mapInPandas(place, f"{schema}, pivot int, angle double")


@dataclass(frozen=True)
class Rings:
    """Chunks lie around the pivot that is nearest to them, in rings. ``at`` is the pivot of a ring, ``low`` and ``high`` the angles to
    it between which its chunks lie. Neighbouring rings are a cell: ``first`` and ``parts`` tell the cells of each ring."""

    pivots: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @property
    def step(self) -> int:
        """So many queries are held against all rings at once."""
        return max(_PRODUCTS // max(len(self.at), len(self.pivots)), 1)

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """What the cosine with a chunk of each ring is at most (rows x rings), by the triangle inequality of angles."""
        angles = np.arccos(np.clip(unit @ self.pivots.T, -1, 1))[:, self.at]
        return np.cos(np.clip(np.maximum(angles - self.high, self.low - angles), 0, np.pi)) + _SLACK

    def cell_bounds(self, unit: np.ndarray) -> np.ndarray:
        """The same for the cells (rows x cells)."""
        _, begins = np.unique(self.first, return_index=True)
        return np.repeat(np.maximum.reduceat(self.bounds(unit), begins, axis=1), self.parts[begins], axis=1)


def _ringed(live: DataFrame, total: int, size: int) -> tuple[DataFrame, Rings]:
    """(chunks with their ``cell``, rings). The place of each chunk is found and written once; pivots and a row for each
    ring pass through the driver. A cell has ``size`` chunks at most, equal vectors too."""
    spark, pivots = live.sparkSession, _pivots(live, total)
    own = written_once(_nearest(live, "embedding", pivots, LIVE).withColumn("nth", F.monotonically_increasing_id()), "placed")
    around = own.groupBy("pivot").agg(F.min("angle").alias("low"), (F.max("angle") - F.min("angle")).alias("width"))
    ring = F.when(F.col("width") > 0, F.least(F.floor((F.col("angle") - F.col("low")) / F.col("width") * RINGS), F.lit(RINGS - 1))).otherwise(0).cast("int")
    own = own.join(F.broadcast(around), "pivot").withColumn("ring", ring).drop("low", "width")  # PIVOTS rows at most
    told = own.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("pivot", "ring").collect()
    first, parts = _packed([r.n for r in told], size)
    at = spark.createDataFrame([(r.pivot, r.ring, int(f), int(p)) for r, f, p in zip(told, first, parts, strict=True)], "pivot int, ring int, first int, parts int")
    placed = own.join(F.broadcast(at), ["pivot", "ring"]).withColumn("cell", _spread("nth"))  # PIVOTS x RINGS rows at most
    low, high = (np.array([r[c] for r in told]) for c in ("low", "high"))
    return placed.select("chunk_id", "document_id", "chunk_index", "embedding", "cell"), Rings(pivots, np.array([r.pivot for r in told]), low, high, first, parts)


def _spread(column: str) -> Column:
    return (F.col("first") + F.pmod(F.xxhash64(column), F.col("parts"))).cast("int")


def _routed(asked: DataFrame, rings: Rings, threshold: float, size: int) -> DataFrame:
    """Queries with the ``cells`` that may have a chunk over the threshold and the ``bounds`` of these, largest first, and a group ``q``
    of at most about ``size`` queries that lie near each other."""
    spark = asked.sparkSession
    sent = spark.sparkContext.broadcast(rings)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rings = sent.value
        for whole in batches:
            for at in range(0, len(whole), rings.step):
                batch = whole.iloc[at : at + rings.step]
                bounds = rings.cell_bounds(_unit(batch["asked"]))
                cells, n = np.argsort(-bounds, axis=1, kind="stable").astype(np.int32), (bounds >= threshold).sum(1)
                yield batch.assign(cells=[c[:m] for c, m in zip(cells, n, strict=True)], bounds=[b[c[:m]] for b, c, m in zip(bounds, cells, n, strict=True)])

    schema = "query_id long, top_k int, asked array<double>, least double"
    near = _nearest(asked, "asked", rings.pivots, schema).drop("angle")
    routed = written_once(near.mapInPandas(route, f"{schema}, pivot int, cells array<int>, bounds array<double>"), "routed")
    told = routed.groupBy("pivot").agg(F.count("*").alias("n")).orderBy("pivot").collect()  # PIVOTS rows at most
    if not told:
        return routed.withColumn("q", F.lit(0)).drop("pivot")
    groups = [(r.pivot, int(f), int(p)) for r, f, p in zip(told, *_packed([r.n for r in told], size), strict=True)]
    return routed.join(F.broadcast(spark.createDataFrame(groups, "pivot int, first int, parts int")), "pivot").withColumn("q", _spread("query_id")).drop("pivot", "first", "parts")


def _scored(asked: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """Hits of the meetings of a group ``q`` of queries and a ``cell`` of chunks; others do not move."""
    asked = asked.select("query_id", "top_k", "asked", "least", "cell", "q")
    pairs = asked.select("cell", F.col("q").alias("group")).distinct()
    chunks = placed.join(pairs, "cell").select("chunk_id", "document_id", "chunk_index", "embedding", "cell", F.col("group").alias("q"))
    return asked.groupBy("cell", "q").cogroup(chunks.groupBy("cell", "q")).applyInPandas(_scorer(threshold), HITS)


def searchable(chunks: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with a vector that can be searched, ``(chunk_id, error)`` of the others): those wait for a vector,
    or have one of another length, with a value that is no finite number, or without direction."""
    error = vector_error(F.col("embedding"), dimensions)
    return chunks.where(error.isNull()), chunks.select("chunk_id", error.alias("error")).where("error is not null")


def _hits_of(live: DataFrame, asked: DataFrame, threshold: float, total: int, queries: int, dimensions: int) -> DataFrame:
    if not total or not queries:
        return live.sparkSession.createDataFrame([], HITS)
    most = max(_VALUES // max(dimensions, 1), 1)  # of long vectors fewer meet
    chunk_block, query_block = min(CHUNK_BLOCK, most), min(QUERY_BLOCK, most)
    if total <= chunk_block and queries <= query_block:  # one block of each
        one = [df.withColumn("block", F.lit(0)).groupBy("block") for df in (asked, live)]
        return one[0].cogroup(one[1]).applyInPandas(_scorer(threshold), HITS)
    placed, rings = _ringed(live, total, chunk_block)
    routed = _routed(asked, rings, threshold, query_block)
    near = written_once(_scored(routed.where("size(cells) > 0").withColumn("cell", F.col("cells")[0]), placed, threshold), "near")
    # with top_k hits in its first cell, a query needs no cell whose bound lies under the last of them
    last = near.groupBy("query_id").agg(F.sort_array(F.collect_list("raw"), False).alias("raws"))
    rest = routed.join(last, "query_id", "left").withColumn("least", F.coalesce(F.get("raws", F.least(F.col("top_k"), F.lit(S.TOP_K_MAX)) - 1) - _EQUAL, F.col("least")))
    rest = rest.withColumn("to", F.explode(F.expr("slice(arrays_zip(cells, bounds), 2, size(cells))"))).where(F.col("to.bounds") >= F.col("least"))
    return near.unionByName(_scored(rest.withColumn("cell", F.col("to.cells")), placed, threshold))


def retrieve(chunks: DataFrame, documents: DataFrame, queries: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """``(query_id, rank, chunk_id, document_id, chunk_index, raw, similarity)``: of the chunks of
    documents that are indexed now, those with a cosine of the threshold or more, the top_k best;
    ties by document, place and chunk. Rank is by the raw value; similarity has four decimals.

    The search is exact. Chunks lie in rings around pivots, neighbouring rings are a cell, and a query is sent to those cells alone whose
    angles allow for a chunk over the threshold, and over its k-th best hit in the cell that it begins with.
    Groups of queries and cells meet in tasks of a bounded size, and nothing but pivots and counts
    passes through the driver. Only the best of each meeting are in the last ranking. All but the last meetings are made at once.

    Chunks without a vector, or with one that cannot be searched (see ``searchable``), are left out; queries
    without such a vector, or without a top_k, have no hits. If both sides name their model and dimension, a mixture
    of them is an error, and so are queries of several lengths. Repeated chunks are chunks each, repeated query_ids are an error of the
    caller. Empty tables have no hits.
    """
    index = {"embedding_model", "embedding_dimensions"}
    if index <= set(chunks.columns) and index <= set(queries.columns):
        assert_single_index(chunks.where("embedding is not null"), queries.where("embedding is not null"))
    asked = queries.select("query_id", "top_k", F.col("embedding").cast("array<double>").alias("asked"), F.lit(threshold).cast("double").alias("least"))
    size = F.size("asked")
    count, low, high = asked.where("asked is not null").agg(F.count("*"), F.min(size), F.max(size)).first()
    if count and low != high:
        raise ValueError(f"queries have vectors of {low} to {high} values")
    asked = asked.where(vector_error(F.col("asked"), high or 0).isNull() & (F.col("top_k") > 0))
    live = chunks.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    live = searchable(live.select("chunk_id", "document_id", "chunk_index", F.col("embedding").cast("array<float>").alias("embedding")), high or 0)[0]
    hits = _hits_of(live, asked, threshold, live.count() if count else 0, count, high or 0)
    best = Window.partitionBy("query_id").orderBy(F.desc("raw"), "document_id", "chunk_index", "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= S.TOP_K_MAX)
    return ranked.join(queries.select("query_id", "top_k"), "query_id").where("rank <= top_k").select(
        "query_id", "rank", "chunk_id", "document_id", "chunk_index", "raw", F.round("raw", 4).alias("similarity")
    )


def skipped_meetings(chunks: DataFrame, queries: DataFrame, threshold: float = S.THRESHOLD) -> tuple[int, int]:
    """(meetings of a query and a ring that the threshold alone skips, all meetings), of vectors that can be searched."""
    asked = queries.select("query_id", "top_k", F.col("embedding").cast("array<double>").alias("asked"), F.lit(threshold).cast("double").alias("least"))
    live = chunks.select("chunk_id", F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("int").alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding"))
    rings = _ringed(live, live.count(), CHUNK_BLOCK)[1]
    sent = chunks.sparkSession.sparkContext.broadcast(rings)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), sent.value.step):
                yield pd.DataFrame({"n": (sent.value.bounds(_unit(whole["asked"].iloc[at : at + sent.value.step])) >= threshold).sum(1)})

    every = asked.count() * len(rings.at)
    return every - (asked.select("asked").mapInPandas(met, "n long").agg(F.sum("n")).first()[0] or 0), every


def gate_queries(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries with their number of hits and ``insufficient_context`` where there is none. A null query_id has no hits;
    repeated queries are told each; no queries give an empty table."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    told = queries.select("query_id").join(n, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return told.withColumn("status", F.when(F.col("hits") == 0, "insufficient_context"))


def build_context(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked hits with their text and provenance, one row each. A hit whose chunk or document is not there is left
    out; repeated chunks repeat their hit."""
    text = chunks.select("chunk_id", "content", "page_index", "page_label", "section")
    title = documents.select(F.col("id").alias("document_id"), "title")
    return hits.join(text, "chunk_id").join(title, "document_id")


def check_citations(answers: DataFrame, hits: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) of the cited chunk ids ``(query_id, chunk_id)``, each once: valid ones are in the
    query's context and their document still exists."""
    cited = answers.select("query_id", F.explode("cited_chunk_ids").alias("chunk_id")).distinct()
    live = hits.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("query_id", "chunk_id").distinct()
    return cited.join(live, ["query_id", "chunk_id"], "left_semi"), cited.join(live, ["query_id", "chunk_id"], "left_anti")


def build_citations(valid: DataFrame, context: DataFrame, excerpt: int = 200) -> DataFrame:
    """Citation rows from the tables alone."""
    return valid.join(context, ["query_id", "chunk_id"]).select(
        "query_id", "rank", "document_id", "chunk_id", "title", "page_index", "page_label", "section", F.substring("content", 1, excerpt).alias("excerpt"), "similarity"
    )


def check_answers(answers: DataFrame, citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Violations ``(query_id, rule)`` of the rules between a status, its citations and its hits."""
    cited = citations.groupBy("query_id").agg(F.count("*").alias("cited"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("found"))
    own = answers.select("query_id", "status").join(cited, "query_id", "left").join(found, "query_id", "left").fillna(0, ["cited", "found"])
    rules = F.array_compact(
        F.array(
            F.when((F.col("status") == "answered") & (F.col("cited") == 0), "answered_without_citation"),
            F.when((F.col("status") == "insufficient_context") & (F.col("cited") > 0), "insufficient_with_citation"),
            F.when(F.col("cited") > F.col("found"), "more_citations_than_hits"),
            F.when(~F.col("status").isin("answered", "insufficient_context", "clarification_needed"), "unknown_status"),
        )
    )
    return own.select("query_id", F.explode(rules).alias("rule"))
