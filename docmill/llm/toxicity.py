"""Toxic passages as maximum-scoring segments.

Each word has a weight: the log-odds of occurring in a toxic rather than a clean labelled document,
under an informative Dirichlet prior (the words of both classes together), drawn towards zero by
its standard error. Words that tell nothing have a small negative score, so that scores drift
downwards. A linear scan (Ruzzo and Tompa) gives every maximal segment of a text. Segment scores
are calibrated as extreme values (Karlin and Altschul): the best segment of n clean words reaches a
score s with a chance of 1 - exp(-K n exp(-lambda s)). Lambda and K are measured on clean labelled
texts that the weights were not learned from. Scores of several passages are pooled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.store import stored
from docmill.llm.text import Words, slices

_U = np.uint64
_POOLED = 0.02


@dataclass(frozen=True)
class ToxicityModel:
    """``weights``: by hash of the word, 2**b of them whatever the vocabulary; ``drift``: taken from
    each score; ``rate`` (lambda) and ``scale`` (K): the extreme-value law of clean text; ``level``:
    the expected count at which a text counts as toxic."""

    weights: np.ndarray
    drift: float
    rate: float
    scale: float
    level: float = 0.005

    def score(self, expected: float) -> float:
        """0.5 at an expected count of ``level``, the share of clean texts that may do as well."""
        return self.level / (self.level + expected)

    def scores(self, hashes: np.ndarray) -> np.ndarray:
        return self.weights[(hashes & _U(len(self.weights) - 1)).astype(np.int64)].astype(np.float64) - self.drift


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, in one pass over the runs of scores of
    one sign."""
    if not (scores > 0).any():
        return []
    positive = scores > 0
    cuts = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate(([0], cuts))
    sums = np.add.reduceat(scores, starts)
    ends = np.concatenate((cuts, [len(scores)]))
    total, segments = 0.0, []  # segments: start, end, total before it, total after it
    for start, end, s in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if s <= 0:
            total += s
            continue
        left, right = total, total + s
        total = right
        while True:
            k = len(segments) - 1
            while k >= 0 and segments[k][2] >= left:
                k -= 1
            if k < 0 or segments[k][3] >= right:
                segments.append((start, end, left, right))
                break
            start, left = segments[k][0], segments[k][2]
            del segments[k:]
    return [(a, b, r - l) for a, b, l, r in segments]


def expected_count(segments: list[tuple[int, int, float]], words: int, model: ToxicityModel) -> float:
    """The number of times that clean text of this length would do as well: over the r best segments
    together, (K n)^r exp(-lambda sum) / r!, the least over r, doubled for each further r tried. Only
    segments that clean text has less than ``_POOLED`` times are pooled."""
    if not segments or not words:
        return math.inf
    base, best, log_e = math.log(model.scale * words), math.inf, 0.0
    for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
        if r > 1 and base - model.rate * s > math.log(_POOLED):
            break
        log_e += base - model.rate * s - math.log(r)
        best = min(best, log_e + (r - 1) * math.log(2.0))
    return math.exp(min(best, 50.0))


def _training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Texts with their label: of the labelled rows for learning, the ``max_rows`` first by hash."""
    sample = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where("crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.join(F.broadcast(sample), "doc_id").select("text", "toxic", F.expr("crc32(cast(doc_id as string)) % 5").alias("fold"))  # at most max_rows pairs of numbers


def _counter(log2_buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << log2_buckets), np.int64)
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(texts):
                words = Words(texts[i:j])
                bucket = (words.hashes & _U((1 << log2_buckets) - 1)).astype(np.int64)
                owner = np.repeat(np.arange(j - i), np.diff(words.offsets))
                once = np.unique(owner << log2_buckets | bucket)  # a document counts a word once
                label = toxic[i:j][once >> log2_buckets]
                np.add.at(counts, (label, once & ((1 << log2_buckets) - 1)), 1)
        at = np.flatnonzero(counts.any(axis=0))
        for a in range(0, len(at), 1 << 16):
            own = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[0, own]), pa.array(counts[1, own])], ["bucket", "clean", "toxic"])

    return count


def _weights(clean: np.ndarray, toxic: np.ndarray, sums: tuple[int, int], buckets: int, prior: float, errors: float, least: float) -> np.ndarray:
    """Log-odds less ``errors`` standard errors; under ``least`` nothing is left of them. ``sums`` are those of the
    clean and the toxic counts of all buckets."""
    both = clean + toxic
    alpha = prior * (both + 0.01) / (sum(sums) + 0.01 * buckets)
    n1, n0 = sums[1] + prior, sums[0] + prior
    y1, y0 = toxic + alpha, clean + alpha
    delta = np.log(y1 / (n1 - y1)) - np.log(y0 / (n0 - y0))
    error = np.sqrt(1.0 / y1 + 1.0 / y0)
    size = np.maximum(np.abs(delta) - errors * error, 0.0)
    return np.where((both > 0) & (size >= least), np.sign(delta) * size, 0.0).astype(np.float32)


def _weigher(*options):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights that are not 0."""
        for batch in batches:
            clean, toxic = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (1, 2))
            weights = _weights(clean, toxic, *options)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(weights[at])], ["bucket", "weight"])

    return weigh


_STEP = 0.1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, log2_buckets: int = 20, prior: float = 10_000.0, errors: float = 1.0, least: float = 1.5, drift: float = 0.05, level: float = 0.005) -> ToxicityModel:
    """Learn from the labelled rows whose crc32(doc_id) mod 5 is not 0, at most ``max_rows`` of them:
    the law of clean text where it is 4, with weights from where it is 1 to 3; then the weights from
    all of them. Without rows of both classes every weight is 0, and every text clean. ``level`` is the
    number of times that clean text may do as well as a text that counts as toxic. Counts stay in Spark; the driver
    has the weights alone."""
    spark = docs.sparkSession
    rows = stored(_training_rows(docs, labels, max_rows), "toxicity-training")

    def counts(*each: DataFrame) -> DataFrame:
        table = reduce(DataFrame.union, each).groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        return stored(table, "toxicity-counts")

    def counted(some: DataFrame) -> DataFrame:
        return some.mapInArrow(_counter(log2_buckets), "bucket int, clean long, toxic long")

    def weights(table: DataFrame, sums: tuple[int, int]) -> np.ndarray:
        weigh = _weigher(sums, 1 << log2_buckets, prior, errors, least)
        told = table.mapInArrow(weigh, "bucket int, weight float").toArrow()  # of 2**log2_buckets at most, those that are not 0
        out = np.zeros(1 << log2_buckets, np.float32)
        out[told["bucket"].to_numpy()] = told["weight"].to_numpy()
        return out

    def sums(table: DataFrame) -> tuple[int, int]:
        return tuple(n or 0 for n in table.agg(F.sum("clean"), F.sum("toxic")).first())

    some = counts(counted(rows.where("fold < 4")))
    if not all(n := sums(some)):
        return ToxicityModel(np.zeros(1 << log2_buckets, np.float32), drift, 1.0, 1.0, level)
    draft = ToxicityModel(weights(some, n), drift, 1.0, 1.0)
    every = counts(some, counted(rows.where("fold = 4")))
    shared = spark.sparkContext.broadcast(draft)

    def best_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By bin of ``_STEP``: how many texts have their best segment there, and their words."""
        model, texts_by, words_by = shared.value, {}, {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts):
                words = Words(texts[i:j])
                scores = model.scores(words.hashes)
                for a in range(j - i):
                    own = scores[words.offsets[a] : words.offsets[a + 1]]
                    b = math.floor(max((x[2] for x in maximal_segments(own)), default=0.0) / _STEP)
                    texts_by[b], words_by[b] = texts_by.get(b, 0) + 1, words_by.get(b, 0) + len(own)
        bins = list(texts_by)
        columns = (bins, [texts_by[b] for b in bins], [words_by[b] for b in bins])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bin", "texts", "words"])

    null = rows.where("toxic = 0 and fold = 4").select("text").mapInArrow(best_segments, "bin long, texts long, words long")
    null = null.groupBy("bin").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")).orderBy("bin").collect()  # a few hundred bins
    law = extreme_value_law([r.bin * _STEP for r in null], [r.texts for r in null], sum(r.words for r in null))
    return ToxicityModel(weights(every, sums(every)), drift, *law, level)


def extreme_value_law(scores: list[float], texts: list[int], words: int) -> tuple[float, float]:
    """Lambda and K from the best segments of clean texts: how fast the number of texts at a score or
    above falls between the score that a tenth of them reach and that which one in 200 reach."""
    total = sum(texts)
    above = np.cumsum(texts[::-1])[::-1] if total else np.zeros(0)
    low = next((k for k in range(len(scores)) if above[k] <= 0.1 * total), None)
    high = next((k for k in reversed(range(len(scores))) if above[k] >= max(3, total / 200)), None)
    if low is None or high is None or high <= low:
        top = scores[low] if low is not None else 0.0
        return 1.0, 0.1 * max(total, 1) / (max(words, 1) * math.exp(-top))
    rate = math.log(above[low] / above[high]) / (scores[high] - scores[low])
    rate = min(max(rate, 0.2), 1.5)
    return rate, float(above[high] / (words * math.exp(-rate * scores[high])))


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score, predicted, passages array<struct<start, end, score>>)`` for each row of
    ``docs(doc_id, text)``; passages are those that are significant alone (score 0.5 or more), in words.

    score = level / (level + expected count) of the text's best evidence; a null, empty or wordless text has
    score 0. A null doc_id stays null; repeated rows keep a row each; other columns are ignored; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                words = Words(texts[i:j])
                scores = m.scores(words.hashes)
                values, passages = [], []
                for a in range(j - i):
                    own = scores[words.offsets[a] : words.offsets[a + 1]]
                    found = maximal_segments(own)
                    values.append(m.score(expected_count(found, len(own), m)))
                    passages.append([{"start": x, "end": y, "score": s} for x, y, s in found if expected_count([(x, y, s)], len(own), m) <= m.level])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(values, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores with ``held_out``: the rows whose label, if any, was kept from learning."""
    scored = score_texts(docs, fit(docs, labels, **options))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not predicted toxic, each judged by its own text: null, empty and
    wordless texts stay, repeated rows share their fate, other columns may have any names, an empty
    table gives an empty one. Rows are filtered where they are, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    schema, at = docs.schema, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts, good = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for i, j in slices(texts):
                words = Words(texts[i:j])
                scores = m.scores(words.hashes)
                for a in range(j - i):
                    own = scores[words.offsets[a] : words.offsets[a + 1]]
                    good[i + a] = m.score(expected_count(maximal_segments(own), len(own), m)) < 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, schema)
