"""Benchmark decontamination with spaced seeds.

A mask such as 1101001 reads the words under its ones and ignores the others, so a seed survives a
substituted word. Benchmark items and documents are hashed under the same fixed masks; equal hashes
are joined, and the hits of a document and an item at one distance are one alignment: along it all
words are compared in place, and the stretches with at least 80 % equal words, equal at their ends
too, are the overlaps. The four masks together hit every stretch of 13 words with two substitutions
and of 15 with three (simulated), while five words in a row miss 4 % and 8 % of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.store import Bloom, split_by_filter, stored, unused
from docmill.llm.text import Words, maximal_runs, mix, slices

_U = np.uint64

#: Fixed seed masks: 1 = the word counts, 0 = any word.
MASKS = ("111101", "1001111", "10110011", "110100101")
#: Items under so many words are found only where they are all the words of a text.
_WHOLE = 5
#: Stretches of up to so many words get masks of their own where ``MASKS`` are not enough.
_SHORT = 12


def _short_masks(lengths: list[int], similarity: float) -> list[tuple[str, int]]:
    """Masks for stretches of so few words that ``MASKS`` do not hit each with the substitutions that
    the share allows (at its ends it has equal words), and the length of these stretches."""
    out = []
    for n in sorted(lengths):
        changes = max(min(max(x for x in range(n) if (n - x) * 1000 >= n * round(similarity * 1000)), n - 2), 0)
        for gaps in combinations(range(1, n - 1), changes):
            if not any(all(c == "0" or at + k not in gaps for k, c in enumerate(m)) for m in MASKS for at in range(n - len(m) + 1)):
                out.append(("".join("0" if k in gaps else "1" for k in range(n)), n))
    return out


def _seeds(h: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a mask and the places of their first words, within texts."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    seed = np.full(n, int(mask, 2), _U)
    for k, c in enumerate(mask):
        if c == "1":
            seed = seed * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return mix(seed[place]), place


_HITS = pa.schema([("id", pa.int64()), ("nid", pa.int64()), ("seed", pa.int64()), ("pos", pa.int32())])


def _seeder(masks: list[tuple[str, int]], min_words: int, filter_words=None):
    """Rows of (id, content id, text) -> seeds with their places; with a filter, only seeds in it,
    without one (items) a mask that is for short stretches only in texts that need it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(filter_words.value) if filter_words is not None else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in slices(texts):
                words = Words(texts[i:j])
                h, off = words.hashes, words.offsets
                needed = np.minimum(np.diff(off), min_words)
                for mask, length in masks:
                    seed, place = _seeds(h, off, mask)
                    text = np.searchsorted(off, place, "right") - 1
                    if length and (bloom is None or length < _WHOLE):
                        at = np.flatnonzero(needed[text] == length)
                        seed, place, text = seed[at], place[at], text[at]
                    if bloom is not None:
                        at = np.flatnonzero(bloom.has(seed))
                        seed, place, text = seed[at], place[at], text[at]
                    own = pa.array(i + text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), pa.array(seed.view(np.int64)), pa.array((place - off[text]).astype(np.int32))], schema=_HITS
                    )

    return rows


def _word_lists(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(nid, words array<int>)`` of the texts whose content id is in ``nodes(nid)``."""
    wanted = texts.sparkSession.sparkContext.broadcast(Bloom.sized(nodes, F.col("nid")).words)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(wanted.value)
        for batch in batches:
            nids = batch.column(0).to_numpy()
            at = np.flatnonzero(bloom.has(nids.view(_U)))
            at = at[np.sort(np.unique(nids[at], return_index=True)[1])]
            some = batch.column(1).take(pa.array(at)).to_pylist()
            for i, j in slices(some):
                words = Words(some[i:j])
                small, off = words.hashes.astype(np.uint32).view(np.int32), words.offsets
                yield pa.RecordBatch.from_arrays([pa.array(nids[at[i:j]], pa.int64()), pa.array([small[off[a] : off[a + 1]] for a in range(j - i)], pa.list_(pa.int32()))], ["nid", "words"])

    found = texts.select("nid", "text").mapInArrow(collect, "nid long, words array<int>")
    return found.join(nodes, "nid", "left_semi").dropDuplicates(["nid"])


def overlaps(a: np.ndarray, b: np.ndarray, similarity: float) -> list[tuple[int, int, int]]:
    """``(start, end, equal)`` of the stretches of a and b, word against word, that begin and end with
    equal words, have enough of them and lie in no longer one."""
    at = np.flatnonzero(a == b)
    share = round(similarity * 1000)
    first, last = maximal_runs(1000 * np.arange(len(at)) - share * at, 1000 - share)
    return [(int(at[x]), int(at[y]) + 1, int(y - x + 1)) for x, y in zip(first, last, strict=True)]


def _verifier(min_words: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("nid", "item_nid", "first", "item_words")}
            windows, items = batch.column("window"), batch.column("item_window")
            out: list[list] = [[], [], [], [], []]
            for r in range(batch.num_rows):
                for start, end, equal in overlaps(windows[r].values.to_numpy(), items[r].values.to_numpy(), similarity):
                    if end - start >= min(min_words, c["item_words"][r]):
                        row = (c["nid"][r], c["item_nid"][r], c["first"][r] + start, c["first"][r] + end, equal)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["nid", "item_nid", "word_start", "word_end", "equal_words"])

    return verify


def _found(docs: DataFrame, benchmark: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """``(doc_id, nid, item_id, word_start, word_end, equal_words)`` of all overlaps."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("nid"), "text")
    needed = F.least("words", F.lit(min_words)).alias("words")
    lengths = stored(items.select("text").mapInArrow(_count_words, "words int").select(needed).where(f"words between 1 and {_SHORT}").distinct(), "lengths")
    masks = [*((m, 0) for m in MASKS), *_short_masks([r[0] for r in lengths.collect()], similarity)]  # a handful of lengths
    ddl = "id long, nid long, seed long, pos int"
    seeds = stored(items.mapInArrow(_seeder(masks, min_words), ddl).distinct(), "benchmark-seeds")
    bloom = spark.sparkContext.broadcast(Bloom.sized(seeds, F.col("seed")).words)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("nid"), "text")
    hits = texts.mapInArrow(_seeder(masks, min_words, bloom), ddl).withColumnRenamed("id", "doc_id")
    own = seeds.select("seed", F.col("nid").alias("item_nid"), F.col("pos").alias("item_pos")).distinct()
    # only after the exact join the hits at one distance are one
    placed = hits.join(own, "seed").select("doc_id", "nid", "item_nid", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    placed = stored(placed, "alignments")
    lined = placed.select("nid", "item_nid", "shift").distinct()
    item_lists = stored(_word_lists(items, lined.select(F.col("item_nid").alias("nid")).distinct()), "item-words").select(F.col("nid").alias("item_nid"), F.col("words").alias("item_list"))
    lists = stored(_word_lists(texts, lined.select("nid").distinct()), "words")
    first, item_first = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    sized = lined.join(item_lists.select("item_nid", F.size("item_list").alias("item_words")), "item_nid")
    cut = sized.join(lists, "nid").withColumn("first", first).withColumn("n", F.least(F.size("words"), F.col("shift") + F.col("item_words")) - F.col("first"))
    cut = cut.select("nid", "item_nid", "item_words", "first", item_first.alias("item_first"), "n", F.expr("slice(words, first + 1, n)").alias("window"))
    pairs = cut.join(item_lists, "item_nid").withColumn("item_window", F.expr("slice(item_list, item_first + 1, n)")).drop("item_list")
    found = pairs.mapInArrow(_verifier(min_words, similarity), "nid long, item_nid long, word_start int, word_end int, equal_words int")
    found = found.join(seeds.select(F.col("nid").alias("item_nid"), F.col("id").alias("item_id")).distinct(), "item_nid")
    return placed.select("doc_id", "nid").distinct().join(found, "nid")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """Overlaps of ``docs(doc_id, text)`` with ``benchmark(item_id, text)``: one row for each document
    and item with ``word_start``, ``word_end``, ``equal_words`` (of the longest stretch; places of
    words in the document) and ``stretches`` (overlaps that begin at different places).

    An overlap has ``min_words`` words, or those of the whole item if it has fewer, and at least the
    given share of equal words in place. Phrases of one to four words are everywhere: an item of so
    few is found only where it is all the words of a text. Null or empty texts have no overlap; a
    null doc_id is kept as such; repeated rows and repeated items count once; other columns are
    ignored; an empty table gives an empty result.
    """
    found = _found(docs, benchmark, min_words, similarity)
    best = F.max_by(F.struct("word_start", "word_end", "equal_words"), F.struct(F.col("word_end") - F.col("word_start"), "equal_words", -F.col("word_start")))
    return found.groupBy("doc_id", "item_id").agg(
        best.alias("best"), F.count_distinct(F.col("word_start")).alias("stretches")
    ).select("doc_id", "item_id", "best.*", "stretches")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, j in slices(texts):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(Words(texts[i:j]).offsets), pa.int32())], ["words"])


def without_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """The rows of docs whose text has no overlap; other texts under the same doc_id, null and empty
    texts and repeated clean rows stay. Other columns may have any names; an empty table, or an empty
    benchmark, changes nothing. Whole rows are shuffled only where a filter of the texts that go may have them."""
    gone = stored(_found(docs, benchmark, min_words, similarity).select("nid").distinct(), "overlapping")
    nid = unused(docs, "row_nid")
    maybe, clear = split_by_filter(docs.withColumn(nid, F.xxhash64("text")), F.col(nid), gone.select(F.col("nid").alias("key")))
    kept = maybe.join(gone.select(F.col("nid").alias(nid)), nid, "left_anti")
    return clear.select(*docs.columns).union(kept.select(*docs.columns))
