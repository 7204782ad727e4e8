"""Source divergence audit with mergeable radix tries.

A task counts the terms of its texts in a byte trie over lang and term, whose leaves have a counter for
each source. A trie is laid out in depth-first order: of each leaf the number of bytes that it shares with
the leaf before it, and the bytes of its own edge. Tries are cut at splitters into prefix ranges; the
pieces of one range meet in one task, which merges them piece by piece and tells the terms that enough
documents have. A frequent term is one leaf of each task's trie, however often it occurs. Slices of a
lang's terms, with all its groups, then give partial distances of each pair of sources and each
group's first terms, in the order of value and bytes.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docmill.llm.store import stored

#: Bytes that are in no term become spaces, A-Z become a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of texts that are counted together, and of a longer text at a time; leaves that a task holds; that a slice of a
#: lang has; bytes that a leaf shares at most with the one before.
_TOGETHER, _HELD, _SLICE, _SHARED = 1 << 20, 1 << 19, 1 << 16, 255
#: Slices of a lang at least, so that a lang with most of the terms is several tasks'.
_LEAST_SLICES = 16
#: Splitters are drawn from this share of the rows, from so many leaves for each range and no more than so many in all; where they
#: lie changes no result.
_SAMPLED, _EACH, _DRAWN = 16, 16, 1 << 16
_LEAVES = pa.schema([("key", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


class RadixTrie:
    """Leaves ``(key, source, n, docs)`` in the order of their keys' bytes; a key is a lang, a zero byte and a
    term, which has none. A row with all bytes of the one before is a further counter of its leaf."""

    def __init__(self, leaves: pa.Table):
        self.leaves = leaves

    @staticmethod
    def merged(tables: list[pa.Table]) -> RadixTrie:
        """One trie of the leaves of all: equal leaves add their counters."""
        table = pa.concat_tables(tables).group_by(["key", "source"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        table = table.rename_columns(["key", "source", "n", "docs"]).select(_LEAVES.names).cast(_LEAVES)
        return RadixTrie(table.take(pc.sort_indices(table, [("key", "ascending")])).combine_chunks())

    def __len__(self) -> int:
        return self.leaves.num_rows

    def pieces(self, splitters: list[bytes]) -> Iterator[tuple[int, RadixTrie]]:
        """The parts between splitters that have leaves, with their numbers."""
        keys, cuts = self.leaves.column("key"), [0]
        for s in splitters:  # both are in order
            low, high = cuts[-1], len(self)
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if keys[middle].as_py() < s else (low, middle)
            cuts.append(low)
        for i, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(self)], strict=True)):
            if low < high:
                yield i, RadixTrie(self.leaves.slice(low, high - low))

    def to_bytes(self) -> bytes:
        keys = self.leaves.column("key").to_pylist()
        data = np.frombuffer(b"".join(keys), np.uint8)
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        begins = np.cumsum(sizes) - sizes
        shared, at = np.zeros(len(keys), np.int64), np.arange(1, len(keys))
        for depth in range(_SHARED):
            at = at[np.minimum(sizes[at], sizes[at - 1]) > depth]
            at = at[data[begins[at] + depth] == data[begins[at - 1] + depth]]
            if not len(at):
                break
            shared[at] = depth + 1
        own = np.ones(len(data), bool)
        row = np.repeat(np.arange(len(keys)), shared)
        own[begins[row] + np.arange(len(row)) - (np.cumsum(shared) - shared)[row]] = False
        ends = np.zeros(len(keys) + 1, np.int32)
        np.cumsum(sizes - shared, out=ends[1:])
        edges = pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(data[own])])
        source = self.leaves.column("source").combine_chunks().dictionary_encode()
        columns = [pa.array(shared.astype(np.uint8)), edges, source, *(self.leaves.column(c).combine_chunks() for c in ("n", "docs"))]
        batch, sink = pa.RecordBatch.from_arrays(columns, ["shared", "edge", "source", "n", "docs"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def leaves_of(blob: bytes) -> pa.Table:
        table, keys, key = pa.ipc.open_stream(blob).read_all(), [], b""
        for shared, edge in zip(table.column("shared").to_pylist(), table.column("edge").to_pylist(), strict=True):
            key = key[:shared] + edge
            keys.append(key)
        source = table.column("source").combine_chunks()
        return pa.table([pa.array(keys, pa.binary()), source.dictionary_decode() if pa.types.is_dictionary(source.type) else source, table.column("n"), table.column("docs")], schema=_LEAVES)


def _leaves(langs: list[str], sources: list[str], of: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    """Leaves of the groups ``of``, numbers into langs and sources."""
    at = pa.array(of)
    lang = pa.array([x.encode() for x in langs], pa.binary()).take(at)
    return pa.table([pc.binary_join_element_wise(lang, terms, b"\0"), pa.array(sources, pa.string()).take(at), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_LEAVES)


def _short(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of some texts; and for each text and term of it: text, term, occurrences."""
    data = np.frombuffer(b" ".join([b"", *(t.translate(_FOLD) for t in texts), b""]), np.uint8)
    inside = data != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    text = np.searchsorted(begins, starts, "right") - 1
    found, times = np.unique(text * len(terms.dictionary) + terms.indices.to_numpy(), return_counts=True)
    some = max(len(terms.dictionary), 1)
    return terms.dictionary, found // some, found % some, times


def _long(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The same of one text, part by part."""
    text, at, counted = text.translate(_FOLD), 0, Counter()
    while at < len(text):
        end = text.find(b" ", at + _TOGETHER)
        end = len(text) if end < 0 else end
        counted.update(text[at:end].split())
        at = end
    return pa.array(counted, pa.binary()), np.zeros(len(counted), np.int64), np.arange(len(counted)), np.fromiter(counted.values(), np.int64, len(counted))


def _counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Leaves ``(key, source, n, docs)`` of a batch of ``(lang, source, text)``. A group also has the leaf of the
    empty term, with counters 0."""
    langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
    numbers: dict[tuple[str, str], int] = {}
    group = np.array([numbers.setdefault(g, len(numbers)) for g in zip(langs, sources, strict=True)], np.int64)
    langs, sources = [list(x) for x in zip(*numbers, strict=True)] or [[], []]
    none = np.zeros(len(numbers), np.int64)
    yield _leaves(langs, sources, np.arange(len(numbers)), pa.array([b""] * len(numbers), pa.binary()), none, none)
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end] or b"") <= _TOGETHER):
            total += len(texts[end] or b"")
            end += 1
        some = [t or b"" for t in texts[start:end]]
        terms, text, term, times = _long(some[0]) if total > _TOGETHER else _short(some)
        if len(terms):
            key = group[start:end][text] * len(terms) + term
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            n, docs = np.add.reduceat(times[order], first), np.diff(np.append(first, len(key)))
            key = key[order][first]
            yield _leaves(langs, sources, key // len(terms), terms.take(pa.array(key % len(terms))), n, docs)
        start = end


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[RadixTrie]:
    """Tries of the texts of a task, of a bounded size each."""
    held: list[pa.Table] = []
    for batch in batches:
        for table in _counted(batch) if batch.num_rows else ():
            held.append(table)
            if sum(t.num_rows for t in held) > 2 * _HELD:
                held = [RadixTrie.merged(held).leaves]
                if held[0].num_rows > _HELD:
                    yield RadixTrie(held.pop())
    if held:
        yield RadixTrie.merged(held)


def _splitters(rows: DataFrame, ranges: int) -> list[bytes]:
    """Keys that cut the leaves of a sample of the rows into equal parts."""

    drawn = min(_EACH * ranges, _DRAWN)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in _tries(batches):
            keys = trie.leaves.column("key").combine_chunks().unique()
            hashes = pd.util.hash_array(keys.to_numpy(zero_copy_only=False), categorize=False)
            hashes = hashes[order := np.argsort(hashes)]
            cell, first = np.unique(hashes % np.uint64(drawn), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(hashes[first].view(np.int64)), keys.take(pa.array(order[first]))], ["cell", "hash", "key"])

    # the key with the smallest hash of each cell: fewer than a task has, and added up before the driver
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLED)) == 0).mapInArrow(draw, "cell int, hash long, key binary")
    keys = sorted(bytes(r.key) for r in some.groupBy("cell").agg(F.min_by("key", "hash").alias("key")).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _merger(min_docs: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves of the ranges of a task, which come in order. Of a range that is told in one piece the terms of too few
        documents are left out; the leaves of a larger one are told as they come and are added up later."""
        now, whole, held = None, True, []

        def told(final: bool) -> Iterator[pa.RecordBatch]:
            trie = RadixTrie.merged(held)
            leaves = trie.leaves
            if final and whole:
                key = leaves.column("key").combine_chunks().dictionary_encode()
                docs = np.bincount(key.indices.to_numpy(), leaves.column("docs").to_numpy())[key.indices.to_numpy()]
                leaves = leaves.filter(pa.array((docs >= min_docs) | (leaves.column("docs").to_numpy() == 0)))
            keys = [k.rsplit(b"\0", 1) for k in leaves.column("key").to_pylist()]
            columns = [pa.array([k[i].decode() for k in keys], pa.string()) for i in range(2)]
            names = ["lang", "term", "source", "n", "docs"]
            yield from pa.table([*columns, *(leaves.column(c) for c in names[2:])], names).to_batches()

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != now:
                    if held:
                        yield from told(True)
                    now, whole, held = number, True, []
                held.append(RadixTrie.leaves_of(blob.as_buffer()))
                if sum(t.num_rows for t in held) > 2 * _HELD:
                    held = [RadixTrie.merged(held).leaves]
                    if held[0].num_rows > _HELD:
                        yield from told(False)
                        whole, held = False, []
        if held:
            yield from told(True)

    return merge


def term_leaves(docs: DataFrame, min_docs: int = 1, ranges: int | None = None) -> DataFrame:
    """``(lang, term, source, n, docs)``: occurrences of each term and the number of rows that have it, of the
    terms that ``min_docs`` rows of the lang have; and a row of the empty term for each group."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").cast("binary").alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(rows, ranges or 4 * partitions)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in _tries(batches):
            for number, piece in trie.pieces(splitters):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([piece.to_bytes()], pa.binary())], ["range", "trie"])

    pieces = rows.mapInArrow(cut, "range int, trie binary").repartition(partitions, "range").sortWithinPartitions("range")
    leaves = pieces.mapInArrow(_merger(min_docs), "lang string, term string, source string, n long, docs long")
    return leaves.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)) without rounding: a digit of base 1000 at a time."""
    below = totals + 5 * kept
    rest = counts + 5
    if int(np.max(below, initial=0)) > 1 << 53:
        return 1 + (10**9 * rest.astype(object) // below.astype(object)).astype(np.int64)
    out, rest = np.divmod(rest, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return 1 + out


_PARTS = "lang string, source string, part string, item string, value long"


def _compare(first: int):
    def compare(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        """Distances of all pairs of sources over the terms of this slice, and for each source its ``first`` terms."""
        groups = groups.sort_values("source")
        sources = groups["source"].to_numpy(object)
        told: list[pd.DataFrame] = []
        distance = np.zeros((len(sources), len(sources)), np.int64)
        terms = terms.sort_values("term")
        names, size = terms["term"].to_numpy(object), max(_SLICE * 8 // max(len(sources), 1), 1)
        best: list[list[tuple[int, str]]] = [[] for _ in sources]
        if len(names):
            kept, totals = int(groups["kept"].iloc[0]), groups["total"].to_numpy(np.int64)
            whole = np.array([groups["whole"].iloc[0]], np.int64)
            number = {s: i for i, s in enumerate(sources)}
        for at in range(0, len(names), size):
            part = terms.iloc[at : at + size]
            counts = np.zeros((len(part), len(sources)), np.int64)
            row = np.repeat(np.arange(len(part)), [len(x) for x in part["sources"]])
            counts[row, [number[s] for x in part["sources"] for s in x]] = np.concatenate(part["counts"].to_list())
            p, q = shares(counts, totals, kept), shares(part["n"].to_numpy(np.int64), whole, kept)
            for i in range(len(sources)):
                distance[i] += np.abs(p - p[:, i : i + 1]).sum(axis=0)
                more = p[:, i] - q
                some = np.flatnonzero((counts[:, i] > 0) & (more > 0))
                some = some[np.argsort(-more[some], kind="stable")[:first]]  # terms are in the order of their bytes
                best[i] = sorted([*best[i], *((-int(more[x]), names[at + x]) for x in some)])[:first]
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        told.append(pd.DataFrame({"source": sources[a], "part": "pair", "item": sources[b], "value": distance[a, b]}))
        listed = [(sources[i], "term", term, -less) for i, x in enumerate(best) for less, term in x]
        told.append(pd.DataFrame(listed, columns=["source", "part", "item", "value"]))
        out = pd.concat(told, ignore_index=True)
        out.insert(0, "lang", key[0])
        return out

    return compare


def source_divergence(docs: DataFrame, min_docs: int = 30, first: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how the sources of a lang differ in their terms.

    A null lang, source or text is an empty one. Terms are runs of ASCII letters and characters over
    U+007F, A-Z in lower case. A lang keeps the terms that ``min_docs`` of its rows have. A
    group's share of a term is p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), with V the kept terms of the
    lang and N the group's occurrences of them. ``pair`` rows have the sum of |p - p'| with each other
    source of the lang; ``term`` rows the ``first`` terms that the group has and whose share is larger than in
    the lang, by p - q. Ranks go by value, largest first, and then by the bytes of item. A group without terms has
    all counts 0; a lang without kept terms has distances 0; a lang with one source has no pair rows. Repeated rows count each; texts of
    any length are whole; other columns are ignored; an empty table gives an empty result.
    """
    leaves = stored(term_leaves(docs, min_docs), "term-leaves")
    groups = leaves.where("term = ''").select("lang", "source")
    kept = leaves.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("x"))
    # a counter for each source of the lang at most
    kept = stored(kept.where(F.col("docs") >= min_docs).select("lang", "term", "n", F.col("x.source").alias("sources"), F.col("x.n").alias("counts")), "kept-terms")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole"), F.sum(F.size("sources")).alias("leaves"))
    slices = F.greatest(F.lit(_LEAST_SLICES), F.expr(f"coalesce(leaves, 0) div {_SLICE}"))
    langs = groups.select("lang").distinct().join(langs, "lang", "left").select("lang", "kept", "whole", slices.cast("int").alias("slices"))
    told = stored(groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", "whole", "slices"), "groups")
    sliced = kept.join(told.select("lang", "slices").distinct(), "lang").withColumn("slice", F.expr("cast(pmod(xxhash64(term), slices) as int)")).drop("slices")
    copied = told.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    parts = stored(sliced.groupBy("lang", "slice").cogroup(copied.groupBy("lang", "slice")).applyInPandas(_compare(first), _PARTS), "divergence")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return pairs.unionByName(terms)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The audit of the documents table in DuckDB, with the default arguments.
ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM found GROUP BY ALL
), kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 30
), langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM kept GROUP BY lang
), sources AS (SELECT DISTINCT lang, source FROM docs
), own AS (SELECT lang, source, sum(counted.n) AS n FROM counted JOIN kept USING (lang, term) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (coalesce(own.n, 0) + 5 * langs.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (langs.n + 5 * langs.v) AS q
  FROM sources s JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN own ON own.lang = s.lang AND own.source = s.source
  LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
