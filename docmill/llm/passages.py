"""Substring dedup with compact windows.

The elements of a text are its five-word shingles, hashed by ``k`` functions. For one function, all
stretches of at least ``shortest`` elements whose smallest hash is at place c form a compact window
(l, c, r): they begin in l..c and end in c..r. The windows are the nodes of the Cartesian tree over
the hashes whose range is long enough, about 2n / shortest of them. Stretches of two texts share a
signature value when their windows have the same hash, so windows are joined by hash.

Texts of one hash are first held against one text of it (stars, not all pairs). The window pairs of two
texts whose distances are neighbours (an inserted or left-out word moves the rest) are counted over
the functions, and enough of them make a candidate. Candidates are verified shingle by shingle around
their windows: all stretches with the required Jaccard similarity. Windows inside a found passage are
settled; the others are open, and are held against all texts of their hash, settled ones too, if
these are few. Large groups meet under narrower keys, which texts with a passage around the place share and
texts with no more than a common phrase, or with too many edits, do not. There open windows lead, more of them
from turn to turn, until none is left; settled windows that are equal over a key's span are held against them once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain, repeat
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docmill.llm.store import Bloom, forget, stored
from docmill.llm.text import Words, maximal_runs, mix, shingles, slices

_U = np.uint64
_WORDS = 5
#: Two distances of a pair of texts are neighbours up to this difference; verification looks at this
#: many further distances on both sides.
_NEAR, _SLACK = 8, 2
#: Levels of the Cartesian trees after which equal values are split together.
_DEEP = 64


def compact_windows(values: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(l, c, r)`` of all compact windows of at least ``shortest`` elements of the texts
    ``values[offsets[i]:offsets[i + 1]]``. Ranges are split at their smallest value, those of one
    depth of the Cartesian trees together; the first of equal values is the smallest. Repeated text
    makes trees as deep as it has repeats: from some depth on, a range is split at all places of its
    smallest value at once, with the same windows."""
    place_bits = max(int(len(values)).bit_length(), 1)
    packed = (values >> _U(place_bits) << _U(place_bits)) | np.arange(len(values), dtype=_U)
    low, high = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    level = 0
    while True:
        keep = high - low >= shortest
        low, high = low[keep], high[keep]
        if not len(low):
            break
        ends = np.empty(2 * len(low), np.int64)
        ends[::2], ends[1::2] = low, high
        least = np.minimum.reduceat(packed, ends[:-1] if ends[-1] == len(packed) else ends)[::2]
        level += 1
        if level <= _DEEP:
            c = (least & _U((1 << place_bits) - 1)).astype(np.int64)
            out.append((low, c, high - 1))
            # left parts then right parts, in order of place
            parts = np.empty((len(low), 4), np.int64)
            parts[:, 0], parts[:, 1], parts[:, 2], parts[:, 3] = low, c, c + 1, high
            low, high = parts[:, ::2].ravel(), parts[:, 1::2].ravel()
            continue
        sizes = high - low
        of = np.repeat(np.arange(len(low)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
        at = np.flatnonzero(packed[place] >> _U(place_bits) == (least >> _U(place_bits))[of])
        of, c = of[at], place[at]
        new = np.concatenate(([True], of[1:] != of[:-1]))
        begin = np.where(new, low[of], np.concatenate(([0], c[:-1] + 1)))
        long = high[of] - begin >= shortest
        out.append((begin[long], c[long], high[of][long] - 1))
        last = np.append(new[1:], True)
        low, high = np.concatenate((begin, c[last] + 1)), np.concatenate((c, high[of][last]))
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    l, c, r = (np.concatenate(x) for x in zip(*out, strict=True))
    return l, c, r


_SCANNED = pa.schema(
    [("doc_id", pa.int64()), ("nid", pa.int64()), ("n", pa.int32()), ("sequence", pa.binary()), ("key", pa.int64()), ("occurrence", pa.int32()), ("place", pa.int64())]
)


def _scanner(k: int, shortest: int):
    """A row for each text that is long enough (``sequence``: 16 bits of each shingle) and a row for each
    of its compact windows. ``key`` has the function in its low byte; ``place`` is c, then how far the
    window reaches to the left and to the right of it (16 bits each: more makes no difference).
    Windows of one key in one text count as one within ``shortest`` places of the one before. A task tells
    a text's length, sequence and windows once, however many copies it has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}  # whether it is long enough, of each text of this task
        for batch in batches:
            texts, all_nids = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            for i, j in slices(texts):
                nids = all_nids[i:j]
                fresh = np.array([t for t in np.sort(np.unique(nids, return_index=True)[1]).tolist() if int(nids[t]) not in seen], np.int64)
                words = Words([texts[i + t] for t in fresh])
                sh, off = shingles(words, _WORDS)
                sizes, small = np.diff(words.offsets), sh.astype(np.uint16)
                seen.update(zip(nids[fresh].tolist(), (sizes >= shortest + _WORDS - 1).tolist(), strict=True))
                some = np.flatnonzero([seen[x] for x in nids.tolist()])
                if not len(some):
                    continue
                number = np.full(j - i, -1)
                number[fresh] = np.arange(len(fresh))
                new, no = number[some], pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(i + some)), pa.array(nids[some]), pa.array([int(sizes[x]) if x >= 0 else None for x in new], pa.int32()),
                        pa.array([small[off[x] : off[x + 1]].tobytes() if x >= 0 else None for x in new], pa.binary()), no, pa.nulls(len(some), pa.int32()), no,
                    ],
                    schema=_SCANNED,
                )
                nids = nids[fresh]
                if not len(nids):
                    continue
                for f in range(k):
                    value = mix(sh + _U(0x9E3779B97F4A7C15 * (f + 1) & 0xFFFFFFFFFFFFFFFF))
                    l, c, r = compact_windows(value, off, shortest)
                    key = value[c] & ~_U(0xFF) | _U(f)
                    text = np.searchsorted(off, c, "right") - 1
                    order = np.lexsort((c, key, text))
                    l, c, r, key, text = l[order], c[order], r[order], key[order], text[order]
                    again = np.concatenate(([False], (key[1:] == key[:-1]) & (text[1:] == text[:-1])))
                    at = np.arange(len(c))
                    first = np.maximum.accumulate(np.where(again, 0, at))
                    occurrence = (c - c[first]) // shortest
                    keep = np.flatnonzero(~(again & (np.diff(occurrence, prepend=-1) == 0)))
                    l, c, r, key, text, occurrence = l[keep], c[keep], r[keep], key[keep], text[keep], occurrence[keep]
                    reach = np.minimum(c - l, 0xFFFF) << 16 | np.minimum(r - c, 0xFFFF)
                    no = pa.nulls(len(c), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            no, pa.array(nids[text]), pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.binary()),
                            pa.array(key.view(np.int64)), pa.array(occurrence.astype(np.int32)), pa.array((c - off[text]) << 32 | reach),
                        ],
                        schema=_SCANNED,
                    )

    return scan


def scan_texts(docs: DataFrame, k: int, shortest: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, nid, n, sequence)`` of the texts that are long enough, and ``(nid, key, occurrence,
    place)`` of their windows: one pass over the texts, written once."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("nid"), "text")
    scanned = rows.mapInArrow(_scanner(k, shortest), "doc_id long, nid long, n int, sequence binary, key long, occurrence int, place long")
    scanned = stored(scanned, "scan")
    return scanned.where("key is null").select("doc_id", "nid", "n", "sequence"), scanned.where("key is not null").select("nid", "key", "occurrence", "place")


def _c(place: str) -> Column:
    return F.shiftright(place, 32).cast("int")


def _overlap(x: str, y: str) -> Column:
    """Elements that two windows have in common when their places c lie on each other."""
    left = [F.shiftright(p, 16).bitwiseAND(0xFFFF) for p in (x, y)]
    right = [F.col(p).bitwiseAND(0xFFFF) for p in (x, y)]
    return F.least(*left) + F.least(*right) + 1


def _pairs(nid: Column, place: Column, b: Column, place_b: Column) -> list[Column]:
    """a is the text with the larger id."""
    return [F.col("key"), *(F.when(nid > b, x).otherwise(y).alias(n) for n, x, y in (("a", nid, b), ("place_a", place, place_b), ("b", b, nid), ("place_b", place_b, place)))]


def star_pairs(windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``(key, a, place_a, b, place_b)`` of the windows of each key that several texts have with that of its
    leader, the text with the smallest id; these windows without the leader's; the stored table of both."""
    rank = F.expr("(nid & ~4095L) | least(occurrence, 4095)")  # fixed-width, so that it is aggregated in place
    leaders = windows.groupBy("key").agg(
        F.min("nid").alias("least"), F.max("nid").alias("most"), F.min_by("nid", rank).alias("b"), F.min_by("place", rank).alias("place_b")
    )
    leaders = leaders.where("least <> most").select("key", "b", "place_b")
    met = stored(windows.select("nid", "key", "place").join(leaders, "key").where("nid <> b"), "window-pairs")
    return met.select(*_pairs(F.col("nid"), F.col("place"), F.col("b"), F.col("place_b"))), met.select("nid", "key", "place"), met


def open_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of the open windows of each key with all others of it."""
    led = windows.where("open").select("key", F.col("nid").alias("b"), F.col("place").alias("place_b"))
    met = windows.join(led, "key").where("nid <> b and (not open or nid > b)")
    return met.select(*_pairs(F.col("nid"), F.col("place"), F.col("b"), F.col("place_b")))


def leader_pairs(windows: DataFrame, leaders_each: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of the windows of each key with its leaders, the open texts with the smallest ids; the
    windows of the keys that have other open ones, without the leaders; the stored leaders."""
    first = F.dense_rank().over(Window.partitionBy("key").orderBy("nid"))  # limited before the shuffle
    led = windows.where("open").withColumn("rank", first).where(F.col("rank") <= leaders_each)
    led = stored(led.select("key", F.col("nid").alias("b"), F.col("place").alias("place_b")), "leaders")
    met = windows.join(led, "key").where("nid <> b and (not open or nid > b)")
    last = led.groupBy("key").agg(F.max("b").alias("last"))
    rest = windows.join(last, "key").where("not open or nid > last").drop("last")
    return met.select(*_pairs(F.col("nid"), F.col("place"), F.col("b"), F.col("place_b"))), rest, led


def votes(pairs: DataFrame, earlier: DataFrame | None, shortest: int) -> DataFrame:
    """``(a, b, low_shift, high_shift, low, high, f)``: in which functions (bits of f) the windows of two
    texts agree at one distance or neighbouring ones, and between which places of a. Counted are
    windows of which a part that is long enough lies against each other, and ``earlier`` votes: two texts may
    meet in one function now, and have met in another one before."""
    own = pairs.where(_overlap("place_a", "place_b") >= shortest).select(
        "a", "b", (_c("place_a") - _c("place_b")).alias("shift"), _c("place_a").alias("low"), _c("place_a").alias("high"), F.expr("shiftleft(1L, cast(key & 255 as int))").alias("f")
    )
    if earlier is not None:
        own = own.union(earlier.select("a", "b", F.col("low_shift").alias("shift"), "low", "high", "f"))
    bounds = (F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("f").alias("f"))
    own = own.groupBy("a", "b", "shift").agg(*bounds)
    by_pair = Window.partitionBy("a", "b").orderBy("shift")
    own = own.withColumn("new", F.when(F.col("shift") - F.lag("shift").over(by_pair) <= _NEAR, 0).otherwise(1))
    own = own.withColumn("run", F.sum("new").over(by_pair))
    return own.groupBy("a", "b", "run").agg(F.min("shift").alias("low_shift"), F.max("shift").alias("high_shift"), *bounds).drop("run")


def matching_stretches(a: list[np.ndarray], b: list[np.ndarray], low_shift: np.ndarray, high_shift: np.ndarray, shortest: int, similarity: float):
    """``(row, start, end, other_start, other_end)``: for each row the stretches of a (and of b) with the
    length whose Jaccard similarity, over places of equal elements, is high enough. a[i] is held against b[i - s]
    for each distance s from low_shift to high_shift. A stretch begins and ends with equal elements;
    stretches that overlap are told as one."""
    scaled = round(similarity * 1000)
    rows: list[np.ndarray] = []
    for width in np.unique(high_shift - low_shift).tolist():
        own = np.flatnonzero(high_shift - low_shift == width)
        sizes_a, sizes_b = (np.array([len(x[r]) for r in own], np.int64) for x in (a, b))
        all_a, all_b = (np.concatenate([x[r] for r in own]) for x in (a, b))
        if not len(all_a) or not len(all_b):
            continue
        begin_a, begin_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
        of = np.repeat(np.arange(len(own)), sizes_a)
        place = np.arange(len(all_a)) - begin_a[of]
        size, begin, against = sizes_b[of], begin_b[of], np.full(len(all_a), -1, np.int64)
        for step in range(width + 1):
            other = place - (low_shift[own][of] + step)
            inside = np.flatnonzero((other >= 0) & (other < size))
            inside = inside[all_a[inside] == all_b[(begin + other)[inside]]]
            against[inside] = other[inside]
        at = np.flatnonzero(against >= 0)
        if not len(at):
            continue
        of, p, q = of[at], place[at], against[at]
        # rows lie apart: no run goes from one to the next
        sums = (1000 + scaled) * np.arange(len(at)) - 2 * scaled * p - of * (4000 * (len(all_a) + 1))
        first, last = maximal_runs(sums, 1000 - scaled)
        equal, long_a, long_b = last - first + 1, p[last] - p[first] + 1, q[last] - q[first] + 1
        good = (np.maximum(long_a, long_b) >= shortest) & (equal * (1000 + scaled) >= scaled * (long_a + long_b))
        first, last = first[good], last[good]
        if not len(first):
            continue
        new = np.concatenate(([True], (of[first][1:] != of[first][:-1]) | (p[first][1:] > p[last][:-1])))
        end = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
        first, last = first[new], last[end]
        rows.append(np.stack([own[of[first]], p[first], p[last] + 1, q[first], q[last] + 1], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)


def _verifier(shortest: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy() for n in ("a", "b", "from_a", "from_b", "low_shift", "high_shift")}
            sa, sb = batch.column("sa"), batch.column("sb")
            total, start = 0, 0
            for r in range(batch.num_rows):
                total += len(sa[r].as_buffer()) // 2
                if total < 1 << 20 and r < batch.num_rows - 1:
                    continue
                part = slice(start, r + 1)
                a, b = ([np.frombuffer(x[y].as_buffer(), np.uint16) for y in range(start, r + 1)] for x in (sa, sb))
                moved = c["from_a"][part].astype(np.int64) - c["from_b"][part]
                low, high = (c[n][part].astype(np.int64) - moved + d for n, d in (("low_shift", -_SLACK), ("high_shift", _SLACK)))
                row, x, y, u, v = matching_stretches(a, b, low, high, shortest, similarity).T
                from_a, from_b = c["from_a"][part][row], c["from_b"][part][row]
                told = [c["a"][part][row], c["b"][part][row], *((s + f).astype(np.int32) for s, f in ((x, from_a), (y, from_a), (u, from_b), (v, from_b)))]
                yield pa.RecordBatch.from_arrays([pa.array(t) for t in told], ["a", "b", "start", "end", "other_start", "other_end"])
                total, start = 0, r + 1

    return verify


def verified(found: DataFrame, sequences: DataFrame, shortest: int, similarity: float) -> DataFrame:
    """``(a, b, start, end, other_start, other_end)`` in shingles. Of both texts only the part around the
    candidate's windows is compared; what lies further off has windows of its own."""
    around = 2 * shortest
    left, right = (sequences.select(F.col("nid").alias(n), F.col("sequence").alias(f"all_{n}")) for n in "ab")

    def cut(text: str, begin: Column, end: Column) -> list[Column]:
        begin = F.greatest(begin, F.lit(0))
        return [begin.cast("int").alias(f"from_{text}"), F.substring(f"all_{text}", 2 * begin + 1, 2 * (end - begin)).alias(f"s{text}")]

    keep = ["a", "b", "low_shift", "high_shift", "low", "high"]
    half = found.join(left, "a").select(*keep, *cut("a", F.col("low") - around, F.col("high") + around + 1))
    both = half.join(right, "b").select(
        *keep[:4], "from_a", "sa", *cut("b", F.col("low") - around - F.col("high_shift") - _SLACK, F.col("high") + around + 1 - F.col("low_shift") + _SLACK)
    )
    return both.mapInArrow(_verifier(shortest, similarity), "a long, b long, start int, end int, other_start int, other_end int")


_CELL = 256
#: Windows of a key that are held against each other without further ado.
_FEW = 32


def with_state(windows: DataFrame, passages: DataFrame) -> DataFrame:
    """``windows`` with ``open``: the place lies in no passage of the text. One that is settled already
    stays so."""
    spans = passages.select(F.col("a").alias("nid"), "start", "end").union(passages.select("b", "other_start", "other_end"))
    cells = spans.select("nid", "start", "end", F.explode(F.expr(f"sequence(start div {_CELL}, (end - 1) div {_CELL})")).alias("cell"))
    cells = cells.groupBy("nid", "cell", "start").agg(F.max("end").alias("end"))  # a leader has very many partners, but few places
    cells = cells.groupBy("nid", "cell").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # fewer than a cell and a window have places
    told = windows.withColumn("cell", F.expr(f"cast(shiftright(place, 32) div {_CELL} as bigint)")).join(cells, ["nid", "cell"], "left")
    inside = F.exists("spans", lambda s: (_c("place") >= s["start"]) & (_c("place") < s["end"]))
    before = F.col("open") if "open" in windows.columns else F.lit(True)
    return told.withColumn("open", before & ~F.coalesce(inside, F.lit(False))).drop("cell", "spans")


#: Places of a grid around a window's place; what keys of a group read from there on: a block of shingles and one
#: further off, or most of a stretch.
_GRID, _BLOCK, _SPAN, _STRETCH = 5, 17, 36, 40


def narrow_keys(around: list[np.ndarray], c: np.ndarray, shortest: int, close: bool, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and variant: hashes of some shingles at the places of a grid around place c of each row,
    and hashes of all shingles from the first to the last of them. A stretch of ``shortest`` (46) places
    with the required similarity has room for one word that is another, put in or left out, which changes four or five
    shingles. Wherever it is, the stretch has a block and a further shingle at one of these places which it
    leaves as they are, on one side or the other. Close keys read all shingles but those of two
    neighbouring steps of the grid, and some two have all that it changes.

    A key reads two parts, with a gap for the change. A word put in or left out moves the part that does not have c by one
    place: so open windows (all, by default) read that part one place before and one further, too, under the same name;
    others need not, as no two of them are held against each other. With c in the gap it may be either part."""
    span = _STRETCH if close else _SPAN
    if close:
        reads = [(range(gap), range(gap + 2 * _GRID, span)) for gap in range(0, span - _GRID, _GRID)]
    else:
        reads = [(range(_BLOCK), range(span - 1, span)), (range(1), range(span - _BLOCK, span))]
    sizes = np.array([len(x) for x in around], np.int64)
    s = np.concatenate([*around, np.zeros(0, np.uint16)]).astype(_U)
    offsets = np.arange(-((shortest - 1) // _GRID) * _GRID, shortest - span + 1, _GRID)
    x = c.astype(np.int64)[:, None] + offsets
    row, column = np.nonzero((x >= 0) & (x + span <= sizes[:, None]))
    begin = (np.cumsum(sizes) - sizes)[row]
    moves = np.ones(len(row), bool) if open_ is None else open_[row]
    before, further = moves & (x[row, column] > 0), moves & (x[row, column] + span < sizes[row])
    o, at_c, x = (offsets[column] + 1000).astype(_U), -offsets[column], x[row, column] + begin
    factor, rows, keys, variants = _U(0x9E3779B97F4A7C15), [], [], []

    def hashed(h: np.ndarray, places: range, at: np.ndarray) -> np.ndarray:
        for step in places:
            h = h * factor + s[at + step]
        return h

    whole = mix(hashed(mix(o << _U(8)), range(span), x))
    for side, (first, second) in enumerate(reads, 1):
        low, high = len(first), second.start  # c is in the first part or before it, or in the second or after it
        left, right = (at_c >= low) & (len(first) > 0), (at_c < high) & (len(second) > 0)
        for moved_first, moved_second, some in ((0, 0, np.ones(len(x), bool)), (1, 0, left & moves), (-1, 0, left & before), (0, 1, right & further), (0, -1, right & moves)):
            at = np.flatnonzero(some)
            h = hashed(hashed(mix(o[at] << _U(8) | _U(side)), first, x[at] + moved_first), second, x[at] + moved_second)
            rows.append(row[at])
            keys.append(mix(h))
            variants.append(whole[at])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(variants)


def _narrower(shortest: int, close: bool, words: Broadcast | None):
    """Narrow keys of the windows of a batch: with ``words``, the bits of a filter, only those that it may have."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at, around = batch.column("key").to_numpy().view(np.uint64), batch.column("at").to_numpy(), batch.column("around")
            open_ = batch.column("open").to_numpy(zero_copy_only=False)
            rows, keys, variants = narrow_keys([np.frombuffer(around[r].as_buffer(), np.uint16) for r in range(batch.num_rows)], at, shortest, close, open_)
            keys = mix(keys ^ key[rows]) & ~_U(0xFF) | key[rows] & _U(0xFF)
            if words is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("nid").take(pa.array(rows)), batch.column("open").take(pa.array(rows))], ["key", "nid", "open"])
                continue
            some = Bloom(words.value).has(keys)
            rows, told = pa.array(rows[some]), [pa.array(x[some].view(np.int64)) for x in (keys, variants)]
            yield pa.RecordBatch.from_arrays([batch.column("nid").take(rows), *told, batch.column("place").take(rows), batch.column("open").take(rows)], ["nid", "key", "variant", "place", "open"])

    return narrow


def narrowed(windows: DataFrame, sequences: DataFrame, shortest: int, close: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The same windows ``(nid, key, place, open)`` under narrower keys, several for each; and the stored
    tables that this reads. Of settled windows that are equal over the whole span of a key one is kept. Most keys
    are one text's: the keys alone are counted first, and windows are told under those only that a filter of the others may have."""
    begin = F.greatest(_c("place") - shortest, F.lit(0))
    own = windows.join(sequences, "nid").select(
        "nid", "key", "place", "open", (_c("place") - begin).alias("at"), F.substring("sequence", 2 * begin + 1, F.lit(4 * shortest + 2)).alias("around")
    )
    own = stored(own, "around")
    told = own.mapInArrow(_narrower(shortest, close, None), "key long, nid long, open boolean")
    told = told.groupBy("key").agg(F.min("nid").alias("least"), F.max("nid").alias("most"), F.bool_or("open").alias("some"))
    told = stored(told.where("some and least <> most").select("key"), "shared-keys")
    words = windows.sparkSession.sparkContext.broadcast(Bloom.sized(told, F.col("key")).words)
    rows = stored(own.mapInArrow(_narrower(shortest, close, words), "nid long, key long, variant long, place long, open boolean"), "narrowed")
    forget(own)
    shared = rows.join(told, "key", "left_semi")
    settled = shared.where("not open").groupBy("key", "variant").agg(F.min("nid").alias("nid"), F.min_by("place", "nid").alias("place"), F.lit(False).alias("open"))
    return shared.where("open").select("nid", "key", "place", "open").unionByName(settled.select("nid", "key", "place", "open")), [told, rows]


def distinct_groups(windows: DataFrame) -> DataFrame:
    """``windows(nid, key, place, open)`` without keys whose windows are just those of another key of the same function:
    neighbouring keys of a long stretch, which would make the same pairs again. Groups are told apart by their size and the sums of two hashes."""
    sums = [F.try_sum(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "nid", "place", "open"), 24)) for seed in (1, 2)]
    own = windows.groupBy("key").agg(F.count("*").alias("n"), *(F.coalesce(x, F.col("key")).alias(f"s{i}") for i, x in enumerate(sums)))
    kept = own.groupBy(F.col("key").bitwiseAND(255).alias("f"), "n", "s0", "s1").agg(F.min("key").alias("key"))
    return windows.join(kept.select("key"), "key", "left_semi")


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, k: int = 4, enough: int = 2) -> DataFrame:
    """Passages of ``docs(doc_id, text)`` that come again in another document: ``(doc_id, other_id,
    word_start, word_end, other_start, copies)``.

    A passage has ``min_words`` words or more, and its five-word shingles have a Jaccard similarity of
    ``similarity`` at least with the other's, in order; a few words may be left out or put in. Each
    text is told against the texts that led the groups it was found in; ``other_id`` is the smallest
    doc_id of the leader's rows. Leaders have rows of their own, against one text for each place.
    Texts that are equal throughout are one text, and each of their rows is told, with ``copies`` the
    number of rows with this text; if such a text has the length, its rows also have the row of the
    whole text (other_id then is the smallest doc_id of its own text). Null, empty and short texts
    have none; a null doc_id is kept; repeated rows count as copies; other columns are ignored; an
    empty table gives an empty result.
    """
    shortest = min_words - _WORDS + 1
    texts, windows = scan_texts(docs, k, shortest)
    pairs, windows, met = star_pairs(windows)
    needed = windows.select("nid").union(pairs.select("b")).distinct()
    sequences = stored(texts.where("sequence is not null").select("nid", "sequence").dropDuplicates(["nid"]).join(needed, "nid", "left_semi"), "sequences")
    counted, found = [], []

    def verify(pairs: DataFrame) -> DataFrame:
        few = counted[-1].where(F.bit_count("f") < enough) if counted else None
        counted.append(stored(votes(pairs, few, shortest), "votes"))
        forget(*counted[:-1])
        del counted[:-1]
        found.append(stored(verified(counted[-1].where(F.bit_count("f") >= enough), sequences, shortest, similarity), "passages"))
        return found[-1]

    flagged = stored(with_state(windows, verify(pairs)), "windows")
    sizes = flagged.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("open").alias("some")).where("some and size > 1")
    groups = stored(flagged.join(sizes.select("key", "size"), "key"), "groups")
    forget(met, flagged)
    large = F.col("size") > _FEW if shortest >= 46 and similarity >= 0.8 else F.lit(False)  # what narrow keys are made for
    more = open_pairs(groups.where(~large).drop("size"))
    narrow, raw = narrowed(groups.where(large), sequences, shortest, False)
    narrow, close_raw = narrowed(narrow.withColumn("key", F.expr("key & 255L")).distinct(), sequences, shortest, True)
    close = stored(narrow.distinct(), "close-groups")
    forget(*raw, *close_raw)
    windows = stored(distinct_groups(close), "distinct-groups")
    forget(close)
    for leaders_each in chain((1,), accumulate(repeat(4), mul, initial=1)):  # 1, 1, 4, 16 ...
        pairs, rest, led = leader_pairs(windows, leaders_each)
        pairs = stored(pairs if more is None else pairs.unionByName(more), "window-pairs")
        if pairs.isEmpty():
            break
        before, windows = windows, stored(with_state(rest, verify(pairs)), "windows")
        forget(before, led, pairs)
        more = None
    forget(sequences, groups)

    found = reduce(DataFrame.union, found)
    both = found.select("a", "b", "start", "end", "other_start").union(found.select("b", "a", "other_start", "other_end", "start"))
    # a leader meets very many texts: it is told against the smallest for each place of its own
    both = both.groupBy("a", "start", "end").agg(F.min("b").alias("b"), F.min_by("other_start", "b").alias("other_start"))
    named = texts.groupBy("nid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"))
    told = both.join(named.select(F.col("nid").alias("b"), F.col("first_id").alias("other_id")), "b")
    told = told.select(F.col("a").alias("nid"), "other_id", F.col("start").alias("word_start"), (F.col("end") + _WORDS - 1).alias("word_end"), "other_start")
    whole = named.where("copies > 1").select("nid", F.col("first_id").alias("other_id"), F.lit(0).alias("word_start"), F.col("n").alias("word_end"), F.lit(0).alias("other_start"))
    told = told.unionByName(whole).join(named.select("nid", "copies"), "nid")
    return texts.select("doc_id", "nid").join(told, "nid").select("doc_id", "other_id", "word_start", "word_end", "other_start", "copies")
