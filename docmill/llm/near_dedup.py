"""MinHash near-dedup with DartMinHash signatures.

Elements are the distinct five-word shingles of a text, each of weight 1, as links are set Jaccard: a
signature that counted occurrences would miss equal sets repeated differently. Darts are thrown
into the region of each element (its weight by a rank axis) as a Poisson process that is a fixed
function of the element, so that two texts share the darts of their common region. Each dart names
one of ``k`` coordinates; a coordinate keeps its earliest dart. Only darts below a rank that is
expected to fill all coordinates are made: about ``k (ln k + 2)`` whatever the length of the text.

Bands of the signature give candidates. In each band bucket every text is first held against one
text of the bucket, the most central one and then others by hash (stars, not all pairs); texts that
end in one class are not compared again. Buckets that still hold more than one class are compared
across classes, but only texts of which enough shingles occur in another class: the others can have
no link to one, which clears groups around a shared passage and copies changed too much, without
their pairs. Links
are verified on whole shingle sets (Jaccard 0.8 or more), and classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.components import connected_components
from docmill.llm.store import Bloom, split_by_filter, stored, unused
from docmill.llm.text import Words, mix, shingles, slices

_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    """A hash as a number in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def distinct_by_text(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each text (at most 65,536 texts) and their texts. An element keeps its
    upper 48 bits."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=_U), np.diff(offsets))
    own = np.unique((owner << _U(48)) | (elements >> _U(16)))
    return own & _U(0xFFFFFFFFFFFF), (own >> _U(48)).astype(np.int64)


def _throw(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts in the regions of elements below their limits: element's place, rank, id."""
    places, ranks, ids = [], [], []
    for strip in range(int(np.ceil(weights.max(initial=0.0)))):
        place = np.flatnonzero(weights > strip)
        salt = _U(0x9E3779B97F4A7C15 * (strip + 1) & 0xFFFFFFFFFFFFFFFF)
        state, room, limit = mix(elements[place] + salt), weights[place] - strip, limits[place]
        rank = -np.log(_uniform(state))
        while True:
            near = np.flatnonzero(rank < limit)
            if not len(near):
                break
            place, state, rank, room, limit = place[near], state[near], rank[near], room[near], limit[near]
            inside = slice(None) if room.min() >= 1 else _uniform(mix(state ^ _U(0xA5A5A5A5A5A5A5A5))) <= room
            places.append(place[inside])
            ranks.append(rank[inside])
            ids.append(state[inside])
            state = mix(state + _U(0xD1B54A32D192ED03))
            rank = rank - np.log(_uniform(state))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, _U)
    return np.concatenate(places), np.concatenate(ranks), np.concatenate(ids)


def dart_signatures(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, texts: int, k: int) -> np.ndarray:
    """``texts x k`` ids: for each coordinate the earliest dart in the regions of a text's elements.
    Rows of texts without elements are 0."""
    total = np.bincount(owner, weights, texts)
    out, open_ = np.zeros((texts, k), _U), total > 0
    limit = np.where(open_, k * (np.log(k) + 2.0) / np.maximum(total, 1e-9), 0.0)
    while open_.any():
        at = np.flatnonzero(open_[owner])
        place, rank, dart = _throw(elements[at], weights[at], limit[owner[at]])
        cell = owner[at][place] * k + (mix(dart ^ _U(0x5851F42D4C957F2D)) % _U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")  # the earliest is written last, and stays
        first = np.full(texts * k, -1, np.int64)
        first[cell[order]] = order
        first = first.reshape(texts, k)
        full = open_ & (first >= 0).all(axis=1)
        out[full] = dart[first[full]]
        open_ &= ~full
        limit = limit * 2.0
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("nid", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])


def _signer(k: int, rows: int, words_each: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, k // rows + 1, dtype=_U))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in slices(texts):
                sh, off = shingles(Words(texts[i:j]), words_each)
                own, owner = distinct_by_text(sh, off)
                sig = dart_signatures(own, owner, np.ones(len(own)), j - i, k).reshape(j - i, -1, rows)
                value = np.tile(seeds, (j - i, 1))
                for r in range(rows):
                    value = mix(value * _U(0x9E3779B97F4A7C15) + sig[:, :, r])
                sizes = np.bincount(owner, minlength=j - i)
                some = np.concatenate(([0], np.cumsum((sizes > 0) * value.shape[1])))
                bands = pa.ListArray.from_arrays(pa.array(some, pa.int32()), pa.array(value[sizes > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(sizes, pa.int32()), bands], schema=_SIGNED)

    return sign


def signatures(docs: DataFrame, k: int = 96, rows: int = 4, words_each: int = 5) -> DataFrame:
    """``(doc_id, nid, n, bands)`` of each row with a text: content id, number of distinct shingles,
    one hash for each band of ``rows`` coordinates (none for a text without words)."""
    return (
        docs.where("text is not null")
        .select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("nid"), "text")
        .mapInArrow(_signer(k, rows, words_each), "doc_id long, nid long, n int, bands array<bigint>")
    )


def shingle_sets(docs: DataFrame, nodes: DataFrame, words_each: int = 5) -> DataFrame:
    """``(nid, shingles array<long>)`` of the texts whose content id is in ``nodes(nid)``."""
    wanted = docs.sparkSession.sparkContext.broadcast(Bloom.sized(nodes, F.col("nid")).words)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(wanted.value)
        for batch in batches:
            nids = batch.column(0).to_numpy()
            at = np.flatnonzero(bloom.has(nids.view(_U)))
            at = at[np.sort(np.unique(nids[at], return_index=True)[1])]
            some = batch.column(1).take(pa.array(at)).to_pylist()
            for i, j in slices(some):
                sh, off = shingles(Words(some[i:j]), words_each)
                sets = [np.unique(sh[off[a] : off[a + 1]].view(np.int64)) for a in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(nids[at[i:j]], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["nid", "shingles"])

    found = docs.where("text is not null").select(F.xxhash64("text").alias("nid"), "text").mapInArrow(collect, "nid long, shingles array<bigint>")
    return found.dropDuplicates(["nid"]).join(nodes, "nid", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs(a, b)`` those whose sets have a Jaccard similarity of the threshold at least."""
    left = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    # whole numbers on both sides: 0.8 exactly is a link
    scaled = round(threshold * 1000)
    return (
        pairs.join(left, "a").join(right, "b").where(both * 1000 >= (F.size("sa") + F.size("sb") - both) * scaled).select("a", "b")
    )


def _open_nodes(mixed: DataFrame, sets: DataFrame, threshold: float, rounds: int = 3) -> DataFrame:
    """Of ``mixed(band, nid, n, root)`` the texts that may have a link to another class, and m. With m of n
    shingles found in other classes, and partners of p shingles at least, no similarity is over
    m / (n + max(p, m) - m). Texts under the threshold go, and the others are looked at again."""
    scaled = round(threshold * 1000)
    smallest = mixed.groupBy("band").agg(F.min("n").alias("low"))
    partner = F.greatest("low", F.ceil(F.col("n") * threshold))
    nodes = mixed.join(smallest, "band").groupBy("nid", "root", "n").agg(F.min(partner).alias("p"))
    for _ in range(rounds):
        each = sets.join(nodes.select("nid", "root", "n", "p"), "nid").select("nid", "root", "n", "p", F.explode("shingles").alias("shingle"))
        spread = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        found = each.join(spread.select("shingle"), "shingle", "left_semi").groupBy("nid", "root", "n", "p").agg(F.count("*").alias("m"))
        nodes = stored(found.where(F.col("m") * 1000 >= F.expr("n + greatest(p, m) - m") * scaled), "open")
    return nodes


def _centrality(sets: DataFrame) -> DataFrame:
    """``(nid, central)``: in how many texts a shingle of the text occurs, on average."""
    each = sets.select("nid", F.explode("shingles").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.count("*").alias("texts"))
    return each.join(spread, "shingle").groupBy("nid").agg(F.avg("texts").alias("central"))


def _classified(docs: DataFrame, threshold: float, k: int, rows: int, words_each: int, stars: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, nid, ...)`` with a text, and ``(nid, first_id, copies, root)`` of each text."""
    signed = stored(signatures(docs, k, rows, words_each), "signatures")
    texts = signed.groupBy("nid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    banded = signed.select("nid", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("nid").alias("least"), F.max("nid").alias("most")).where("least <> most").select("band")
    members = stored(banded.join(shared, "band", "left_semi").distinct(), "buckets")
    sets = stored(shingle_sets(docs, members.select("nid").distinct(), words_each), "sets")
    scaled = round(threshold * 1000)

    def sized(x: str, y: str):
        """No pair whose sizes alone keep it under the threshold can be a link."""
        return F.least(x, y) * 1000 >= F.greatest(x, y) * scaled

    def mixed(roots: DataFrame | None) -> DataFrame:
        """The buckets that hold more than one class."""
        if roots is None:
            return stored(members.join(_centrality(sets), "nid").withColumn("root", F.col("nid")), "members")
        told = members.join(roots, members["nid"] == roots["node"], "left").select("band", "nid", "n", F.coalesce("root", "nid").alias("root"))
        several = told.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        return stored(told.join(several, "band", "left_semi"), "mixed-buckets")

    links, roots = None, None
    for turn in range(stars):
        rest = mixed(roots)
        # the text that shares most with others leads first: copies are close to their original
        rank = F.xxhash64("nid", "band", F.lit(turn)) if turn else -F.col("central")
        leaders = rest.groupBy("band").agg(F.min(F.struct(rank, "nid", "n", "root")).alias("low"))
        leaders = leaders.select("band", F.col("low.nid").alias("a"), F.col("low.n").alias("na"), F.col("low.root").alias("ra"))
        star = rest.join(leaders, "band").where("root <> ra").where(sized("n", "na")).select("a", F.col("nid").alias("b")).distinct()
        new = stored(_verified(star, sets, threshold), "star-links")
        links = new if links is None else links.union(new)
        if turn and new.isEmpty():
            break
        roots = connected_components(links)

    rest = mixed(roots)
    open_ = _open_nodes(rest, sets, threshold)
    bands = signed.join(open_.select("nid"), "nid", "left_semi").select("nid", "bands").dropDuplicates(["nid"])
    cells = rest.join(open_.select("nid", "m").join(bands, "nid"), "nid")
    right = cells.select(*[F.col(c).alias(f"{c}_b") for c in ("band", "nid", "n", "root", "m", "bands")])
    # two texts have no more in common than either has in common with other classes
    enough = F.least("m", "m_b") * (1000 + scaled) >= (F.col("n") + F.col("n_b")) * scaled
    first = F.array_intersect("bands", "bands_b")[0] == F.col("band")  # a pair counts in the first band that it shares
    cross = cells.join(right, (F.col("band") == F.col("band_b")) & (F.col("root") < F.col("root_b")) & sized("n", "n_b") & enough & first)
    more = stored(_verified(cross.select(F.col("nid").alias("a"), F.col("nid_b").alias("b")), sets, threshold), "cross-links")
    if not more.isEmpty():
        roots = connected_components(links.union(more))

    classes = texts.join(roots, texts["nid"] == roots["node"], "left").select("nid", "first_id", "copies", F.coalesce("root", "nid").alias("root"))
    return signed, classes


def near_duplicate_classes(
    docs: DataFrame, threshold: float = 0.8, k: int = 96, rows: int = 4, words_each: int = 5, stars: int = 3
) -> DataFrame:
    """``(doc_id, class_id, copies)`` for each row of ``docs(doc_id, text)``.

    class_id is the smallest doc_id of the class, copies the number of rows with exactly this text.
    Equal texts are one class whatever they hold (two empty ones too); a null text is a class of its
    own, with its own doc_id. Texts under five words have one shingle of all their words. Repeated
    rows keep a row each. Other columns are ignored. An empty table gives an empty result.
    """
    signed, classes = _classified(docs, threshold, k, rows, words_each, stars)
    lowest = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = classes.join(lowest, "root").select("nid", "class_id", "copies")
    told = signed.select("doc_id", "nid").join(classes, "nid").select("doc_id", "class_id", "copies")
    alone = docs.where("text is null").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return told.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 96, rows: int = 4, words_each: int = 5, stars: int = 3) -> DataFrame:
    """Of each near-duplicate class the row with the smallest doc_id; of several texts under that doc_id one.

    A row is its doc_id and its text: other texts under the same doc_id are judged for themselves, and
    a row that is there twice is kept once. A null doc_id is larger than all others. Rows with a null
    text stay as they are. Other columns may have any names; an empty table gives an empty result.
    Whole rows are shuffled only where a filter of the rows that go, or are repeated, may have them.
    """
    signed, classes = _classified(docs, threshold, k, rows, words_each, stars)
    order = F.struct(F.col("first_id").isNull(), "first_id", "nid")
    best = classes.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.first_id").alias("best_id"), F.col("best.nid").alias("best_nid"))
    told = signed.select("doc_id", "nid").join(classes.join(best, "root").select("nid", "best_id", "best_nid"), "nid")
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("nid") == F.col("best_nid"))
    told = told.groupBy("doc_id", "nid").agg(F.bool_and(stays).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")
    told = stored(told.select(F.xxhash64("doc_id", "nid").alias("key"), "doc_id", "nid", "stays"), "judged")
    row, nid, doc = (unused(docs, n) for n in ("row_key", "row_nid", "row_doc"))
    keyed = docs.where("text is not null").withColumns({nid: F.xxhash64("text"), doc: F.col("doc_id").cast("long")}).withColumn(row, F.xxhash64(doc, nid))
    maybe, clear = split_by_filter(keyed, F.col(row), told)
    told = told.select(*(F.col(c).alias(f"judged {c}") for c in ("key", "doc_id", "nid", "stays")))
    same = (F.col(row) == F.col("judged key")) & F.col(doc).eqNullSafe(F.col("judged doc_id")) & (F.col(nid) == F.col("judged nid"))
    judged = maybe.join(told, same, "left")
    once = judged.where("`judged stays`").dropDuplicates([doc, nid])
    kept = clear.select(*docs.columns).union(judged.where("`judged stays` is null").select(*docs.columns)).union(once.select(*docs.columns))
    return kept.union(docs.where("text is null"))
