"""Source divergence (op11), sharding (op12) and vector codes (op13) against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docmill.llm import codes, divergence, sharding

DOCS = "doc_id long, text string, lang string, source string, rank string, shard string"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame([(*r, *["x"] * 2)[: len(schema.split(","))] for r in rows], schema).repartition(parts)


# ---------------------------------------------------------------- op11


def audit(rows, min_docs, first):
    """The contract, word by word."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    count, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(lower) for t in term.findall(text or "")]
        count.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (l, t), n in docs.items() if l == lang and n >= min_docs]
        sources = [s for l, s in groups if l == lang]
        v = len(kept)

        def share(n, of):
            total = sum(n(t) for t in of)
            return {t: 1 + 10**9 * (n(t) + 5) // (total + 5 * v) for t in of}

        p = {s: share(lambda t: count[lang, s, t], kept) for s in sources}
        q = share(lambda t: sum(count[lang, s, t] for s in sources), kept)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s, t] and p[s][t] > q[t])[:first]
            out |= {(lang, s, part, x.decode(), -f, r + 1) for part, some in (("pair", pairs), ("term", terms)) for r, (f, x) in enumerate(some)}
    return out


def texts(n, seed):
    rng = random.Random(seed)
    words = ["The", "the", "Été", "été", "naïve", "z", "zz", "co-op", "data2base", "東京", "東", "\x00a", "a\tb", "[x]", "{y}", "😀", "DON'T", "_u_"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "é", "", None])) for i in range(n)]
    return rows + [(None, None, "xx", "only"), (None, "", "yy", "p"), (5, None, "yy", "q"), rows[0], rows[0], (9, "the " * 5000, "en", "a")]


@pytest.mark.parametrize("parts", [1, 5])
def test_divergence_against_the_plain_version(spark, parts):
    rows = texts(150, 1)
    got = divergence.source_divergence(frame(spark, rows, parts=parts), min_docs=4, first=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    told = [tuple(r) for r in got.collect()]
    assert len(told) == len(set(told))
    assert set(told) == audit(rows, 4, 3)


def test_divergence_with_small_tries_and_parts_of_long_texts(spark, monkeypatch):
    rows = texts(60, 2) + [(99, " ".join(f"w{i % 9}x" + "y" * (i % 300) for i in range(4000)), "en", "a")]
    table = pa.record_batch([pa.array([r[2] or "" for r in rows]), pa.array([r[3] or "" for r in rows]), pa.array([(r[1] or "").encode() for r in rows], pa.binary())], ["lang", "source", "text"])
    whole = divergence.RadixTrie.merged([t.leaves for t in divergence._tries(iter([table]))])
    monkeypatch.setattr(divergence, "_TOGETHER", 500)
    monkeypatch.setattr(divergence, "_HELD", 40)
    small = list(divergence._tries(iter(table.slice(i, 7) for i in range(0, len(rows), 7))))
    assert len(small) > 3
    splitters = [b"", b"de\0z", b"en\0d", b"en\0w1x" + b"y" * 260, b"zz"]
    pieces = [(n, divergence.RadixTrie.leaves_of(p.to_bytes())) for t in small for n, p in t.pieces(splitters)]
    assert all(sum(s <= k for s in splitters) == n for n, p in pieces for k in p.column("key").to_pylist())
    order = [("key", "ascending"), ("source", "ascending")]
    assert divergence.RadixTrie.merged([p for _, p in pieces]).leaves.sort_by(order).equals(whole.leaves.sort_by(order))
    # ranges that are told in several pieces are the same in the end
    blobs = pa.record_batch([pa.array([n for n, _ in pieces], pa.int32()), pa.array([divergence.RadixTrie(p).to_bytes() for _, p in pieces], pa.binary())], ["range", "trie"])
    blobs = blobs.take(pa.array(np.argsort(blobs.column(0).to_numpy(), kind="stable")))
    told = defaultdict(lambda: [0, 0])
    for batch in divergence._merger(1)(iter([blobs])):
        for lang, term, source, n, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            told[f"{lang}\0{term}".encode(), source][0] += n
            told[f"{lang}\0{term}".encode(), source][1] += docs
    assert told == {(k, s): [n, d] for k, s, n, d in zip(*(whole.leaves.column(c).to_pylist() for c in ("key", "source", "n", "docs")), strict=True)}


def test_shares_are_exact():
    rng = random.Random(3)
    for total in (1, 10**6, 10**12, 1 << 54, 1 << 60):
        counts = np.array([0, total, *(rng.randrange(total) for _ in range(50))], np.int64)
        want = [1 + 10**9 * (int(c) + 5) // (total + 5 * 7) for c in counts]
        assert divergence.shares(counts, np.array([total]), 7).tolist() == want


def test_divergence_of_no_rows(spark):
    assert divergence.source_divergence(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- op12


def sharded(spark, rows, **more):
    got = sharding.shard_documents(frame(spark, rows), **more)
    assert {"doc_id", "text", "rank", "size", "text_crc32", "shard", "slot"} <= set(got.columns) and got.columns.count("shard") == 1
    got = got.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots, size, of = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r["rank"]) == (len(data) + 1, zlib.crc32(data), "x")
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        of[r.text].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size, of


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(1, 400), "en", "s") for i in range(3000)]
    rows += [(i, "a copy " * 20, "en", "s") for i in range(300)] + [(None, None, None, None)] * 40 + [(7, "", "en", "s")] * 30
    size, of = sharded(spark, rows)
    assert set(size) == set(range(8)) and max(size.values()) < 1.01 * min(size.values())
    assert all(len(x) == 1 for x in of.values())
    assert of[None] | of[""] <= set(range(8))


@pytest.mark.parametrize("ids", [range(6000), [3] * 6000, [None] * 6000])
def test_groups_over_half_a_shard_are_split(spark, ids):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(100), "en", "s") for i in range(3000)] + [(i, "the same text of very many rows " * 3, "en", "s") for i in ids]
    size, of = sharded(spark, rows)
    assert max(size.values()) < 1.05 * min(size.values())
    assert len(of["the same text of very many rows " * 3]) > 3


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i, f"text {i % 700} " * (i % 13), "en", "s") for i in range(2000)]
    one, many = ({(r.doc_id, r.shard, r.slot) for r in sharding.shard_report(frame(spark, rows, parts=p)).collect()} for p in (1, 7))
    assert one == many


def test_shards_of_few_and_no_rows(spark, tmp_path):
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    size, _ = sharded(spark, [(1, "a" * 5000, "en", "s"), (2, None, None, None)], shards=3)
    assert sorted(size.values()) == [1, 5001]
    sharding.write_shards(frame(spark, [(i, "t" * i, "en", "s") for i in range(50)]), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def test_report_has_the_columns_of_its_law(spark):
    got = sharding.shard_report(frame(spark, [(1, "a", "en", "s")]))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    assert got.collect()[0].law == "bytes"


def test_overfull_ranges_are_cut():
    import pandas as pd

    splitters = np.array([0, 1000])
    more = sharding.subdivided(splitters, pd.DataFrame({"range": [1], "bytes": [100]}), np.array([5, np.iinfo(np.int64).max]), 25.0)
    assert {0, 5, 6, 1000, np.iinfo(np.int64).max} <= set(more.tolist()) and len(more) == 5 + 4
    keys = np.random.default_rng(0).integers(0, 10**6, 10000)
    cut = sharding.quantile_splitters(keys, np.ones(10000), 10)
    assert np.abs(np.bincount(np.searchsorted(cut, keys, "right")) - 1000).max() < 20


# ---------------------------------------------------------------- op13


def lloyd(rows, parts, entries, rounds):
    kept = [(i, label, [int(np.floor(c * 1024)) for c in v]) for i, label, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for c in cut:
                of[best(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(of[n]) for col in zip(*of[n], strict=True)] if n in of else e for n, e in enumerate(books[p])]
    told = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        found = [best(c[p], books[p]) for p in range(parts)]
        told.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return told, books


VECTORS = "vec_id long, embedding array<double>, label int, code string"


def vectors(n, seed, dims=8, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) if grid is None else rng.integers(0, grid, (n, dims)) / 1024
    return [(int(i), int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize(("rows", "entries", "parts"), [(vectors(300, 1), 16, 4), (vectors(200, 2, grid=3), 9, 2), (vectors(5, 3), 256, 4), (vectors(120, 4, grid=2) * 2, 256, 4)])
def test_codes_against_plain_lloyd(spark, rows, entries, parts):
    """On a small grid very many distances are equal, and entries too."""
    rows = [*rows, (1000, None, None), (1001, 1, [float("nan")] * 8), (1002, None, [0.1] * 8), (1003, 2, [None] * 8), (1004, 0, [float("inf")] + [0.0] * 7)]
    want, books = lloyd(rows, parts, entries, 4)
    for n in (1, 4):
        table = frame(spark, [(i, v, label) for i, label, v in rows], VECTORS, n)
        told, got = codes.product_codes(table, parts=parts, entries=entries)
        assert got.tolist() == books
        assert Counter(map(tuple, told.collect())) == Counter(want)


def test_code_report_sums_labels_and_tells_the_codebooks(spark):
    rows = [*vectors(40, 7), (99, None, [0.5] * 8), (98, None, [-0.5] * 8)]
    want, books = lloyd(rows, 4, 256, 4)
    table = frame(spark, [(i, v, label) for i, label, v in rows], VECTORS)
    got = codes.code_report(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert Counter(map(tuple, got.collect())) == Counter((i, code, error, sums[label], digest) for i, label, code, error in want)


def test_codes_of_odd_tables(spark):
    assert codes.code_report(frame(spark, [], VECTORS)).count() == 0
    rows = [(2, [0.25] * 5, 1), (1, [0.5] * 5, 1), (3, [0.5] * 4, 1), (4, [2.0e5] * 5, 1), (None, [0.5] * 5, None)]
    told, books = codes.product_codes(frame(spark, rows, VECTORS))
    assert books.shape == (4, 3, 2) and books[3, 0].tolist() == [0, 0]  # five components are padded to eight
    assert {(r.vec_id, r.code, r.error) for r in told.collect()} == {(1, "00000000", 0), (2, "01010100", 0), (None, "00000000", 0)}
    wide = [(i, [131072.0 * s, -131072.0 * s, 1.0, i / 7], 0) for i, s in enumerate([1, -1, 0.5, 0.999, 1])]
    want, books = lloyd([(i, 0, v) for i, v, _ in wide], 4, 2, 4)
    told, got = codes.product_codes(frame(spark, wide, VECTORS), entries=2)
    assert got.tolist() == books and Counter((r.vec_id, r.code, r.error) for r in told.collect()) == Counter((i, c, e) for i, _, c, e in want)


def test_bounds_spare_full_scans_and_keep_ties():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-9, 9, (2000, 4)), rng.integers(-9, 9, (2000, 4)) + 500])
    before = np.array([[0, 0, 0, 0], [500] * 4, [502] * 4, [0, 0, 0, 2]])
    code, upper, lower = codes.nearest(x, codes.Codebook.of(before))
    after = before + np.array([[0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]])
    book = codes.Codebook.of(after, before)
    new, up, low, scans = codes.reassign(x, book, code, upper, lower)
    want, _, _ = codes.nearest(x, book)
    assert (new == want).all() and 0 < scans < 4000
    real = np.sqrt(((x[:, None] - after) ** 2).sum(2))
    assert (up >= real[np.arange(4000), new]).all()
    real[np.arange(4000), new] = np.inf
    assert (low <= real.min(1)).all()
