"""Operators against their definitions, word by word."""

from __future__ import annotations

import heapq
import math
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from docmill.llm import language, mixing, passages, toxicity, urls
from docmill.llm.text import Words, shingles


def docs_of(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


# ---------------------------------------------------------------- op1


def _bundle(text, dims):
    """Each letter, rotated by its place in a trigram, bound by products and summed."""

    def vector(letter):
        return language.letter_vectors(np.array([ord(letter) if letter else 0], np.uint64), dims)[0].astype(int)

    letters = [ch.lower()[0] if unicodedata.category(ch)[0] in "LM" else "" for ch in text or ""]
    line = [""]
    for x in [*letters, ""]:
        if x or line[-1]:
            line.append(x)
    total = np.zeros(dims)
    for a, b, c in zip(line, line[1:], line[2:]):
        if b:
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def test_prototypes_and_cosines_by_definition(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdé ", "bb": "cdefğ-", "cc": "xyz1 "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(0, 60))), lang) for i, lang in enumerate(rng.choices(sorted(alphabets), k=60))]
    rows += [(100, None, "aa"), (101, "abc", None), (102, "123", "bb"), (103, "́̂ ̃", "cc"), (104, "", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    dims, want = 128, defaultdict(lambda: np.zeros(128))
    for _, text, lang in rows:
        if text is not None and lang is not None:
            want[lang] += _bundle(text, dims)
    names, vectors = language.prototypes(df, dims)
    assert names == sorted(want) and np.array_equal(vectors, np.array([want[n] for n in names]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(df, (names, vectors)).collect()}
    for i, text, _ in rows:
        own = _bundle(text, dims)
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            assert got[i] == ("und", 0.0)  # marks alone are no text
            continue
        cosines = [float(own @ want[n] / np.linalg.norm(own) / np.linalg.norm(want[n])) for n in names]
        assert abs(got[i][1] - max(0.0, max(cosines))) < 1e-5 and abs(cosines[names.index(got[i][0])] - max(cosines)) < 1e-5


# ---------------------------------------------------------------- op2

_PLAIN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", re.DOTALL | re.IGNORECASE)


def test_markup_is_cut_as_by_a_pattern():
    rng = random.Random(2)
    bits = ["<", ">", "<script", "<SCRIPT ", "</script>", "</Script  >", "</script", "<style>", "</style>", "<scripts>", "<!--", "-->", "<!-->", "&amp;", "&", "&nb", ";", "word", " ", "\n", "/", "<p>", "--"]
    for _ in range(20_000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert urls.without_markup(html) == _PLAIN.sub(" ", html), html


@pytest.mark.parametrize("piece", ["<script ", "<!--", "<", "<style>", "</script", "&a", "<script>x</script ", "<!-- >", "<script>a</script>"])
def test_a_page_of_open_tags_takes_linear_time(piece):
    html = piece * (1_000_000 // len(piece))
    began = time.process_time()
    urls.without_markup(html)
    assert time.process_time() - began < 2.0


def test_page_words_by_definition(spark):
    pages = [(1, "u", "<p>One two ONE</p><script>three</script>"), (2, "u", None), (3, "u", "four<br>five &amp; a1b_c <!-- six"), (3, "u", "four<br>five &amp; a1b_c <!-- six"), (4, "u", "")]
    got = {r.word: r.n for r in urls.page_words(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()}
    want = Counter()
    for _, _, html in pages:
        want.update(re.findall(r"[^\W\d_]+", _PLAIN.sub(" ", html or "").lower()))
    assert got == want and got["four"] == 2 and "three" not in got


# ---------------------------------------------------------------- op6


def _words(text):
    out, word = [], ""
    for ch in [*(text or ""), " "]:
        if ch.isalnum() or unicodedata.category(ch)[0] == "M":
            word += ch.lower()[0]
        elif word:
            out.append(word)
            word = ""
    return out


def _segments(scores):
    """Maximal segments by definition: of the stretches that no other stretch inside beats, the largest, then those left and right."""
    out = []

    def inside(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-9:
            return
        out.append((best[3], best[4], best[0]))
        inside(a, best[3])
        inside(best[4], b)

    inside(0, len(scores))
    return sorted(out)


def test_toxicity_by_definition(spark):
    rng = random.Random(3)
    clean, bad = [f"w{i}" for i in range(60)], [f"bad{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=rng.randint(1, 30))
        toxic = int(rng.random() < 0.15)
        for _ in range(rng.randint(2, 5) * toxic + (rng.random() < 0.05)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(5000, None), (5001, ""), (5002, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    options = {"prior": 100.0, "errors": 0.5, "least": 0.3, "drift": 0.1, "level": 0.01}
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)

    import zlib

    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    text, toxic = dict(rows), {i: t for i, _, t in labels}

    def weights(of):
        n = [Counter(), Counter()]
        for i in toxic:
            if fold[i] in of:
                n[toxic[i]].update(set(_words(text[i])))
        sums = [sum(x.values()) for x in n]
        vocabulary, buckets = n[0].keys() | n[1].keys(), len(model.weights)
        out = {}
        for w in vocabulary:
            alpha = 100.0 * (n[0][w] + n[1][w] + 0.01) / (sum(sums) + 0.01 * buckets)
            y = [x[w] + alpha for x in n]
            odds = [math.log(a / (s + 100.0 - a)) for a, s in zip(y, sums)]
            size = max(abs(odds[1] - odds[0]) - 0.5 * math.sqrt(1 / y[0] + 1 / y[1]), 0.0)
            out[w] = math.copysign(size, odds[1] - odds[0]) if size >= 0.3 else 0.0
        return out

    final, draft = weights({1, 2, 3, 4}), weights({1, 2, 3})
    for w, value in final.items():
        assert abs(float(model.weights[int(Words([w]).hashes[0]) & (len(model.weights) - 1)]) - value) < 1e-5, w

    def scored(words, of):
        return [float(np.float32(of.get(w, 0.0))) - 0.1 for w in words]

    null = [(max((s for *_, s in _segments(scored(_words(text[i]), draft))), default=0.0), len(_words(text[i]))) for i in toxic if fold[i] == 4 and not toxic[i]]
    bins = Counter(math.floor(s / 0.1) for s, _ in null)
    places = sorted(bins)
    rate, scale = toxicity.extreme_value_law([b * 0.1 for b in places], [bins[b] for b in places], sum(n for _, n in null))
    assert abs(model.rate - rate) < 0.05 and abs(math.log(model.scale / scale)) < 0.2  # a score on the edge of a bin may fall either way
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    for i, body in random.Random(4).sample(rows, 150) + rows[-3:]:
        words = _words(body)
        found = _segments(scored(words, final))
        best, log_e = math.inf, 0.0
        for r, s in enumerate(sorted((s for *_, s in found), reverse=True), 1):
            one = model.scale * len(words) * math.exp(-model.rate * s)
            if r > 1 and one > 0.02:
                break
            log_e += math.log(one) - math.log(r)
            best = min(best, math.exp(min(log_e + (r - 1) * math.log(2), 50)))
        want = 0.01 / (0.01 + best) if found else 0.0
        assert abs(got[i].score - want) < 1e-3 and got[i].predicted == int(got[i].score >= 0.5), (i, body)
    assert sum(got[i].predicted for i in toxic if toxic[i]) > 0.8 * sum(toxic.values())


# ---------------------------------------------------------------- op8


def test_told_spans_are_passages(spark):
    """Every told span is held against the other text: as many words, and the shingles of both alike."""
    rng = random.Random(5)

    def words(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    texts = []
    for _ in range(12):
        base = words(rng.randint(100, 140))  # two edits leave 50 words with one at least
        for _ in range(4):
            copy, at = list(base), rng.randrange(len(base))
            edit = rng.choice(["none", "change", "put in", "leave out"])
            if edit != "none":
                copy[at : at + (edit != "put in")] = [] if edit == "leave out" else words(1)
            texts.append([*words(rng.randint(0, 50)), *copy, *words(rng.randint(0, 50))])
    got = passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts])).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))

    def shingled(t):
        return set(shingles(Words([" ".join(t)]))[0].tolist())

    for r in got:
        own, other = texts[r.doc_id][r.word_start : r.word_end], texts[r.other_id]
        assert r.word_end - r.word_start >= 50 and len(own) == r.word_end - r.word_start
        a = shingled(own)
        alike = max(len(a & b) / len(a | b) for b in (shingled(other[r.other_start : r.other_start + len(own) + d]) for d in range(-3, 4)))
        assert alike >= 0.8, (r, alike)


# ---------------------------------------------------------------- op4


def earliest_deadline_first(sources: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(key, turn, slot) of (key, weight, blocks) with a heap over all sources."""
    sources, now, told = sorted(sources), 0, []
    total, ready = sum(w for _, w, _ in sources), []
    waiting = [(0, i, 0) for i in range(len(sources))]
    while waiting or ready:
        now = now if ready else max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, i, turn = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(turn + 1) * total // sources[i][1]), -sources[i][1], i, turn))
        _, _, i, turn = heapq.heappop(ready)
        told.append((sources[i][0], turn, now))
        now += 1
        if turn + 1 < sources[i][2]:
            heapq.heappush(waiting, ((turn + 1) * total // sources[i][1], i, turn + 1))
    return told


@pytest.mark.parametrize("go, many", [(2, 1), (3, 40), (8, 150), (128, 400)])
def test_schedule_by_goes_equals_one_heap_over_all_sources(spark, monkeypatch, go, many):
    monkeypatch.setattr(mixing, "_GO", go)  # goes that are shorter than the list, with leaps of time and many ties
    rng = random.Random(many)
    sources = [(f"s{i}", rng.choice([1, 1, 2, 50, rng.randint(1, 1000), 10**6]), rng.choice([1, 1, 2, 3, 25])) for i in range(many)]
    late = [("a", 0, 3), ("t", 0, 2)]  # each source but the late ones has a last block of one row
    df = spark.createDataFrame([(k, 2 * b - (w > 0), w, 2, b) for k, w, b in [*sources, *late]], "key string, n long, w long, block long, blocks long")
    got = sorted((tuple(r) for r in mixing._schedule(df).select("key", "turn", "slot", "start").collect()), key=lambda r: r[2])
    want = earliest_deadline_first(sources)
    want += [(k, turn, want[-1][2] + 1 + i) for i, (k, turn) in enumerate((k, turn) for k, _, b in late for turn in range(b))]
    last = {k: b - 1 for k, _, b in sources}
    starts = accumulate((2 - (last.get(k) == turn) for k, turn, _ in want), initial=0)
    assert got == [(*x, start) for x, start in zip(want, starts, strict=False)]


def test_six_thousand_sources_equal_one_heap(spark):
    rng = random.Random(7)
    sources = [(f"s{i:04}", rng.randint(1, 10**5), 2) for i in range(6000)]
    df = spark.createDataFrame([(k, 2 * b, w, 2, b) for k, w, b in sources], "key string, n long, w long, block long, blocks long")
    got = sorted((tuple(r) for r in mixing._schedule(df).select("key", "turn", "slot").collect()), key=lambda r: r[2])
    assert got == earliest_deadline_first(sources)
