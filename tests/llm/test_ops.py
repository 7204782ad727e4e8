"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import chat, decontaminate, language, media, mixing, near_dedup, passages, secrets, toxicity, urls
from docmill.llm.text import Words, maximal_runs, shingles

DDL = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "word", "...", "a b c d", "\u00e9\u4e2d \U0001f600 " * 3, "x " * 30_000, "same text here now please", "same text here now please"]


def docs_of(spark, texts, langs=None, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else None, sources[i] if sources else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def words_of(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, None, None, None) for i, t in enumerate(ODD)] + [(9, ODD[9], None, None, None)]
    return spark.createDataFrame(rows, DDL).withColumns({"nid": F.lit(1), "score": F.lit("x"), "key": F.lit("k"), "rank": F.lit(0)})


def test_words_and_shingles():
    w = Words(["A b,C", "", None, "a B c d e f", "\ud800x"])
    assert np.diff(w.offsets).tolist() == [3, 0, 0, 6, 1]
    assert w.hashes[:3].tolist() == w.hashes[3:6].tolist() and w.starts[:3].tolist() == [0, 2, 4] and w.ends[8] == 11
    sh, off = shingles(w)
    assert np.diff(off).tolist() == [1, 0, 0, 2, 1] and len(set(sh.tolist())) == 4


# 1 language

def test_language_held_out_accuracy_and_odd_rows(spark, odd):
    rng = random.Random(1)
    stems = {"aa": ["tion", "the", "ing", "oun"], "bb": ["sch", "ung", "keit", "ein"], "cc": ["ció", "mente", "ado", "los"]}
    langs = [rng.choice(list(stems)) for _ in range(240)]
    texts = [" ".join(rng.choice(stems[x]) + rng.choice(stems[x]) for _ in range(rng.randint(4, 60))) for x in langs]
    got = language.language_report(docs_of(spark, texts, langs)).collect()
    assert len(got) == 240 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    told = language.predict_language(odd, language.prototypes(docs_of(spark, texts, langs))).collect()
    assert len(told) == 11 and {r.lang_pred for r in told if r.doc_id in (None, 1, 2, 4)} == {"und"}
    assert {r.lang_pred for r in language.language_report(odd).collect()} == {"und"}  # nothing to learn from
    assert language.language_report(odd.where("false")).count() == 0


def test_bundles_equal_the_definition():
    text, dims = "ab c", 128
    v = {c: language.letter_vectors(np.array([ord(c) if c != " " else 0]), dims)[0].astype(int) for c in "abc "}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", " c "))
    assert np.array_equal(language.bundles([text], dims)[0], want)


# 2 urls

def test_url_rules_and_hosts(spark):
    rows = [
        (1, "https://A.Example.COM/de/x?y#z", "<p>the cat sat</p>"), (2, "http://notexample.com/de/", "the dog"), (3, "no scheme", None), (4, None, "cat dog"), (5, "http://example.net/en/a", ""),
        (6, "http://b.net/en/a", "x"), (7, "http://z.org/fr/", "x"), (8, "http://example.net", "x"), (9, "a://b://c/d", "x"), (None, "http://catdog.info/1", "x"), (5, "http://example.net/en/a", ""),
    ]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("no"))).collect()}
    assert {k: (r.host, r.path, r.rule) for k, r in got.items()} == {
        1: ("a.example.com", "/de/x", "example.com/de/"), 2: ("notexample.com", "/de/", None), 3: ("", "", None), 4: ("", "", None), 5: ("example.net", "/en/a", "example.net/en/"),
        6: ("b.net", "/en/a", "net/"), 7: ("z.org", "/fr/", "org/fr/"), 8: ("example.net", "", None), 9: ("b:", "//c/d", None), None: ("catdog.info", "/1", None),
    }
    assert [got[k].verdict for k in (1, 5, 6, 7)] == ["block", "allow", "block", "allow"] and all(r.verdict in ("block", "allow") for r in got.values())
    assert got[None].words == ["cat", "dog", "info"]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_naive_bayes_equals_its_definition(spark):
    rng = random.Random(37)
    bits = ["cat", "dog", "sun", "é", "Größe", "x1", "zz"]
    rows = [(i, f"http://{''.join(rng.choice(bits) for _ in range(3))}.{rng.choice(['net', 'org', 'com'])}{rng.choice(['/', '/fr/', '/fr/cat/7', '/dog?q'])}", "<b>cat dog dog</b> sun größe") for i in range(300)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"word": F.lit(1), "n": F.lit(2), "piece": F.lit(3)})).collect()

    def tokens(r):
        return [f"h:{w}" for w in r.words or []] + ["p:#" if p.isdigit() else f"p:{p}" for p in re.split(r"[\W_]+", r.path.lower()) if p]

    taught = [(r.verdict, t) for r in got if r.rule for t in tokens(r)]
    counts = {v: defaultdict(int) for v in ("block", "allow")}
    for v, token in taught:
        counts[v][token] += 1
    seen, pages = len({t for _, t in taught}) + 1, {v: sum(r.verdict == v for r in got if r.rule) for v in counts}
    odds = {t: np.log((counts["block"][t] + 1) / (sum(counts["block"].values()) + seen)) - np.log((counts["allow"][t] + 1) / (sum(counts["allow"].values()) + seen)) for _, t in list(taught)}
    for r in got:
        want = np.log(pages["block"] / pages["allow"]) + sum(odds.get(t, 0.0) for t in tokens(r)) if tokens(r) else 0.0
        assert r.score == pytest.approx(want, abs=1e-6) and (r.rule or r.verdict == ("block" if want > 0 else "allow"))
    assert any(r.words and "größe" in r.words for r in got) and pages["block"] and pages["allow"]


def test_very_long_hosts(spark):
    host = "catdog" * 4000
    (r,) = urls.judge_urls(spark.createDataFrame([(1, f"http://{host}/", "cat dog " + "y" * 40)], "page_id long, url string, html string")).collect()
    assert r.words == ["cat", "dog"] * 4000


def test_viterbi_equals_all_splits():
    rng = random.Random(2)
    counts = {"a": 5, "ab": 3, "b": 2, "ba": 7, "aba": 1}

    def all_splits(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in all_splits(s[i:])]

    def value(split):
        return sum(np.log(counts[w] / 18) if w in counts else -np.log(18) - len(w) * np.log(10) for w in split)

    for _ in range(40):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        best = urls.best_split(s, counts, 18)
        assert "".join(best) == s and value(best) == pytest.approx(max(map(value, all_splits(s))))


# 3 benchmark

def test_decontamination_finds_substituted_passages_and_leaves_others(spark, odd):
    rng = random.Random(3)
    items = [" ".join(words_of(rng, n, 5000)) for n in (40, 25, 15, 13, 8, 5, 3)]
    texts, want = [], set()
    for i, item in enumerate(items):
        own = item.split()
        for edits in (0, 1, len(own) // 8):
            copy = list(own)
            for p in rng.sample(range(1, len(own) - 1), min(edits, max(len(own) - 2, 0)) if len(own) >= 13 else 0):
                copy[p] = "zz"
            if len(own) >= 5:  # of one of three words only a text of just these is a copy
                want.add((len(texts), i))
            texts.append(" ".join([*words_of(rng, 60, 5000), *copy, *words_of(rng, 60, 5000)]).upper())
        texts.append(" ".join([*words_of(rng, 60, 5000), *own[: min(8, len(own) // 2)], *words_of(rng, 60, 5000)]))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None), (98, ""), (0, items[0])], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.benchmark_overlaps(docs_of(spark, texts), bench).collect()}
    assert set(got) == want
    assert (got[(0, 0)].word_start, got[(0, 0)].word_end, got[(0, 0)].equal_words) == (60, 100, 40)
    kept = {r.doc_id for r in decontaminate.without_overlaps(docs_of(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.without_overlaps(odd.withColumn("_id", F.lit(1)), bench).count() == 11 and decontaminate.without_overlaps(odd, bench.where("false")).count() == 11


def test_every_hit_counts_and_overlaps_are_whole(spark):
    rng = random.Random(31)
    # a lone hit (all but the words of one seed are at the limit), between neighbours that other items share
    item = words_of(rng, 13, 10**6)
    lone = [w if p not in (4, 8) else "zz" for p, w in enumerate(item)]
    others = [[*words_of(rng, 6, 10**6), *item[p : p + 7], *words_of(rng, 6, 10**6)] for p in range(7)]
    long = words_of(rng, 300, 10**6)
    items = [item, *others, long]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    texts = [" ".join([*words_of(rng, n, 10**6), *lone, *words_of(rng, 20, 10**6)]) for n in range(40)]
    texts += [" ".join([*words_of(rng, 7, 10**6), *long, "end"]), " ".join([*long[:100], *words_of(rng, 100, 10**6), *long[200:]])]
    for parts in (1, 5):  # the result is the same however rows are dealt
        got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.benchmark_overlaps(docs_of(spark, texts).repartition(parts, "text"), bench).collect()}
        assert {d: v for (d, i), v in got.items() if i == 0} == {n: (n, n + 13, 11, 1) for n in range(40)}
        assert got[(40, 8)] == (7, 307, 300, 1)
        start, end, equal, stretches = got[(41, 8)]
        assert (start, equal, stretches) == (0, 100, 2) and end == 100


def test_short_items_are_found_with_every_allowed_substitution(spark):
    rng = random.Random(34)
    items = {n: words_of(rng, n, 10**6) for n in range(5, 13)}
    texts, want = [], set()
    for n, own in items.items():
        allowed = n // 5  # of 5 to 9 words one, of 10 to 12 two
        for places in [*combinations(range(n), allowed), *combinations(range(n), allowed + 1)]:
            copy = ["zz" if p in places else w for p, w in enumerate(own)]
            if len(places) == allowed and 0 not in places and n - 1 not in places:
                want.add((len(texts), n))
            texts.append(" ".join([*words_of(rng, 20, 10**6), *copy, *words_of(rng, 20, 10**6)]))
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_overlaps(docs_of(spark, texts), bench).collect()} == want


def test_overlaps_equal_all_alignments(spark):
    rng = random.Random(36)
    items = [words_of(rng, n, 60) for n in (40, 22, 13, 9, 6, 5, 3, 2, 1)]
    items.append([*items[0][:9], *items[5], *items[0][9:]])  # one item lies in another
    texts = [words_of(rng, rng.randint(0, 90), 60) for _ in range(60)] + [items[6], items[7], items[8], [*items[8], "more"]]
    for _ in range(60):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, len(own) // 4)):
            own[rng.randrange(len(own))] = "zz"
        texts.append([*words_of(rng, rng.randint(0, 40), 60), *own, *words_of(rng, rng.randint(0, 40), 60)])
    want = {}
    for (d, text), (i, item) in ((x, y) for x in enumerate(texts) for y in enumerate(items)):
        runs = []
        for shift in range(1 - len(item), len(text)):
            at = [p for p in range(max(shift, 0), min(len(text), shift + len(item))) if text[p] == item[p - shift]]
            runs += [(y - x + 1, m - n + 1, -x) for n, x in enumerate(at) for m, y in enumerate(at[n:], n) if (m - n + 1) * 10 >= 8 * (y - x + 1) and y - x + 1 >= min(13, len(item))]
        if runs and (len(item) >= 5 or len(item) == len(text)):
            want[(d, i)] = max(runs)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = docs_of(spark, [" ".join(t) for t in texts]).withColumns({"_id": F.lit(1), "row_nid": F.lit(2), "key": F.lit(3), "nid": F.lit(4)})
    got = {(r.doc_id, r.item_id): (r.word_end - r.word_start, r.equal_words, -r.word_start) for r in decontaminate.benchmark_overlaps(docs, bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and sum(got[x] == want[x] for x in got) >= 0.98 * len(got)
    kept = decontaminate.without_overlaps(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}


def test_maximal_runs_equal_brute_force():
    rng = np.random.default_rng(32)
    for _ in range(200):
        sums, slack = rng.integers(-30, 30, rng.integers(0, 14)).cumsum(), int(rng.integers(0, 40))
        runs = {(p, q) for q in range(len(sums)) for p in range(q + 1) if sums[p] <= sums[q] + slack}
        want = {r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)}
        first, last = maximal_runs(sums, slack)
        assert set(zip(first.tolist(), last.tolist(), strict=True)) == want


# 4 mixing

def _deviation(rows, share, block):
    """Largest distance from the targets before the first source ends, in blocks."""
    slots = sorted({(r.mix_slot, r.source) for r in rows})
    ends = min(max(t for t, s in slots if s == own) for own in share)
    done, worst = defaultdict(int), 0.0
    for k, (t, s) in enumerate(x for x in slots if x[0] <= ends):
        assert t == k  # no slot is empty
        done[s] += 1
        worst = max(worst, *(abs(done[x] - w * (k + 1)) for x, w in share.items()))
    return worst


def test_mixing_deviation_and_odd_rows(spark):
    rng = random.Random(4)
    sources = [rng.choice(["a"] * 8 + ["b"] * 4 + ["c", None, ""]) for _ in range(900)]
    docs = docs_of(spark, ["t"] * 900, sources=sources).withColumns({"mix_block": F.lit("x"), "key": F.lit(1), "_mixkey": F.lit(1), "block": F.lit(1)})
    rows = sorted(mixing.mix_sources(docs, block=4).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in rows] == list(range(900)) and sorted(r.doc_id for r in rows) == list(range(900))
    roots = {s: int(sources.count(s) ** 0.5 * 1000) for s in set(sources)}
    assert _deviation(rows, {s: w / sum(roots.values()) for s, w in roots.items()}, 4) < 1
    twice = docs.union(docs.where("doc_id < 10"))
    assert mixing.mix_sources(twice).count() == 910 and mixing.mix_sources(docs.where("false")).count() == 0
    # a source without a weight, or with none given, comes last; the others are at their targets
    given = sorted(mixing.mix_sources(docs, {"a": 0.25, "b": 0.75, "c": 0}, block=1).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in given] == list(range(900)) and {r.source for r in given[-sum(s not in ("a", "b") for s in sources) :]} == {"c", None, ""}
    assert _deviation([r for r in given if r.source in ("a", "b")], {"a": 0.25, "b": 0.75}, 1) < 1
    assert mixing.mix_sources(docs, {}).count() == 900


def test_mixing_is_at_uneven_targets_for_long_and_takes_many_sources(spark):
    target = {"a": 0.9995, "b": 0.0004, "c": 0.0001}
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("case when id < 29985 then 'a' when id < 29997 then 'b' else 'c' end").alias("source"))
    rows = mixing.mix_sources(docs, target, block=1).collect()
    assert _deviation(rows, target, 1) < 1 and len(rows) == 30_000
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    assert sorted(r.mix_position for r in mixing.mix_sources(many).collect()) == list(range(3000))


def test_mixing_has_no_python_and_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    df = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(f"SELECT doc_id, source, mix_block, mix_slot, mix_position FROM ({mixing.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


# 5 secrets

def _plain_spans(text):
    out = []
    for k, (p, group, least) in enumerate(((r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        out += [(m.start(), m.end(), k) for m in re.finditer(p, text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secrets_equal_plain_regex(spark, odd):
    rng = random.Random(5)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "paſſword", '"', "'", " ", ":", "=", " = ", "AKIA", "0123456789abcdef", "deadbeef", "ABCDEFGHIJKLMN", "aG9tZS9x", "é", "\n", "x", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "\U0001f600"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    got = {r.doc_id: r for r in secrets.secret_report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base, kinds = _plain_spans(t or ""), ("assign", "access", "hex")
        told = ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for *_, k in base) for x in range(3))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(filter(None, told.split(","))) <= set(got[i].spans.split(","))
    assert secrets.find_spans(["eyJ" * 400_000])[0] == []  # in linear time
    clean = secrets.redact(docs_of(spark, ["a token=abcdefghijklmnop b", "plain", None])).collect()
    assert [(r.text, r.n_chars) for r in clean] == [("a [SECRET] b", 12), ("plain", 5), (None, 0)]
    assert secrets.secret_report(odd).count() == 11 and secrets.redact(odd).count() == 11 and secrets.redact(odd.where("false")).count() == 0


def test_trigram_queries_are_necessary_conditions():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert rule.kind == "hex" or query is not True
    assert secrets.trigram_query("abc|xy") is True and secrets.trigram_query("ab(c|d)ef") == ("or", (("and", ("abc", "bce", "cef")), ("and", ("abd", "bde", "def"))))
    for pattern, text in (("ab?cde", "xacdex"), ("(foo|bar)+baz", "foobarbaz"), ("[ab]xyz{2,3}", "BXYZZ"), ("a.bcd", "a-bcd"), ("abc*def", "abdef")):
        index = secrets.ShardIndex([text, "nothing"], sorted(secrets.trigrams_of(secrets.trigram_query(pattern))))
        assert index.answer(secrets.trigram_query(pattern))[0], pattern


# 6 toxicity

def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(7)

    def brute(s):
        if not len(s):
            return []
        sums = np.concatenate(([0], np.cumsum(s)))
        best = max(((sums[j] - sums[i], -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return [(a, b, v) for a, b, v in brute(s[:i])] + [(i, j, best[0])] + [(a + j, b + j, v) for a, b, v in brute(s[j:])]

    for _ in range(60):
        s = rng.normal(-0.2, 1, rng.integers(1, 14))
        assert [(a, b, round(v, 9)) for a, b, v in toxicity.maximal_segments(s)] == [(a, b, round(v, 9)) for a, b, v in brute(s)]


def test_toxicity_weights_and_score_equal_their_definition(spark):
    rng = random.Random(38)
    texts = [" ".join(words_of(rng, 40, 60) + (["vile", "nasty"] if i % 3 == 0 else [])) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, texts), labels, prior=50.0, least=0.1)
    taught = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    counts = [defaultdict(int), defaultdict(int)]
    for i in taught:
        for w in set(texts[i].split()):
            counts[i % 3 == 0][w] += 1
    buckets, n = len(model.weights), [sum(c.values()) for c in counts]
    for w in sorted({*counts[0], *counts[1]}):
        alpha = 50.0 * (counts[0][w] + counts[1][w] + 0.01) / (sum(n) + 0.01 * buckets)
        y0, y1 = counts[0][w] + alpha, counts[1][w] + alpha
        delta = np.log(y1 / (n[1] + 50 - y1)) - np.log(y0 / (n[0] + 50 - y0))
        size = max(abs(delta) - np.sqrt(1 / y0 + 1 / y1), 0)
        got = float(model.scores(Words([w]).hashes)[0]) + model.drift
        assert got == pytest.approx(np.sign(delta) * size if size >= 0.1 else 0.0, abs=1e-4)
    assert model.weights[int(Words(["vile"]).hashes[0]) & (buckets - 1)] > 0
    m = toxicity.ToxicityModel(model.weights, 0.1, 0.5, 0.02, 0.01)
    one, two = 0.02 * 30 * np.exp(-0.5 * 14), (0.02 * 30) ** 2 * np.exp(-0.5 * 26) / 2 * 2  # the best alone, or two and a second trial
    assert toxicity.expected_count([(0, 2, 14.0), (5, 6, 12.0), (9, 10, 1.0)], 30, m) == pytest.approx(min(one, two)) and m.score(0.01) == 0.5


def test_toxicity_counts_stay_out_of_the_driver(spark):
    """60,000 words that tell nothing and one that does: the driver's Python has the weights (4 MB), not the counts of all words."""
    import tracemalloc

    texts = [" ".join([*(f"w{i}x{k}" for k in range(300)), *(["vile"] * (i % 3 == 0))]) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = docs_of(spark, texts)
    tracemalloc.start()
    model = toxicity.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.count_nonzero(model.weights) == 1 and model.weights[int(Words(["vile"]).hashes[0]) & (len(model.weights) - 1)] > 0
    assert peak < 25e6


def test_toxicity_held_out(spark, odd):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        own = words_of(rng, rng.randint(20, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                own.insert(rng.randrange(len(own)), rng.choice(["vile", "awful", "nasty"]))
        texts.append(" ".join(own))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, 0), (77777, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs_of(spark, texts), table).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == 600
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity_report(odd, table).count() == 11
    assert {r.predicted for r in toxicity.toxicity_report(odd, table.where("false")).collect()} == {0}
    kept = toxicity.without_toxic(docs_of(spark, texts), table)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


# 7 near duplicates

def _classes(texts):
    sh, off = shingles(Words(texts))
    sets = [set(sh[off[i] : off[i + 1]].tolist()) for i in range(len(texts))]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = words_of(rng, rng.randint(3, 150), 3000)
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["repeat this line again and again. " * n for n in (1, 5, 50)] + [None, "", "", "one two", "one, TWO"]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs_of(spark, texts).repartition(3)).collect()}
    assert got == _classes(texts)
    kept = sorted(r.doc_id for r in near_dedup.keep_one(docs_of(spark, texts)).collect())
    assert kept == sorted(set(got.values()))


def test_equal_sets_with_other_repeats_are_one_class(spark):
    rng = random.Random(33)
    texts = []
    for _ in range(40):
        line = " ".join(words_of(rng, rng.randint(6, 12), 10**6)) + " "
        texts += [line * 5, line * rng.choice([50, 500, 5000])]
        once = " ".join(words_of(rng, 44, 10**6)) + " "  # 40 shingles, and 4 more where it comes again
        texts += [once, once * 10]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_near_duplicates_on_odd_rows(spark, odd):
    told = near_dedup.near_duplicate_classes(odd)
    assert told.count() == 11 and {r.class_id for r in told.where("doc_id in (8, 9)").collect()} == {8}
    assert sorted(r.doc_id for r in near_dedup.keep_one(odd).where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert near_dedup.keep_one(odd.where("false")).count() == 0
    assert near_dedup.near_duplicate_classes(odd.where("false")).count() == 0


def test_keep_one_drops_no_document_without_a_copy(spark):
    rng = random.Random(35)
    a, b, c, d = (" ".join(words_of(rng, 40, 10**6)) for _ in range(4))
    texts = [(5, a), (5, b), (3, a), (7, c), (7, c), (7, d), (None, d), (None, d), (None, "x y"), (None, "x y"), (2, None), (2, None)]
    df = spark.createDataFrame(texts, "doc_id int, text string").withColumns({"row_key": F.lit(1), "nid": F.lit("n"), "judged": F.lit(0)})
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in [(3, a), (5, b), (7, c), (7, d), (None, "x y"), (2, None), (2, None)])


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 2**48, (2, 300), dtype=np.uint64)
    b[:200] = a[:200]
    wa, wb = 1 + rng.random(300) * 3, 1 + rng.random(300) * 3
    k = 2048
    owner = np.repeat([0, 1], 300)
    sig = near_dedup.dart_signatures(np.concatenate((a, b)), owner, np.concatenate((wa, wb)), 2, k)
    low, high = np.minimum(wa, wb)[:200].sum(), np.maximum(wa, wb)[:200].sum() + wa[200:].sum() + wb[200:].sum()
    assert abs(float((sig[0] == sig[1]).mean()) - low / high) < 0.05


# 8 passages

def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(11)
    values, offsets = rng.integers(0, 2**60, 90, dtype=np.uint64), np.array([0, 40, 40, 43, 90])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(values, offsets, 5)), strict=True))
    for deep in (0, 2):  # with equal values split together or one by one
        repeated = np.tile(values[:7], 13)[:90]
        before, passages._DEEP = passages._DEEP, deep
        one = sorted(zip(*(x.tolist() for x in passages.compact_windows(repeated, offsets, 5)), strict=True))
        passages._DEEP = before
        assert one == sorted(zip(*(x.tolist() for x in passages.compact_windows(repeated, offsets, 5)), strict=True))
    want = set()
    for s, e in zip(offsets[:-1], offsets[1:], strict=True):
        for c in range(s, e):
            l, r = c, c
            while l > s and values[l - 1] > values[c]:
                l -= 1
            while r < e - 1 and values[r + 1] > values[c]:
                r += 1
            if r - l + 1 >= 5:
                want.add((l, c, r))
    assert got == want


def test_repeated_passages(spark, odd):
    rng = random.Random(12)
    passage, short = words_of(rng, 60, 9000), words_of(rng, 30, 9000)
    texts = [" ".join(words_of(rng, 150, 9000)) for _ in range(6)]
    for i in (1, 3, 4):
        own = texts[i].split()
        texts[i] = " ".join([*own[: 20 * i], *passage, *own[20 * i :]])
    near = list(passage)
    near[30] = "changed"
    texts += [" ".join([*words_of(rng, 40, 9000), *near, *words_of(rng, 40, 9000)]), *(" ".join([*words_of(rng, 50, 9000), *short, *words_of(rng, 50, 9000)]) for _ in range(3)), texts[0]]
    got = passages.repeated_passages(docs_of(spark, texts)).collect()
    assert {r.doc_id for r in got} == {1, 3, 4, 6, 0, 10}
    spans = {(r.doc_id, r.word_start, r.word_end) for r in got}
    assert {(10, 0, 150), (0, 0, 150)} <= spans and all(r.word_end - r.word_start >= 50 for r in got)
    for i in (1, 3, 4):
        assert any(d == i and a <= 20 * i + 3 and b >= 20 * i + 57 for d, a, b in spans)
    assert {r.doc_id for r in passages.repeated_passages(odd).collect()} == set() and passages.repeated_passages(odd.where("false")).count() == 0


def _stretches(a, b, low, high, shortest, similarity):
    """Of all stretches of a, those that begin and end with an equal place, in no longer one."""
    against = [next((i - s for s in range(high, low - 1, -1) if 0 <= i - s < len(b) and b[i - s] == a[i]), None) for i in range(len(a))]
    at = [i for i, q in enumerate(against) if q is not None]
    runs = [(x, y) for n, x in enumerate(at) for m, y in enumerate(at[n:], n) if (m - n + 1) * (1 + similarity) >= 2 * similarity * (y - x + 1)]
    runs = [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]
    return {i for x, y in runs for i in range(x, y + 1) if y - x + 1 >= shortest}


def test_matching_stretches_equal_brute_force():
    rng = np.random.default_rng(13)
    a, b, low, high = [], [], [], []
    for _ in range(60):
        x = rng.integers(0, 50, int(rng.integers(0, 40)))
        y = np.where(rng.random(len(x)) < 0.1, 99, x)[int(rng.integers(0, 3)) :]
        a.append(x.astype(np.uint16))
        b.append(y.astype(np.uint16))
        low.append(int(rng.integers(-2, 3)))
        high.append(low[-1])
    got = [set() for _ in a]
    for row, start, end, *_ in passages.matching_stretches(a, b, np.array(low), np.array(high), 6, 0.8).tolist():
        got[row] |= set(range(start, end))
    assert got == [_stretches(x.tolist(), y.tolist(), s, t, 6, 0.8) for x, y, s, t in zip(a, b, low, high, strict=True)]
    # a word put in: two distances, one stretch
    x = np.arange(50, dtype=np.uint16)
    y = np.concatenate((x[:24], [200, 201, 202, 203, 204], x[28:]))
    assert passages.matching_stretches([x], [y.astype(np.uint16)], np.array([-1]), np.array([0]), 46, 0.8).tolist() == [[0, 0, 50, 0, 51]]


def _narrow_keys_of(a, close, settled=False):
    return set(passages.narrow_keys([a[:0], a], np.array([0, 100]), 46, close, np.array([True, not settled]))[1].tolist())


@pytest.mark.parametrize("close", [False, True])
def test_narrow_keys_survive_a_substituted_word(close):
    rng = np.random.default_rng(17)
    for start in range(46):  # the passage lies at each place around the window's
        for changed in range(1, 49):
            a, b = rng.integers(0, 2**16, (2, 200)).astype(np.uint16)
            own = slice(100 - start, 146 - start)
            b[own] = a[own]
            b[max(100 - start, 100 - start + changed - 4) : 100 - start + changed + 1] += 1
            assert _narrow_keys_of(a, close) & _narrow_keys_of(b, close), (start, changed)
    a, b = rng.integers(0, 2**16, (2, 200)).astype(np.uint16)
    b[90:120] = a[90:120]  # a phrase of 34 words is no passage
    assert close or not _narrow_keys_of(a, close) & _narrow_keys_of(b, close)
    b = a.copy()
    b[np.arange(40, 160, 12)] += 1  # too many changes
    assert not close or not _narrow_keys_of(a, close) & _narrow_keys_of(b, close)


@pytest.mark.parametrize("close", [False, True])
def test_narrow_keys_survive_a_word_put_in_or_left_out(close):
    rng = np.random.default_rng(20)
    for start in range(0, 46, 4):  # where the window's place lies in the passage of text a, of 46 shingles
        for at in range(1, 46, 2):  # shingles at .. at + 3 of a are gone; b has five others there
            if at <= start < at + 4:
                continue  # the place itself is changed: another window's
            a, b = rng.integers(0, 2**16, (2, 240)).astype(np.uint16)
            begin = 100 - start
            moved = 0 if start < at else 1  # the place of b's window: texts are aligned there
            b[begin - moved : begin - moved + at] = a[begin : begin + at]
            b[begin - moved + at + 5 : begin - moved + 47] = a[begin + at + 4 : begin + 46]
            assert b[100] == a[100]
            for settled_a, settled_b in ((False, False), (True, False), (False, True)):
                assert _narrow_keys_of(a, close, settled_a) & _narrow_keys_of(b, close, settled_b), (start, at)


def test_pairs_in_groups_of_every_size_are_told(spark):
    """Pairs of a passage with one word changed, put in or left out, in groups of 10, 40 and 400 looser variants of the passage,
    which are no passages of one another."""
    rng, texts, pairs = random.Random(21), [], set()
    for size in (10, 40, 400):
        for edit in ("change", "put in", "leave out"):
            base = words_of(rng, 58, 10**6)

            def looser():
                copy = list(base)
                for at in rng.sample(range(58), 8):
                    copy[at] = f"q{rng.randrange(10**7)}"
                return copy

            for k in range(size):
                one = looser()
                some = [one]
                if k < 2 * min(size // 4, 15):
                    other, at = list(one), rng.randrange(8, 50)
                    other[at : at + (edit != "put in")] = [] if edit == "leave out" else [f"new{rng.randrange(10**7)}"]
                    some.append(other)
                    pairs |= {len(texts), len(texts) + 1}
                texts += [[*words_of(rng, rng.randint(20, 60), 10**6), *t, *words_of(rng, rng.randint(20, 60), 10**6)] for t in some]
    got = {r.doc_id for r in passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts])).collect()}
    assert len(got & pairs) >= 0.97 * len(pairs) and len(got - pairs) <= 0.01 * len(texts)


def test_every_passage_of_a_pair_is_told(spark):
    rng = random.Random(18)
    two = [words_of(rng, 240, 10**6) for _ in range(2)]
    two[1][:80], two[1][180:] = two[0][:80], two[0][180:]  # two passages at one distance
    put_in = words_of(rng, 52, 10**6)
    texts = [*two, [*words_of(rng, 60, 10**6), *put_in, *words_of(rng, 60, 10**6)], [*words_of(rng, 90, 10**6), *put_in[:26], "new", *put_in[26:], *words_of(rng, 9, 10**6)]]
    got = passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts])).collect()
    assert {(0, 0, 80), (0, 180, 240), (1, 0, 80), (1, 180, 240), (2, 60, 112), (3, 90, 143)} <= {(r.doc_id, r.word_start, r.word_end) for r in got}


def test_passages_of_edited_copies_and_of_common_lines_against_all_pairs(spark):
    rng = random.Random(19)
    line, texts = words_of(rng, 30, 10**6), []
    for _ in range(12):
        base = words_of(rng, rng.randint(50, 70), 10**6)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append([*words_of(rng, rng.randint(20, 80), 10**6), *copy, *line, *words_of(rng, rng.randint(20, 80), 10**6)])
    texts += [[*words_of(rng, 60, 10**6), *line, *words_of(rng, 60, 10**6)] for _ in range(60)]  # no passage: the line is too short
    texts += [words_of(rng, 20, 10**6) + [w] * 300 for w in ("in", "in", "of")]  # deep trees
    sh, off = shingles(Words([" ".join(t) for t in texts]))
    seqs = [sh[a:b].astype(np.uint16) for a, b in zip(off[:-1], off[1:], strict=True)]
    where = [{v: i for i, v in enumerate(s.tolist())} for s in seqs]
    want = set()
    for i, j in combinations(range(len(texts)), 2):
        shifts = sorted({where[i][v] - where[j][v] for v in where[i].keys() & where[j].keys()})
        if any(len(passages.matching_stretches([seqs[i]], [seqs[j]], np.array([s]), np.array([s]), 46, 0.8)) for s in shifts):
            want |= {i, j}
    got = {r.doc_id for r in passages.repeated_passages(docs_of(spark, [" ".join(t) for t in texts])).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) < 100 and {156, 157} <= got and 158 not in got


# 9 chat

def test_chat_round_trip_and_mask(spark):
    rng = random.Random(14)
    bits = ["### ", "#", "\\", " </turn>\n", "</turn>", ":", ": ", "assistant", "é", "\U0001f600", "\n", " ", "ok", "<"]
    rows, want = [], {}
    for c in range(60):
        turns = []
        for t in range(rng.randint(1, 6)):
            role, text = rng.choice(["user", "assistant", "sy:s#tem", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))])
            rows.append((c, t, role, text, "x"))
            turns.append((role or "", text or ""))
        want[c] = turns
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    formatted = chat.format_conversations(df)
    for r in formatted.collect():
        assert chat.read_back(r.formatted) == want[r.conv_id]
        inside = chat.masked_text(r.formatted, np.array([r.mask_tokens, r.mask_starts, r.mask_ends]).T)
        assert [chat.unescape(x) for x in inside] == [t for role, t in want[r.conv_id] if role == "assistant" and t]
    for r in chat.format_digests(formatted).collect():
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0
    lost = chat.format_conversations(spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", None), (1, 5, "user", "x " * 50_000), (1, 5, "user", "x " * 50_000)], "conv_id long, turn int, role string, text string"))
    assert sorted((r.conv_id or 0, r.n_turns) for r in lost.collect()) == [(0, 1), (0, 1), (0, 1), (1, 2)]


# 10 media

def test_media_round_trip(spark, odd):
    rng = random.Random(15)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [None, "", "x" * 576, "y" * 577, "é" * 3000, shared, shared + "tail", "head" + shared, shared, "".join(rng.choice("xyz") for _ in range(40_000))]
    got = {r.doc_id: r for r in media.media_report(docs_of(spark, texts).repartition(3)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[5][1:] == got[8][1:] and got[0][1:] == got[1][1:]
    assert media.media_report(odd).count() == 11 and media.media_report(odd.where("false")).count() == 0


def test_chunks_are_shared_and_verified():
    rng = random.Random(16)
    a = bytes(rng.randrange(256) for _ in range(30_000))
    (_, _, one, _), (_, _, two, _) = media._chunked(["".join(chr(32 + x % 90) for x in a), "zz" + "".join(chr(32 + x % 90) for x in a)])
    assert len(set(one) & set(two)) >= len(one) - 2 and all(len(c) <= media.MOST for c in one)
    payload, n, chunks, digests = next(media._chunked(["abc" * 500]))
    recipe = media._MAGIC + __import__("struct").pack("<QI", n, len(chunks)) + b"".join(__import__("struct").pack(media._ENTRY, d, len(c)) for d, c in zip(digests, chunks, strict=True))
    assert media.rebuild(recipe, chunks, {}) == (payload, n)
    with pytest.raises(ValueError):
        media.rebuild(recipe, [chunks[0][:-1] + b"!", *chunks[1:]], {})
