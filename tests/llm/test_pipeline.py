"""The pipeline against a brute-force version of its stages, on the smallest tables and on odd ones."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _redacted(text, spans):
    merged = []
    for a, b, _ in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def _overlap(words, item):
    """A stretch with 80 % equal words, of 13 words or the item's, at any alignment."""
    where = defaultdict(list)
    for p, w in enumerate(item):
        where[w].append(p)
    shifts = Counter(p - q for p, w in enumerate(words) for q in where.get(w, ()))
    least = min(13, len(item))
    for shift, n in shifts.items():
        if n * 10 >= 8 * least:
            at = [p for p in range(max(shift, 0), min(len(words), shift + len(item))) if words[p] == item[p - shift]]
            if any((m - k + 1) * 10 >= 8 * (y - x + 1) and y - x + 1 >= least for k, x in enumerate(at) for m, y in enumerate(at[k:], k)):
                return True
    return False


def test_stages_take_effect_one_after_the_other(spark):
    import corpus_pipeline as P
    from docmill.llm import secrets
    from docmill.llm.text import Words
    from docmill.llm.toxicity import toxicity_report
    from test_ops import _classes

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in toxicity_report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    left = [d for d in sorted(rows) if d not in toxic]
    classes = _classes([rows[d].text for d in left])
    left = [left[i] for i in sorted(set(classes.values()))]
    items = [Words([r.text]).hashes.tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [d for d in left if not any(_overlap(Words([rows[d].text]).hashes.tolist(), i) for i in items)]
    want = {d: _redacted(rows[d].text, secrets.find_spans([rows[d].text])[0]) for d in left}
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    assert {d: r.text for d, r in got.items()} == want
    assert sorted(r.mix_position for r in got.values()) == list(range(len(got)))


def test_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    from test_ops import DDL, ODD

    labels, benchmark = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    item = benchmark.orderBy("item_id").first().text
    rows = [(i if i else None, t, None, None, None) for i, t in enumerate(ODD)] + [(9, ODD[9], None, "s", 1), (20, f"so it says: {item} end", "en", "s", 3), (21, "a token=abcdefghijklmnop b", "en", None, 26), (21, "another text under its id", "en", "s", 1)]
    odd = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(c) for c in ("_id", "nid", "row_nid", "row_key", "key", "score", "_mixkey", "mix_block", "class_id", "judged", "bucket")})
    for name, docs, want in (("odd", odd, [None, 1, 2, 3, 4, 5, 6, 7, 8, 21, 21]), ("empty", odd.where("false"), [])):
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        got = P.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == [-1 if x is None else x for x in want]
        if got:
            assert {"a [SECRET] b", "another text under its id"} <= {r.text for r in got} and {r._id for r in got} == {"_id"} and {r.bucket for r in got} == {"bucket"}
