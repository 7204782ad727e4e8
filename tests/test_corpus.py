"""Dedup, publishing, streaming and retrieval on small tables."""

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill import schemas as S
from docmill.jobs.ingest import extracted_once
from docmill.operators import corpus, extraction, retrieval, validation, vectors
from docmill.jobs.ingest import ingest_batch
from docmill.sources import corpus as tables
from docmill.sources.corpus import delete_published, index_files, known_documents, publish, read_corpus, read_received, read_rejected
from docmill.streaming.ingest import stream_ingest


def _received(spark, rows):
    return spark.createDataFrame([(k, i, n, "text/plain", c, None, None, None, None, None) for i, (k, n, c) in enumerate(rows)], S.RECEIVED)


def test_rejected_first_copy_does_not_block(spark):
    rows = _received(spark, [("a", "bad.exe", b"same"), ("b", "ok.txt", b"same"), ("c", "later.txt", b"same"), ("d", "x.txt", b"other")])
    documents, chunks, bad = ingest_batch(rows, spark.createDataFrame([], S.DOCUMENTS_DDL), "2024-01-01 00:00:00")
    assert sorted(r.original_filename for r in documents.collect()) == ["ok.txt", "x.txt"]
    assert chunks.count() == 2 and [r.error_code for r in bad.collect()] == ["unsupported_file_extension"]


def test_publish_hides_what_is_not_finished(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "indexed", "t", "f", "text/plain", "0" * 64, None, 1, 1, None, None, None, "{}", datetime.datetime(2024, 1, 1))], S.DOCUMENTS_DDL)
    chunks = spark.createDataFrame([(x, d, 0, "c", 1, None, None, None, None, False, [1.0], "m", 1) for x, d in (("c1", "d1"), ("c2", "gone"))], S.CHUNKS_DDL)
    publish(docs, chunks, str(tmp_path), "0")
    assert [r.id for r in read_corpus(spark, str(tmp_path))[1].collect()] == ["c1"]


def test_a_replay_shows_the_old_version_or_the_new_one(spark, tmp_path):
    root = str(tmp_path)

    def version(name):
        docs = spark.createDataFrame([(name, "indexed", "t", "f", "text/plain", "0" * 64, None, 1, 1, None, None, None, "{}", datetime.datetime(2024, 1, 1))], S.DOCUMENTS_DDL)
        return docs, spark.createDataFrame([(f"c-{name}", name, 0, "c", 1, None, None, None, None, False, [1.0], "m", 1)], S.CHUNKS_DDL)

    def seen(corpus):
        return [[r.id for r in df.collect()] for df in corpus]

    publish(*version("old"), root, "0")
    begun = read_corpus(spark, root)
    docs, chunks = version("broken")  # an attempt that never commits
    chunks.write.parquet(f"{root}/chunks/version=0/attempt=a9")
    docs.write.parquet(f"{root}/documents/version=0/attempt=a9")
    assert seen(read_corpus(spark, root)) == [["old"], ["c-old"]]
    publish(*version("new"), root, "0")
    assert seen(begun) == [["old"], ["c-old"]] and seen(read_corpus(spark, root)) == [["new"], ["c-new"]]
    publish(*(df.where("false") for df in version("none")), root, "0")  # a replay without rows replaces, too
    assert seen(read_corpus(spark, root)) == [[], []] and seen(read_corpus(spark, root, without_version="0")) == [[], []]


def test_stream_replay_gives_the_same_corpus(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "corpus")
    _received(spark, [("a", "a.txt", b"one"), ("b", "b.txt", b"one")]).coalesce(1).write.parquet(source)
    stream_ingest(spark, source, root, str(tmp_path / "ck"), "2024-01-01 00:00:00").awaitTermination()
    _received(spark, [("c", "c.txt", b"one"), ("d", "d.txt", b"two")]).coalesce(1).write.mode("append").parquet(source)
    stream_ingest(spark, source, root, str(tmp_path / "ck"), "2024-01-01 00:00:00").awaitTermination()
    first = sorted((r.original_filename, r.version) for r in read_corpus(spark, root)[0].collect())
    assert first == [("a.txt", "0"), ("d.txt", "1")]
    shas = {r.sha256 for r in read_corpus(spark, root)[0].collect()}
    stream_ingest(spark, source, root, str(tmp_path / "ck2"), "2024-01-01 00:00:00").awaitTermination()  # both files in one batch, numbered 0
    again = read_corpus(spark, root)
    assert {r.sha256 for r in again[0].collect()} == shas and {r.content for r in again[1].collect()} == {"one", "two"}
    # a corpus that cannot be read is no empty corpus
    for table in ("documents", "summaries"):
        for attempt in (tmp_path / "corpus" / table / "version=0").iterdir():
            (attempt / "part-bad.parquet").write_bytes(b"no parquet")
    _received(spark, [("e", "e.txt", b"one")]).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        stream_ingest(spark, source, root, str(tmp_path / "ck"), "2024-01-01 00:00:00").awaitTermination()


def test_read_received(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_bytes(b"nested")
    (tmp_path / "b.exe").write_bytes(b"y" * (S.MAX_FILE_BYTES + 10))
    manifest = spark.createDataFrame([("a.md", "k", 1, "named.md", "text/markdown", None, None, None, None, None)], "path string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RECEIVED if f.name != "content"))
    got = {r.doc_key: r for r in read_received(spark, str(tmp_path), manifest).collect()}
    assert got["k"].filename == "named.md" and (got["x/a.md"].filename, bytes(got["x/a.md"].content)) == ("a.md", b"nested") and (got["b.exe"].content, got["b.exe"].length) == (None, S.MAX_FILE_BYTES + 10)


def test_long_files_are_told_but_not_read(spark, tmp_path):
    """Two folders of the root's own name in one another; a file that Spark could not hold in one value."""
    root = tmp_path / "in"
    (root / "in" / "in").mkdir(parents=True)
    (root / "in" / "in" / "a.txt").write_bytes(b"deep")
    with open(root / "huge.txt", "wb") as f:
        f.truncate((1 << 31) + 5)  # sparse
    manifest = spark.createDataFrame([("in/in/a.txt", "k", 1, None, "text/plain", None, None, None, None, None)], "path string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RECEIVED if f.name != "content"))
    rows = read_received(spark, str(root), manifest).withColumn("mime_type", F.lit("text/plain"))
    assert {(r.doc_key, r.filename, r.error_code) for r in validation.judge(rows).collect()} == {("k", "a.txt", None), ("huge.txt", "huge.txt", "file_too_large")}
    plan = read_received(spark, str(root), manifest)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LessThanOrEqual(length") >= 1 and plan.count("GreaterThan(length") >= 1


def _version(spark, names, version):
    """Documents by the names of their texts, with a chunk each."""
    when = datetime.datetime(2024, 1, 1)
    sha = {n: hashlib.sha256(n.encode()).hexdigest() for n in names}
    docs = spark.createDataFrame([(f"id-{n}", "indexed", "t", f"{n}.txt", "text/plain", sha[n], None, 1, 1, None, None, None, "{}", when) for n in names], S.DOCUMENTS_DDL)
    return docs, spark.createDataFrame([(f"c-{n}-{version}", f"id-{n}", 0, n, 1, None, None, None, None, False, [1.0, 0.0], "m", 2) for n in names], S.CHUNKS_DDL)


def test_deletes_last_and_later_documents_live_again(spark, tmp_path):
    root = str(tmp_path)

    def alive():
        documents, chunks = read_corpus(spark, root)
        return sorted((r.id, r.version) for r in documents.collect()), sorted(r.id for r in chunks.collect())

    def ids(*names):
        return spark.createDataFrame([(f"id-{n}" if n else None,) for n in names], "id string")

    publish(*_version(spark, ["a", "b", "c"], 0), root, "0")
    publish(*_version(spark, ["d"], 1), root, "1")
    lost = delete_published(spark, root, ids("a", "d", "zz", None), "delete-1")
    assert [r.id for r in lost.collect()] == ["id-zz"] and [r.id for r in lost.collect()] == ["id-zz"]
    assert alive() == ([("id-b", "0"), ("id-c", "0")], ["c-b-0", "c-c-0"])
    # the bytes are not known any more, and are ingested again
    batch = _version(spark, ["a", "b"], 2)[0].select("sha256")
    assert [r.id for r in known_documents(spark, root, batch).collect()] == ["id-b"]
    publish(*_version(spark, ["a"], 2), root, "2")
    now = ([("id-a", "2"), ("id-b", "0"), ("id-c", "0")], ["c-a-2", "c-b-0", "c-c-0"])
    assert alive() == now
    # replays of the old version and of the delete change nothing
    publish(*_version(spark, ["a", "b", "c"], 0), root, "0")
    delete_published(spark, root, ids("a", "d", "zz"), "delete-1")
    assert alive() == now and {r.id for r in known_documents(spark, root, batch).collect()} == {"id-a", "id-b"}
    delete_published(spark, root, ids("a"), "delete-2")
    assert alive() == ([("id-b", "0"), ("id-c", "0")], ["c-b-0", "c-c-0"])
    # what is deleted is neither found nor cited
    documents, chunks = read_corpus(spark, root)
    asked = spark.createDataFrame([(1, 5, [1.0, 0.0])], "query_id long, top_k int, embedding array<double>")
    hits = retrieval.retrieve(chunks.withColumnRenamed("id", "chunk_id"), documents, asked)
    assert sorted(r.chunk_id for r in hits.collect()) == ["c-b-0", "c-c-0"]
    answers = spark.createDataFrame([(1, "answered", ["c-a-0", "c-a-2", "c-b-0"])], "query_id long, status string, cited_chunk_ids array<string>")
    valid, invalid = retrieval.check_citations(answers, hits, documents)
    assert [r.chunk_id for r in valid.collect()] == ["c-b-0"] and sorted(r.chunk_id for r in invalid.collect()) == ["c-a-0", "c-a-2"]


def test_a_batch_reads_only_the_files_of_its_hashes(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(tables, "RANGE", 40)
    names = [[f"t{v}-{i}" for i in range(100)] for v in range(4)]
    batch = _version(spark, ["t0-3", "t1-7", "new", "newer"], "x")[0].select("sha256").unionAll(spark.createDataFrame([(None,)], "sha256 string"))
    files = []
    for v, some in enumerate(names):
        publish(*_version(spark, some, v), root, str(v))
        files.append(index_files(spark, root, batch))
    assert len(spark.read.parquet(f"{root}/hashes").inputFiles()) >= 12
    assert len(files[0]) == 1 and len(files[1]) == 2 and files[1] == files[2] == files[3]  # further versions are not read
    got = known_documents(spark, root, batch)
    read = {f.split("/hashes/")[1].rsplit("/", 1)[0] for f in got.inputFiles() if "/hashes/" in f}
    assert read == {f.split("/hashes/")[1] for f in files[3]}

    def plain(batch, **more):
        known = read_corpus(spark, root, **more)[0].select("sha256", "id")
        return sorted(map(tuple, known.join(batch.select("sha256").distinct(), "sha256", "left_semi").collect()))

    everything = read_corpus(spark, root)[0].select("sha256")
    for asked, more in ((batch, {}), (batch, {"without_version": "1"}), (everything, {}), (everything.where("false"), {})):
        assert sorted(map(tuple, known_documents(spark, root, asked, **more).collect())) == plain(asked, **more)
    monkeypatch.setattr(tables, "MOST_PROBES", 2)  # a batch that is too large for the summaries
    assert sorted(map(tuple, known_documents(spark, root, batch).collect())) == plain(batch)


def test_the_stream_keeps_its_rejects(spark, tmp_path):
    """Rejects of validation, extraction and chunking under the version's commit: each once, after replays, too."""
    source, root = str(tmp_path / "in"), str(tmp_path / "corpus")
    table = b"| a |\n|---|\n| " + b"w" * 3000 + b" |"
    rows = [("a", "a.txt", b"one"), ("b", "b.exe", b"two"), ("c", "c.txt", b" \n "), ("d", "d.txt", b"one"), ("e", "e.txt", table), ("f", "f.txt", b"three"), ("g", "g.txt", b"")]
    cached = spark.range(3).cache()
    assert cached.count() == 3
    for part in (rows[:4], rows[4:]):
        _received(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream_ingest(spark, source, root, str(tmp_path / "ck"), "2024-01-01 00:00:00").awaitTermination()
    assert cached.is_cached and cached.storageLevel.useMemory  # the stream clears nothing of others
    cached.unpersist()

    def told():
        return sorted((r.doc_key, r.stage, r.error_code) for r in read_rejected(spark, root).collect())

    want = [("b", "validation", "unsupported_file_extension"), ("c", "extraction", "empty_extracted_text"), ("e", "chunking", "indivisible_table_row"), ("g", "validation", "empty_file")]
    assert told() == want
    published = read_corpus(spark, root)[0].count()
    assert (published, len(rows)) == (2, published + len(want) + 1)  # d is a copy
    stream_ingest(spark, source, root, str(tmp_path / "ck2"), "2024-01-01 00:00:00").awaitTermination()  # all in one batch, numbered 0
    assert sorted({t for t in told()}) == want and read_corpus(spark, root)[0].count() == 2
    again = ingest_batch(spark.read.schema(S.RECEIVED).parquet(source), lambda h: known_documents(spark, root, h), "2024-01-01 00:00:00")
    assert again[0].count() == again[1].count() == 0 and again[2].count() == len(want)


def test_one_run_of_each_helper(spark, tmp_path):
    """Validation, extraction and dedup read the files once and run each helper once."""
    from docmill.jobs import fixtures as X
    from docmill.operators.extraction import screen

    received = X.received(spark, "/root/testdata/sf0.001")
    plan = screen(received)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and len(plan) < 40_000
    assert [plan.count(f"{n}(") for n in ("_markdown_blocks", "_verdicts")] == [1, 1]
    documents, rejected = extracted_once(received)
    assert documents.count() + rejected.count() == received.count()
    validated, bad = validation.validate(received)
    old, _, worse = extraction.extract(validated)
    same = ["doc_key", "arrival_seq", "sha256", "original_filename", "mime_type", "title", "content", "character_count", "page_count", "source_name", "source_url", "published_at", "metadata", "blocks"]
    assert documents.select(same).exceptAll(old.select(same)).count() == 0 and old.count() == documents.count()
    assert sorted(map(tuple, bad.unionByName(worse).collect())) == sorted(map(tuple, rejected.collect()))


def test_delete_and_reconcile(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, chunks_count int")
    chunks = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, document_id string")
    left, rest, lost = corpus.delete_documents(docs, chunks, spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert ([r.id for r in left.collect()], [r.id for r in rest.collect()], [r.id for r in lost.collect()]) == (["b"], ["2"], ["zz"])
    assert [tuple(r) for r in corpus.reconcile_chunk_counts(docs, chunks).collect()] == [("b", 2, 1)]


def test_exact_top_k_with_ties_threshold_and_deleted(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    base[10:14] = base[9]  # exact ties
    rows = [(f"c{i:02d}", f"d{i % 5}", i, [float(x) for x in v]) for i, v in enumerate(base)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, embedding array<float>").repartition(7)
    docs = spark.createDataFrame([(f"d{i}",) for i in range(4)], "id string")  # d4 is deleted
    queries = [(q, k, [float(x) for x in base[q] * 3]) for q, k in ((9, 5), (3, 2), (20, 10))]
    got = retrieval.retrieve(chunks, docs, spark.createDataFrame(queries, "query_id long, top_k int, embedding array<double>"), 0.3).orderBy("query_id", "rank").collect()
    unit = np.array([r[3] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = []
    for q, k, v in sorted(queries):
        sims = unit @ (np.array(v) / np.linalg.norm(v))
        hits = sorted((-round(float(sims[i]), 9), r[1], r[2], r[0]) for i, r in enumerate(rows) if r[1] != "d4" and sims[i] >= 0.3)
        want += [(q, n, h[3]) for n, h in enumerate(hits[:k], 1)]
    assert [(r.query_id, r.rank, r.chunk_id) for r in got] == want
    assert retrieval.retrieve(chunks.where("false"), docs, spark.createDataFrame(queries, "query_id long, top_k int, embedding array<double>")).count() == 0


def test_retrieval_in_many_blocks_and_with_its_guard(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", "d", i, [float(x) for x in v], "m", 4) for i, v in enumerate(rng.normal(size=(90, 4)))]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, embedding array<float>, embedding_model string, embedding_dimensions int")
    queries = chunks.select(F.col("chunk_index").cast("long").alias("query_id"), F.lit(3).alias("top_k"), "embedding", "embedding_model", "embedding_dimensions")
    docs = spark.createDataFrame([("d",)], "id string")
    one = sorted(map(tuple, retrieval.retrieve(chunks, docs, queries, 0.2).select("query_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 7)
    monkeypatch.setattr(retrieval, "RINGS", 2)
    assert sorted(map(tuple, retrieval.retrieve(chunks, docs, queries, 0.2).select("query_id", "rank", "chunk_id").collect())) == one
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, docs, queries.withColumn("embedding_model", F.lit("other")))


CHUNKS = "chunk_id string, document_id string, chunk_index int, embedding array<float>"
QUERIES = "query_id long, top_k int, embedding array<double>"


def _brute(chunks, queries, threshold):
    """All pairs; ties by document, place and chunk."""
    good = [r for r in chunks if r[3] and all(x is not None and np.isfinite(x) for x in r[3]) and any(r[3])]
    unit = np.array([r[3] for r in good], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = []
    for q, k, v in queries:
        if v is None or not any(v) or not all(map(np.isfinite, v)):
            continue
        sims = (unit * (np.array(v) / np.linalg.norm(v))).sum(1)
        hits = sorted((-round(float(s), 9), r[1], r[2], r[0]) for s, r in zip(sims, good, strict=True) if s >= threshold)
        out += [(q, n, h[3]) for n, h in enumerate(hits[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("spread", "threshold"), [(0.05, 0.6), (0.4, 0.3), (5.0, 0.1), (0.05, 0.9999999)])
def test_pruned_search_is_exact(spark, monkeypatch, spread, threshold):
    """Clustered and scattered vectors, exact copies (ties), vectors that cannot be searched, queries of many neighbours."""
    for name, value in (("QUERY_BLOCK", 16), ("CHUNK_BLOCK", 25), ("RINGS", 3), ("PIVOTS", 12)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(10, 8))
    base = centers[rng.integers(0, 10, 400)] + spread * rng.normal(size=(400, 8))
    base[100:140] = base[99]
    rows = [(f"c{i:03d}", f"d{i % 7}", i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [("n", "d1", 0, None), ("z", "d1", 1, [0.0] * 8), ("s", "d1", 2, [1.0] * 7), ("x", "d1", 3, [float("nan")] * 8), ("y", "d1", 4, [None] * 8), ("e", "d1", 5, [])]
    asked = [(i, int(rng.integers(1, 11)), [float(x) for x in base[int(rng.integers(0, 400))] + 0.02 * rng.normal(size=8)]) for i in range(60)]
    asked += [(100, 5, [float(np.float32(x)) for x in base[99]]), (101, 10, [float(np.float32(x)) for x in base[120]]), (102, 5, None), (103, 5, [0.0] * 8)]
    docs = spark.createDataFrame([(f"d{i}",) for i in range(7)], "id string")
    want = _brute([r for r in rows if not r[3] or len(r[3]) == 8], asked, threshold)
    for parts in (1, 6):
        chunks, queries = spark.createDataFrame(rows, CHUNKS).repartition(parts), spark.createDataFrame(asked, QUERIES).repartition(parts)
        got = sorted(map(tuple, retrieval.retrieve(chunks, docs, queries, threshold).select("query_id", "rank", "chunk_id").collect()))
        assert got == want
    skipped, every = retrieval.skipped_meetings(chunks.where("size(embedding) = 8 and chunk_id like 'c%'"), queries.where("query_id < 100"), threshold)
    assert 0 <= skipped < every and (spread > 0.1 or skipped > 0.25 * every)


def test_a_meeting_of_copies_needs_no_row_for_each_pair():
    """3,000 equal chunks and 1,000 queries that all find them: 3 million pairs over the threshold, five hits a query."""
    import tracemalloc

    import pandas as pd

    vector = np.arange(1, 17, dtype=np.float32)
    chunks = pd.DataFrame({"chunk_id": [f"c{i:04d}" for i in range(3000)], "document_id": "d", "chunk_index": np.arange(3000, dtype=np.int32)[::-1], "embedding": [vector] * 3000})
    queries = pd.DataFrame({"query_id": np.arange(1000), "top_k": 5, "asked": [vector.astype(float)] * 1000, "least": 0.5})
    tracemalloc.start()
    hits = retrieval._scorer(0.5)(queries, chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(hits["chunk_id"]) == [f"c{i:04d}" for i in range(2999, 2994, -1)] * 1000
    assert peak < 150e6


def test_no_cell_of_chunks_grows_with_copies(spark, monkeypatch):
    """Copies all lie at one angle, in one ring; they are spread over cells, and a query moves once to a cell."""
    monkeypatch.setattr(retrieval, "PIVOTS", 12)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8))
    base[100:] = base[99]
    live = spark.createDataFrame([(f"c{i:03d}", "d", i, [float(x) for x in v]) for i, v in enumerate(base)], CHUNKS)
    placed, rings = retrieval._ringed(live, 300, 40)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 80
    asked = spark.createDataFrame([(i, 5, [float(x) for x in v], 0.0) for i, v in enumerate(base)], "query_id long, top_k int, asked array<double>, least double")
    routed = retrieval._routed(asked, rings, -1.0, 50)
    assert routed.count() == 300 and routed.where(f"size(cells) = {len(sizes)}").count() == 300
    assert max(r["count"] for r in routed.groupBy("q").count().collect()) <= 100


def test_search_over_vectors_that_are_not_there_yet(spark, monkeypatch):
    docs = spark.createDataFrame([("d",)], "id string")
    rows = [("a", "d", 0, None), ("b", "d", 1, [1.0]), ("c", "d", 2, [0.0, 0.0]), ("e", "d", 3, [3.0, 4.0])]
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(1, 5, [0.6, 0.8]), (2, None, [0.6, 0.8]), (3, 5, None)], QUERIES)
    assert [(r.query_id, r.chunk_id, r.similarity) for r in retrieval.retrieve(chunks, docs, queries).collect()] == [(1, "e", 1.0)]
    assert {(r.chunk_id, r.error) for r in retrieval.searchable(chunks, 2)[1].collect()} == {("a", "wrong_dimension"), ("b", "wrong_dimension"), ("c", "zero_norm")}
    assert retrieval.retrieve(chunks.where("false"), docs, queries).count() == retrieval.retrieve(chunks, docs, queries.where("false")).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, docs, spark.createDataFrame([(1, 5, [1.0]), (2, 5, [1.0, 2.0])], QUERIES))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 0)
    assert retrieval.retrieve(chunks.where("false"), docs, queries).count() == retrieval.retrieve(chunks, docs, queries.where("false")).count() == 0


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [float("inf"), 1.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    assert [r[0] for r in df.orderBy("i").select(vectors.vector_error(F.col("v"), 2)).collect()] == [None, "zero_norm", "non_finite_value", "wrong_dimension", "wrong_dimension", "non_finite_value", "non_finite_value"]
    assert [round(x, 6) for x in df.where("i = 1").select(vectors.l2_normalize(F.col("v"))).first()[0]] == [0.6, 0.8]


def test_schema_audit_on_valid_rows(spark):
    doc = ("d", "indexed", "Synthetic document", "synthetic.md", "text/markdown", "a" * 64, None, 1200, 1, None, None, None, "{}", datetime.datetime(2024, 1, 1))
    chunk = ("c", "d", 0, "Evidence grounded content.", 26, None, None, None, "Overview", False, [0.0] * 768, "m", 768)
    docs, chunks = spark.createDataFrame([doc], S.DOCUMENTS_DDL), spark.createDataFrame([chunk], S.CHUNKS_DDL)
    assert corpus.audit_schema(docs, chunks).count() == 0
    assert {r.rule for r in corpus.audit_schema(docs.union(docs), chunks.withColumn("embedding_dimensions", F.lit(767))).collect()} == {"id_unique", "sha256_unique", "embedding_dimensions_fixed"}


def test_deep_pages_are_those_of_the_whole_sort(spark):
    import random

    r = random.Random(5)
    times = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r.choice([0, 0, 0, 59, 60, 3600, 86400 * r.randint(0, 3)])) for _ in range(400)] + [None] * 20
    rows = [(f"{r.randrange(16**6):06x}" if r.random() < 0.97 else None, "indexed", "t", "f", "text/plain", t) for t in times]
    documents = spark.createDataFrame(rows, "id string, status string, title string, original_filename string, mime_type string, created_at timestamp").repartition(4).cache()
    for offset in (0, 7, 211, 395, 410, 419, 420, 1000):
        want = [(x.created_at, x.id) for x in corpus.list_documents(documents, 10, offset).collect()]
        assert [(x.created_at, x.id) for x in corpus.list_deep(documents, 10, offset, enough=15).collect()] == want, offset
    same = documents.withColumn("created_at", F.lit(datetime.datetime(2024, 1, 1)))
    near, at = corpus.locate_page(same, 10, 395, enough=15)
    assert near.count() < 40 and [x.id for x in corpus.list_documents(near, 10, at).collect()] == [x.id for x in corpus.list_documents(same, 10, 395).collect()]
    documents.unpersist()


def test_patched_audit_is_the_full_audit(spark):
    """Random ingests and deletes, with faults of every kind, repeated keys, orphans and null ids."""
    import random

    r = random.Random(6)
    when = datetime.datetime(2024, 1, 1)

    def document():
        n = r.choice([None, *range(12)]) if r.random() < 0.9 else r.randrange(100)
        bad = r.random() < 0.3
        return (None if n is None else f"d{n}", "pending" if bad else "indexed", "t", "f", r.choice(["text/plain", "image/png"]), None if r.random() < 0.1 else f"{r.randrange(6):064x}", None, 1, 1, None, None, None, r.choice(["{}", "[1]", "{bad", None]), when)

    def chunk():
        return (r.choice([None, *[f"c{i}" for i in range(20)]]), r.choice([None, *[f"d{i}" for i in range(14)]]), r.choice([-1, 0, 1]), r.choice(["x", " "]), 1, None, None, None, None, False, [1.0], "m", r.choice([1, 2]))

    docs, chunks = [document() for _ in range(25)], [chunk() for _ in range(40)]

    def frames(d, c):
        return spark.createDataFrame(d, S.DOCUMENTS_DDL), spark.createDataFrame(c, S.CHUNKS_DDL)

    told = corpus.keyed_audit(*frames(docs, chunks), 1).collect()
    for _ in range(4):
        gone, lost = r.sample(docs, 4), r.sample(chunks, 6)
        new, more = [document() for _ in range(5)], [chunk() for _ in range(7)]
        for x in gone:
            docs.remove(x)
        for x in lost:
            chunks.remove(x)
        docs, chunks = docs + new, chunks + more
        now, changed = frames(docs, chunks), frames(gone + new, lost + more)
        before = spark.createDataFrame(told, "table_name string, row_id string, rule string, kind string, key string") if told else corpus.keyed_audit(*frames([], []), 1)
        told = corpus.patch_audit(before, *now, *changed, 1).select("table_name", "row_id", "rule", "kind", "key").collect()
        full = sorted(str(tuple(x)) for x in corpus.audit_schema(*now, 1).collect())
        assert full == sorted(str((x.table_name, x.row_id, x.rule)) for x in told) and len(full) > 10
    nothing = frames([], [])
    assert corpus.patch_audit(corpus.keyed_audit(*nothing, 1), *nothing, *nothing, 1).count() == 0


def test_reindexing_embeds_only_new_texts(spark):
    old = [("1", "kept", [1.0, 0.0], "m", 2), ("2", "twice", [0.0, 1.0], "m", 2), ("3", "twice", None, None, None), ("4", "gone", [1.0, 1.0], "m", 2), ("5", "other model", [1.0, 1.0], "n", 2), ("6", "zero", [0.0, 0.0], "m", 2), ("7", None, [1.0, 1.0], "m", 2)]
    new = [("a", "twice"), ("b", "new"), ("c", "new"), ("d", "kept"), ("e", "kept"), ("f", "other model"), ("g", "zero"), ("h", None)]
    frames = (spark.createDataFrame(old, "chunk_id string, content string, embedding array<float>, embedding_model string, embedding_dimensions int"), spark.createDataFrame(new, "chunk_id string, content string"))
    moved, pending, gone = vectors.reindex(*frames, "m", 2)
    assert sorted((r.chunk_id, r.embedding) for r in moved.collect()) == [("a", [0.0, 1.0]), ("d", [1.0, 0.0]), ("e", [1.0, 0.0])]
    assert sorted((r.content, r.chunks) for r in pending.collect()) == [("new", 2), ("other model", 1), ("zero", 1)]
    assert gone.count() == 1
    assert [x.count() for x in vectors.reindex(*(f.where("false") for f in frames), "m", 2)] == [0, 0, 0]
