"""The store, the cache, retrieval pieces and streams end to end."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import bm25, cache, diversity, filters, fusion, store, vectors
from inkwell.plans import adapters, answers, index, pages, respond, search
from inkwell.streaming import watch


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("d1", "/w/a.md", "pending"), ("d2", "/w/sub/b.md", "pending")], "id string, file_path string, processing_status string")
    s.upsert("documents", docs)
    s.upsert("documents", docs.where("id = 'd1'").withColumn("processing_status", F.lit("indexed")))
    assert {r["id"]: r["processing_status"] for r in s.read("documents").collect()} == {"d1": "indexed", "d2": "pending"}
    left = store.delete_folder({"documents": s.read("documents")}, "/w/sub")
    assert [r["id"] for r in left["documents"].collect()] == ["d1"]
    v = spark.createDataFrame([("v1", "c1", "main", "t", [1.0]), ("v2", "c1", "summary", "t", [0.5])], store.SCHEMAS["vectors"])
    s.write("vectors", v)
    assert s.find("vectors", F.col("vector_type") == "main").count() == 1
    s.clear()
    assert s.read("documents").count() == s.read("vectors").count() == 0


def test_store_survives_a_stopped_writer(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "store"))
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    s.upsert("documents", rows("a", "b"))
    reader = s.read("documents")

    class Stop(Exception):
        pass

    def stopped(where):
        raise Stop

    # stopped between the snapshot and its marker: the old table is there, whole
    with monkeypatch.context() as m:
        m.setattr(s, "_commit", stopped)
        with pytest.raises(Stop):
            s.upsert("documents", rows("c"))
    assert sorted(r["id"] for r in s.read("documents").collect()) == ["a", "b"]
    s.upsert("documents", rows("d"))
    assert sorted(r["id"] for r in s.read("documents").collect()) == ["a", "b", "d"]
    assert sorted(r["id"] for r in reader.collect()) == ["a", "b"]  # a reader at work keeps its snapshot
    assert len(s.versions("documents")) == 2 and len(list((tmp_path / "store" / "documents").glob("[0-9]*[0-9]"))) == 2
    # stopped while the snapshot is written
    (tmp_path / "store" / "documents" / "000000000009").mkdir()
    s.upsert("documents", rows("e"))
    assert s.read("documents").count() == 4
    # two writers of one version: the second fails
    t = store.Store(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        t._commit(f"{t.path}/documents/{t.versions('documents')[-1]:012d}")


def test_written_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (None, "alpha")], "doc_id long, text string")
    ix = bm25.build(docs, "doc_id", F.col("text"))
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.read_index() is None
    s.write_index(ix)
    s.write_index(ix)
    asked = spark.createDataFrame([("q", "beta beta gamma")], "q string, text string")
    got = bm25.score(s.read_index(), asked)
    assert sorted(map(str, got.collect())) == sorted(map(str, bm25.score(ix, asked).collect())) and got.count() == 2
    assert "PartitionFilters" in got._jdf.queryExecution().executedPlan().toString()


def test_projections(spark):
    d = spark.createDataFrame([("a", "indexed", 2, "[]", None), ("b", "pending", None, None, "x")], "id string, processing_status string, page_count int, layout_data string, extracted_markdown string")
    assert [tuple(r)[3:] for r in store.processing_status(d).orderBy("id").collect()] == [(True, False), (False, True)]
    p = spark.createDataFrame([("a", 1, "[1,2]", "[1,2,3]"), ("a", 2, "[1]", "[]"), ("a", 3, None, "x")], "document_id string, page_number int, layout string, unfiltered_layout string")
    assert [tuple(r)[2:] for r in store.page_info(p).orderBy("page_number").collect()] == [(2, 3, 1), (1, 0, 0), (0, 0, 0)]
    flat = json.dumps([{"label": "text", "text": "Some words here", "bbox": [0, 0, 1, 1], "page": 1}, {"label": "title", "text": "Top", "bbox": [0, 0, 1, 1]}])
    paged = json.dumps([{"page_number": 4, "regions": [{"label": "table", "text": "cells", "bbox": [1, 1, 2, 2]}]}])
    boxes = store.layout_boxes(spark.createDataFrame([("f", flat), ("p", paged), ("n", None), ("l", "[[1, 2]]")], "id string, layout_data string"))
    got = sorted((r["id"], r["pos"], r["page_number"], r["label"]) for r in boxes.collect())
    assert got == [("f", 0, 1, "text"), ("f", 1, None, "title"), ("p", 0, 4, "table")]
    nodes = spark.createDataFrame([("f", 0, " some WORDS "), ("f", 1, "absent"), ("f", 2, "")], "id string, node int, text string")
    assert [(r["node"], r["label"]) for r in store.matched_boxes(nodes, boxes).orderBy("node").collect()] == [(0, "text"), (1, None), (2, None)]
    files = lambda *rows: spark.createDataFrame(list(rows), "id string, file_hash string")
    out = store.reindex(files(("a", "1"), ("b", "2"), ("c", "3")), files(("a", "1"), ("b", "0"), ("z", "9")), files(("c", "")))
    assert {r["outcome"]: r["n"] for r in out.collect()} == {"processed": 1, "failed": 1, "skipped": 1, "removed": 1}


def test_cascade(spark):
    t = {
        "documents": spark.createDataFrame([("a",), ("b",)], "id string"),
        "chunks": spark.createDataFrame([("1", "a", None), ("2", "b", "1"), ("3", "b", "2")], "id string, document_id string, parent_chunk_id string"),
        "chunk_questions": spark.createDataFrame([("1", "q"), ("3", "r")], "chunk_id string, question string"),
    }
    out = store.delete(t, "documents", t["documents"].where("id = 'a'"))
    assert sorted(map(tuple, out["chunks"].collect())) == [("2", "b", None), ("3", "b", "2")]
    assert [r["chunk_id"] for r in out["chunk_questions"].collect()] == ["3"]


def test_replace_children(spark):
    old = spark.createDataFrame([("c1", "x"), ("c2", "y")], "chunk_id string, question string")
    new = spark.createDataFrame([("c1", "z")], "chunk_id string, question string")
    assert sorted(map(tuple, store.replace_children(old, new, "chunk_id").collect())) == [("c1", "z"), ("c2", "y")]


def test_cache(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("k1", "q", [1.0, 0.0], "r1", ["d1"], at(0), at(5)), ("k2", "p", [0.0, 1.0], "r2", ["d2"], at(1), at(9))]
    c = spark.createDataFrame(rows, "key string, query string, embedding array<double>, response string, document_ids array<string>, created_at timestamp, last_access timestamp")
    q = spark.createDataFrame([("a", [0.99, 0.14]), ("b", [0.7, 0.7])], "q string, vector array<double>")
    now = F.lit(at(30))
    assert [(r["q"], r["key"]) for r in cache.lookup(c, q, now).collect()] == [("a", "k1")]
    assert cache.lookup(c, q, F.lit(dt.datetime(2024, 1, 2))).count() == 0
    assert [r["key"] for r in cache.evict(c, 1).collect()] == ["k2"]
    assert {r["key"] for r in cache.put(c, c.limit(0), 5).collect()} == {"k1", "k2"}
    assert [r["key"] for r in cache.invalidate(c, "d1").collect()] == ["k2"] and cache.prune(c, F.lit(at(0)), 0).count() == 2


def test_bm25_by_formula(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (4, "")]
    ix = bm25.build(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", F.col("text"))
    got = {r["id"]: r["score"] for r in bm25.score(ix, spark.createDataFrame([("q", "beta beta gamma")], "q string, text string")).collect()}
    n, avgdl, ln = 4, 6 / 4, np.log
    idf = ln(n - 1 + 0.5) - ln(1.5)
    part = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got == pytest.approx({1: 2 * part(2, 3), 2: part(1, 2)})


def test_vectors_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id long, vector array<float>").repartition(5)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    found = vectors.top_k(df, df.withColumnRenamed("id", "q"), 30)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    x = np.float32(x).astype(float)
    want = [(i, k + 1, int(j)) for i in range(60) for k, j in enumerate(np.argsort(-(x @ x[i]), kind="stable")[:30])]
    assert sorted((g["q"], g["rank"], g["id"]) for g in found.collect()) == want
    assert vectors.top_k(df, df.withColumnRenamed("id", "q").limit(0), 5).count() == 0


def test_vectors_and_filters(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "id long, vector array<double>").repartition(5)
    q = df.where("id < 3").select(F.col("id").alias("q"), "vector")
    got = vectors.top_k(df, q, 5).collect()
    own = vectors.top_k(df, q, 5, allowed=q.select("q").crossJoin(df.select("id"))).collect()
    key = lambda rows: sorted((g["q"], g["rank"], g["id"]) for g in rows)
    want = [(i, k + 1, int(j)) for i in range(3) for k, j in enumerate(np.argsort(-(x @ x[i]), kind="stable")[:5])]
    assert key(got) == key(own) == sorted(want)
    assert vectors.top_k(df, q, 5, allowed=df.limit(0).select("id")).count() == 0


def test_mmr():
    docs = np.array([[1, 0], [0.99, 0.14], [0, 1.0]])
    assert diversity.mmr_order(np.array([1, 0.2]), docs, 2, 0.3) == [1, 2]
    assert diversity.mmr_order(np.array([1, 0.0]), docs, 3, 1.0) == [0, 1, 2]


def test_mmr_short_list(spark):
    rows = [("q", 5, 1, 0.9, [1.0, 0.0], [1.0, 0.0]), ("q", 6, 2, 0.8, [0.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "q string, id long, rank int, score double, vector array<double>, query_vector array<double>")
    assert [r["score"] for r in diversity.mmr(df, 5).orderBy("rank").collect()] == [0.9, 0.8]
    assert [r["score"] for r in diversity.mmr(df, 1).collect()] == [1.0]


def test_rrf_by_formula(spark):
    rows = [("q", "main_vector", 1, 1, 0.9), ("q", "bm25", 1, 3, 7.0), ("q", "bm25", 2, 1, 9.0), ("q", "summary_vector", 3, 1, 0.1)]
    lists = spark.createDataFrame(rows, "q string, source string, id long, rank int, score double")
    got = {r["id"]: (r["score"], r["rank"]) for r in fusion.rrf(lists).collect()}
    assert got[1][0] == pytest.approx(0.40 / 31 + 0.25 / 33) and got[1][1] == 1 and got[2][0] == pytest.approx(0.25 / 31) and got[3][1] == 3


def test_empty_filters(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    none, one = ids.where("id > 5"), ids.where("id = 1")
    assert filters.candidates(ids, [none, one]).count() == 1 and filters.candidates(ids, [none], "empty").count() == 0
    e = spark.createDataFrame([(["a ", "a", " "], ["x"])], "k array<string>, z array<string>").select(F.create_map(F.lit("k"), "k", F.lit("z"), "z").alias("m"))
    assert e.select(filters.clean_entities(F.col("m"), ["k"])).first()[0] == {"k": ["a"]}
    assert e.select(filters.entities_text(F.col("m"))).first()[0] == "k: a , a,  ; z: x" and e.select(filters.entities_text(F.lit(None).cast("map<string,array<string>>"))).first()[0] == "N/A"


def test_index_and_search(spark):
    docs = spark.createDataFrame([("d1", "a.md", "claim", None, "# Claims\nHow to file a claim.\n## Steps\nCall the agent first."), ("d2", "b.md", "policy", "# Policy\nThe policy covers water damage.", "old")], "id string, file_name string, detected_doc_type string, reviewed_markdown string, extracted_markdown string")
    chunks = index.chunked(docs).cache()
    assert {r["text"] for r in chunks.collect()} >= {"Claims", "How to file a claim.", "The policy covers water damage."}
    meta = index.enriched(chunks, adapters.ExtractiveModel).cache()
    assert {r["category"] for r in meta.collect()} == {"narrative"}
    full = index.contextualised(chunks, meta, docs)
    assert full.where("text = 'Steps'").first()["contextualized_text"].startswith("Document: a.md\nType: claim\nSection: Claims > Steps\nPrevious context: How to file a claim.")
    v = index.vector_rows(full, meta, adapters.HashingEmbedder)
    assert {r[0] for r in v.select("vector_type").distinct().collect()} == {"main", "summary", "question"}
    corpus = search.Corpus(chunks.select(F.col("chunk_id").alias("id"), "document_id", "text", F.lit("narrative").alias("category")), v, index.keyword_index(chunks, meta))
    asked = adapters.embedded(spark.createDataFrame([("q1", "water damage policy")], "q string, text string"), "text", adapters.HashingEmbedder)
    best = search.search(corpus, asked, 3, by_type=True).orderBy("rank").first()
    assert best["document_id"] == "d2" and any("water" in h for h in best["highlights"])


def corpus_of(spark):
    texts = [("c1", "d1", "water damage is covered by the policy"), ("c2", "d1", "water damage is covered by the policies"), ("c3", "d2", "file a claim with the agent"), ("c4", "d2", "fire claims need photographs"), ("c5", "d3", "the agent calls back about water")]
    chunks = spark.createDataFrame(texts, "id string, document_id string, text string").withColumn("category", F.lit("narrative"))
    v = adapters.embedded(chunks.select("id", F.col("id").alias("chunk_id"), "text"), "text", adapters.HashingEmbedder)
    vectors_ = v.select("id", "chunk_id", F.lit("main").alias("vector_type"), "vector")
    docs = spark.createDataFrame([("d1", "a.md", "policy"), ("d2", "b.md", "claim form"), ("d3", "c.md", "letter")], "id string, file_name string, detected_doc_type string")
    return search.Corpus(chunks, vectors_, bm25.build(chunks, "id", F.col("text"))), docs


def test_search_steps(spark):
    corpus, docs = corpus_of(spark)
    asked = adapters.embedded(spark.createDataFrame([("q", "water damage policy")], "q string, text string"), "text", adapters.HashingEmbedder)
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert ids(search.search(corpus, asked, 2)) == ["c1", "c2"]
    only = search.allowed_chunks(corpus.chunks, docs, "claim")
    assert set(ids(search.search(corpus, asked, 5, only))) <= {"c3", "c4"}
    assert search.allowed_chunks(corpus.chunks, docs, "nothing of the kind") is None and search.allowed_chunks(corpus.chunks, docs) is None
    assert [r["id"] for r in search.allowed_chunks(corpus.chunks, docs, document_id="d3").collect()] == ["c5"]
    entities = spark.createDataFrame([("d1", "people", "Ann"), ("d3", "people", "Bob")], "document_id string, entity_key string, entity_value string")
    assert [r["id"] for r in search.allowed_chunks(corpus.chunks, docs, None, {"people": "bo"}, entities).collect()] == ["c5"]

    class Last:
        def score(self, pairs):
            return [float("agent" in t) for _, t in pairs]

    assert ids(search.search(corpus, asked, 2, scorer=Last))[0] in ("c3", "c5")
    diverse = ids(search.search(corpus, asked, 2, diverse=True))
    assert diverse[0] == "c1" and len(diverse) == 2
    wide = search.search(corpus, asked, 2, hyde=(Talker, adapters.HashingEmbedder), sources=("main_vector",))
    assert wide.count() == 2 and {r["source"] for r in wide.select(F.explode("details.source").alias("source")).collect()} == {"main_vector"}


def test_respond(spark):
    corpus, docs = corpus_of(spark)
    entries = spark.createDataFrame([], respond.CACHE)
    asked = spark.createDataFrame([("a", "why is water damage covered?"), ("b", "claim photographs")], "q string, text string")
    models = respond.Models(adapters.HashingEmbedder, Talker)
    now = F.lit(dt.datetime(2024, 1, 1))
    out, entries = respond.respond(corpus, docs, entries, asked, models, now, k=3)
    got = {r["q"]: r for r in out.collect()}
    assert got["a"]["tier"] == "synthesis" and "Source Chunk" not in got["a"]["answer"][:3] and got["b"]["tier"] == "retrieval" and got["b"]["answer"] is None
    assert got["a"]["results"][0]["id"] == "c1" and got["a"]["sources"][0]["document_id"] == "d1" and got["a"]["total_results"] == 3
    entries = spark.createDataFrame(entries.collect(), respond.CACHE)
    assert entries.count() == 2
    again, _ = respond.respond(corpus, docs, entries, asked, models, now, k=3)
    for r in again.collect():
        assert r["tier"] == "cache" and r["cache_hit"] and r["answer"] == got[r["q"]]["answer"] and r["results"] == got[r["q"]]["results"]
    other, more = respond.respond(corpus, docs, entries, asked.where("q = 'b'"), models, now, mode="synthesis", k=2)
    assert other.first()["tier"] == "synthesis" and more.count() == 3  # another mode and k is another question
    with pytest.raises(ValueError):
        respond.respond(corpus, docs, entries, asked, models, now, mode="none")


class Printer:
    def count(self, document):
        return len(self.sizes(document))

    def sizes(self, document):
        if document == b"broken":
            raise ValueError("no pages")
        return [(100.0, 200.0)] * len(document.split(b"|"))

    def render(self, document, page, dpi=150):
        part = document.split(b"|")[page - 1]
        if part == b"torn":
            raise ValueError("torn page")
        return b"%d:" % dpi + part


class Finder:
    def detect(self, images, confidence=0.2, size=1024):
        return [[("title", 0.9, 0, 0, 50, 10), ("text", 0.8, 0, 20, 50, 60), ("text", 0.7, 0, 21, 50, 60), ("table", 0.9, 0, 80, 50, 120)] if b"full" in x else [] for x in images]


class Reader:
    def read(self, kind, images):
        if b"bad" in images[0]:
            raise ValueError
        return [f"{kind} of {images[0].decode()}"]


def test_pages(spark):
    docs = spark.createDataFrame([("a", bytearray(b"full 1|empty|torn")), ("b", bytearray(b"broken")), ("c", bytearray(b"full 2"))], "id string, content binary")
    got = pages.rendered(docs, Printer).orderBy("document_id", "page_number").collect()
    assert [(r["document_id"], r["page_number"], r["error"]) for r in got] == [("a", 1, None), ("a", 2, None), ("a", 3, "torn page"), ("b", None, "no pages"), ("c", 1, None)]
    assert bytes(got[0]["image"]) == b"150:full 1" and got[0]["width"] == 100
    shown = pages.rendered(docs, Printer)
    assert pages.detected(shown, Finder).count() == 8
    kept = pages.detections(shown, Finder)
    assert sorted((r["document_id"], r["pos"]) for r in kept.collect()) == [(d, n) for d in "ac" for n in (0, 1, 3)]
    assert kept.first()["input_count"] == 4 and kept.first()["output_count"] == 3
    rows = [("a", 1, 1, "title", b"x", " Top "), ("a", 1, 2, "table", b"cells", None), ("a", 1, 3, "figure", b"bad", None), ("a", 2, 1, "text", b"words", ""), ("a", 2, 2, "text", None, None), ("a", 2, 3, "isolate_formula", b"bad", None)]
    read = pages.regions_read(spark.createDataFrame([(*r[:4], bytearray(r[4]) if r[4] else None, r[5]) for r in rows], "document_id string, page_number int, reading_order int, label string, image binary, own_text string"), Reader)
    assert [r["text"] for r in read.orderBy("page_number", "reading_order").collect()] == ["Top", "table of cells", "[Figure]", "text of words", "", "[Formula could not be extracted]"]
    assert pages.pages_markdown(read).first()["markdown"].startswith("# Top\n\ntable of cells\n\n[Figure]\n\ntext of words")
    text = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, None)], "document_id string, page_number int, text string")
    assert {r["document_id"]: r["text"] for r in pages.plain_text(text).collect()} == {"a": "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo", "b": "--- Page 1 ---\n"}


class Picky:
    def complete(self, prompts):
        if any("poison" in p for p in prompts):
            raise ValueError
        return [json.dumps({"title": "t", "summary": "s", "entities": {"agents": ["Ann "], "unknown": ["x"]}}) for _ in prompts]


def test_one_bad_prompt(spark):
    chunks = spark.createDataFrame([(str(i), "poison" if i == 2 else "fine") for i in range(5)], "chunk_id string, text string").coalesce(1)
    got = {r["chunk_id"]: r for r in index.enriched(chunks, Picky).collect()}
    assert [got[str(i)]["failed"] for i in range(5)] == [False, False, True, False, False] and got["0"]["title"] == "t"
    assert got["0"]["entities"] == {"agents": ["Ann"]}


def test_chunked_dispatch(spark):
    docs = spark.createDataFrame([("d1", "a.md", "md", "# Top\nText.", None), ("d2", "b.CSV", "CSV", None, None), ("d3", "c.csv", "csv", None, None)], "id string, file_name string, file_type string, reviewed_markdown string, extracted_markdown string")
    content = spark.createDataFrame([("d2", bytearray(b"a,b\n1,x\n2,\n"))], "id string, content binary")
    for strategy in ("hierarchical", "paragraph"):
        got = index.chunked(docs, strategy, files=content).orderBy("document_id", "chunk_index").collect()
        assert {r["document_id"] for r in got} == {"d1", "d2", "d3"}
        table = [r for r in got if r["document_id"] == "d2"]
        assert [r["content_type"] for r in table] == ["summary", "schema", "paragraph", "row_batch"] and [r["chunk_index"] for r in table] == [0, 1, 2, 3]
        assert table[3]["text"] == "Columns: a, b\nRow 1: a=1, b=x\nRow 2: a=2" and table[3]["prev_chunk_id"] == table[2]["chunk_id"]
        assert [r["text"] for r in got if r["document_id"] == "d3"][1] == "[CSV parsing failed: no content]"


class Echo:
    def complete(self, prompts):
        if any("broken" in p for p in prompts):
            raise ValueError
        return [json.dumps({"document_type": p.split()[2], "summary": p.split("---\n")[1], "key_topics": ["k"]}) for p in prompts]


def test_documents_enriched(spark):
    docs = spark.createDataFrame([("d1", "a.md", "md", "m" * 7000, None), ("d2", "b.csv", "csv", None, None)], "id string, file_name string, file_type string, reviewed_markdown string, extracted_markdown string")
    content = spark.createDataFrame([("d2", bytearray(b"a,b\n1,x\n"))], "id string, content binary")
    got = {r["id"]: r for r in index.documents_enriched(docs, Echo, content).collect()}
    assert got["d1"]["document_type"] == "document" and got["d1"]["summary"] == "m" * 6000 + "\n[... content truncated ...]"
    assert got["d2"]["document_type"] == "table" and "CSV File: b.csv\nTotal rows: 1" in got["d2"]["summary"] and got["d2"]["key_topics"] == ["k"]
    lost = index.documents_enriched(docs.where("id = 'd1'").withColumn("file_name", F.lit("broken")), Echo).first()
    assert lost["document_type"] == "unknown" and lost["summary"] == "Document: broken"


def test_refined(spark):
    text = " ".join(f"Sentence {w} speaks about {w} {w} only and at some length." for w in ("water", "fire", "claims", "agents"))
    rows = [("d", 0, "a", "short", "P\n\nshort"), ("d", 1, "b", text, "P\n\n" + text)]
    got = index.refined(spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_id string, text string, contextualized_text string"), adapters.HashingEmbedder, 100).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b_0", "b_1", "b_2", "b_3"] and " ".join(r["text"] for r in got[1:]) == text
    assert all(r["contextualized_text"] == "P\n\n" + r["text"] for r in got) and [r["chunk_index"] for r in got] == [0, 1, 2, 3, 4]
    assert index._cut_up("x" * 60 + " short " + "y" * 60 + " end", [61, 67, 127]) == ["x" * 60, "short " + "y" * 60 + " end"]


class Talker:
    def complete(self, prompts):
        if any("fail" in p for p in prompts):
            raise ValueError
        return ["short" if "brief" in p else f"{p.count('Source Chunk')} " + p[-200:] + " and more words to be long enough for an answer" for p in prompts]


def test_expanded_and_synthesised(spark):
    asked = adapters.embedded(spark.createDataFrame([("a", "how do water claims work?"), ("b", "brief"), ("c", "fail")], "q string, text string").repartition(3, "q"), "text", adapters.HashingEmbedder)
    before = {r["q"]: r["vector"] for r in asked.collect()}
    for q in "abc":
        r = answers.expanded(asked.where(F.col("q") == q), Talker, adapters.HashingEmbedder).first()
        assert (r["hypothetical"] is not None) == (q == "a") and (r["vector"] == pytest.approx(before[q])) == (q != "a")
        assert sum(x * x for x in r["vector"]) == pytest.approx(1)
    found = spark.createDataFrame([("a", i, 0.0625, f"text {i}", "a.md") for i in range(1, 13)], "q string, rank int, score double, text string, file_name string")
    assert "Document: a.md\nDocument Type: N/A\n" in answers.source_text(found).first()["source"] and "Score: 0.062\n" in answers.source_text(found).first()["source"]
    got = {r["q"]: r["answer"] for r in answers.synthesised(asked, found, Talker).collect()}
    assert got["a"].startswith("10 ") and got["b"] is None and got["c"] is None


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    seen = []
    q = watch.index_stream(watch.watched(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r["file_path"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert len(seen) == 1 and seen[0].endswith("a.txt")


def test_event_windows(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    e = spark.createDataFrame([(1, t(1), 7, "a", 1.0), (2, t(50), 7, "a", 2.0), (3, t(5), 8, "b", 4.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in watch.windowed_counts(e).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert sorted((r["user_id"], r["n"]) for r in watch.sessions(e).collect()) == [(7, 1), (7, 1), (8, 1)]
