import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from inkwell.llm import bpe  # noqa: E402


def test_stages(spark, tmp_path):
    base = [" ".join(f"w{(i * 37 + k * k) % 501}" for k in range(40)) for i in range(30)]
    rows = [(i, base[i % 30], "en", f"s{i % 3}", len(base[i % 30])) for i in range(45)]  # 15 exact copies
    rows += [(100 + i, base[i] + " tail", "en", "s0", 1) for i in range(5)]  # near copies
    rows += [(200 + i, "SHOUT!! " * (20 + i), "en", "s1", 1) for i in range(8)] + [(None, None, None, None, None), (300, "", None, None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if r[0] >= 200 else 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        seen.append(docs.collect())
    good, distinct, unlike, mixed, coded = seen
    assert {r["doc_id"] for r in good} >= set(range(45)) | set(range(100, 105)) and not any((r["text"] or "").startswith("SHOUT") for r in good)
    assert len({r["text"] or "" for r in good}) == len(distinct)
    assert {r["doc_id"] for r in distinct if r["text"] in base} == set(range(15, 45))
    assert not {100 + i for i in range(5)} & {r["doc_id"] for r in unlike}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in unlike}
    assert len(coded) == len(mixed)
    text = {r["doc_id"]: r["text"] for r in mixed}
    codec = bpe.Codec(bpe.public_vocabulary())
    assert all(r["ids"] == b"".join(codec.encode([text[r["doc_id"]]])[0]) for r in coded)
    assert corpus_pipeline.run(spark, d).count() == len(coded)


def words(n, seed):
    return " ".join(f"{seed}{i}" for i in range(n))


def test_stages_with_repeated_ids(spark, tmp_path):
    """Null and repeated ids, clashing extra columns: what each stage keeps, against the same by definition."""
    near = lambda k: words(40, "w") + f" tail{k}"
    rows = [(3, near(0)), (5, words(30, "b")), (5, near(1)), (None, near(2)), (None, words(25, "n")), (7, words(30, "b")), (5, words(30, "b")), (None, words(25, "n")), (8, ""), (8, None), (9, " ")]
    d = str(tmp_path)
    extra = "x'extra' AS row, 1 AS size, 'k' AS kept, 2 AS component, 3 AS text_hash, 'm' AS own_id"
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", extra.replace("x'", "'").split(", ")[0], *extra.split(", ")[1:])
    exact = corpus_pipeline.distinct_documents(spark, docs, d)
    assert exact.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in exact.collect()), key=str) == sorted([(3, near(0)), (5, near(1)), (None, near(2)), (None, words(25, "n")), (7, words(30, "b")), (8, ""), (9, " ")], key=str)
    unlike = corpus_pipeline.unlike_documents(spark, docs, d)
    assert unlike.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in unlike.collect()), key=str) == sorted([(3, near(0)), (5, words(30, "b")), (None, words(25, "n")), (8, ""), (8, None), (9, " ")], key=str)
    mixed = corpus_pipeline.mixed_documents(spark, unlike, d)
    assert mixed.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(3, near(0)), (5, words(30, "b")), (None, words(25, "n"))}
    coded = corpus_pipeline.encoded_documents(spark, docs, d).collect()
    assert len(coded) == len(rows)


def test_stages_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0
