"""The best k of blocks of scores, against sorting them all, and the memory it takes."""

import os
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from inkwell.functions import domain as D
from inkwell.functions import text as T
from inkwell.operators import bm25, topk, vectors


@pytest.mark.parametrize("kind", [int, str])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_is_that_of_a_sort(kind, k):
    rng = np.random.default_rng(k)
    scores = np.round(rng.normal(size=(7, 60)), 1)  # many ties
    scores[:, :2] += 4e-13  # equal once rounded
    scores[2, 5] = np.nan
    valid = rng.random((7, 60)) < 0.6
    valid[3] = False
    ids = np.array([kind(x) for x in rng.permutation(60)], dtype=object if kind is str else np.int64)
    best = topk.Best(7, k, 12)
    for at in range(0, 60, 17):
        for q in range(0, 7, 3):
            best.add(q, scores[q : q + 3, at : at + 17], ids[at : at + 17], valid[q : q + 3, at : at + 17])
    got = list(zip(*(x.tolist() for x in best.rows()), strict=True))
    want = []
    for q in range(7):
        found = sorted((not np.isnan(s), -s if s == s else 0, i) for s, i, v in zip(np.round(scores[q], 12), ids, valid[q], strict=True) if v)
        want += [(q, i) for _, _, i in found[:k]]
    assert [g[:2] for g in got] == want


def test_a_worker_holds_few_scores(spark, monkeypatch):
    """6000 queries against batches of 10,000 rows: 60 million products, of which a worker holds some 8 MB at once."""
    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(6000, 4)).tolist())], "q long, vector array<double>")
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "id long, vector array<double>")
    made = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, fn, schema: made.append(fn) or self.selectExpr("id AS q", "id", "0D AS score"))
    vectors.top_k(df, q, 5)
    rows = [pd.DataFrame({"id": np.arange(a, a + 10000), "vector": list(rng.normal(size=(10000, 4)))}) for a in (0, 10000)]
    tracemalloc.start()
    got = pd.concat(made[0](iter(rows)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert len(got) == 6000 * 5  # of both batches together


@pytest.mark.parametrize("twice", [False, True])
def test_bm25_of_whole_texts(spark, twice):
    """The k best found without postings are those of the postings, keywords and all; rows of one id still meet."""
    rng = np.random.default_rng(5)
    words = ["running", "runs", "runner", "the", "a", "x", "Tables", "table,", "été", "b2b", "snake_case", "nations", "national", "q r", "zz\u001czz", "٣٤", "ness", "ings"]
    docs = [(str(i), " ".join([*rng.choice(words, int(rng.integers(0, 5))).tolist(), f"own{i}"])) for i in range(300)] + [("300", ""), ("301", None), (None, "running")]
    docs += [("7", "running été")] * twice
    asked = spark.createDataFrame([("p", "running running tables b2b"), ("n", "national été snake_case the"), ("z", "nothing of it"), ("e", ""), ("s", "zz 34 ٣٤ q r rr")], "q string, text string")
    made = bm25.build(spark.createDataFrame(docs, "id string, text string"), "id", F.col("text"))
    got = bm25.score(made, asked, 20, keywords=True)
    want = bm25.score(bm25.Index(made.postings, made.lengths, made.terms), asked, 20, keywords=True)
    assert ("Generate" in got._jdf.queryExecution().optimizedPlan().toString()) == twice  # words are not rows
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 9), r["keywords"]) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 40
    assert [r[:3] for r in rows(bm25.score(made, asked, 3, keywords=True))] == [r[:3] for r in rows(want) if r[1] <= 3]
    none = bm25.build(spark.createDataFrame([], "id string, text string"), "id", F.col("text"))
    assert bm25.score(none, asked, 3).count() == 0


def test_texts_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch):
    """A file's only row group is read by one task; its texts are counted by all cores, those that lie evenly stay. The best are those of the postings."""
    rng = np.random.default_rng(7)
    words = np.array(["run", "table", "nation", "part", "order", "étude", "b2b"])
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 6, 4000)]
    pq.write_table(pa.table({"id": np.arange(4000), "text": texts}), f"{tmp_path}/t.parquet")
    asked = spark.createDataFrame([(1, "runs table"), (2, "étude orders nation")], "q long, text string")
    seen, scored = [], bm25._scored
    monkeypatch.setattr(bm25, "_scored", lambda texts, *a: seen.append(texts.groupBy(F.spark_partition_id()).count().collect()) or scored(texts, *a))
    docs = spark.read.parquet(f"{tmp_path}/t.parquet")
    made = bm25.build(docs, "id", F.col("text"))
    got = bm25.score(made, asked, 20)
    assert max(r["count"] for r in seen[0]) < 1500 and sum(r["count"] for r in seen[0]) == 4000
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(bm25.score(bm25.Index(made.postings, made.lengths, made.terms), asked, 20)) and got.count() == 40
    even = bm25.build(spark.createDataFrame(pa.table({"id": np.arange(4000), "text": texts})).repartition(8), "id", F.col("text"))
    assert rows(bm25.score(even, asked, 20)) == rows(got) and len(seen[1]) == 8


def test_texts_are_counted_once(spark, tmp_path):
    """Scores come from what the one pass over the texts kept, and nothing of it is left."""

    def read(t):
        with open(f"{tmp_path}/{os.getpid()}", "a") as f:
            f.write("x")
        return t

    left = spark.sparkContext._jsc.getPersistentRDDs().size()
    docs = spark.createDataFrame([(i, f"word{i % 7} run") for i in range(300)], "id long, text string")
    made = bm25.build(docs, "id", F.udf(read, "string")(F.col("text")))
    got = bm25.score(made, spark.createDataFrame([(1, "word3 word5"), (2, "word3")], "q long, text string"), 50)
    assert got.where("q = 2").count() == 43 and got.where("q = 1").count() == 50
    assert sum(p.stat().st_size for p in tmp_path.iterdir()) == 300
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == left
    assert bm25.score(made, spark.createDataFrame([(1, "the of"), (2, None)], "q long, text string"), 5).count() == 0


def test_a_task_hands_on_a_term_once_for_many_slices(spark, monkeypatch):
    """A task of three slices gives a row for each of its terms, not for each slice's; the best are those of the postings."""
    monkeypatch.setattr(bm25, "DEALT_ROWS", 3 * bm25.ROWS)
    docs = spark.createDataFrame([(i, f"word{i % 7} run") for i in range(2 * bm25.ROWS + 9)], "id long, text string").coalesce(1)
    seen, persist = [], type(docs).persist
    monkeypatch.setattr(type(docs), "persist", lambda df, *a: seen.append(df) or persist(df, *a))
    made = bm25.build(docs, "id", F.col("text"))
    asked = spark.createDataFrame([(1, "word3 word5"), (2, "word3")], "q long, text string")
    got, want = bm25.score(made, asked, 20), bm25.score(bm25.Index(made.postings, made.lengths, made.terms), asked, 20)
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(want) and got.count() == 40
    handed = seen[0].collect()
    assert sum(r["block"] is not None for r in handed) >= 3
    assert sum(r["term"] is not None for r in handed) == 8 and sum(r["df"] for r in handed) == 2 * docs.count()


def test_held_terms_are_bounded(monkeypatch):
    """Terms are handed on when too many are left, a slice of too long ones at once, and their documents add up."""
    monkeypatch.setattr(bm25, "HELD", 2000)
    rng = np.random.default_rng(5)
    held, want, got, most = bm25.Held(), Counter(), Counter(), 0
    slices = [[f"t{i}" for i in rng.choice(n, m, replace=False)] for n, m in [(20, 15)] * 50 + [(5000, 60)] * 50] + [["x" * 3000, "t1"], [], ["y"]]
    for terms in slices:
        df = rng.integers(1, 9, len(terms))
        want.update(dict(zip(terms, df.tolist(), strict=True)))
        for own, n in held.add(pa.array(terms, pa.string()), df):
            assert len(set(own.to_pylist())) == len(own)
            got.update(dict(zip(own.to_pylist(), n.tolist(), strict=True)))
            most += 1
        assert sum(t.nbytes for t in held.terms) <= 2000
        if len(held.terms) and terms is slices[49]:
            assert not got  # few terms are summed up and stay
    for own, n in held.rest():
        got.update(dict(zip(own.to_pylist(), n.tolist(), strict=True)))
    assert got == want and 3 < most < 50 and not held.terms
    assert not list(bm25.Held().rest())


def test_lowered_texts_have_the_words_of_cleaned_ones(spark):
    """Every character between two letters, alone and beside one that REPLACED does not judge; and null and empty texts."""
    texts = ["a" + chr(c) + "bé" + more for c in range(0x11000) if not 0xD800 <= c < 0xE000 for more in ("", " Ωx", " “q”")] + ["", None, " \t\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    rows = df.select(T.cleaned(F.col("text")).alias("clean"), T.lowered(F.col("text")).alias("low")).toArrow()
    assert [t for t, c in zip(rows["low"].to_pylist(), rows["clean"].to_pylist(), strict=True) if t != c]  # most are not cleaned in Spark
    known = pa.array(sorted({w for c in rows["clean"].to_pylist() for w in (c or "").split()}))
    got, want = (bm25._counted(rows[c].combine_chunks(), known) for c in ("low", "clean"))
    assert all((a == b).all() for a, b in zip(got[:4], want[:4], strict=True))


def test_counted_words_are_those_counted_one_by_one():
    rng = np.random.default_rng(3)
    ends = [s for s, _ in D.SUFFIXES] + ["", "é", "x"]
    words = [a + e for a in ("", "a", "été", "run", "𝒳y") for e in ends] + list(D.STOPWORDS[:9])
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 60, 200)]
    assert T.stems(pa.array(words)).to_pylist() == [T._stem(w) for w in words]
    text, term, times, length, names = bm25._counted(pa.array(texts))
    got = {(t, names[n].as_py()): k for t, n, k in zip(text.tolist(), term.tolist(), times.tolist(), strict=True)}
    want = Counter((i, T._stem(w)) for i, t in enumerate(texts) for w in t.split() if len(w) >= 2 and w not in D.STOPWORDS)
    assert got == want and length.sum() == sum(want.values())
    few = pa.array(["run", "été", "nothing"])
    text, term, times, short, _ = bm25._counted(pa.array(texts), few)
    assert {(t, few[n].as_py()): k for t, n, k in zip(text.tolist(), term.tolist(), times.tolist(), strict=True)} == {x: k for x, k in want.items() if x[1] in ("run", "été")}
    assert (short == length).all()
    assert len(bm25._counted(pa.array(["", None], pa.string()), pa.array([], pa.string()))[0]) == 0


def test_slices_are_bounded_by_bytes():
    """A batch of long texts is counted in parts, each text once; one over the limit is a part of its own."""
    texts = ["x" * n for n in (bm25.BYTES * 2, 5, bm25.BYTES - 6, 7, 0)] + [None] + ["y"] * (bm25.ROWS + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["low"])
    parts = [b.column("low").to_pylist() for b in bm25._slices(iter([batch]))]
    assert sum(parts, []) == texts and [len(p) for p in parts[:2]] == [1, 2]
    assert all(len(p) <= bm25.ROWS and (len(p) == 1 or sum(len(t or "") for t in p) <= bm25.BYTES) for p in parts)
