"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.operators import bm25
from inkwell.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in catalogue.SQL:
        rel = db.sql(catalogue.SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_search_reranked", "hybrid_search_full"])
def test_texts_stay_where_they_are(spark, name):
    """The join nearest to the chunks' texts is a broadcast of what was found; labels, large as they are, don't meet all texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    met = []
    for i in (i for i, line in enumerate(plan) if "FileScan" in line and "doc_id#" in line and "text#" in line):
        above, least = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < least:
                least = depth(line)
                above.append(line)
        nearest = next(line for line in above if "Join" in line or "MapInArrow" in line)
        met += [nearest] * ("Join" in nearest)  # BM25 scores its texts before they meet anything
    assert met and all("BroadcastHashJoin" in line for line in met)


@pytest.mark.parametrize("name", ["source_attribution", "category_boost", "rerank_minmax_blend"])
def test_fused_queries_deal_texts(spark, name, monkeypatch):
    """The documents' only row group is read by one task; all cores count its texts."""
    monkeypatch.setattr(bm25, "DEALT_ROWS", 10, raising=False)
    seen, scored = [], bm25._scored
    monkeypatch.setattr(bm25, "_scored", lambda texts, *a: seen.extend(texts.groupBy(F.spark_partition_id()).count().collect()) or scored(texts, *a))
    assert catalogue.QUERIES[name](spark, DATA).count()
    assert sum(r["count"] for r in seen) == 200 and max(r["count"] for r in seen) < 50


@pytest.mark.parametrize("name", ["category_boost", "rerank_minmax_blend"])
def test_fused_queries_hand_on_a_term_once_a_task(spark, name, monkeypatch):
    """One task counts all texts, in several slices, and gives a row for each term."""
    monkeypatch.setattr(bm25, "DEALT_ROWS", 1 << 20)
    frame = type(spark.range(0))
    seen, persist = [], frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *a: seen.append(df) or persist(df, *a))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.1").count()
    handed = seen[0].groupBy(F.spark_partition_id(), "term").agg(F.count("*").alias("rows"), F.count("block").alias("blocks")).agg(F.max(F.when(F.col("term").isNotNull(), F.col("rows"))).alias("rows"), F.max("blocks").alias("blocks")).first()
    assert handed["rows"] == 1 and handed["blocks"] > 2
