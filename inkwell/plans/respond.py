"""Responses to a batch of queries: cache, understanding, filters, search, answers, sources, and the cache written back."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import cache, fusion
from inkwell.plans import adapters, answers, search

CACHE = "key string, context string, query string, embedding array<double>, response string, document_ids array<string>, created_at timestamp, last_access timestamp"
MODES = ("auto", "retrieval", "synthesis")


@dataclass(frozen=True)
class Models:
    """Makers of the models that a response needs; `scorer` re-ranks where it is given, `hyde` widens queries."""

    embedder: Callable[[], adapters.Embedder]
    language: Callable[[], adapters.LanguageModel]
    scorer: Callable[[], adapters.PairScorer] | None = None
    hyde: bool = False
    diverse: bool = False


def context_of(mode: str, k: int, doc_type: str | None, entities: dict[str, str] | None) -> str:
    """What, beside its words, makes a query another one."""
    return json.dumps([mode, k, doc_type, sorted((entities or {}).items())])


def _found(corpus: search.Corpus, documents: DataFrame, asked: DataFrame, models: Models, k: int, doc_type: str | None, entities: dict[str, str] | None, entity_rows: DataFrame | None) -> DataFrame:
    """The search for queries with `wanted`, the type of document that each asks for: one search for each of the known types in the batch."""
    wanted = [doc_type] if doc_type else sorted((r["wanted"] for r in asked.select("wanted").distinct().collect()), key=str)  # at most one row for each known type
    parts = []
    for t in wanted:
        own = asked if doc_type else asked.where(F.col("wanted").eqNullSafe(t))
        allowed = search.allowed_chunks(corpus.chunks, documents, t, entities, entity_rows)
        parts.append(search.search(corpus, own, k, allowed, hyde=(models.language, models.embedder) if models.hyde else None, scorer=models.scorer, diverse=models.diverse))
    return reduce(DataFrame.unionByName, parts)


def respond(corpus: search.Corpus, documents: DataFrame, entries: DataFrame, queries: DataFrame, models: Models, now: Column, mode: str = "auto", k: int = 10, doc_type: str | None = None, entities: dict[str, str] | None = None, entity_rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, cache) for queries (q, text); documents: id, file_name, detected_doc_type.

    A response: q, tier (cache, retrieval or synthesis), cache_hit, answer, results (rank, id, document_id, score, highlights),
    sources (document_id, chunks_used in order of their first rank), total_results. A query whose words are near a fresh entry's of the
    same mode, k and filters gets that entry; others are searched and, in synthesis mode or where auto finds the need, answered. All
    of them go into the cache.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    context = context_of(mode, k, doc_type, entities)
    asked = adapters.embedded(queries.select("q", "text"), "text", models.embedder)
    hits = cache.lookup(entries, asked, now, context=context).join(entries.select("key", "response"), "key").select("q", "response")
    low = F.lower("text")
    need = F.lit(mode == "synthesis") if mode != "auto" else T.needs_synthesis(low)
    todo = asked.join(hits, "q", "left_anti").withColumn("need", need).withColumn("wanted", T.doc_type(low))
    shape = "struct<tier:string,answer:string,results:array<struct<rank:int,id:string,document_id:string,score:double,highlights:array<string>>>,sources:array<struct<document_id:string,chunks_used:bigint>>,total_results:int>"
    old = hits.select("q", F.from_json("response", shape).alias("r"), F.lit(True).alias("cache_hit"))
    if todo.isEmpty():
        made = None
    else:
        found = _found(corpus, documents, todo, models, k, doc_type, entities, entity_rows)
        about = found.join(documents.select(F.col("id").alias("document_id"), "file_name", "detected_doc_type"), "document_id", "left").withColumnRenamed("chunk_text", "text")
        answered = answers.synthesised(todo.where("need"), about, models.language)
        row = F.struct(F.col("rank").cast("int").alias("rank"), F.col("id").cast("string").alias("id"), F.col("document_id").cast("string").alias("document_id"), F.col("score").cast("double").alias("score"), "highlights")
        results = found.groupBy("q").agg(F.array_sort(F.collect_list(row)).alias("results"))
        used = fusion.sources_rollup(found.select("q", "document_id", "id", "rank"))
        place = F.struct("first_rank", F.col("document_id").cast("string").alias("document_id"), "chunks_used")
        sources = used.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: F.struct(x["document_id"].alias("document_id"), x["chunks_used"].alias("chunks_used"))).alias("sources"))
        rows = todo.join(results, "q", "left").join(sources, "q", "left").join(answered, "q", "left")
        total = F.coalesce(F.array_size("results"), F.lit(0))
        tier = F.when(F.col("need") & (total > 0), "synthesis").otherwise("retrieval")
        none = lambda c, of: F.coalesce(F.col(c), F.from_json(F.lit("[]"), of))
        fields = [x.split(":", 1)[1] for x in ("results:array<struct<rank:int,id:string,document_id:string,score:double,highlights:array<string>>>", "sources:array<struct<document_id:string,chunks_used:bigint>>")]
        made = rows.select("q", "text", "vector", F.struct(tier.alias("tier"), F.col("answer"), none("results", fields[0]).alias("results"), none("sources", fields[1]).alias("sources"), total.alias("total_results")).alias("r"), F.lit(False).alias("cache_hit"))
    every = old if made is None else old.unionByName(made.select("q", "r", "cache_hit"))
    out = every.select("q", F.when(F.col("cache_hit"), "cache").otherwise(F.col("r.tier")).alias("tier"), "cache_hit", "r.answer", "r.results", "r.sources", "r.total_results")
    if made is None:
        return out, entries
    new = made.select(
        cache.cache_key(F.col("text"), context).alias("key"), F.lit(context).alias("context"), F.col("text").alias("query"), F.col("vector").cast("array<double>").alias("embedding"), F.to_json("r").alias("response"),
        F.transform("r.sources", lambda x: x["document_id"]).alias("document_ids"), now.cast("timestamp").alias("created_at"), now.cast("timestamp").alias("last_access"),
    ).dropDuplicates(["key"])
    return out, cache.put(entries, new)
