"""The semantic result cache as a table (key, query, embedding, response, document_ids, created_at, last_access)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import domain as D
from inkwell.functions import text as T
from inkwell.operators import vectors
from inkwell.session import plain_unions


def cache_key(query: Column, context: str | None = None) -> Column:
    """The key of a query or, with a context (mode, k and filters), of a query asked that way."""
    text = F.lower(F.trim(query))
    return T.short_id(text) if context is None else T.short_id(text, F.lit(context))


def lookup(cache: DataFrame, queries: DataFrame, now: Column, least: float = D.CACHE_SIMILARITY, ttl: int = D.CACHE_TTL, context: str | None = None) -> DataFrame:
    """q, key, score of the most similar entry of each query (q, vector), if it is similar enough and not too old. Age is judged on the best entry only.

    With a context only entries of that context count: an answer to the same words in another mode is none.
    """
    if context is not None:
        cache = cache.where(F.col("context") == context)
    best = vectors.top_k(cache, queries, 1, "key", "embedding")
    entry = best.join(cache.select(F.col("key").alias("id"), "created_at"), "id")
    fresh = now.cast("double") - F.col("created_at").cast("double") <= ttl
    return entry.where((F.col("score") >= least) & fresh).select("q", F.col("id").alias("key"), "score")


def evict(cache: DataFrame, most: int = D.CACHE_ENTRIES) -> DataFrame:
    """The `most` entries used last; ties to the smaller key. A top-n: only n rows a task come together."""
    return cache.orderBy(F.desc("last_access"), "key").limit(most)


def put(cache: DataFrame, entries: DataFrame, most: int = D.CACHE_ENTRIES) -> DataFrame:
    """Add or replace entries, then evict."""
    plain_unions(cache.sparkSession)
    return evict(cache.join(entries.select("key"), "key", "left_anti").unionByName(entries), most)


def invalidate(cache: DataFrame, document_id: str) -> DataFrame:
    """Without the entries that used a document."""
    return cache.where(~F.array_contains("document_ids", document_id))


def prune(cache: DataFrame, now: Column, ttl: int = D.CACHE_TTL) -> DataFrame:
    """Without the entries that are too old."""
    return cache.where(now.cast("double") - F.col("created_at").cast("double") <= ttl)
