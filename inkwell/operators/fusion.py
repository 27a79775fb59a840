"""Weighted reciprocal-rank fusion, category boost, re-ranking blend and roll-ups of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import domain as D
from inkwell.session import plain_unions


def weight_of(source: Column, profile: Column) -> Column:
    """The weight of a source in a profile; an unknown profile is the default."""
    table = F.create_map(*[x for p, ws in D.WEIGHTS.items() for s, w in zip(D.SOURCES, ws, strict=True) for x in (F.lit(f"{p}:{s}"), F.lit(w))])
    return F.coalesce(F.element_at(table, F.concat_ws(":", profile, source)), F.element_at(table, F.concat(F.lit("default:"), source)))


def ranked(lists: dict[str, DataFrame]) -> DataFrame:
    """q, source, id, rank, score of several ranked lists (q, id, rank, score)."""
    plain_unions(next(iter(lists.values())).sparkSession)
    return reduce(DataFrame.unionByName, [df.select("q", F.lit(s).alias("source"), "id", "rank", "score") for s, df in lists.items()])


def rrf(lists: DataFrame, k: int = D.RRF_K, profile: Column | None = None) -> DataFrame:
    """q, id, score, rank, details (source -> rank): the sum of weight / (k + rank) over a chunk's lists.

    Ties go to the list that comes first in SOURCES, then to the better rank in it.
    """
    order = F.array_position(F.array(*map(F.lit, D.SOURCES)), F.col("source"))
    part = weight_of(F.col("source"), profile if profile is not None else F.lit("default")) / (k + F.col("rank"))
    fused = lists.groupBy("q", "id").agg(F.sum(part).alias("score"), F.min(F.struct(order.alias("o"), F.col("rank").alias("r"))).alias("first"), F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("details"))
    w = Window.partitionBy("q").orderBy(F.round("score", 12).desc(), "first", "id")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")


def category_boost(fused: DataFrame, category: Column, preferred: Column, factor: float = D.BOOST, window: int = D.BOOST_WINDOW) -> DataFrame:
    """Multiply the first `window` rows of each query whose category is preferred, and rank again."""
    boosted = F.when((F.col("rank") <= window) & F.coalesce(F.array_contains(preferred, category), F.lit(False)), F.col("score") * factor).otherwise(F.col("score"))
    w = Window.partitionBy("q").orderBy(F.round("boosted", 12).desc(), "before")
    return fused.withColumn("boosted", boosted).withColumnRenamed("rank", "before").withColumn("rank", F.row_number().over(w)).drop("score").withColumnRenamed("boosted", "score")


def rerank(rows: DataFrame, blend: float = 0.7, top_k: int = 20) -> DataFrame:
    """q, id, score from (q, id, rank, score, pair_score): the first top_k rows by blend of the pair score, scaled to 0..1 within the query (0.5 if all are equal), and the old score."""
    w = Window.partitionBy("q")
    low, high = F.min("pair_score").over(w), F.max("pair_score").over(w)
    scaled = F.when(high > low, (F.col("pair_score") - low) / (high - low)).otherwise(0.5)
    cut = rows.where(F.col("rank") <= top_k)
    out = cut.withColumn("blended", blend * scaled + (1 - blend) * F.col("score"))
    order = Window.partitionBy("q").orderBy(F.round("blended", 12).desc(), "rank")
    return out.select("q", "id", F.col("blended").alias("score"), F.row_number().over(order).alias("rank"))


def attribution(final: DataFrame, lists: DataFrame) -> DataFrame:
    """q, id, sources: which lists hold a final row (sorted, comma-joined)."""
    return final.select("q", "id").join(lists, ["q", "id"]).groupBy("q", "id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def sources_rollup(final: DataFrame) -> DataFrame:
    """q, document_id, chunks_used, chunk_ids (in rank order), first_rank from rows (q, document_id, id, rank)."""
    return final.groupBy("q", "document_id").agg(
        F.count("*").alias("chunks_used"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("chunk_ids"),
        F.min("rank").alias("first_rank"),
    )
