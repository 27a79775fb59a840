"""Language-model steps around a search: hypothetical answers that widen queries, and answers from what was found."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.plans import adapters

#: A hypothetical answer counts from this length on; found chunks that an answer is made from.
LEAST_ANSWER, SOURCES = 50, 10


def expanded(asked: DataFrame, make_model: Callable[[], adapters.LanguageModel], make_embedder: Callable[[], adapters.Embedder]) -> DataFrame:
    """Queries (q, text, vector) with vector blended with a hypothetical answer's, and hypothetical; where the model fails or says 50 characters or less, the vector stays and hypothetical is null."""
    prompt = F.concat(F.lit("Write a detailed paragraph (150-250 words) that would be found in a document answering this question. State facts, without any preamble.\n---\n"), "text")
    reply = F.trim("_reply")
    rows = adapters.completed(asked, prompt, make_model, "_reply").withColumn("hypothetical", F.when(F.length(reply) > LEAST_ANSWER, reply)).drop("_reply")
    rows = adapters.embedded(rows, "hypothetical", make_embedder, "_other")
    blended = V.blend(F.col("vector"), F.col("_other"), T.adaptive_alpha(F.col("text")))
    return rows.withColumn("vector", F.when(F.col("hypothetical").isNotNull(), blended).otherwise(F.col("vector").cast("array<double>"))).drop("_other")


def source_text(found: DataFrame) -> DataFrame:
    """found (q, rank, score, text, and where there are any file_name, detected_doc_type, heading_path, temporal_context, keywords, entities) with source: the chunk as a model reads it."""

    @F.pandas_udf("string")
    def three_places(s: pd.Series) -> pd.Series:
        # ties go to even, which Spark's format_string doesn't do
        return s.map("{:.3f}".format)

    have = lambda c, kind: F.col(c) if c in found.columns else F.lit(None).cast(kind)
    shown = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.when(have(c, "string") != "", have(c, "string")), F.lit("N/A")), F.lit("\n"))
    words, entities = have("keywords", "array<string>"), have("entities", "map<string,string>")
    info = F.array_join(F.transform(F.slice(F.map_entries(entities), 1, 5), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return found.withColumn("source", F.concat(
        F.lit("\n--- Source Chunk "), F.col("rank").cast("string"), F.lit(" ---\n"), shown("Document", "file_name"), shown("Document Type", "detected_doc_type"), shown("Section/Heading", "heading_path"),
        F.lit("Relevance Score: "), three_places(F.col("score").cast("double")), F.lit("\n"), shown("Temporal Context", "temporal_context"), F.lit("Content:\n"), F.coalesce("text", F.lit("")), F.lit("\n"),
        F.when(F.size(words) > 0, F.concat(F.lit("Keywords: "), F.array_join(words, ", "), F.lit("\n"))).otherwise(""),
        F.when(F.size(entities) > 0, F.concat(F.lit("Key Info: "), info, F.lit("\n"))).otherwise(""),
    ))


def synthesised(asked: DataFrame, found: DataFrame, make: Callable[[], adapters.LanguageModel], most: int = SOURCES) -> DataFrame:
    """q, answer: a model's answer to each query (q, text) from its first `most` found chunks by rank; null where it fails or nothing was found."""
    parts = source_text(found.where(F.col("rank") <= most)).groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), "\n").alias("_sources"))
    rules = "Answer the user's question using ONLY the search results below. Cite the clause, section or heading for each claim, never a result's number. If no result answers it, say: No exact match was found for this query."
    prompt = F.concat(F.lit(f"{rules}\n\nQUESTION: "), "text", F.lit("\n\nSEARCH RESULTS:\n---\n"), "_sources")
    got = adapters.completed(asked.select("q", "text").join(parts, "q"), prompt, make)
    answer = F.trim("reply")
    return asked.select("q").join(got.select("q", F.when(answer != "", answer).alias("answer")), "q", "left")
