"""Indexing: chunks -> enrichment -> context -> vectors and postings; each step is a table of its own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import domain as D
from inkwell.functions import text as T
from inkwell.operators import bm25, chunking, filters
from inkwell.plans import adapters
from inkwell.sources import tabular
from inkwell.sources.files import is_tabular

REPLY = "title string, summary string, keywords array<string>, category string, questions array<string>, entities map<string,array<string>>"

DOCUMENT_REPLY = "document_type string, summary string, entities map<string,array<string>>, key_topics array<string>, table_descriptions array<string>"
PROMPT_LENGTH = 6000


def enriched(chunks: DataFrame, make: Callable[[], adapters.LanguageModel]) -> DataFrame:
    """chunk_id, title, summary, keywords (10), category, questions (5), entities (known keys) of each chunk; unknown categories become null.

    A chunk whose reply doesn't parse has nulls, and failed says so.
    """
    prompt = F.concat(F.lit("Describe this chunk as JSON.\n---\n"), F.substring("text", 1, 3000))
    got = adapters.completed(chunks, prompt, make).withColumn("r", adapters.parse_json(F.col("reply"), REPLY))
    category = F.lower(F.trim("r.category"))
    return got.select("chunk_id", "r.title", "r.summary", F.slice("r.keywords", 1, 10).alias("keywords"), F.when(category.isin(*D.CHUNK_CATEGORIES), category).alias("category"), F.slice("r.questions", 1, 5).alias("questions"), filters.clean_entities(F.col("r.entities"), list(D.ENTITY_KEYS)).alias("entities"), F.col("r.title").isNull().alias("failed"))


def documents_enriched(documents: DataFrame, make: Callable[[], adapters.LanguageModel], files: DataFrame | None = None) -> DataFrame:
    """id, document_type, summary, entities, key_topics, table_descriptions of each document; `unknown` and its name where the model fails.

    A prompt holds the first PROMPT_LENGTH characters of the markdown or, with files (id, content), of a tabular file's description.
    """

    @F.pandas_udf("string")
    def described(kind: pd.Series, content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(t for t, k, _ in tabular.pieces(x, None if c is None else bytes(c), n, None) if k == "paragraph") for x, c, n in zip(kind, content, name, strict=True)], dtype=object)

    kind = F.lower("file_type")
    is_table = F.coalesce(is_tabular(kind), F.lit(False)) if files is not None else F.lit(False)
    texts = documents.where(~is_table).select("id", "file_name", kind.alias("kind"), F.lit("document").alias("what"), T.chosen_markdown(F.col("reviewed_markdown"), F.col("extracted_markdown")).alias("t"))
    if files is not None:
        tables = documents.where(is_table).join(files.select("id", "content"), "id", "left")
        texts = texts.unionByName(tables.select("id", "file_name", kind.alias("kind"), F.lit("table").alias("what"), described(kind, F.col("content"), F.col("file_name")).alias("t")))
    shown = F.concat(F.substring("t", 1, PROMPT_LENGTH), F.when(F.length("t") > PROMPT_LENGTH, "\n[... content truncated ...]").otherwise(""))
    prompt = F.concat(F.lit("Describe this "), "what", F.lit(" as JSON with document_type, summary, entities, key_topics and table_descriptions.\nFile: "), "file_name", F.lit(" ("), "kind", F.lit(")\n---\n"), F.coalesce(shown, F.lit("")))
    got = adapters.completed(texts, prompt, make).withColumn("r", adapters.parse_json(F.col("reply"), DOCUMENT_REPLY))
    summary = F.coalesce("r.summary", F.concat(F.lit("Document: "), "file_name"))
    return got.select("id", F.coalesce("r.document_type", F.lit("unknown")).alias("document_type"), summary.alias("summary"), "r.entities", "r.key_topics", "r.table_descriptions")


def contextualised(chunks: DataFrame, metadata: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with contextualized_text: document, section, the neighbours' summaries, then the text."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = chunks.join(metadata.select("chunk_id", "summary"), "chunk_id", "left").join(documents.select(F.col("id").alias("document_id"), "file_name", "detected_doc_type"), "document_id", "left")
    rows = rows.withColumn("_before", F.lag("summary").over(w)).withColumn("_after", F.lead("summary").over(w))
    heading = F.col("heading_path") if "heading_path" in chunks.columns else F.lit(None).cast("string")
    none = F.create_map().cast("map<string,string>")
    prefix = T.context_prefix(F.col("file_name"), F.coalesce("detected_doc_type", F.lit("unknown")), heading, none, F.col("_before"), F.col("_after"), F.lit(None).cast("string"))
    return rows.withColumn("contextualized_text", F.concat(prefix, F.lit("\n\n"), F.col("text"))).drop("_before", "_after", "summary", "file_name", "detected_doc_type")


def vector_rows(chunks: DataFrame, metadata: DataFrame, make: Callable[[], adapters.Embedder]) -> DataFrame:
    """id, chunk_id, vector_type, source_text, vector: main, summary and question vectors in one pass of the model."""
    q = metadata.select("chunk_id", F.posexplode("questions").alias("n", "t"))
    parts = (
        chunks.select(F.col("chunk_id").alias("id"), "chunk_id", F.lit("main").alias("vector_type"), F.col("contextualized_text").alias("t"))
        .unionByName(metadata.where(F.length("summary") > 0).select(F.concat("chunk_id", F.lit("_summary")).alias("id"), "chunk_id", F.lit("summary").alias("vector_type"), F.col("summary").alias("t")))
        .unionByName(q.select(F.concat(F.lit("q_"), "chunk_id", F.lit("_"), "n").alias("id"), "chunk_id", F.lit("question").alias("vector_type"), "t"))
    )
    return adapters.embedded(parts, "t", make).select("id", "chunk_id", "vector_type", F.substring("t", 1, 200).alias("source_text"), "vector")


def keyword_index(chunks: DataFrame, metadata: DataFrame, expand: bool = True) -> bm25.Index:
    """BM25 over title, summary, keywords and text."""
    rows = chunks.join(metadata.select("chunk_id", "title", "summary", "keywords"), "chunk_id", "left")
    text = F.concat_ws(" ", "title", "summary", F.array_join("keywords", " "), "text")
    return bm25.build(rows, "chunk_id", text, expand)


def tabular_chunks(documents: DataFrame, files: DataFrame, id_column: str = "id") -> DataFrame:
    """Chunks of CSV and spreadsheet documents (id, file_name, file_type, perhaps summary) from the content of files (id, content).

    A file is read in one Python call, so the largest one must fit into a worker's memory.
    """

    @F.pandas_udf("array<struct<text:string,content_type:string,heading_path:string>>")
    def run(kind: pd.Series, content: pd.Series, name: pd.Series, summary: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("text", "content_type", "heading_path"), p, strict=True)) for p in tabular.pieces(k, None if c is None else bytes(c), n, s)] for k, c, n, s in zip(kind, content, name, summary, strict=True)])

    summary = F.col("summary") if "summary" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col(id_column).alias("document_id"), F.lower("file_type").alias("_kind"), "file_name", summary.alias("_summary")).join(files.select(F.col("id").alias("document_id"), "content"), "document_id", "left")
    out = rows.select("document_id", F.posexplode(run("_kind", "content", "file_name", "_summary")).alias("chunk_index", "piece"))
    return out.select("document_id", "chunk_index", T.short_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "piece.*")


def chunked(documents: DataFrame, strategy: str = "hierarchical", id_column: str = "id", files: DataFrame | None = None) -> DataFrame:
    """Chunks of the chosen markdown of documents, with neighbour links.

    With files (id, content), documents whose file_type is tabular are chunked from their content instead.
    """
    if files is not None:
        kind = F.coalesce(is_tabular(F.lower("file_type")), F.lit(False))
        tables = chunking.linked(tabular_chunks(documents.where(kind), files, id_column))
        return chunked(documents.where(~kind), strategy, id_column).unionByName(tables, allowMissingColumns=True)
    text = T.chosen_markdown(F.col("reviewed_markdown"), F.col("extracted_markdown"))
    rows = documents.select(F.col(id_column).alias("doc_id"), text.alias("markdown"))
    if strategy == "hierarchical":
        return chunking.linked(chunking.hierarchical_chunks(rows))
    if strategy == "paragraph":
        return chunking.linked(chunking.paragraph_chunks(rows, text_column="markdown"))
    raise ValueError(f"unknown strategy {strategy}")


def _cut_up(text: str, breaks: list[int], least: int = 50) -> list[str]:
    """Pieces of `least` characters or more between breaks; a shorter one goes with the next, the last with the one before, so that no text is lost."""
    edges = [0]
    for b in breaks:
        if len(text[edges[-1] : b].strip()) >= least:
            edges.append(b)
    if len(edges) > 1 and len(text[edges[-1] :].strip()) < least:
        edges.pop()
    return [text[a:z].strip() for a, z in zip(edges, [*edges[1:], len(text)], strict=True)]


def refined(chunks: DataFrame, make: Callable[[], adapters.Embedder], size: int = chunking.MAX_CHUNK, threshold: float = 0.72) -> DataFrame:
    """Chunks with those over `size` cut where neighbouring sentences are unlike; numbered and linked anew, with similarities.

    A piece is `id_n`, keeps the chunk's other columns and, of a contextualized_text, what stands before the text.
    """
    long = chunks.where(F.length("text") > size).select("chunk_id", "text")
    parts = chunking.exploded(long, "text", lambda t: [{"s": s, "a": a} for s, a, _ in chunking.sentences(t)], "struct<s:string,a:int>")
    parts = adapters.embedded(parts.select(F.col("chunk_id").alias("id"), F.col("piece_index").alias("n"), "piece.s", "piece.a"), "s", make)
    # a break is the start of the next sentence
    breaks = chunking.breakpoints(parts.withColumn("end", F.lead("a").over(Window.partitionBy("id").orderBy("n"))), threshold)

    @F.pandas_udf("array<string>")
    def run(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([[t] if b is None else _cut_up(t, list(b)) for t, b in zip(text, at, strict=True)])

    rows = chunks.join(breaks.withColumnRenamed("id", "chunk_id"), "chunk_id", "left").withColumn("_pieces", run("text", "breaks"))
    rows = rows.select("*", F.posexplode("_pieces").alias("_n", "_piece")).withColumn("_cut", F.size("_pieces") > 1)
    if "contextualized_text" in chunks.columns:
        at = F.expr("locate(text, contextualized_text)")
        moved = F.concat(F.when(at > 1, F.expr("substring(contextualized_text, 1, locate(text, contextualized_text) - 1)")).otherwise(""), F.col("_piece"))
        rows = rows.withColumn("contextualized_text", F.when(F.col("_cut"), moved).otherwise(F.col("contextualized_text")))
    rows = chunking.numbered(rows.withColumnRenamed("chunk_index", "_old"), "document_id", ["_old", "_n"]).drop("_old", "batch")
    rows = rows.withColumn("chunk_id", F.when(F.col("_cut"), F.concat_ws("_", "chunk_id", "_n")).otherwise(F.col("chunk_id"))).withColumn("text", F.col("_piece"))
    out = chunking.linked(rows.drop("_pieces", "_n", "_piece", "_cut", "breaks"))
    return chunking.boundaries(adapters.embedded(out, "text", make), threshold).drop("vector")
