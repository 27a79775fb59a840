"""The registered queries of the engine and their SQL twins.

The driver's tables stand in for the engine's: `documents` rows are chunks (one each), `embeddings` are vectors with
vec_id = doc_id, `benchmark` items are query texts, nation and region form a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import domain as D
from inkwell.functions import geometry as G
from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.operators import bm25, cache, chunking, diversity, filters, fusion, layout, profile, store, tree, vectors
from inkwell.plans import adapters, search
from inkwell.sources import files
from inkwell.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL building blocks -------------------------------------------------------------------------------------------

_STOP = "[" + ",".join(T.quoted(w) for w in D.STOPWORDS) + "]"


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"instr({text}, {T.quoted(n)}) > 0" for n in needles) + ")"


_BM25_SQL = f"""
d AS (SELECT doc_id AS id, {_words('text')} AS ws FROM documents),
w AS (SELECT id, unnest(ws) AS w FROM d),
t AS (SELECT id, {T.stem_sql('w')} AS term FROM w),
p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT id, len(ws) AS dl FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
r AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term, n),
i AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM r) ELSE raw END AS idf FROM r),
qs AS (SELECT item_id AS q, {_words('text')} AS ws FROM benchmark),
qu AS (SELECT q, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM qs),
qt AS (SELECT q, pos, {T.stem_sql('w')} AS term FROM qu),
h AS (SELECT q, p.id, pos, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS part
      FROM qt JOIN i USING (term) JOIN p USING (term) JOIN l USING (id), s),
b AS (SELECT q, id, sum(part) AS score, string_agg(term, ' ' ORDER BY pos) AS keywords FROM h GROUP BY q, id HAVING sum(part) > 0),
bk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS rank FROM b)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _probes(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Query vectors: every n-th row, as the search's query set."""
    return _vectors(spark, sf_dir).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))


# --- ids, statistics, listings -------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(concat(doc_id, ':', 0))[:16] AS chunk_id, sha256(text)[:32] AS text_id FROM documents")
def chunk_ids_sha(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("doc_id", T.short_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"), F.substring(F.sha2("text", 256), 1, 32).alias("text_id"))


@query("SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def doc_stats_by_type(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("SELECT label, count(*) AS n_vectors, count(DISTINCT vec_id) AS n_chunks FROM embeddings GROUP BY label")
def vector_counts(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_vectors"), F.countDistinct("vec_id").alias("n_chunks"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 50")
def list_documents_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(100)


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview, left(text, 500) AS chunk_text FROM documents")
def chunk_previews(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"), F.substring("text", 1, 500).alias("chunk_text"))


@query("SELECT DISTINCT source AS document_id FROM documents")
def distinct_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("source").alias("document_id")).distinct()


@query("SELECT doc_id AS id, lang AS processing_status, quality AS page_count, l.doc_id IS NOT NULL AS has_layout, nullif(text, '') IS NOT NULL AS has_markdown FROM documents d LEFT JOIN labels l USING (doc_id)")
def processing_status(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("page_count"), F.lit("[]").alias("layout_data"))
    d = _documents(spark, sf_dir).join(l, "doc_id", "left")
    return store.processing_status(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("processing_status"), "page_count", "layout_data", F.nullif("text", F.lit("")).alias("extracted_markdown")))


@query("SELECT user_id AS document_id, event_id AS page_number, (event_id % 4)::INT AS n_detections, (event_id % 7)::INT AS n_unfiltered, greatest(0, event_id % 7 - event_id % 4)::INT AS n_removed FROM events")
def page_info(spark, sf_dir):
    boxes = lambda n: F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), (F.col("event_id") % n).cast("int")), ","), F.lit("]"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("page_number"), boxes(4).alias("layout"), boxes(7).alias("unfiltered_layout"))
    return store.page_info(e)


# --- tokens and BM25 -----------------------------------------------------------------------------------------------


@query(f"WITH w AS (SELECT unnest({_words('text')}) AS w FROM documents) SELECT {T.stem_sql('w')} AS term, count(*) AS n FROM w GROUP BY 1")
def tokenize_stem_counts(spark, sf_dir):
    w = T.exploded_words(_documents(spark, sf_dir), F.col("text")).groupBy("w").agg(F.count("*").alias("n"))
    return w.groupBy(T.stem(F.col("w")).alias("term")).agg(F.sum("n").alias("n"))


@query(f"WITH d AS (SELECT doc_id, {_words('text')} AS ws FROM documents) SELECT doc_id, len(ws) AS dl, len(list_distinct(ws)) AS n_distinct FROM d")
def document_lengths(spark, sf_dir):
    w = _documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("ws"))
    return w.select("doc_id", F.size("ws").cast("long").alias("dl"), F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"))


@query(f"WITH {_BM25_SQL} SELECT q, id, rank, round(score, 6) AS score FROM bk WHERE rank <= 30")
def bm25_topk(spark, sf_dir):
    ix = bm25.build(_documents(spark, sf_dir), "doc_id", F.col("text"))
    return bm25.score(ix, _asked(spark, sf_dir), 30).select("q", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25_SQL} SELECT q, id, rank, keywords FROM bk WHERE rank <= 10")
def bm25_matched_keywords(spark, sf_dir):
    ix = bm25.build(_documents(spark, sf_dir), "doc_id", F.col("text"))
    hits = bm25.score(ix, _asked(spark, sf_dir), 10, keywords=True)
    return hits.select("q", "id", F.col("rank").cast("long").alias("rank"), F.array_join("keywords", " ").alias("keywords"))


def _list(words) -> str:
    return "[" + ", ".join(T.quoted(w) for w in words) + "]"


def _case(column: str, table: dict[str, list[str]]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {T.quoted(k)} THEN {_list(dict.fromkeys(v))}" for k, v in table.items()) + " ELSE []::VARCHAR[] END"


_ACRONYM_WORDS = {a: [w for w in v.split() if len(w) >= 2 and w not in D.STOPWORDS] for a, v in D.ACRONYMS.items()}
_ACRONYM_SQL = f"CASE x[1] " + " ".join(f"WHEN {T.quoted(k)} THEN {_list(v) if v else '[]::VARCHAR[]'}" for k, v in _ACRONYM_WORDS.items()) + " END"


# a running list of terms; each step sees one word x[1] and its stem x[2]
@query(f"""WITH w AS (SELECT item_id, list_transform({_words('text')}, lambda w: [w, {T.stem_sql('w')}]) AS ws FROM benchmark)
    SELECT item_id, array_to_string(list_reduce(ws, lambda acc, x: CASE WHEN x[1] IN ({', '.join(map(T.quoted, D.ACRONYMS))}) THEN list_concat(acc, {_ACRONYM_SQL})
    ELSE list_concat(list_concat(acc, [x[2]]), list_filter({_case('x[2]', {k: [T._stem(w) for w in v] for k, v in D.SYNONYMS.items()})}, lambda m: NOT list_contains(list_concat(acc, [x[2]]), m))) END, []::VARCHAR[]), ' ') AS terms FROM w""")
def tokens_expanded(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.analyse(F.col("text")), " ").alias("terms"))


# --- vectors -------------------------------------------------------------------------------------------------------


def _vector_sql(every: int, k: int, where: str = "true") -> str:
    return f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, round({_dot('a.embedding', 'b.embedding')}, 12) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % {every} = 0 AND {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)
    SELECT q, id, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _out(df: DataFrame) -> DataFrame:
    return df.select("q", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_vector_sql(50, 30))
def vector_topk(spark, sf_dir):
    return _out(vectors.top_k(_vectors(spark, sf_dir), _probes(spark, sf_dir, 50), 30, "vec_id", "embedding"))


@query(_vector_sql(50, 10))
def vector_topk_batch(spark, sf_dir):
    return _out(vectors.top_k(_vectors(spark, sf_dir), _probes(spark, sf_dir, 50), 10, "vec_id", "embedding"))


@query(_vector_sql(50, 10, "b.label IN (1, 3)"))
def vector_topk_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    allowed = v.where(F.col("label").isin(1, 3)).select(F.col("vec_id").alias("id"))
    return _out(vectors.top_k(v, _probes(spark, sf_dir, 50), 10, "vec_id", "embedding", allowed))


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id // 4 AS chunk, b.vec_id AS v, round({_dot('a.embedding', 'b.embedding')}, 12) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, v) AS n FROM s),
    c AS (SELECT q, chunk AS id, max(score) AS score FROM r WHERE n <= 40 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM c)
    SELECT q, id, rank, round(score, 6) AS score FROM o WHERE rank <= 20""")
def multi_vector_dedupe(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = vectors.top_k(v, _probes(spark, sf_dir, 50), 40, "vec_id", "embedding")
    return _out(vectors.best_per_chunk(found.select("q", F.floor(F.col("id") / 4).alias("chunk_id"), "score"), 20))


@query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x, lead(embedding) OVER (ORDER BY vec_id)::DOUBLE[] AS y FROM embeddings),
    b AS (SELECT vec_id, list_transform(list_zip(x, y), lambda p: 0.6 * p[1] + 0.4 * p[2]) AS z FROM a WHERE y IS NOT NULL)
    SELECT vec_id, round(z[1] / sqrt(list_inner_product(z, z)), 6) AS first, round(sqrt(list_inner_product(z, z)), 6) AS length FROM b""")
def hyde_blend(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    z = F.zip_with("embedding", "other", lambda a, b: 0.6 * a.cast("double") + 0.4 * b.cast("double"))
    mixed = pairs.select("vec_id", V.blend(F.col("embedding"), F.col("other"), F.lit(0.4)).alias("m"), V.norm(z).alias("n"))
    return mixed.select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round("n", 6).alias("length"))


@query(f"""WITH a AS (SELECT item_id, lower(text) AS q FROM benchmark), n AS (SELECT item_id, q, len(string_split_regex(trim(q), '\\s+')) AS n FROM a)
    SELECT item_id, (CASE WHEN n <= 3 THEN 0.3 WHEN trim(q) LIKE '%?' AND n <= 8 THEN 0.45 WHEN n <= 10 THEN 0.48 ELSE 0.6 END)::DOUBLE AS alpha FROM n""")
def adaptive_alpha(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(T.adaptive_alpha(F.lower("text")), 6).alias("alpha"))


# --- fusion --------------------------------------------------------------------------------------------------------

_LISTS_SQL = f"""
v AS (SELECT b.item_id AS q, e.vec_id AS id, round({_dot('p.embedding', 'e.embedding')}, 12) AS score
      FROM benchmark b JOIN embeddings p ON p.vec_id = b.item_id, embeddings e),
vk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM v),
lists AS (SELECT q, 'main_vector' AS source, id, rank FROM vk WHERE rank <= 30 UNION ALL SELECT q, 'bm25', id, rank FROM bk WHERE rank <= 30),
f AS (SELECT q, id, sum(CASE source WHEN 'bm25' THEN 0.25 ELSE 0.40 END / (30 + rank)) AS score,
      min(CASE source WHEN 'bm25' THEN 1000000 ELSE 0 END + rank) AS first, string_agg(source || '=' || rank, ',' ORDER BY source) AS details,
      string_agg(source, ',' ORDER BY source) AS sources FROM lists GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first, id) AS rank FROM f)
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main-vector and BM25 lists of the benchmark queries; a query's vector is that of its own number."""
    v = _vectors(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    probes = asked.join(v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), "q")
    ix = bm25.build(_documents(spark, sf_dir), "doc_id", F.col("text"))
    return fusion.ranked({"main_vector": vectors.top_k(v, probes, 30, "vec_id", "embedding"), "bm25": bm25.score(ix, asked, 30)})


@query(f"WITH {_BM25_SQL}, {_LISTS_SQL} SELECT q, id, rank, round(score, 9) AS score, details FROM fr WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    f = fusion.rrf(_lists(spark, sf_dir)).where("rank <= 20")
    details = F.array_join(F.transform("details", lambda x: F.concat_ws("=", x["source"], x["rank"].cast("string"))), ",")
    return f.select("q", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), details.alias("details"))


@query(f"WITH {_BM25_SQL}, {_LISTS_SQL} SELECT q, id, sources FROM fr WHERE rank <= 20")
def source_attribution(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return fusion.attribution(fusion.rrf(lists).where("rank <= 20"), lists)


@query(f"""WITH {_BM25_SQL}, {_LISTS_SQL},
    m AS (SELECT fr.*, CASE WHEN fr.rank <= 50 AND quality = 1 THEN fr.score * 1.3 ELSE fr.score END AS boosted FROM fr LEFT JOIN labels ON doc_id = id),
    o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(boosted, 12) DESC, rank) AS n FROM m)
    SELECT q, id, n AS rank, round(boosted, 9) AS score FROM o WHERE n <= 10""")
def category_boost(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("category"))
    f = fusion.rrf(_lists(spark, sf_dir)).join(l, "id", "left")
    b = fusion.category_boost(f, F.col("category"), F.array(F.lit(1))).where("rank <= 10")
    return b.select("q", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"""WITH {_BM25_SQL}, {_LISTS_SQL}, sr AS (SELECT q, source AS document_id, id, rank FROM (SELECT q, id, rank FROM fr WHERE rank <= 10) JOIN documents ON doc_id = id)
    SELECT q, document_id, count(*) AS chunks_used, string_agg(id::VARCHAR, ',' ORDER BY rank) AS chunk_ids, min(rank) AS first_rank FROM sr GROUP BY ALL""")
def sources_rollup(spark, sf_dir):
    f = fusion.rrf(_lists(spark, sf_dir)).where("rank <= 10").select("q", "id", "rank")
    r = f.join(_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("document_id")), "id")
    return fusion.sources_rollup(r).withColumn("first_rank", F.col("first_rank").cast("long"))


@query(f"""WITH {_BM25_SQL}, {_LISTS_SQL}, rt AS (SELECT fr.q, fr.id, fr.rank, fr.score, coalesce(d.n_chars % 97, 0)::DOUBLE AS pair_score FROM fr LEFT JOIN documents d ON doc_id = id WHERE fr.rank <= 20),
    rs AS (SELECT *, min(pair_score) OVER (PARTITION BY q) AS lo, max(pair_score) OVER (PARTITION BY q) AS hi FROM rt),
    z AS (SELECT q, id, rank, 0.7 * CASE WHEN hi > lo THEN (pair_score - lo) / (hi - lo) ELSE 0.5 END + 0.3 * score AS blended FROM rs)
    SELECT q, id, round(blended, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(blended, 12) DESC, rank) AS rank FROM z""")
def rerank_minmax_blend(spark, sf_dir):
    f = fusion.rrf(_lists(spark, sf_dir)).where("rank <= 20")
    p = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("n_chars") % 97).cast("double").alias("p"))
    r = fusion.rerank(f.join(p, "id", "left").withColumn("pair_score", F.coalesce("p", F.lit(0.0))))
    return r.select("q", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _corpus(spark: SparkSession, sf_dir: str, kinds: bool) -> search.Corpus:
    """Documents as chunks of their source; vectors all `main` or, with kinds, of three types by label; the category is that of a label."""
    v = _vectors(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("main"), F.lit("summary"), F.lit("question")), (F.col("label") % 3 + 1).cast("int")) if kinds else F.lit("main")
    d = _documents(spark, sf_dir)
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "procedure").otherwise("narrative").alias("category"))
    chunks = d.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), "text")
    return search.Corpus(chunks, v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chunk_id"), kind.alias("vector_type"), F.col("embedding").alias("vector")), bm25.build(d, "doc_id", F.col("text")), l)


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector")), "q")


_PREFERRED = "[" + ", ".join(f"CASE WHEN {_any('lower(text)', ks)} THEN '{c}' END" for c, ks in D.CATEGORIES.items()) + "]"
_BOOSTED_SQL = f"""pq AS (SELECT item_id AS q, {_PREFERRED} AS preferred FROM benchmark JOIN embeddings ON vec_id = item_id),
    hb AS (SELECT fr.q, fr.id, fr.rank, source AS document_id, text, CASE WHEN fr.rank <= {D.BOOST_WINDOW} AND list_contains(preferred, CASE quality WHEN 1 THEN 'procedure' ELSE CASE WHEN l.doc_id IS NOT NULL THEN 'narrative' END END) THEN fr.score * {D.BOOST} ELSE fr.score END AS score
      FROM fr JOIN pq USING (q) JOIN documents d ON d.doc_id = fr.id LEFT JOIN labels l ON l.doc_id = fr.id WHERE fr.rank <= {D.BOOST_WINDOW} + 20),
    ho AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, rank) AS n FROM hb)"""


@query(f"""WITH {_BM25_SQL}, {_LISTS_SQL}, {_BOOSTED_SQL} SELECT q, id, document_id, n AS rank, round(score, 9) AS score, left(text, 500) AS chunk_text FROM ho WHERE n <= 10""")
def hybrid_search(spark, sf_dir):
    """The search as users run it: main vectors and BM25, fusion, category boost."""
    r = search.search(_corpus(spark, sf_dir, False), _asked_vectors(spark, sf_dir), 10, sources=("main_vector", "bm25"))
    return r.select("q", "id", "document_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.substring("chunk_text", 1, 500).alias("chunk_text"))


class _LengthScorer:
    """A stand-in for a cross-encoder that SQL can follow: the length of the text, by parts of 97."""

    def score(self, pairs):
        return [float(len(t) % 97) for _, t in pairs]


@query(f"""WITH {_BM25_SQL}, {_LISTS_SQL}, {_BOOSTED_SQL}, rt AS (SELECT *, (length(text) % 97)::DOUBLE AS pair FROM ho WHERE n <= 20),
    rs AS (SELECT *, min(pair) OVER (PARTITION BY q) AS lo, max(pair) OVER (PARTITION BY q) AS hi FROM rt),
    z AS (SELECT q, id, document_id, n, 0.7 * CASE WHEN hi > lo THEN (pair - lo) / (hi - lo) ELSE 0.5 END + 0.3 * score AS blended FROM rs),
    o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(blended, 12) DESC, n) AS rank FROM z)
    SELECT q, id, document_id, rank, round(blended, 9) AS score FROM o WHERE rank <= 10""")
def hybrid_search_reranked(spark, sf_dir):
    """The same with the first 20 re-ranked."""
    r = search.search(_corpus(spark, sf_dir, False), _asked_vectors(spark, sf_dir), 10, scorer=_LengthScorer, sources=("main_vector", "bm25"))
    return r.select("q", "id", "document_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query()
def hybrid_search_full(spark, sf_dir):
    """All four lists: main, summary and question vectors (by label) and BM25, typed weights, boost, re-ranking, diversity and highlights."""
    r = search.search(_corpus(spark, sf_dir, True), _asked_vectors(spark, sf_dir), 10, by_type=True, scorer=adapters.OverlapScorer, diverse=True)
    return r.select("q", "id", "document_id", "rank", F.round("score", 9).alias("score"), F.array_join("highlights", " | ").alias("highlights"))


@query(f"""WITH RECURSIVE sc AS (SELECT a.vec_id AS q, b.vec_id AS id, a.embedding::DOUBLE[] AS qv, b.embedding::DOUBLE[] AS v, round({_dot('a.embedding', 'b.embedding')}, 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
    c AS MATERIALIZED (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS unit,
      list_inner_product(qv, v) / (sqrt(list_inner_product(v, v)) + 1e-9) / (sqrt(list_inner_product(qv, qv)) + 1e-9) AS relevance FROM sc QUALIFY rank <= 40),
    s(q, id, rank, step, near, picked) AS (
      SELECT q, id, rank, 0, 0.0::DOUBLE, 0::BIGINT FROM c
      UNION ALL (WITH n AS (SELECT s.*, unit, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN picked = 0 THEN round(0.7 * relevance - 0.3 * near, 12) END DESC NULLS LAST, rank) AS place FROM s JOIN c USING (q, id, rank)),
        b AS (SELECT q, unit AS best FROM n WHERE place = 1 AND picked = 0)
        SELECT q, id, rank, step + 1, CASE WHEN step = 0 THEN list_inner_product(unit, best) ELSE greatest(near, list_inner_product(unit, best)) END, CASE WHEN place = 1 THEN step + 1 ELSE picked END FROM n JOIN b USING (q) WHERE step < 10))
    SELECT q, id, 1.0::DOUBLE - (picked - 1) / 10.0::DOUBLE * 0.5 AS score, picked::INT AS rank FROM s WHERE step = 10 AND picked > 0""")
def mmr_select(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = _probes(spark, sf_dir, 50)
    found = vectors.top_k(v, asked, 40).join(v, "id").join(asked.withColumnRenamed("vector", "query_vector"), "q")
    return diversity.mmr(found, 10)


# --- query understanding -------------------------------------------------------------------------------------------


@query("SELECT item_id, " + "coalesce(" + ", ".join(f"CASE WHEN {_any('lower(text)', ks)} THEN '{t}' END" for t, ks in D.DOC_TYPES.items()) + ", 'none') AS doc_type, "
       + "coalesce(" + ", ".join(f"CASE WHEN {_any('lower(text)', ks)} THEN '{t}' END" for t, ks in D.QUERY_TYPES) + ", 'factual') AS query_type, "
       + f"({_any('lower(text)', D.SYNTHESIS)} OR lower(text) LIKE '%?' OR len(string_split_regex(trim(lower(text)), '\\s+')) > 10) AS needs_synthesis, "
       + "concat_ws(',', " + ", ".join(f"CASE WHEN {_any('lower(text)', ks)} THEN '{c}' END" for c, ks in D.CATEGORIES.items()) + ") AS categories FROM benchmark")
def query_intent(spark, sf_dir):
    q = F.lower("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(T.doc_type(q), F.lit("none")).alias("doc_type"), T.query_type(q).alias("query_type"), T.needs_synthesis(q).alias("needs_synthesis"), F.array_join(T.categories(q), ",").alias("categories"))


@query("""WITH q AS (SELECT doc_id, text, unnest(['the', 'and on']) AS query FROM documents),
    t AS (SELECT doc_id, text, query, unnest(string_split(query, ' ')) AS term, generate_subscripts(string_split(query, ' '), 1) AS n FROM q),
    a AS (SELECT *, instr(lower(text), term) - 1 AS place FROM t WHERE instr(lower(text), term) > 0),
    s AS (SELECT doc_id, query, n, greatest(0, place - 50) AS s, least(length(text), place + length(term) + 50) AS e, text FROM a)
    SELECT doc_id, query, string_agg((CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(text, s + 1, e - s) || (CASE WHEN e < length(text) THEN '...' ELSE '' END), ' | ' ORDER BY n) AS highlights FROM s GROUP BY ALL""")
def highlights(spark, sf_dir):
    q = _documents(spark, sf_dir).select("doc_id", "text", F.lower("text").alias("low"), F.explode(F.array(F.lit("the"), F.lit("and on"))).alias("query"))
    return q.select("doc_id", "query", F.array_join(T.highlights(F.col("text"), F.col("query"), low=F.col("low")), " | ").alias("highlights")).where("highlights <> ''")


_MODELS = ["gpt-5-mini-2025-08-07", "gpt-5.1-x", "o3-2025", "gpt-4o-mini", "other-model", "gemini-2.5-flash-001"]
_COSTS = "CASE model " + " ".join(f"WHEN '{m}' THEN tin * {a} / 1e6 + tout * {b} / 1e6" for m, (a, b) in zip(_MODELS, [(0.25, 2.0), (1.25, 10.0), (2.0, 8.0), (0.15, 0.6), (0, 0), (0.15, 0.6)], strict=True)) + " END"


@query(f"WITH e AS (SELECT event_id, {_MODELS}[(event_id % {len(_MODELS)})::INT + 1] AS model, value * 1000 AS tin, user_id AS tout FROM events) SELECT event_id, round(({_COSTS})::DOUBLE, 9) AS usd FROM e")
def usage_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % len(_MODELS) + 1).cast("int"))
    return e.select("event_id", F.round(filters.price(model, D.PRICES, F.col("value") * 1000, F.col("user_id")), 9).alias("usd"))


# --- filters and joins ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%eco%'")
def type_filter_ilike(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(filters.like(F.col("p_type"), "eco")).select("p_partkey", "p_type")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND props ILIKE '%1%'")
def entity_filter_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where(filters.has_json_entity(F.col("props"), "k", "1")).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urg%'")
def entity_filter_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("entity_key"), F.col("o_orderpriority").alias("entity_value"))
    return filters.by_entity(o, "F", "urg")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_nationkey < 10 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def candidate_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("id"))
    as_id = lambda df: df.select(F.col("o_custkey").alias("id"))
    return filters.candidates(c, [as_id(o.where("o_totalprice > 100000")), as_id(o.where("o_orderstatus = 'O'"))], on_empty="empty").distinct()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_quantity")


def _detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with their labels as metadata and the turns of the conversation of their number as questions."""
    chunks = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")
    metadata = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality", "toxic", F.lit("{}").alias("entities"))
    questions = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), F.concat_ws(":", "turn", "role").alias("question"))
    return store.with_details(chunks, metadata, questions)


@query("SELECT d.doc_id AS id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def chunk_metadata_join(spark, sf_dir):
    return _detailed(spark, sf_dir).drop("questions")


@query("""SELECT doc_id AS id, coalesce(n, 0) AS n_questions, coalesce(qs, '') AS questions FROM documents LEFT JOIN
    (SELECT conv_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS qs FROM (SELECT conv_id, concat_ws(':', turn, role) AS x FROM conversations) GROUP BY 1) ON conv_id = doc_id""")
def chunk_with_questions(spark, sf_dir):
    return _detailed(spark, sf_dir).select("id", F.coalesce(F.size("questions"), F.lit(0)).cast("long").alias("n_questions"), F.coalesce(F.array_join("questions", ","), F.lit("")).alias("questions"))


# --- trees ---------------------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and those nations' customers as one tree."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    a = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("position"), F.col("r_name").alias("title"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("position"), F.col("n_name").alias("title"))
    d = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_custkey").alias("position"), F.concat(F.lit("customer "), "c_custkey").alias("title"))
    return a.unionByName(b).unionByName(d)


_NODES_SQL = """t AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS title FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'customer ' || c_custkey FROM customer)"""


@query(f"""WITH RECURSIVE {_NODES_SQL}, w AS (SELECT id, parent_id, 0 AS depth, id AS path FROM t WHERE parent_id IS NULL
    UNION ALL SELECT c.id, c.parent_id, w.depth + 1, w.path || '/' || c.id FROM w JOIN t c ON c.parent_id = w.id)
    SELECT id, coalesce(parent_id, '') AS parent_id, depth, path FROM w""")
def chunk_tree_recursive(spark, sf_dir):
    return tree.walk(_nodes(spark, sf_dir)).select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "depth", "path")


@query(f"""WITH RECURSIVE {_NODES_SQL}, w AS (SELECT id, parent_id FROM t WHERE title ILIKE '%11%'
    UNION ALL SELECT p.id, p.parent_id FROM w JOIN t p ON p.id = w.parent_id) SELECT DISTINCT id FROM w""")
def ancestor_tree_filter(spark, sf_dir):
    return tree.with_ancestors(_nodes(spark, sf_dir), filters.like(F.col("title"), "11"))


@query("SELECT n_nationkey AS id, n_regionkey AS parent_id FROM nation WHERE n_regionkey = 2")
def child_chunks(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent_id"))


# --- segmentation --------------------------------------------------------------------------------------------------


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents)),
    t AS (SELECT doc_id, i, trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM p),
    g AS (SELECT doc_id, i, p, length(p) > 1500 AS big, sum((length(p) > 1500)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t WHERE p <> ''),
    x AS (SELECT doc_id, i, 0 AS j, p AS t, 2 * run AS grp, chr(10) || chr(10) AS glue FROM g WHERE NOT big
      UNION ALL SELECT doc_id, i, generate_subscripts(ss, 1), trim(unnest(ss), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 2 * run - 1, ' '
      FROM (SELECT doc_id, i, run, string_split(replace(regexp_replace(p, '([.?!]) ', '\1|', 'g'), '|', chr(1)), chr(1)) AS ss FROM g WHERE big)),
    a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM x WHERE t <> ''),
    r(doc_id, n, grp, c, held) AS (SELECT doc_id, n, grp, 0, length(t) + length(glue) FROM a WHERE n = 1
      UNION ALL SELECT a.doc_id, a.n, a.grp, CASE WHEN a.grp = r.grp AND held + length(t) <= 1500 THEN c ELSE c + 1 END,
        CASE WHEN a.grp = r.grp AND held + length(t) <= 1500 THEN held ELSE 0 END + length(t) + length(glue) FROM r JOIN a ON a.doc_id = r.doc_id AND a.n = r.n + 1),
    k AS (SELECT doc_id, c, CASE WHEN any_value(glue) = ' ' THEN string_agg(t, ' ' ORDER BY n) ELSE string_agg(t, chr(10) || chr(10) ORDER BY n) END AS text FROM r JOIN a USING (doc_id, n) GROUP BY doc_id, c),
    h AS (SELECT doc_id, c, text, sha256(concat(doc_id, ':', c))[:16] AS chunk_id FROM k)
    SELECT doc_id AS document_id, c AS chunk_index, chunk_id, text, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY c)""")
def paragraph_chunks(spark, sf_dir):
    return chunking.linked(chunking.paragraph_chunks(_documents(spark, sf_dir)))


@query(r"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([.!?])(\s+)([A-Z])', '\1' || chr(2) || '\2' || chr(3) || '\3', 'g'), '([.!?])(\s*\n+)', '\1' || chr(2) || '\2' || chr(3), 'g') AS t FROM documents),
    e AS (SELECT doc_id, text, unnest(ss) AS e, generate_subscripts(ss, 1) AS k, len(ss) AS total FROM (SELECT doc_id, text, string_split(t, chr(2)) AS ss FROM m)),
    w AS (SELECT *, length(e) - (k > 1)::INT AS own, CASE WHEN k > 1 THEN instr(e, chr(3)) - 1 ELSE 0 END AS gap FROM e),
    p AS (SELECT *, sum(own) OVER (PARTITION BY doc_id ORDER BY k) - own + gap AS a FROM w),
    z AS (SELECT doc_id, k, a, CASE WHEN k < total THEN a + own - gap + 1 ELSE length(text) END AS z, text FROM p),
    s AS (SELECT doc_id, k, a, z, trim(substring(text, a::INT + 1, (z - a)::INT), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM z)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS n, a::INT AS start, z::INT AS "end", sha256(s) AS sentence_id FROM s WHERE length(s) > 10""")
def semantic_sentences(spark, sf_dir):
    rows = chunking.exploded(_documents(spark, sf_dir).select("doc_id", "text"), "text", lambda t: [{"s": s, "a": a, "z": z} for s, a, z in chunking.sentences(t)], "struct<s:string,a:int,z:int>")
    return rows.select("doc_id", F.col("piece_index").alias("n"), F.col("piece.a").alias("start"), F.col("piece.z").alias("end"), F.sha2("piece.s", 256).alias("sentence_id"))


@query()
def markdown_chunks(spark, sf_dir):
    """Conversations as markdown: a heading for each turn, the text under it."""
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.when(F.col("turn") == 0, "# Conversation\n").otherwise(""), F.lit("## "), F.coalesce("role", F.lit("none")), F.lit("\n"), F.coalesce("text", F.lit("")))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("markdown"))
    return chunking.hierarchical_chunks(docs)


@query("""WITH c AS (SELECT source AS document_id, doc_id AS chunk_index, sha256(concat(doc_id, ':', 0))[:16] AS chunk_id FROM documents)
    SELECT *, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)""")
def chunk_links_lag_lead(spark, sf_dir):
    return chunking.linked(_documents(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), T.short_id(F.col("doc_id"), F.lit(0)).alias("chunk_id")))


@query(f"""WITH s AS (SELECT label, vec_id, {_dot('lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)', 'embedding')} AS sim FROM embeddings)
    SELECT label, vec_id, round(sim, 6) AS semantic_similarity_prev, coalesce(sim < 0.72, false) AS is_semantic_boundary FROM s""")
def semantic_boundaries(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.col("label").alias("document_id"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("vector"))
    b = chunking.boundaries(v)
    return b.select(F.col("document_id").alias("label"), F.col("chunk_index").alias("vec_id"), F.round("semantic_similarity_prev", 6).alias("semantic_similarity_prev"), "is_semantic_boundary")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
    SELECT s_nationkey, ((n - 1) // 50)::INT AS batch, 'Columns: s_suppkey, s_nationkey' || chr(10) ||
    string_agg('Row ' || n || ': s_suppkey=' || s_suppkey || ', s_nationkey=' || s_nationkey, chr(10) ORDER BY n) AS text FROM n GROUP BY s_nationkey, (n - 1) // 50""")
def row_batch_text(spark, sf_dir):
    b = chunking.row_batches(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_nationkey"], ["s_suppkey"], "s_nationkey")
    return b.select("s_nationkey", "batch", "text")


# rows whose batches are over 3000 characters
@query("""WITH RECURSIVE n AS (SELECT source, doc_id, replace(left(text, 150), chr(10), ' ') AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    l AS (SELECT source, n, (n - 1) // 50 AS batch, (n - 1) % 50 AS i, 'Row ' || n || ': ' || concat_ws(', ', 'doc_id=' || doc_id, 'words=' || words) AS line FROM n),
    w AS (SELECT source, batch, sum(length(line) + 1) + 22 > 3000 AS cut FROM l GROUP BY ALL),
    a AS MATERIALIZED (SELECT l.*, cut FROM l JOIN w USING (source, batch)),
    r(source, batch, i, part, held) AS (SELECT source, batch, i, 0, length(line) + 1 FROM a WHERE i = 0
      UNION ALL SELECT a.source, a.batch, a.i, CASE WHEN NOT cut OR held + length(line) + 1 <= 3000 - 22 THEN part ELSE part + 1 END, CASE WHEN NOT cut OR held + length(line) + 1 <= 3000 - 22 THEN held ELSE 0 END + length(line) + 1
      FROM r JOIN a ON a.source = r.source AND a.batch = r.batch AND a.i = r.i + 1)
    SELECT source, batch::INT AS batch, part, 'Columns: doc_id, words' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM r JOIN a USING (source, batch, i) GROUP BY source, batch, part""")
def row_batch_split(spark, sf_dir):
    d = _documents(spark, sf_dir).select("source", "doc_id", F.replace(F.substring("text", 1, 150), F.lit("\n"), F.lit(" ")).alias("words"))
    return chunking.row_batches(d, ["doc_id", "words"], ["doc_id"], "source")


@query("""WITH w AS (SELECT conv_id, turn, role, text, lag(left(text, 40)) OVER w AS before, lead(left(text, 40)) OVER w AS after FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
    SELECT conv_id, turn, concat_ws(chr(10), 'Document: conv-' || conv_id, 'Type: ' || role, 'Section: turn ' || turn, 'Key info: id=' || conv_id,
    CASE WHEN length(before) > 0 THEN 'Previous context: ' || before END, CASE WHEN length(after) > 0 THEN 'Following context: ' || after END) AS context FROM w""")
def context_prefix(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag(F.substring("text", 1, 40)).over(w)).withColumn("after", F.lead(F.substring("text", 1, 40)).over(w))
    made = T.context_prefix(F.concat(F.lit("conv-"), "conv_id"), F.col("role"), F.concat(F.lit("turn "), "turn"), F.create_map(F.lit("id"), F.col("conv_id").cast("string")), F.col("before"), F.col("after"), F.lit(None).cast("string"))
    return c.select("conv_id", "turn", made.alias("context"))


# --- profiles ------------------------------------------------------------------------------------------------------

_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ALL = [*_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 4) AS mean_value, round(sum({c})::DOUBLE, 2) AS sum_value FROM lineitem" for c in _NUMBERS))
def numeric_profile(spark, sf_dir):
    p = profile.numeric(table(spark, sf_dir, "lineitem"))
    return p.select("column_name", "min_value", "max_value", F.round("mean_value", 4).alias("mean_value"), F.round("sum_value", 2).alias("sum_value"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, count(*) AS n_rows FROM lineitem" for c in _ALL))
def column_cardinality(spark, sf_dir):
    return profile.cardinality(table(spark, sf_dir, "lineitem"), _ALL).drop("type_label")


_SAMPLED = ["p_brand", "p_type", "p_size"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, string_agg(v, ',' ORDER BY k, v) AS sample_values FROM (SELECT {c}::VARCHAR AS v, min(p_partkey) AS k FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k, v LIMIT 5)" for c in _SAMPLED))
def sample_values(spark, sf_dir):
    return profile.first_values(table(spark, sf_dir, "part"), ["p_partkey"], _SAMPLED)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN count(*) = 0 THEN 'text' WHEN bool_and(coalesce(try_cast(v AS TIMESTAMP), try_strptime(v, '%m/%d/%Y')) IS NOT NULL) THEN 'date_string' WHEN bool_or(regexp_matches(v, '[$€£¥₹]')) THEN 'currency' ELSE 'text' END AS looks_like FROM (SELECT {c}::VARCHAR AS v FROM orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 10)" for c in ("o_orderpriority", "o_orderdate", "o_orderstatus")))
def column_kinds(spark, sf_dir):
    return profile.text_kinds(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderpriority", "o_orderdate", "o_orderstatus"])


_PART = {"p_partkey": "integer", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "integer", "p_retailprice": "decimal"}


def _described(c: str, kind: str) -> str:
    """One column's line of a table's description."""
    missing = f"CASE WHEN count(*) > count({c}) THEN ', ' || (count(*) - count({c})) || ' missing' ELSE '' END"
    if kind != "text":
        return f"(SELECT '- {c} ({kind}): ' || format('range {{:,.2f}} to {{:,.2f}}, mean {{:,.2f}}', min({c})::DOUBLE, max({c})::DOUBLE, avg({c})) || {missing} FROM part)"
    few = f"(SELECT ', values ' || string_agg(v, ',' ORDER BY k, v) FROM (SELECT {c} AS v, min(p_partkey) AS k FROM part WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k, v LIMIT 5))"
    return f"(SELECT '- {c} (text): ' || count(DISTINCT {c}) || ' distinct' || CASE WHEN count(DISTINCT {c}) <= 10 THEN {few} ELSE '' END || {missing} FROM part)"


@query("SELECT 'Table part: ' || (SELECT count(*) FROM part) || ' rows' || chr(10) || concat_ws(chr(10), " + ", ".join(_described(c, k) for c, k in _PART.items()) + ") AS description")
def table_description(spark, sf_dir):
    return profile.describe_text(table(spark, sf_dir, "part"), "part", ["p_partkey"])


# --- layout --------------------------------------------------------------------------------------------------------

_LABELS = ["text", "table", "figure", "title", "table_caption", "figure_caption", "plain text"]


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the boxes of a page, one page an order."""
    l = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 400, F.col("l_suppkey") % 10 * 60
    box = F.array(x, y, x + 40 + F.col("l_quantity") * 4, y + 20 + F.col("l_linenumber") * 12).cast("array<double>")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("l_partkey") % len(_LABELS) + 1).cast("int"))
    l = l.withColumn("document_id", F.lit("d")).withColumn("page_number", F.col("l_orderkey").cast("int"))
    # by the key of the page filters, so that rows are dealt once
    pos = F.row_number().over(Window.partitionBy(*layout.PAGE).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return l.select(*layout.PAGE, pos.alias("pos"), box.alias("bbox"), label.alias("label"), (F.lit(0.2) + F.col("l_quantity") / 100).alias("confidence"))


_BOX_SQL = f"""b AS (SELECT l_orderkey::INT AS page_number, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))::INT AS pos, l_quantity, (l_partkey % 400)::DOUBLE AS x1, (l_suppkey % 10 * 60)::DOUBLE AS y1,
    l_partkey % 400 + 40 + l_quantity * 4 AS x2, l_suppkey % 10 * 60 + 20 + l_linenumber * 12.0::DOUBLE AS y2, {_LABELS}[(l_partkey % {len(_LABELS)})::INT + 1] AS label FROM lineitem),
    p AS (SELECT a.page_number, a.pos AS a, c.pos AS c, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (c.x2 - c.x1) * (c.y2 - c.y1) AS sc,
    greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS i,
    sqrt(greatest(0, c.x1 - a.x2, a.x1 - c.x2) ** 2 + greatest(0, c.y1 - a.y2, a.y1 - c.y2) ** 2) AS gap
    FROM b a JOIN b c ON a.page_number = c.page_number AND a.pos < c.pos)"""


@query(f"WITH {_BOX_SQL} SELECT page_number, a, c, round(CASE WHEN i > 0 THEN i / (sa + sc - i) ELSE 0 END, 6) AS iou, round(gap, 6) AS gap FROM p")
def box_iou_pairs(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("page_number", "pos", "bbox")
    p = b.select("page_number", F.col("pos").alias("a"), F.col("bbox").alias("x")).join(b.select("page_number", F.col("pos").alias("c"), F.col("bbox").alias("y")), "page_number").where("a < c")
    return p.select("page_number", "a", "c", F.round(G.iou(F.col("x"), F.col("y")), 6).alias("iou"), F.round(G.gap(F.col("x"), F.col("y")), 6).alias("gap"))


@query(f"WITH {_BOX_SQL} SELECT page_number, a, c, round(i / least(sa, sc), 6) AS containment FROM p WHERE least(sa, sc) > 0 AND i / least(sa, sc) >= 0.85")
def containment_pairs(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("page_number", "pos", "bbox")
    p = b.select("page_number", F.col("pos").alias("a"), F.col("bbox").alias("x")).join(b.select("page_number", F.col("pos").alias("c"), F.col("bbox").alias("y")), "page_number").where("a < c")
    small = F.when(G.area(F.col("x")) < G.area(F.col("y")), G.containment(F.col("x"), F.col("y"))).otherwise(G.containment(F.col("y"), F.col("x")))
    return p.withColumn("s", small).where("s >= 0.85").select("page_number", "a", "c", F.round("s", 6).alias("containment"))


_RANK_SQL = "CASE label " + " ".join(f"WHEN '{x}' THEN {D.BOX_PRIORITY[x]}" for x in _LABELS if x in D.BOX_PRIORITY) + f" ELSE {layout.OTHER_PRIORITY} END"
_NESTED_SQL = " OR ".join(f"(lo = '{a}' AND li = '{b}')" for a, b in D.NESTED_LABELS)
# A page's boxes are bits. ns: the pairs of a box mostly inside another, in list order, with the set of those gone and that at the
# first box's turn; ks: the rest, best first, with the set kept.
_NMS_SQL = f"""WITH RECURSIVE {_BOX_SQL},
    bx AS MATERIALIZED (SELECT page_number, pos, label, x1, y1, x2, y2, 0.2 + l_quantity / 100 AS confidence, {_RANK_SQL} AS rk, (1::BIGINT << pos) AS bit, (x2 - x1) * (y2 - y1) AS s
      FROM b),
    pr AS MATERIALIZED (SELECT p.page_number, a, c, i, sa, sc, i / (sa + sc - i) AS iou, x.label AS la, y.label AS lc, x.rk AS ra, y.rk AS rc FROM p JOIN bx x ON x.page_number = p.page_number AND x.pos = a JOIN bx y ON y.page_number = p.page_number AND y.pos = c),
    np AS (SELECT page_number, a, c, CASE WHEN sa < sc THEN a ELSE c END AS inner_, CASE WHEN sa < sc THEN la ELSE lc END AS li, CASE WHEN sa < sc THEN lc ELSE la END AS lo, CASE WHEN sa < sc THEN ra ELSE rc END AS ri, CASE WHEN sa < sc THEN rc ELSE ra END AS ro
      FROM pr WHERE least(sa, sc) > 0 AND least(sa, sc) >= 0.1 * greatest(sa, sc) AND i >= 0.85 * least(sa, sc)),
    nq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY a, c) AS k FROM np WHERE NOT ({_NESTED_SQL}) AND ro <= ri),
    ns(page_number, k, a, gone, start, dropped) AS (SELECT DISTINCT page_number, 0::BIGINT, -1, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM bx
      UNION ALL SELECT n.page_number, n.k, n.a, CASE WHEN hit THEN gone | (1::BIGINT << inner_) ELSE gone END, begun, CASE WHEN hit THEN list_append(dropped, li) ELSE dropped END
      FROM (SELECT nq.page_number, nq.k, nq.a, inner_, li, gone, dropped, CASE WHEN nq.a = ns.a THEN start ELSE gone END AS begun,
        ((CASE WHEN nq.a = ns.a THEN start ELSE gone END) >> nq.a) & 1 = 0 AND (gone >> nq.c) & 1 = 0 AS hit FROM ns JOIN nq ON nq.page_number = ns.page_number AND nq.k = ns.k + 1) n),
    nl AS (SELECT page_number, arg_max(gone, k) AS gone, arg_max(dropped, k) AS dropped FROM ns GROUP BY 1),
    le AS MATERIALIZED (SELECT bx.*, row_number() OVER (PARTITION BY page_number ORDER BY rk, confidence DESC, pos) AS k FROM bx JOIN nl USING (page_number) WHERE (gone >> pos) & 1 = 0),
    rv AS MATERIALIZED (SELECT le.page_number, le.pos, coalesce(bit_or(CASE WHEN iou > 0.5 THEN 1::BIGINT << (CASE WHEN a = le.pos THEN c ELSE a END) END), 0) AS rivals FROM le LEFT JOIN pr ON pr.page_number = le.page_number AND i > 0 AND (a = le.pos OR c = le.pos) GROUP BY ALL),
    ks(page_number, k, kept, lost) AS (SELECT page_number, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM nl
      UNION ALL SELECT le.page_number, le.k, CASE WHEN kept & rivals = 0 THEN kept | bit ELSE kept END, CASE WHEN kept & rivals = 0 THEN lost ELSE list_append(lost, label) END FROM ks JOIN le ON le.page_number = ks.page_number AND le.k = ks.k + 1 JOIN rv ON rv.page_number = le.page_number AND rv.pos = le.pos),
    kl AS (SELECT page_number, max(kept) AS kept, arg_max(lost, k) AS lost, max(k) AS n_left FROM ks GROUP BY 1),
    fp AS MATERIALIZED (SELECT page_number, gone, kept, list_concat(dropped, lost) AS removed, n_in, n_left, bit_count(kept) AS n_kept FROM nl JOIN kl USING (page_number) JOIN (SELECT page_number, count(*) AS n_in FROM bx GROUP BY 1) USING (page_number))"""


def _removed_sql(removed: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_distinct({removed})), lambda x: x || '=' || len(list_filter({removed}, lambda y: y = x))), ',')"


def _plain_boxes(found: DataFrame) -> DataFrame:
    return found.select("page_number", "pos", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], "label", F.round("confidence", 6).alias("confidence"), "input_count", "output_count", "containment_removed", "iou_removed", "soft_nms_removed", "removed_by_label")


@query(f"""{_NMS_SQL} SELECT page_number, pos, x1, y1, x2, y2, label, round(confidence, 6) AS confidence, n_in::INT AS input_count, n_kept::INT AS output_count, (n_in - n_left)::INT AS containment_removed, (n_left - n_kept)::INT AS iou_removed,
    0 AS soft_nms_removed, {_removed_sql('removed')} AS removed_by_label FROM bx JOIN fp USING (page_number) WHERE (kept >> pos) & 1 = 1""")
def nms_filter(spark, sf_dir):
    return _plain_boxes(layout.filter_detections(_boxes(spark, sf_dir)))


@query(f"{_NMS_SQL} SELECT x AS label, count(*) AS removed FROM (SELECT unnest(removed) AS x FROM fp) GROUP BY 1")
def removed_by_label(spark, sf_dir):
    return layout.removed_counts(layout.filter_detections(_boxes(spark, sf_dir)))


# pairs of kept boxes in list order; the scores of a page's boxes are a list by pos
@query(f"""{_NMS_SQL},
    sp AS MATERIALIZED (SELECT pr.page_number, a, c, ra, rc, iou, row_number() OVER (PARTITION BY pr.page_number ORDER BY a, c) AS k FROM pr JOIN fp USING (page_number) WHERE i > 0 AND (kept >> a) & 1 = 1 AND (kept >> c) & 1 = 1),
    ss(page_number, k, scores) AS (SELECT page_number, 0::BIGINT, list_transform(range(1, 64), lambda j: coalesce(list_filter(l, lambda z: z.pos = j)[1].confidence, 0.0::DOUBLE)) FROM (SELECT page_number, list({{'pos': pos, 'confidence': confidence}}) AS l FROM bx GROUP BY 1)
      UNION ALL SELECT sp.page_number, sp.k, list_transform(scores, lambda z, j: CASE WHEN j = CASE WHEN ra < rc OR ra = rc AND scores[a] > scores[c] THEN c ELSE a END THEN z * exp(-(iou * iou) / 0.3) ELSE z END) FROM ss JOIN sp ON sp.page_number = ss.page_number AND sp.k = ss.k + 1),
    sl AS (SELECT page_number, arg_max(scores, k) AS scores FROM ss GROUP BY 1),
    st AS (SELECT bx.*, scores[pos] AS score, n_in, n_left, n_kept, removed FROM bx JOIN fp USING (page_number) JOIN sl USING (page_number) WHERE (kept >> pos) & 1 = 1),
    sd AS (SELECT page_number, count(*) FILTER (score >= 0.1) AS n_out, list_concat(any_value(removed), coalesce(list(label) FILTER (score < 0.1), [])) AS gone_ FROM st GROUP BY 1)
    SELECT page_number, pos, x1, y1, x2, y2, label, round(score, 6) AS confidence, n_in::INT AS input_count, n_out::INT AS output_count, (n_in - n_left)::INT AS containment_removed, (n_left - n_kept)::INT AS iou_removed,
    (n_kept - n_out)::INT AS soft_nms_removed, {_removed_sql('gone_')} AS removed_by_label FROM st JOIN sd USING (page_number) WHERE score >= 0.1""")
def soft_nms(spark, sf_dir):
    return _plain_boxes(layout.filter_detections(_boxes(spark, sf_dir), layout.BoxConfig.service()))


@query(f"WITH {_BOX_SQL} SELECT page_number, round(1.3 * quantile_cont(x2 - x1, 0.5), 6) AS spanning_limit FROM b GROUP BY 1 HAVING true".replace("quantile_cont(x2 - x1, 0.5)", "quantile_cont(CASE WHEN label NOT IN ('title', 'figure', 'table') THEN x2 - x1 END, 0.5)"))
def median_threshold(spark, sf_dir):
    return layout.spanning_limits(_boxes(spark, sf_dir)).select("page_number", F.round("spanning_limit", 6).alias("spanning_limit"))


@query()
def reading_order(spark, sf_dir):
    return layout.reading_order(_boxes(spark, sf_dir).withColumn("page_width", F.lit(640)).withColumn("page_height", F.lit(720)))


@query("""WITH r AS (SELECT l_orderkey AS page_number, l_linenumber AS reading_order, CASE l_returnflag WHEN 'R' THEN 'title' WHEN 'A' THEN 'abandon' ELSE 'text' END AS label,
    l_linestatus || ' ' || l_partkey AS text FROM lineitem)
    SELECT page_number::INT AS page_number, string_agg(CASE label WHEN 'title' THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY reading_order, CASE label WHEN 'title' THEN '# ' || text ELSE text END) AS markdown FROM r WHERE label <> 'abandon' GROUP BY 1""")
def page_markdown(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "title").when(F.col("l_returnflag") == "A", "abandon").otherwise("text")
    r = l.select(F.lit("d").alias("document_id"), F.col("l_orderkey").cast("int").alias("page_number"), F.col("l_linenumber").alias("reading_order"), label.alias("label"), F.concat_ws(" ", "l_linestatus", F.col("l_partkey").cast("string")).alias("text"))
    return chunking.page_markdown(r).select("page_number", "markdown")


# --- store and cache -----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, c_nationkey, c_acctbal + 1000 FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey + 1000000, NULL, c_acctbal FROM customer WHERE c_custkey % 7 = 0""")
def upsert_antijoin(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal")
    new = old.where("id % 3 = 0").select("id", (F.col("c_acctbal") + 1000).alias("c_acctbal")).unionByName(old.where("id % 7 = 0").select((F.col("id") + 1000000).alias("id"), "c_acctbal"))
    return store.upsert(old, new, ["id"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal, c_nationkey FROM customer")
def update_columns(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    return store.update(old, old.where("id % 4 = 0").select("id", F.lit(0.5).alias("c_acctbal")), ["id"])


@query("""SELECT 'documents' AS tbl, count(*) AS n FROM customer WHERE c_nationkey <> 3
    UNION ALL SELECT 'chunks', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) OR o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'vectors', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)""")
def cascade_delete(spark, sf_dir):
    tables = {
        "documents": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"),
        "chunks": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id")),
        "vectors": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber"),
    }
    left = store.delete(tables, "documents", tables["documents"].where("c_nationkey = 3"))
    parts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id AS id, sha256(text) AS file_hash FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def incremental_by_hash(spark, sf_dir):
    """The known table lacks every fifth file and has another hash for every seventh: those are to be read again."""
    found = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"))
    known = found.where("id % 5 <> 0").withColumn("file_hash", F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(F.col("file_hash")))
    return store.changed_files(found, known)


@query("SELECT user_id AS key, max(ts) AS last_access FROM events GROUP BY user_id ORDER BY last_access DESC, key LIMIT 25")
def lru_eviction(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"))
    return cache.evict(e, 25)


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS key, round({_dot('a.embedding', 'b.embedding')}, 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 2 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS n FROM s) SELECT q, key, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.5 AND key % 3 <> 0""")
def cache_argmax(spark, sf_dir):
    """Even vectors are cached; those of a multiple of 3 are too old."""
    age = F.when(F.col("vec_id") % 3 == 0, 0).otherwise(9000)
    c = _vectors(spark, sf_dir).where("vec_id % 2 = 0").select(F.col("vec_id").alias("key"), "embedding", age.alias("created_at"))
    return cache.lookup(c, _probes(spark, sf_dir, 50), F.lit(10000), 0.5).select("q", "key", F.round("score", 6).alias("score"))


@query("SELECT event_id, sha256(lower(trim(event_type)))[:16] AS key FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 86400")
def cache_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("created_at", F.col("ts").cast("timestamp").cast("double"))
    now = e.agg(F.max("created_at").alias("now"))
    rows = e.crossJoin(F.broadcast(now))  # one row
    return cache.prune(rows, F.col("now"), 86400).select("event_id", cache.cache_key(F.col("event_type")).alias("key"))


# --- streams, files, small pieces ----------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    w = watch.windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    s = watch.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(r"SELECT page_id, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS file_type, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) IN ('csv', 'xlsx', 'xls') AS is_tabular, sha256(url)[:32] AS document_id FROM pages")
def file_types(spark, sf_dir):
    kind = files.file_type(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("file_type"), files.is_tabular(kind).alias("is_tabular"), F.substring(F.sha2("url", 256), 1, 32).alias("document_id"))


@query("""SELECT p_partkey, 'Part ' || p_partkey || chr(10) || 'brand | type | size' || chr(10) || left(p_brand, 50) || ' | ' || left(p_type, 50) || ' | ' || p_size AS text FROM part""")
def table_to_text(spark, sf_dir):
    row = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    made = chunking.table_text(F.concat(F.lit("Part "), "p_partkey"), F.array(*map(F.lit, ("brand", "type", "size"))), F.array(row))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("text"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, l_quantity - 5) AS x1, greatest(0, l_partkey % 400 - 5)::DOUBLE AS y1, least(640, l_quantity + 65) AS x2, least(380, l_partkey % 400 + 25)::DOUBLE AS y2 FROM lineitem""")
def region_crops(spark, sf_dir):
    q, y = F.col("l_quantity"), (F.col("l_partkey") % 400).cast("double")
    b = G.padded(F.array(q, y, q + 60, y + 20), 5.0, F.lit(640.0), F.lit(380.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[b[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT source AS document_id, doc_id, (row_number() OVER w - 1)::INT AS chunk_index, ((row_number() OVER w - 1) // 50)::INT AS batch FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def chunk_numbers(spark, sf_dir):
    return chunking.numbered(_documents(spark, sf_dir).select(F.col("source").alias("document_id"), "doc_id"), "document_id", ["doc_id"])


@query("SELECT CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN CASE WHEN doc_id % 35 = 0 THEN 'failed' ELSE 'processed' END ELSE 'skipped' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def reindex_counts(spark, sf_dir):
    found = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("file_hash"))
    known = found.where("id % 5 <> 0").withColumn("file_hash", F.when(F.col("id") % 7 == 0, F.lit("old")).otherwise(F.col("file_hash")))
    return store.reindex(found, known, found.where("id % 35 = 0"))


_PROFILES = [p for p in D.WEIGHTS if p != "default"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}', {w}::DOUBLE)" for p in [*_PROFILES, "none"] for s, w in zip(D.SOURCES, D.WEIGHTS.get(p, D.WEIGHTS["default"]), strict=True)) + ") t(profile, source, weight)")
def weight_profiles(spark, sf_dir):
    p = spark.range(1).select(F.explode(F.array(*map(F.lit, [*_PROFILES, "none"]))).alias("profile"))
    s = p.select("profile", F.explode(F.array(*map(F.lit, D.SOURCES))).alias("source"))
    return s.select("profile", "source", fusion.weight_of(F.col("source"), F.col("profile")).alias("weight"))


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter([trim(' x' || c_nationkey), trim(' '), trim('x' || c_nationkey || ' '), 'y'], lambda v: v <> ''))), ',') AS people FROM customer""")
def clean_entities(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    m = F.create_map(F.lit("people"), F.array(F.concat(F.lit(" x"), n), F.lit(" "), F.concat(F.lit("x"), n, F.lit(" ")), F.lit("y")), F.lit("unknown"), F.array(F.lit("z")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(filters.clean_entities(m, ["people"])["people"], ",").alias("people"))


@query("""WITH s AS (SELECT vec_id, embedding, label, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt, count(*) OVER (PARTITION BY label) AS total FROM embeddings)
    SELECT label AS id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS breaks FROM s WHERE total >= 3 AND list_inner_product(embedding::DOUBLE[], nxt::DOUBLE[]) < 0.1 GROUP BY label""")
def semantic_breakpoints(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.col("label").alias("id"), F.col("vec_id").alias("n"), F.col("vec_id").alias("end"), F.col("embedding").alias("vector"))
    return chunking.breakpoints(v, 0.1).select("id", F.array_join(F.transform("breaks", lambda x: x.cast("string")), ",").alias("breaks"))


@query("""WITH c AS (SELECT user_id AS key, max(ts) AS last_access FROM events GROUP BY user_id), n AS (SELECT key, last_access FROM c WHERE key % 2 = 0),
    e AS (SELECT DISTINCT user_id + 1000000 AS key, (SELECT max(ts) FROM events) AS last_access FROM events WHERE user_id < 5)
    SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM e) ORDER BY last_access DESC, key LIMIT 10""")
def cache_put(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access")).where("key % 2 = 0")
    new = e.where("user_id < 5").select((F.col("user_id") + 1000000).alias("key")).distinct().crossJoin(F.broadcast(e.agg(F.max("ts").alias("last_access"))))
    return cache.put(old, new, 10)
