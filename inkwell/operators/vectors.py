"""Exact vector search: a batch of queries against all rows, in blocks.

The queries go to every task; a task multiplies its rows with them, topk.CELLS products at a time, and hands on the
best k per query of all its rows, so what is shuffled is k rows for each query and task, never the pairs. The driver and
each worker hold all queries of a batch, 8 bytes for each of their numbers, and a worker 16 bytes for each of their k
best. Only filters of each query's own are joined as pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import vectors as V
from inkwell.operators import topk

#: Queries multiplied at once, at most; rows that a worker hands on at once.
BLOCK_QUERIES, BLOCK_ROWS = 2048, 1 << 16


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "id", vector_column: str = "vector", allowed: DataFrame | None = None) -> DataFrame:
    """q, id, score, rank: the k largest inner products of each query (q, vector); ties to the smaller id.

    allowed: (id) or (q, id) rows that may be found (an exact pre-filter; an empty table finds nothing).
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    if allowed is not None and "q" not in allowed.columns:
        rows = rows.join(allowed.select("id"), "id", "left_semi")
    if allowed is not None and "q" in allowed.columns:
        return _joined(rows, queries, k, allowed)
    batch = queries.select("q", "vector").toArrow()
    names = np.array(batch["q"].to_pylist())
    asked = np.array([np.asarray(v, dtype=np.float64) for v in batch["vector"].to_numpy()])

    def run(batches):
        best = topk.Best(len(names), k, 12)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vector"].to_numpy()).astype(np.float64)
            ids = b["id"].to_numpy()
            step = min(BLOCK_QUERIES, max(1, topk.CELLS // len(ids)))
            for at in range(0, len(names), step):
                best.add(at, asked[at : at + step] @ x.T, ids)
        q, i, s = best.rows()
        for at in range(0, len(q), BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            yield pd.DataFrame({"q": names[q[part]], "id": i[part], "score": s[part]})

    q_type = queries.schema["q"].dataType.simpleString()
    best = rows.mapInPandas(run, f"q {q_type}, id {rows.schema['id'].dataType.simpleString()}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _joined(rows: DataFrame, queries: DataFrame, k: int, allowed: DataFrame) -> DataFrame:
    """The same as columns, for filters of each query's own."""
    asked = queries.select("q", F.col("vector").alias("qv"))
    pairs = allowed.join(asked, "q").join(rows, "id")
    scored = pairs.select("q", "id", F.round(V.dot(F.col("qv"), F.col("vector")), 12).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_chunk(found: DataFrame, k: int) -> DataFrame:
    """q, id, score, rank from rows (q, chunk_id, score): each chunk by its best vector (questions)."""
    best = found.groupBy("q", F.col("chunk_id").alias("id")).agg(F.max("score").alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
