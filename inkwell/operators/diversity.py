"""Maximal marginal relevance, one query's candidates at a time (candidates are a bounded list)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def mmr_order(query: np.ndarray, docs: np.ndarray, k: int, balance: float = 0.7) -> list[int]:
    """Greedy selection: relevance against the nearest one chosen; ties to the earlier candidate."""
    unit = docs / (np.linalg.norm(docs, axis=1, keepdims=True) + 1e-9)
    relevance = unit @ (query / (np.linalg.norm(query) + 1e-9))
    nearest = np.zeros(len(docs))
    open_ = np.ones(len(docs), dtype=bool)
    chosen: list[int] = []
    while len(chosen) < min(k, len(docs)):
        value = np.where(open_, np.round(balance * relevance - (1 - balance) * nearest, 12), -np.inf)
        pick = int(value.argmax())
        near = unit @ unit[pick]
        nearest = near if not chosen else np.maximum(nearest, near)
        open_[pick] = False
        chosen.append(pick)
    return chosen


def mmr(candidates: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """q, id, score, rank from candidates (q, id, rank, score, vector, query_vector).

    With at most k candidates they come back as they are; else the score is 1 - 0.5 * position / chosen.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank", "id"], kind="stable")
        if len(g) <= k:
            return pd.DataFrame({"q": g["q"], "id": g["id"], "score": g["score"], "rank": np.arange(1, len(g) + 1, dtype=np.int32)})
        order = mmr_order(np.asarray(g["query_vector"].iloc[0], dtype=float), np.stack(g["vector"].to_numpy()).astype(float), k, balance)
        out = g.iloc[order]
        return pd.DataFrame({"q": out["q"], "id": out["id"], "score": 1.0 - np.arange(len(out)) / len(out) * 0.5, "rank": np.arange(1, len(out) + 1, dtype=np.int32)})

    q, i = (candidates.schema[c].dataType.simpleString() for c in ("q", "id"))
    return candidates.groupBy("q").applyInPandas(run, f"q {q}, id {i}, score double, rank int")
