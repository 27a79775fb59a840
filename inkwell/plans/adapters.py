"""Models behind interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class VisionModel(Protocol):
    """Tables, figures, formulas and plain text of a page region."""

    def read(self, kind: str, images: list[bytes]) -> list[str]: ...


class PageRenderer(Protocol):
    """Pages of a document: how many, width and height of each, and each as a PNG."""

    def count(self, document: bytes) -> int: ...

    def sizes(self, document: bytes) -> list[tuple[float, float]]: ...

    def render(self, document: bytes, page: int, dpi: int = 150) -> bytes: ...


class LayoutDetector(Protocol):
    """(label, confidence, x1, y1, x2, y2) of each region of each page's image, unfiltered; operators/layout.py filters them."""

    def detect(self, images: list[bytes], confidence: float = 0.2, size: int = 1024) -> list[list[tuple[str, float, float, float, float, float]]]: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashingEmbedder:
    """Signed feature hashing of words; unit vectors, zero for blank texts."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", t.lower()):
                h = xxhash.xxh3_64_intdigest(w.encode())
                row[h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


class OverlapScorer:
    """The share of the query's words that a text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            have = set(re.findall(r"\w+", t.lower()))
            asked = re.findall(r"\w+", q.lower())
            out.append(sum(w in have for w in asked) / max(1, len(asked)))
        return out


class ExtractiveModel:
    """Answers JSON prompts with the first sentence and the longest words of the prompt's last part."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            text = p.rsplit("\n---\n", 1)[-1]
            first = re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0][:200]
            words = sorted(set(re.findall(r"[^\W\d_]{5,}", text.lower())), key=lambda w: (-len(w), w))[:10]
            out.append("```json\n" + json.dumps({"title": first[:60], "summary": first, "keywords": words, "category": "narrative", "questions": [f"What about {w}?" for w in words[:5]], "entities": {}}) + "\n```")
        return out


def parse_json(reply: Column, schema: str) -> Column:
    """The JSON of a model's reply, with or without a fence; null fields where it doesn't parse."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(F.length(inner) > 0, inner).otherwise(F.trim(reply)), schema)


def embedded(df: DataFrame, text_column: str, make: Callable[[], Embedder], vector_column: str = "vector") -> DataFrame:
    """df with the vector of a text column; the model is made once in each Python worker's task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            yield pd.Series(list(model.embed([t or "" for t in s]).astype(np.float32)))

    return df.withColumn(vector_column, run(F.col(text_column)))


def completed(df: DataFrame, prompt: Column, make: Callable[[], LanguageModel], column: str = "reply", batch: int = 5) -> DataFrame:
    """df with a model's reply to a prompt column, asked `batch` at a time.

    Where a batch fails its prompts are asked one by one; one that fails on its own has an empty reply.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            out: list[str] = []
            for at in range(0, len(s), batch):
                some = s.iloc[at : at + batch].fillna("").tolist()
                try:
                    out += model.complete(some)
                except Exception:  # one bad prompt must not lose the others
                    for one in some:
                        try:
                            out += model.complete([one])
                        except Exception:
                            out.append("")
            yield pd.Series(out)

    return df.withColumn(column, run(prompt))


def pair_scored(df: DataFrame, query_column: str, text_column: str, make: Callable[[], PairScorer]) -> DataFrame:
    """df with pair_score for the re-ranker."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in parts:
            yield pd.Series(model.score(list(zip(q.fillna(""), t.fillna(""), strict=True))))

    return df.withColumn("pair_score", run(F.col(query_column), F.col(text_column)))
