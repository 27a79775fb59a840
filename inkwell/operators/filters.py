"""Candidate filters of a search: type, entities, categories, as chained semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like(column: Column, part: str) -> Column:
    """Substring match without regard to case; % and _ are wildcards."""
    return column.ilike(f"%{part}%")


def by_type(documents: DataFrame, part: str) -> DataFrame:
    return documents.where(like(F.col("detected_doc_type"), part)).select("id")


def by_entity(entities: DataFrame, key: str, value: str) -> DataFrame:
    """Ids of documents with an entity of that key and a like value, from (document_id, entity_key, entity_value)."""
    return entities.where((F.col("entity_key") == key) & like(F.col("entity_value"), value)).select(F.col("document_id").alias("id")).distinct()


def has_json_entity(entities: Column, key: str, value: str | None = None) -> Column:
    """Rows whose JSON text holds the key and, anywhere in it, the value; without a value, a non-empty list under the key."""
    got = F.get_json_object(entities, f"$.{key}")
    return got.isNotNull() & like(entities, value) if value is not None else F.coalesce(F.json_array_length(got) > 0, F.lit(False))


def candidates(ids: DataFrame, filters: list[DataFrame], on_empty: str = "ignore") -> DataFrame:
    """ids that pass every filter (tables of id). on_empty: whether a filter that nothing passes is ignored or empties the result."""
    out = ids
    for f in filters:
        passed = out.join(f, "id", "left_semi")
        out = out if on_empty == "ignore" and passed.isEmpty() else passed
    return out


def clean_entities(entities: Column, allowed: list[str]) -> Column:
    """A map of key -> values with known keys only, values trimmed, distinct and sorted, empty ones dropped."""
    trimmed = F.transform_values(F.map_filter(entities, lambda k, _: k.isin(allowed)), lambda _, v: F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x != ""))))
    return F.map_filter(trimmed, lambda _, v: F.size(v) > 0)


def price(model: Column, prices: dict[str, tuple[float, float]], tokens_in: Column, tokens_out: Column) -> Column:
    """USD of a call: the price of the longest known name that the model's name starts with, per million tokens; unknown models cost nothing."""
    out = F.lit(0.0)
    for name, (a, b) in sorted(prices.items(), key=lambda p: len(p[0])):
        out = F.when(model.startswith(name), tokens_in * a / 1e6 + tokens_out * b / 1e6).otherwise(out)
    return out


def entities_text(entities: Column) -> Column:
    """`key: a, b; ...` of a map of key -> values: the first eight keys with three values each; N/A for none."""
    line = lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, 3), ", "))
    return F.when(F.size(entities) > 0, F.array_join(F.transform(F.slice(F.map_entries(entities), 1, 8), line), "; ")).otherwise("N/A")
