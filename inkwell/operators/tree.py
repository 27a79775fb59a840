"""Trees of rows with parent pointers: depth, path, and filters that keep ancestors; recursive queries over edges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame


def _named(df: DataFrame) -> str:
    name = f"_tree_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(name)
    return name


def _asked(nodes: DataFrame, sql: str, *views: str) -> DataFrame:
    """The query, whose plan holds the views' plans once it is analysed; the names then go."""
    out = nodes.sparkSession.sql(sql)
    for v in views:
        nodes.sparkSession.catalog.dropTempView(v)
    return out


def walk(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, position) -> id, parent_id, depth, path (ids from the root joined by /).

    A node whose parent is missing is left out, and so are nodes on a cycle, which no root reaches.
    """
    t = _named(nodes.select("id", "parent_id", "position"))
    return _asked(nodes, f"""
        WITH RECURSIVE w(id, parent_id, depth, path) AS (
            SELECT id, parent_id, 0, CAST(id AS STRING) FROM {t} WHERE parent_id IS NULL
            UNION ALL
            SELECT c.id, c.parent_id, w.depth + 1, concat(w.path, '/', CAST(c.id AS STRING)) FROM w JOIN {t} c ON c.parent_id = w.id)
        SELECT * FROM w""", t)


def with_ancestors(nodes: DataFrame, match: Column) -> DataFrame:
    """The ids of the nodes (id, parent_id, ...) that match, and of all their ancestors; parents must not form a cycle."""
    t, m = _named(nodes.select("id", "parent_id")), _named(nodes.where(match).select("id", "parent_id"))
    return _asked(nodes, f"""
        WITH RECURSIVE w(id, parent_id) AS (
            SELECT id, parent_id FROM {m}
            UNION ALL
            SELECT p.id, p.parent_id FROM w JOIN {t} p ON p.id = w.parent_id)
        SELECT DISTINCT id FROM w""", t, m)
