"""The queries by name, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Common table expressions of the SQL side.
TURNS = """turns AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""
SPLIT = "CAST(('0x' || substr(md5('split:' || CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10"
LABELLED = (
    TURNS
    + """, labelled AS (
  SELECT conv_id, turn_index, text, CASE WHEN length(text) < 60 THEN 'generic' WHEN length(text) % 2 = 0 THEN 'followup' ELSE 'elaborate' END AS observation
  FROM turns WHERE role = 'assistant')"""
)
