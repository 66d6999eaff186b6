"""The queries of the library outside llm: callables (spark, sf_dir) -> DataFrame, and their SQL.

Every query reads whole tables and whole texts.  SQL is for DuckDB over views of the same names.
"""

from __future__ import annotations

from . import articles, connect, papers, runs, series, sources, texts

QUERIES: dict = {}
SQL: dict = {}
for _part in (papers, texts, articles, series, sources, connect, runs):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
