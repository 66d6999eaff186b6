"""Every query that SQL can express, against DuckDB; the others run and keep their rules."""

from __future__ import annotations

import pytest

import corpusflow.queries as q
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_matches_sql(spark, sf, con, name):
    assert_same(q.QUERIES[name](spark, sf), con, q.SQL[name])


def test_every_sql_has_a_query():
    assert set(q.SQL) <= set(q.QUERIES)


def test_priority_fill_keeps_its_limits(spark, sf):
    rows = q.QUERIES["priority_fill"](spark, sf).collect()
    assert 0 < len(rows) <= 15 and sorted(r.order for r in rows) == list(range(1, len(rows) + 1))


def test_page_metadata_has_a_row_for_each_page(spark, sf):
    out = q.QUERIES["page_metadata"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


@pytest.mark.parametrize("missing", ["corpusflow.llm.queries", "corpus_pipeline"])
def test_entry_without_llm(monkeypatch, missing):
    """Without the subpackage, without the pipeline, or without what they import, the other queries stay."""
    import __spark_entry__ as e

    real = e.importlib.import_module

    def without(name, *args):
        if name == missing:
            raise ImportError(name)
        return real(name, *args)

    monkeypatch.setattr(e.importlib, "import_module", without)
    assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.SQL)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
