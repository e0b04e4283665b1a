"""Queries that have SQL against DuckDB, on the small tables and on awkward rows."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import registry, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def same(got, found) -> bool:
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda table: sorted(repr(tuple(r)) for r in table)
    return rows([r[c] for c in columns] for r in got.collect()) == rows(found.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert same(registry.QUERIES[name](spark, SF), con.execute(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("module, dropped", [(suffix_dedup, "kept"), (substring_dedup, "kept_text")])
def test_awkward_rows_against_sql(docs, rows, module, dropped):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert same(module.dedup(docs).drop(dropped), con.execute(module.oracle_sql()))
