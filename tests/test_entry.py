"""The driver's contract, and independence from the training-data operators."""

from __future__ import annotations

import pathlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import oracle, queries

ROOT = pathlib.Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return float(value) + 0.0 if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    found = duck.execute(oracle.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda table: sorted(repr(tuple(plain(x) for x in r)) for r in table)
    assert rows([r[c] for c in columns] for r in got.collect()) == rows(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).collect()


def test_nothing_imports_the_training_operators():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tessera.llm" not in path.read_text(), path


def test_entry_without_the_training_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(queries.QUERIES)), str(len(oracle.ORACLE))], done.stderr
