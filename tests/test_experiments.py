"""Sinks, readers of small files, experiments and the tuned approximate index."""

from __future__ import annotations

import pytest

from tessera.functions import query as Q
from tessera.operators import dense
from tessera.plans import experiments
from tessera.sources import files, samples, storage


def test_json_sinks_and_reset(spark, tmp_path):
    path = str(tmp_path / "settings")
    storage.save_json(spark, path, {"mode": "hybrid", "k": 10, "name": "విద్య"})
    storage.save_json(spark, path, {"mode": "keyword", "k": 5})
    assert storage.load_json(spark, path) == {"mode": "keyword", "k": 5}
    assert storage.deleted(spark, path) and storage.load_json(spark, path, {}) == {}
    assert not storage.deleted(spark, path)


def test_pdf_files():
    text, pages, metadata = files.pdf_file(samples.pdf([["a (b)", r"c \ d"], [], ["é"]]))
    assert text == "a (b)\nc \\ d\n\né" and len(pages) == 3 and metadata == {"page_count": "3"}
    for broken in (b"", b"no pdf", samples.pdf([["x"]]) + b"/Encrypt", samples.pdf([["x"]]) + b"/Type0"):
        with pytest.raises(NotImplementedError):
            files.pdf_file(broken)


def test_dropped_files_are_listed(spark):
    rows = [("a.pdf", "pdf", bytearray(b"broken")), ("b.png", "image", bytearray(b"x")), ("c.txt", "text", bytearray(b"fine"))]
    content = spark.createDataFrame(rows, "file_path string, file_type string, content binary")
    assert {r["file_path"] for r in files.dropped(content).collect()} == {"a.pdf", "b.png"}
    assert [r["file_path"] for r in files.extracted(content).collect()] == ["c.txt"]


def test_short_queries():
    assert Q.is_short("network security") and not Q.is_short("") and not Q.is_short("one two three four words")
    assert Q.is_phrase('"') and Q.is_phrase("'a b'") and not Q.is_phrase("") and not Q.is_phrase("\"a'")


def test_cells_are_tuned_and_swept(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS doc_id", "0 AS chunk_id", "embedding")
    queries = [r["embedding"] for r in vectors.where("doc_id in (0, 20)").collect()]
    tuned = dense.CellIndex.build(vectors, str(tmp_path / "cells"), cells=4).tuned(queries)
    exact = {r["doc_id"] for q in queries for r in dense.search_by_vector(vectors, q).collect()}
    found = {r["doc_id"] for q in queries for r in tuned.search(q).collect()}
    assert len(found & exact) >= 0.8 * len(exact) and 1 <= tuned.nprobe <= 4
    rows = experiments.cell_sweep(vectors, str(tmp_path), [4], [0.25, 1.0], queries[:1])
    assert [r["nprobe"] for r in rows] == [1, 4] and rows[1]["recall"] == 1.0 and all(r["qps"] > 0 for r in rows)
