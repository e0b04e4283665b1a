"""The pipeline's stages one by one, and as a whole."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import __spark_entry__
from tessera.llm import mixing, packing, quality_rules, simhash, substring_dedup
from test_dedup import brute_components, brute_print, brute_substring


def test_stages_on_awkward_rows(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        got = stage(spark, docs, "")
        assert last or got.columns == docs.columns, name
        got.count()
        assert stage(spark, empty, "").count() == 0, name
        assert stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "").count() == got.count(), name


def test_run_is_its_stages(spark):
    """Near-duplicates and substrings by brute force; the sizes of the mix and the pieces follow from what they leave."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.verdicts(docs).where("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    prints = [brute_print(text, simhash.NEAR) for _, text in rows]
    first = {min(rows[i][0] for i in members) for members in brute_components(prints, simhash.NEAR.radius).values()}
    rows = [r for r in rows if r[0] in first]
    assert len(first) < len(kept)
    words = {doc_id: n - gone for doc_id, n, gone, _ in brute_substring(rows)}
    cut = substring_dedup.without_repeats(docs.where(docs["doc_id"].isin(sorted(first))))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(cut).collect()}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(cut).collect()} == words
    length = Counter()
    for r in packing.pieces(cut).collect():
        length[r["doc_id"]] += r["length"] * copies[r["doc_id"]]
    got = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert got == +length


def test_untouched_texts_whatever_the_partitions(spark):
    """Texts that lose nothing are byte for byte what they were, with few and with many blocks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            after = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
            assert all(after[i] == before[i] for i in before if not words[i]) and any(after[i] != before[i] for i in before if words[i])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)


def test_entry_lists_all_operators():
    names = __spark_entry__.queries()
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)) and "pipeline" in names
