"""Search on a corpus of four documents with expectations worked by hand, and properties on generated data."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.operators import boolean, chunk, dense, evaluate, fusion, sparse, wildcard
from tessera.operators.index import Index
from tessera.plans import queries as P
from tessera.plans import session as S

MINI = [(0, "Network security protects the network"), (1, "Network of security"), (2, "విద్య security 123 12345"), (3, "")]


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(MINI, "doc_id long, text string"))


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def scores(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.collect()]


def test_index(index):
    found = {(r["term"], r["doc_id"]): r["positions"] for r in index.postings.collect()}
    assert found["network", 0] == [0, 4] and found["protects", 0] == [2] and found["security", 1] == [2] and found["123", 2] == [2]
    assert index.num_docs == 4 and {r["doc_id"]: r["length"] for r in index.lengths.collect()} == {0: 4, 1: 2, 2: 4}
    norms = {r["doc_id"]: r["norm"] for r in index.lengths.collect()}
    assert [round(norms[i], 6) for i in range(3)] == [0.21514, 0.162964, 0.262564]
    assert index.frequency("SECURITY") == 3 and index.term_frequency("network", 0) == 2 and index.frequency("absent") == 0
    assert index.idf(["security"]) == {"security": pytest.approx(math.log10(4 / 3))}
    assert [r["term"] for r in index.top_terms(2, 2).orderBy("rank").collect()] == ["123", "12345"]


def test_index_is_saved_and_loaded(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.num_docs == 4 and again.postings.count() == index.postings.count()


def test_boolean(index):
    ask = lambda q: ids(boolean.evaluate(index, q))
    assert ask("network AND NOT protects") == {1} and ask("network NOT protects") == {0, 1} and ask("network and security") == {0, 1}
    assert ask("protects OR 12345") == {0, 2} and ask("absent AND network") == set() and ask("the AND of") == set()
    assert ids(boolean.none_of(index, ["network"])) == {2}
    assert ids(boolean.all_of(index, [])) == set() and ids(boolean.any_of(index, [])) == set()


def test_phrases(index):
    ask = lambda q: ids(boolean.phrase(index, q))
    assert ask("network security") == {0} and ask("network of security") == {0} and ask("security") == {0, 1, 2} and ask("security network") == set()


def test_incidence(index):
    row = index.incidence_stats().first()
    assert (row["num_terms"], row["num_docs"], row["total_cells"], row["non_zero_cells"]) == (6, 3, 18, 9)
    assert {r["doc_id"]: r["present"] for r in index.incidence_row("network").collect()} == {0: 1, 1: 1, 2: 0}
    assert {r["term"] for r in index.incidence_column(1).where("present = 1").collect()} == {"network", "security"}
    assert index.incidence().count() == 9


def test_ranking(index):
    search = lambda q, k=10: scores(sparse.search(index, Q.parse(q), k))
    assert search("network security") == [(1, 1.0), (0, 0.701825), (2, 0.045601)]
    assert search("123") == [] and [d for d, _ in search("12345")] == [2] and search("the") == []
    assert search('"network security"') == [(0, 0.701825)]
    assert search("network AND NOT protects") == [(1, 0.413051)]  # the query's vector has the excluded term too
    assert search("security OR విద్య", 1)[0][0] == 2 and search("sec*") == []


def test_wildcards(index):
    assert scores(wildcard.search(index, "sec*")) == [(1, 0.062469), (0, 0.031235), (2, 0.031235)]
    assert {r["term"] for r in wildcard.matching_terms(index, "sec*").collect()} == {"security"}
    assert wildcard.matching_terms(index, "network?").count() == 0 and wildcard.matching_terms(index, "net%").count() == 0
    for pattern in ("*", "n*k", "?ecurity", "1*", "*ct*"):
        exact = {r["term"] for r in wildcard.matching_terms(index, pattern).collect()}
        assert exact <= {r["term"] for r in wildcard.candidates(index, pattern).collect()}


def test_many_queries_rank_as_one_by_one(spark, index):
    rows = [(1, "network", 1.0), (1, "security", 1.0), (2, "12345", 1.0), (3, "absent", 1.0)]
    got = sparse.rank_many(index, spark.createDataFrame(rows, "query_id int, term string, weight double"))
    assert [(r["doc_id"], round(r["score"], 6)) for r in got.where("query_id = 1").orderBy("rank").collect()] == [(1, 1.0), (0, 0.701825), (2, 0.045601)]
    assert got.where("query_id = 3").count() == 0


def ranking(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, score double")


def test_fusion(spark):
    keyword, semantic = ranking(spark, [(1, 3.0), (0, 2.0), (2, 1.0)]), ranking(spark, [(2, 0.9), (1, 0.8)])
    assert scores(sparse.top(fusion.reciprocal(keyword, semantic, (0.4, 0.8)), 10)) == [(2, 0.019464), (1, 0.019461), (0, 0.006452)]
    d = {r["doc_id"]: r for r in fusion.details(keyword, semantic).collect()}
    assert d[0]["semantic_rank"] is None and d[1]["keyword_rank"] == 1 and d[1]["score"] == pytest.approx(1 / 61 + 1 / 62)
    blended = dict(scores(fusion.blend(keyword, semantic)))
    assert blended == {1: 0.65, 0: 0.325, 2: 0.35}
    flat = ranking(spark, [(1, 5.0), (2, 5.0)])
    assert [r[0] for r in flat.select(fusion.min_max(F.col("score"))).collect()] == [0.0, 0.0]
    assert [r[0] for r in flat.select(fusion.display(F.col("score"))).collect()] == [0.5, 0.5]
    assert scores(sparse.top(fusion.greatest(keyword, semantic), 9))[0] == (1, 3.0)


def test_rerank(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "b"), (2, " ")], "doc_id long, text string")
    fused = ranking(spark, [(0, 0.1), (1, 0.2), (2, 0.3)])
    assert scores(fusion.rerank("alpha", fused, docs, P.Overlap())) == [(1, 0.0), (0, 0.0)]
    assert [d for d, _ in scores(fusion.rerank("x", fused, docs, None, 2))] == [2, 1]


def test_metrics(spark):
    rankings = spark.createDataFrame([(1, n, i) for i, n in enumerate("abcde", 1)], "query_id int, name string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "e"), (1, "z"), (2, "q"), (3, None)], "query_id int, name string")
    got = {r["query_id"]: r for r in evaluate.per_query(rankings, relevant).collect()}
    r = got[1]
    assert (r["precision_5"], round(r["recall_5"], 6), round(r["f1_5"], 6), r["reciprocal_rank"], round(r["average_precision"], 6)) == (0.4, 0.666667, 0.5, 0.5, 0.3)
    assert r["precision_10"] == 0.2 and got[2]["reciprocal_rank"] == 0 and got[3]["recall_5"] == 0
    total = evaluate.aggregate(evaluate.per_query(rankings, relevant)).first()
    assert total["num_queries"] == 3 and total["mrr"] == pytest.approx(0.5 / 3)
    same = evaluate.per_query(rankings, relevant)
    assert {r["verdict"] for r in evaluate.compare(same, same).collect()} == {"unchanged"}
    assert evaluate.failures(same).count() == 2


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(0, words), (1, " a  b "), (2, "  "), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk_id"], r["text"].split()) for r in chunk.fixed_chunks(docs).orderBy("doc_id", "chunk_id").collect()]
    assert [(d, c, w[0], w[-1]) for d, c, w in got[:3]] == [(0, 0, "w0", "w179"), (0, 1, "w130", "w299"), (0, 2, "w260", "w299")]
    assert len(got) == 4
    text = "HEADING ONE\nFirst one. Second  two! दूसरा वाक्य। तीसरा\n\nIntro part:\nlast"
    found = [r["text"] for r in chunk.sentence_rows(spark.createDataFrame([(0, text)], "doc_id long, text string")).orderBy("sentence_id").collect()]
    assert found == ["HEADING ONE", "First one.", "Second two!", "दूसरा वाक्य।", "तीसरा", "Intro part:", "last"]


def test_semantic_fold():
    same, other = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    part = lambda n, w="w": " ".join([w] * n)
    topic = chunk.fold([part(40), part(30), part(5, "x")], [False] * 3, np.array([same, same, other]))
    assert topic == [f"{part(40)} {part(30)}", f"{part(30)} {part(5, 'x')}"]
    assert chunk.fold([part(70), "HEADING", part(5)], [False, True, False], np.array([same] * 3)) == [part(70), f"HEADING {part(5)}"]
    assert [len(c.split()) for c in chunk.fold([part(10), part(300), part(3)], [False] * 3, np.array([same] * 3))] == [10, 180, 170, 40, 3]
    assert chunk.fold([part(100), part(100)], [False] * 2, np.array([same] * 2)) == [part(100), f"{part(100)} {part(100)}"]


def test_dense(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i // 4, i % 4, v.tolist()) for i, v in enumerate(x)], "doc_id long, chunk_id int, embedding array<float>")
    q = x[17].tolist()
    best = np.argsort(-(x @ x[17]), kind="stable")[:50]
    expected = list(dict.fromkeys(int(i) // 4 for i in best))[:10]
    assert [d for d, _ in scores(dense.search_by_vector(vectors, q))] == expected
    means = {r["doc_id"]: r["embedding"] for r in dense.document_vectors(vectors).collect()}
    assert np.allclose(means[3], x[12:16].mean(axis=0), atol=1e-6)
    near = scores(dense.similar(dense.document_vectors(vectors), 3))
    m = x.reshape(100, 4, 8).mean(axis=1)
    order = [int(i) for i in np.argsort(-(m @ m[3])) if i != 3][:5]
    assert [d for d, _ in near] == order


def test_cells_reach_the_recall(spark, tmp_path):
    vectors = P.chunk_vectors(spark, "/root/testdata/sf0.01", False)
    index = dense.CellIndex.build(vectors, str(tmp_path / "cells"), cells=16)
    queries = [r["embedding"] for r in vectors.where("doc_id % 20 = 0").select("embedding").limit(12).collect()]
    got = [dense.recall(index.search(q), dense.search_by_vector(vectors, q), 10) for q in queries]
    assert index.vectors.count() == vectors.count() and sum(got) / len(got) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_default_cells_reach_the_recall(spark, tmp_path, sf):
    """The index that ivf_topk builds, for every query vector."""
    vectors = P.chunk_vectors(spark, f"/root/testdata/{sf}", False)
    index = dense.CellIndex.build(vectors, str(tmp_path / "cells"))
    index.vectors = index.vectors.cache()
    rows = vectors.collect()
    ids, x = np.array([r["doc_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    got = []
    for i in np.flatnonzero(ids % 20 == 0):
        exact = set(ids[np.lexsort((ids, -np.round(x @ x[i], 9)))[:10]].tolist())
        got.append(len(exact & {r["doc_id"] for r in index.search(x[i].tolist()).collect()}) / len(exact))
    print(sf, len(got), sum(got) / len(got))
    assert sum(got) / len(got) >= 0.9


def test_clusters(spark):
    rows = [(i, [float(i % 2 * 10), 1.0]) for i in range(20)]
    clusters, centres = dense.kmeans(spark.createDataFrame(rows, "doc_id long, embedding array<float>"), 2, 2)
    assert len({(r["doc_id"] % 2, r["cluster"]) for r in clusters.collect()}) == 2 and len(centres) == 2
    assert [r["size"] for r in dense.cluster_sizes(clusters, 3).orderBy("cluster").collect()] == [10, 10, 0]
    assert dense.cluster_of(clusters, 99) == -1


def test_session(spark, tmp_path):
    docs = spark.createDataFrame([(*m, f"file-{m[0]}.txt") for m in MINI], "doc_id long, text string, file_name string")
    session = S.SearchSession.build(docs, str(tmp_path / "s"))
    for mode in S.MODES:
        assert {r["doc_id"] for r in session.search("network security", mode).collect()} >= {0, 1}
    top = session.search("network security", "keyword").first()
    assert (top["rank"], top["doc_id"], top["score"], top["language"], top["file_name"]) == (1, 1, 1.0, "English", "file-1.txt")
    assert {r["doc_id"] for r in session.search("sec*", "hybrid").collect()} == {0, 1, 2}
    assert session.details("network security").count() >= 2
    session.reranker = P.Overlap()
    assert session.hybrid("network security").count() >= 2
    judged = spark.createDataFrame([(1, "network security", "file 1"), (2, "విద్య", "file 2")], "query_id int, query string, name string")
    found = S.SearchSession.load(spark, str(tmp_path / "s")).evaluate(judged, "file_name", ("keyword",))["keyword"]
    assert {r["query_id"]: r["reciprocal_rank"] for r in found.collect()} == {1: 1.0, 2: 1.0}
    with pytest.raises(ValueError):
        session.ranked("x", "other")


def test_index_moves_postings_once(spark, tmp_path):
    """Postings carry no weights, and rows of one doc_id are one document, as one row with both texts would be."""
    docs = spark.createDataFrame([(0, "alpha beta alpha"), (1, None), (2, "gamma"), (0, "beta the delta"), (3, "a 1")], "doc_id long, text string")
    index = Index.build(docs, str(tmp_path / "i"))
    assert index.postings.columns == ["term", "doc_id", "tf", "length", "positions"]
    found = {(r["term"], r["doc_id"]): (r["tf"], r["length"], r["positions"]) for r in index.postings.collect()}
    assert found == {("alpha", 0): (2, 5, [0, 2]), ("beta", 0): (2, 5, [0, 1]), ("delta", 0): (1, 5, [2]), ("gamma", 2): (1, 1, [0])}
    assert {(r["term"], r["doc_id"]): round(r["weight"], 6) for r in index.weights().collect()}["alpha", 0] == round(2 / 5 * math.log10(5), 6)
    assert {r["doc_id"]: r["length"] for r in index.lengths.collect()} == {0: 5, 2: 1}


def test_many_or_few_queries(spark, index, monkeypatch):
    """A few queries prune the scan by their terms; more than that are joined, with the same ranks."""
    rows = [(1, "network", 1.0), (1, "security", 1.0), (2, "12345", 1.0), (3, "absent", 1.0), (4, "security", 2.0)]
    queries = spark.createDataFrame(rows, "query_id int, term string, weight double")
    few = sparse.rank_many(index, queries)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "term#" in plan and "network" in plan and "broadcast" in plan
    monkeypatch.setattr(sparse, "FEW", 2)
    many = sparse.rank_many(index, queries)
    assert "network" not in many._jdf.queryExecution().optimizedPlan().toString()
    ranks = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert ranks(few) == ranks(many) and len(ranks(few)) == 7


def test_postings_have_the_columns_tokens(spark, monkeypatch):
    """Postings are made by Python's patterns, positions by the columns': alike on awkward texts, however they are cut."""
    odd = ["", "a@b.c x@y. @z.w p@q@r.s.t. end", "see https://a.b/c?d WWW.x www.y z http://", "\x1cme@x.org\x1funit ab\u0085cd@e.fg", "ABCవిద్య Kelvin King İstanbul १२३ é1", "x" * 51 + " " + "Y" * 50, "The the THE net Net NET", "u@v" * 50 + ".w tail"]
    docs = spark.createDataFrame([*enumerate(odd * 3), (99, None)], "doc_id long, text string").unionByName(P.docs_of(spark, "/root/testdata/sf0.001").selectExpr("doc_id + 1000 as doc_id", "text"))
    from tessera.operators import index as I

    expected = sorted((r["term"], r["doc_id"], r["pos"]) for r in I.positions(docs).collect())
    for size in (I.BLOCK, 300):
        monkeypatch.setattr(I, "BLOCK", size)
        rows = I.raw_postings(docs).collect()
        assert sorted((r["term"], r["doc_id"], p) for r in rows for p in r["positions"]) == expected
        assert len({(r["term"], r["doc_id"]) for r in rows}) == len(rows) and all(r["tf"] == len(r["positions"]) for r in rows)


def test_encoder_is_as_its_terms_one_by_one():
    """Hashes are added at once for all texts; tokens are looked up, not judged again and again."""
    import zlib

    texts = ["", "The network, the NETWORK 123 12345 me@x.org", "passage: విద్య Network " + "x" * 51, "İstanbul é1 a", "only the of"]
    expected = np.zeros((len(texts), 384), np.float32)
    for i, text in enumerate(texts):
        for term in Q.searched_terms(text.lower()):
            h = zlib.crc32(term.encode())
            expected[i, h % 384] += 1 if h >> 31 else -1
    size = np.linalg.norm(expected, axis=1, keepdims=True)
    dense.hashed.cache_clear()
    got = dense.HashEncoder().encode(texts)
    assert got.dtype == np.float32 and np.array_equal(got, expected / np.where(size > 0, size, 1)) and dense.HashEncoder().encode([]).shape == (0, 384)
    assert dense.hashed.cache_info().misses < sum(len(Q.raw_tokens(t)) for t in texts)


def test_sentences_with_any_white_space(spark):
    text = "One  two.\tThree four!   Five\x0bsix? \x1cseven \x1c  eight.\r\nnine 　\n\t\n ten ."
    found = [r["text"] for r in chunk.sentence_rows(spark.createDataFrame([(0, text)], "doc_id long, text string")).orderBy("sentence_id").collect()]
    assert found == ["One two.", "Three four!", "Five six?", "\x1cseven \x1c eight.", "nine", "ten ."]
