"""One query for each operator, over whole tables. The index is built once for a data folder and session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import query as Q
from tessera.functions import text as T
from tessera.operators import boolean, chunk, dense, evaluate, fusion, sparse, wildcard
from tessera.operators.index import Index, document_frequency, positions, raw_postings
from tessera.plans import experiments as E
from tessera.plans import session as S
from tessera.sources import files, samples, storage
from tessera.sources.storage import new_path, spread, stored
from tessera.streaming.ingest import collapsed

FREE_TEXT = "thing ering er en"
AND, OR, AND_NOT, NOT = "thing and ering", "thing or ering", "thing and not ering", ["thing"]
PHRASE, WILDCARD, TERM, SNIPPET = '"er en"', "th*ed", "thing", "ering thing"
BOOSTED = "thing timetable class routine"
JUDGED = {1: "thing ering er en", 2: "ention stent", 3: "hand or stand", 4: "eau pour", 5: "der heit"}
EXPANDED = {1: {"thing": 1.0, "ering": 0.3}, 2: {"ention": 1.0, "enst": 0.3}, 3: {"hand": 1.0}, 4: {"eau": 1.0, "elle": 0.3}, 5: {"heit": 1.0}}

_INDEXES: dict[tuple[str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(docs_of(spark, sf_dir).select("doc_id", "text"))
    return _INDEXES[key]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def chunk_vectors(spark: SparkSession, sf_dir: str, by_label: bool = True) -> DataFrame:
    """The embeddings as chunks: of the document `label`, or each of its own."""
    doc = F.col("label").cast("bigint") if by_label else F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(doc.alias("doc_id"), (F.col("vec_id") if by_label else F.lit(0)).alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


# Text functions and generators.
def tokens_per_doc(s, d):
    t = T.tokens(F.col("text"))
    return docs_of(s, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.filter(t, T.is_indexed)).alias("n_indexed"))


def token_positions(s, d):
    return positions(docs_of(s, d))


def stopword_filtered_counts(s, d):
    return docs_of(s, d).select("doc_id", F.size(T.terms(F.col("text"))).alias("n_terms"))


def language_detect(s, d):
    return docs_of(s, d).select("doc_id", T.language(F.col("text")).alias("language"))


def doc_language_label(s, d):
    return docs_of(s, d).select("doc_id", T.language_label(F.col("text")).alias("language"))


def char_ngrams(s, d):
    return T.ngram_counts(docs_of(s, d))


def bigram_index(s, d):
    return wildcard.bigrams(index_of(s, d).terms)


def normalized_names(s, d):
    return table(s, d, "pages").select("page_id", T.normal_name(F.col("url")).alias("name"))


def file_types(s, d):
    return table(s, d, "pages").select("page_id", T.file_type(F.col("url")).alias("file_type"))


def embedding_inputs(s, d):
    return table(s, d, "benchmark").select("item_id", T.embedding_input(F.col("text"), False).alias("passage"), T.embedding_input(F.col("text"), True).alias("query"))


def rerank_texts(s, d):
    return docs_of(s, d).select("doc_id", T.rerank_input(F.col("text")).alias("rerank_text"))


def plain_queries(s, d):
    return table(s, d, "benchmark").select("item_id", T.plain_query(F.col("text")).alias("plain"))


def snippets(s, d):
    return docs_of(s, d).select("doc_id", T.snippet(F.col("text"), SNIPPET).alias("snippet"))


def headings(s, d):
    lines = docs_of(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(T.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_headings"))


def fixed_chunks(s, d):
    return chunk.fixed_chunks(docs_of(s, d))


def sentence_split(s, d):
    return chunk.sentence_rows(docs_of(s, d))


def semantic_chunks(s, d):
    return chunk.semantic_chunks(docs_of(s, d), dense.HashEncoder())


# The index.
def doc_freq(s, d):
    return document_frequency(raw_postings(docs_of(s, d)))


def postings(s, d):
    return index_of(s, d).postings.select("term", "doc_id", "tf")


def doc_lengths(s, d):
    return positions(docs_of(s, d)).groupBy("doc_id").agg(F.count("*").alias("length"))


def idf(s, d):
    return rounded(index_of(s, d).terms, "idf")


def tfidf_weights(s, d):
    return rounded(index_of(s, d).weights(), "weight")


def doc_norms(s, d):
    return rounded(index_of(s, d).lengths.select("doc_id", "norm"), "norm")


def top_terms(s, d):
    return rounded(index_of(s, d).top_terms(), "weight")


def term_lookup(s, d):
    return index_of(s, d).lookup(TERM.upper()).select("doc_id", F.size("positions").alias("tf"), F.element_at("positions", 1).alias("first"))


# Boolean retrieval.
def bool_and(s, d):
    return boolean.evaluate(index_of(s, d), AND)


def bool_or(s, d):
    return boolean.evaluate(index_of(s, d), OR)


def bool_not(s, d):
    return boolean.none_of(index_of(s, d), NOT)


def bool_and_not(s, d):
    return boolean.evaluate(index_of(s, d), AND_NOT)


def phrase_match(s, d):
    return boolean.phrase(index_of(s, d), PHRASE)


def incidence_stats(s, d):
    return rounded(index_of(s, d).incidence_stats(), "sparsity")


def incidence_row(s, d):
    return index_of(s, d).incidence_row(TERM)


def wildcard_terms(s, d):
    return wildcard.matching_terms(index_of(s, d), WILDCARD).select("term", "df")


def wildcard_candidates(s, d):
    return wildcard.candidates(index_of(s, d), WILDCARD)


def wildcard_search(s, d):
    return rounded(wildcard.search(index_of(s, d), WILDCARD), "score")


# Keyword ranking.
def keyword_ranked(s, d):
    return rounded(sparse.search(index_of(s, d), Q.parse(FREE_TEXT)), "score")


def keyword_boolean_ranked(s, d):
    return rounded(sparse.search(index_of(s, d), Q.parse(AND_NOT)), "score")


def keyword_phrase_ranked(s, d):
    return rounded(sparse.search(index_of(s, d), Q.parse(PHRASE)), "score")


def keyword_phrase_boost(s, d):
    return rounded(sparse.search(index_of(s, d), Q.parse(BOOSTED)), "score")


def keyword_many(s, d):
    rows = [(i, t, 1.0) for i, q in JUDGED.items() for t in Q.searched_terms(q)]
    return rounded(sparse.rank_many(index_of(s, d), s.createDataFrame(rows, "query_id int, term string, weight double")), "score")


# Dense vectors.
def dense_topk(s, d):
    return rounded(dense.search_by_vector(chunk_vectors(s, d, False), query_vector(s, d)), "score")


def dense_doc_maxpool(s, d):
    return rounded(dense.search_by_vector(chunk_vectors(s, d), query_vector(s, d)), "score")


def doc_mean_vector(s, d):
    means = dense.document_vectors(chunk_vectors(s, d))
    return rounded(means.select("doc_id", F.posexplode("embedding").alias("dim", "x")), "x")


def weighted_query_vector(s, d):
    rows = table(s, d, "embeddings").where("vec_id < 3").select("embedding", (1.0 / (1 + F.col("vec_id"))).alias("weight"))
    return rounded(dense.weighted_sum(rows).select(F.posexplode("embedding").alias("dim", "x")), "x")


def similar_docs(s, d):
    return rounded(dense.similar(dense.document_vectors(chunk_vectors(s, d)), 0), "score")


def kmeans_clusters(s, d):
    clusters, _ = dense.kmeans(chunk_vectors(s, d, False).select("doc_id", "embedding"))
    return clusters


def ivf_topk(s, d):
    index = dense.CellIndex.build(chunk_vectors(s, d, False), new_path(s, "cells"))
    return rounded(index.search(query_vector(s, d)), "score")


# Fusion.
def _lists(s, d):
    keyword = sparse.search(index_of(s, d), Q.parse(FREE_TEXT), 20)
    return keyword, dense.search_by_vector(chunk_vectors(s, d, False), query_vector(s, d), 20)


def rrf_fusion(s, d):
    return rounded(sparse.top(fusion.reciprocal(*_lists(s, d)), fixed.TOP_K), "score")


def weighted_rrf(s, d):
    return rounded(sparse.top(fusion.reciprocal(*_lists(s, d), Q.fusion_weights(Q.parse(FREE_TEXT))), fixed.TOP_K), "score")


def rrf_details(s, d):
    return rounded(fusion.details(*_lists(s, d)), "keyword_score", "semantic_score", "keyword_rrf", "semantic_rrf", "score")


def rerank_blend(s, d):
    keyword, semantic = _lists(s, d)
    return rounded(fusion.blend(fusion.reciprocal(keyword, semantic), sparse.top(semantic, fixed.TOP_K)), "score")


def linear_fusion(s, d):
    return rounded(sparse.top(fusion.linear(list(_lists(s, d)), [0.4, 0.6]), fixed.TOP_K), "score")


def union_max(s, d):
    return rounded(sparse.top(fusion.greatest(*_lists(s, d)), fixed.TOP_K), "score")


def display_scores(s, d):
    keyword, _ = _lists(s, d)
    return keyword.select("doc_id", fusion.display(F.col("score") * 10).alias("shown"), F.round(fusion.min_max(F.col("score")), 6).alias("normal"))


def rerank(s, d):
    keyword, _ = _lists(s, d)
    return rounded(fusion.rerank(FREE_TEXT, keyword, docs_of(s, d), Overlap()), "score")


@dataclass(frozen=True)
class Known:
    """An encoder whose every text has one vector: searches that depend on nothing but the tables."""

    vector: list[float]

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vector] * len(texts))


class Overlap:
    """A stand-in for a cross-encoder: the share of the query's terms that a text holds."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(Q.searched_terms(query))
        return [len(wanted & set(Q.searched_terms(t))) / max(len(wanted), 1) for t in texts]


def session_of(s, d):
    return S.SearchSession(docs_of(s, d), index_of(s, d), chunk_vectors(s, d, False), Known(query_vector(s, d)))


def semantic_search(s, d):
    return rounded(session_of(s, d).semantic_with_language(FREE_TEXT), "score")


def hybrid_search(s, d):
    return rounded(session_of(s, d).hybrid(FREE_TEXT), "score")


def search_modes(s, d):
    session, out = session_of(s, d), None
    for mode, text in (*((m, FREE_TEXT) for m in S.MODES), ("wildcard", WILDCARD)):
        one = session.ranked(text, mode if mode in S.MODES else "hybrid").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "score")


def search_results(s, d):
    return S.results(sparse.search(index_of(s, d), Q.parse(FREE_TEXT)), docs_of(s, d).select("doc_id", "text", "source"), FREE_TEXT).drop("raw_score")


# Queries.
PARSED = ["network security", "electricity", "id card", "house permission form", '"er en"', "th*ed", "terms and conditions", "విద్య", "", '"', "bonafide 2024 timetable"]


def query_parse(s, d):
    rows = [(q, p.type, p.language, p.expand_reason, " ".join(p.intent), p.use_weighted_embedding, t, None if t is None else float(p.weighted_terms[t])) for q in PARSED for p in [Q.parse(q)] for t in p.weighted_terms or [None]]
    return s.createDataFrame(rows, "query string, type string, language string, expand_reason string, intent string, weighted boolean, term string, weight double")


def query_weights(s, d):
    rows = [(q, *Q.fusion_weights(Q.parse(q)), Q.is_short(q)) for q in PARSED]
    return rounded(s.createDataFrame(rows, "query string, keyword double, semantic double, short boolean"), "keyword", "semantic")


def synonyms_clean(s, d):
    """Cleaned, written, and read again."""
    path = new_path(s, "synonyms")
    storage.save_json(s, path, Q.clean_synonyms(fixed.SYNONYMS))
    rows = [(lang, term, word) for lang, entries in storage.load_json(s, path).items() for term, words in entries.items() for word in words]
    return s.createDataFrame(rows, "lang string, term string, synonym string")


def synonym_forms(s, d):
    return docs_of(s, d).select("doc_id", T.synonym_form(F.substring("text", 1, 40), F.col("lang")).alias("form"))


def name_terms(s, d):
    """Names of three kinds: the page's own, one with tags and one with search terms."""
    named = table(s, d, "pages").select("page_id", F.explode(F.array("url", F.concat(F.lit("d/my_id-card."), "page_id", F.lit(".pdf")), F.lit("d/house_permission-electricity.docx"))).alias("path"))
    return named.select("page_id", "path", T.with_name_terms(F.lit("x"), F.col("path")).alias("text"))


# Files: the benchmark's texts are written as files, scanned and read again.
def file_documents(s, d):
    path = new_path(s, "files")
    table(s, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    found = files.documents(s, path, name_terms=False)
    return found.select("doc_id", F.regexp_extract("file_path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "file_type", "text")


def office_documents(s, d):
    """Word, Excel and PDF files, and one that is none of them, made of each text and read again."""

    def made(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                rows += [(f"{item}.docx", "docx", samples.word(text.split("\n"))), (f"{item}.xlsx", "excel", samples.excel([text.split()[:3]])), (f"{item}.pdf", "pdf", samples.pdf([text.split()[:4], text.split()[4:6]]))]
                rows.append((f"{item}.png", "image", b"no picture"))
            yield pd.DataFrame(rows, columns=["file_path", "file_type", "content"])

    content = table(s, d, "benchmark").select("item_id", "text").mapInPandas(made, "file_path string, file_type string, content binary")
    kept = files.extracted(content).select("file_path", "file_type", "text", F.size("pages").alias("n_pages"))
    lost = files.dropped(content).select("file_path", "file_type", F.col("reason").alias("text"), F.lit(-1).alias("n_pages"))
    return kept.unionByName(lost)


def saved_history(s, d):
    """Searches appended in two parts, then read, collapsed and bounded."""
    path = new_path(s, "history")
    rows = table(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts")
    for part in (0, 1):
        storage.append_history(rows.where(F.col("event_id") % 2 == part), path)
    return collapsed(s.read.parquet(path), fixed.HISTORY).select("event_id", "user_id", "action", "place")


# The incidence matrix, clusters.
def incidence_cells(s, d):
    return index_of(s, d).incidence()


def incidence_column(s, d):
    return index_of(s, d).incidence_column(0)


def _clusters(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("cluster"))


def cluster_sizes(s, d):
    return dense.cluster_sizes(_clusters(s, d), 12)


def similar_in_cluster(s, d):
    return rounded(dense.similar(dense.document_vectors(chunk_vectors(s, d, False)), 0, clusters=_clusters(s, d)), "score")


# Evaluation: documents of quality 1 are relevant to every query.
def _judged(s, d, weights=None):
    rows = [(i, t, w) for i, q in JUDGED.items() for t, w in ({t: 1.0 for t in Q.searched_terms(q)} if weights is None else weights[i]).items()]
    rankings = sparse.rank_many(index_of(s, d), s.createDataFrame(rows, "query_id int, term string, weight double"))
    good = table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("name"))
    relevant = good.crossJoin(F.broadcast(s.createDataFrame([(i,) for i in JUDGED], "query_id int")))  # a handful of queries
    return evaluate.per_query(rankings.select("query_id", F.col("doc_id").alias("name"), "rank"), relevant)


METRICS = ["reciprocal_rank", "average_precision", "precision_5", "recall_5", "f1_5", "precision_10", "recall_10", "f1_10"]


def eval_per_query(s, d):
    return rounded(_judged(s, d), *METRICS)


def eval_aggregate(s, d):
    return rounded(evaluate.aggregate(_judged(s, d)), "mrr", "map", *METRICS[2:])


def expansion_ab(s, d):
    return rounded(evaluate.compare(_judged(s, d), _judged(s, d, EXPANDED)), "delta_ap", "delta_rr")


def failing_queries(s, d):
    return evaluate.failures(_judged(s, d)).select("query_id", "num_retrieved")


def without_failures(s, d):
    return rounded(E.without_failures(_judged(s, d)), "mrr", "map", *METRICS[2:])


def short_expansion_ab(s, d):
    short = list(E.short_queries(JUDGED))
    return rounded(evaluate.compare(_judged(s, d), _judged(s, d, EXPANDED)).where(F.col("query_id").isin(short)), "delta_ap", "delta_rr")


def metric_report(s, d):
    return storage.report(evaluate.aggregate(_judged(s, d)))


MODE_QUERIES = {1: "thing ering er en", 2: "ention stent", 4: "eau pour"}


def eval_modes(s, d):
    good = table(s, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("name"))
    judgments = good.crossJoin(F.broadcast(s.createDataFrame(list(MODE_QUERIES.items()), "query_id int, query string")))  # a handful of queries
    out = None
    for mode, found in session_of(s, d).evaluate(judgments, "doc_id").items():
        one = rounded(found, *METRICS).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def _grid_lists(s, d):
    """Score lists of all judged queries: keyword, semantic (query i is vector i), and the reranker's on the first."""
    rows = [(i, t, 1.0) for i, q in JUDGED.items() for t in Q.searched_terms(q)]
    keyword = storage.held(sparse.rank_many(index_of(s, d), s.createDataFrame(rows, "query_id int, term string, weight double"), 30).drop("rank"))
    vectors = chunk_vectors(s, d, False)
    asked = F.broadcast(vectors.where(F.col("doc_id").isin(list(JUDGED))).select(F.col("doc_id").cast("int").alias("query_id"), F.col("embedding").alias("asked")))  # a handful of queries
    scores = vectors.crossJoin(asked).select("query_id", "doc_id", dense.dot(F.col("embedding"), F.col("asked")).alias("score"))
    semantic = storage.held(fusion.ranked(scores, "query_id").where("rank <= 30").drop("rank"))
    return keyword, semantic, E.rerank_many(keyword, docs_of(s, d), JUDGED, Overlap())


GRID = [(0.2, 0.8), (0.3, 0.7), (0.4, 0.6), (0.5, 0.5)]


def fusion_grid(s, d):
    keyword, semantic, reranked = _grid_lists(s, d)
    return S.grid(keyword, semantic, reranked, [(k, m, r) for k, m in GRID for r in (0.0, 0.2, 0.4)], fixed.TOP_K).drop("score")


def _relevant(s, d):
    good = table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("name"))
    return good.crossJoin(F.broadcast(s.createDataFrame([(i,) for i in JUDGED], "query_id int")))  # a handful of queries


def two_stage_grid(s, d):
    found = E.two_stage_grid(*_grid_lists(s, d), _relevant(s, d), GRID, [0.2, 0.4])
    return rounded(found.select("stage", "w0", "w1", "w2", "mrr", "map", "precision_5", "recall_5"), "mrr", "map", "precision_5", "recall_5")


def guarded_grid(s, d):
    found = E.two_stage_grid(*_grid_lists(s, d), _relevant(s, d), GRID, [0.2, 0.4]).where("stage = 1")
    return rounded(evaluate.guarded(found).select("w0", "w1", "precision_5", "recall_5"), "precision_5", "recall_5")


def rerank_comparison(s, d):
    keyword, _, reranked = _grid_lists(s, d)
    names = lambda df: df.withColumnRenamed("doc_id", "name").select("query_id", "name", "rank")
    before = evaluate.per_query(names(fusion.ranked(keyword, "query_id").where(F.col("rank") <= fixed.TOP_K)), _relevant(s, d))
    after = evaluate.per_query(names(E.reranked(reranked)), _relevant(s, d))
    return rounded(evaluate.compare(before, after), "delta_ap", "delta_rr")


def history_dedup(s, d):
    rows = table(s, d, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts")
    return collapsed(rows, fixed.HISTORY).select("event_id", "user_id", "action", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens_per_doc, token_positions, stopword_filtered_counts, language_detect, doc_language_label, char_ngrams, bigram_index, normalized_names, file_types,
        embedding_inputs, rerank_texts, plain_queries, snippets, headings, fixed_chunks, sentence_split, semantic_chunks, doc_freq, postings, doc_lengths, idf,
        tfidf_weights, doc_norms, top_terms, term_lookup, bool_and, bool_or, bool_not, bool_and_not, phrase_match, incidence_stats, incidence_row, wildcard_terms,
        wildcard_candidates, wildcard_search, keyword_ranked, keyword_boolean_ranked, keyword_phrase_ranked, keyword_phrase_boost, keyword_many, dense_topk,
        dense_doc_maxpool, doc_mean_vector, weighted_query_vector, similar_docs, kmeans_clusters, ivf_topk, rrf_fusion, weighted_rrf, rrf_details, rerank_blend,
        linear_fusion, union_max, display_scores, rerank, hybrid_search, search_results, query_parse, synonyms_clean, eval_per_query, eval_aggregate, expansion_ab,
        failing_queries, fusion_grid, history_dedup, query_weights, synonym_forms, name_terms, file_documents, office_documents, saved_history, incidence_cells,
        incidence_column, cluster_sizes, similar_in_cluster, semantic_search, search_modes, without_failures, short_expansion_ab, metric_report, eval_modes,
        two_stage_grid, guarded_grid, rerank_comparison,
    )
}
