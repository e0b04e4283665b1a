"""Experiments over a set of judged queries: fusion grids in two stages, reranking, failures, cell sweeps, timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import query as Q
from tessera.functions import text as T
from tessera.operators import dense, evaluate
from tessera.operators.fusion import Reranker
from tessera.operators.sparse import DECIMALS
from tessera.plans.session import grid
from tessera.sources.storage import held


def rerank_many(scores: DataFrame, docs: DataFrame, queries: dict[int, str], reranker: Reranker, candidates: int = fixed.RERANK_CANDIDATES) -> DataFrame:
    """query_id, doc_id, score (the reranker's), fused of the first candidates of every query (query_id, doc_id, score).

    Candidates are a bounded list for each query; their texts are found by literal ids and scored in Arrow batches."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "doc_id")
    first = held(scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= candidates).select("query_id", "doc_id", F.col("score").alias("fused")))
    ids = [r["doc_id"] for r in first.select("doc_id").distinct().collect()]
    texts = docs.where(F.col("doc_id").isin(ids)).select("doc_id", T.rerank_input(F.col("text")).alias("text")).where("text <> ''")

    @F.pandas_udf("double")
    def scored(query_id, text):  # type: ignore[no-untyped-def]
        import pandas as pd

        out = pd.Series(0.0, index=text.index)
        for number, own in text.groupby(query_id):
            out[own.index] = reranker.score(queries[number], own.tolist())
        return out

    return texts.join(F.broadcast(first), "doc_id").select("query_id", "doc_id", scored("query_id", "text").alias("score"), "fused")


def reranked(scores: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """rank by the reranker's score, then the fused one."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), F.round("fused", DECIMALS).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grid_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """configuration and the aggregate metrics of each configuration of a grid (configuration, query_id, name, rank), all in
    one pass: a query of a configuration is a query of its own."""
    own = F.struct("configuration", "query_id").alias("query_id")
    points = F.broadcast(ranked.select("configuration").distinct())  # the grid's few points
    metrics = evaluate.per_query(ranked.select(own, "name", "rank"), relevant.crossJoin(points).select(own, "name"))
    return evaluate.aggregate(metrics.withColumn("configuration", F.col("query_id.configuration")), "configuration")


def two_stage_grid(keyword: DataFrame, semantic: DataFrame, rerank: DataFrame, relevant: DataFrame, first: list[tuple[float, float]], second: list[float], k: int = fixed.TOP_K, kept: int = 3) -> DataFrame:
    """w0, w1, w2 and aggregate metrics: all weights of the first stage without a reranker, then its best `kept` with each
    reranker weight. The score lists have query_id, doc_id, score; relevant has query_id, name, where name is the doc_id."""

    def metrics(weights: list[tuple[float, float, float]], stage: int) -> DataFrame:
        ranked = held(grid(keyword, semantic, rerank, weights, k)).withColumnRenamed("doc_id", "name")  # k rows a query and point
        table = keyword.sparkSession.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weights)], "configuration int, w0 double, w1 double, w2 double")
        return grid_metrics(ranked, relevant).join(F.broadcast(table), "configuration").withColumn("stage", F.lit(stage))

    coarse = held(metrics([(a, b, 0.0) for a, b in first], 1))
    best = [(r["w0"], r["w1"]) for r in evaluate.best_configurations(coarse, kept).collect()]
    fine = metrics([(a, b, w) for a, b in best for w in second], 2)
    return coarse.unionByName(fine)


def without_failures(metrics: DataFrame) -> DataFrame:
    """The aggregate of the queries that find anything relevant."""
    return evaluate.aggregate(metrics.where("reciprocal_rank > 0"))


def short_queries(queries: dict[int, str]) -> dict[int, str]:
    return {i: q for i, q in queries.items() if Q.is_short(q)}


def timed(search: Callable[[object], DataFrame], queries: Iterable[object], warm: int = 3) -> dict[str, float]:
    """Mean milliseconds and queries a second of a search, after some to warm up."""
    queries = list(queries)
    for q in queries[:warm]:
        search(q).collect()
    began = time.perf_counter()
    for q in queries:
        search(q).collect()
    seconds = max(time.perf_counter() - began, 1e-9)
    return {"mean_ms": 1000 * seconds / max(len(queries), 1), "qps": len(queries) / seconds}


def cell_sweep(vectors: DataFrame, path: str, cells: Iterable[int], shares: Iterable[float], queries: list[list[float]], k: int = fixed.TOP_K) -> list[dict[str, float]]:
    """Recall against exact search, and time, for every number of cells and share of them that is read."""
    exact = [{r["doc_id"] for r in dense.search_by_vector(vectors, q, k).collect()} for q in queries]
    rows = []
    for n in cells:
        index = dense.CellIndex.build(vectors, f"{path}/cells-{n}", n)
        for share in shares:
            nprobe = max(1, round(n * share))
            found = [{r["doc_id"] for r in index.search(q, k, nprobe).collect()} for q in queries]
            hit = sum(len(a & b) / max(len(b), 1) for a, b in zip(found, exact, strict=True)) / max(len(queries), 1)
            rows.append({"cells": n, "nprobe": nprobe, "recall": hit} | timed(lambda q, index=index, nprobe=nprobe: index.search(q, k, nprobe), queries, 1))
    return rows
