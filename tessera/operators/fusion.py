"""Fusion of ranked lists (doc_id, score), and reranking."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text as T
from tessera.operators.sparse import DECIMALS, top


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """With a 1-based rank; ties go to the least doc_id. The lists are top-k results, so the window is small."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("score", DECIMALS).desc(), "doc_id")))


def reciprocal(keyword: DataFrame, semantic: DataFrame, weights: tuple[float, float] = (1.0, 1.0), c: int = fixed.RRF_K) -> DataFrame:
    """Sum of weight / (c + rank) over both lists."""
    lists = [ranked(x).select("doc_id", (F.lit(w) / (c + F.col("rank"))).alias("part")) for x, w in zip((keyword, semantic), weights, strict=True)]
    return lists[0].unionByName(lists[1]).groupBy("doc_id").agg(F.sum("part").alias("score"))


def details(keyword: DataFrame, semantic: DataFrame, k: int = fixed.TOP_K, c: int = fixed.RRF_K) -> DataFrame:
    """Ranks, scores and parts of both lists beside the plain fused score."""

    def side(x: DataFrame, name: str) -> DataFrame:
        return ranked(x).select("doc_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"), (1.0 / (c + F.col("rank"))).alias(f"{name}_rrf"))

    both = side(keyword, "keyword").join(side(semantic, "semantic"), "doc_id", "full_outer").fillna(0.0, ["keyword_rrf", "semantic_rrf"])
    return top(both.withColumn("score", F.col("keyword_rrf") + F.col("semantic_rrf")), k)


def min_max(score: Column, window: Window | None = None) -> Column:
    """0 to 1 over the whole list; a flat list is all 0."""
    over = window if window is not None else Window.partitionBy()
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high - low <= fixed.FLAT, 0.0).otherwise((score - low) / (high - low))


def display(score: Column) -> Column:
    """As shown: kept where all lie in 0 to 1, else min-max, a flat list 0.5; four decimals."""
    over = Window.partitionBy()
    low, high = F.min(score).over(over), F.max(score).over(over)
    shown = F.when((low >= 0) & (high <= 1), score).when(high == low, 0.5).otherwise((score - low) / (high - low))
    return F.round(shown, 4)


def blend(fused: DataFrame, reranked: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Min-max of all fused scores and of the reranked ones, weighed; a missing one is 0."""
    w = min(fixed.RERANK_WEIGHT, fixed.RERANK_MAX)
    a = fused.select("doc_id", min_max(F.col("score")).alias("a"))
    b = reranked.select("doc_id", min_max(F.col("score")).alias("b"))
    both = a.join(b, "doc_id", "full_outer").fillna(0.0, ["a", "b"])
    return top(both.select("doc_id", (F.col("a") * (1 - w) + F.col("b") * w).alias("score")), k)


def linear(lists: list[DataFrame], weights: list[float]) -> DataFrame:
    """Weighted sum of min-max scores; a missing one is 0."""
    parts = None
    for x, w in zip(lists, weights, strict=True):
        one = x.select("doc_id", (min_max(F.col("score")) * w).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("doc_id").agg(F.sum("part").alias("score"))


def greatest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each document's better score, 0 at least."""
    return a.unionByName(b).groupBy("doc_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


class Reranker(Protocol):
    """Scores of (query, text) pairs."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


def rerank(query: str, fused: DataFrame, docs: DataFrame, reranker: Reranker | None, k: int = fixed.TOP_K) -> DataFrame:
    """The first RERANK_CANDIDATES by the reranker's score, then the fused one; without a reranker the fused order."""
    if reranker is None:
        return top(fused, k)
    first = top(fused, fixed.RERANK_CANDIDATES)
    texts = docs.join(F.broadcast(first), "doc_id").select("doc_id", F.col("score").alias("fused"), T.rerank_input(F.col("text")).alias("text")).where("text <> ''")

    @F.pandas_udf("double")
    def scored(text):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(reranker.score(query, text.tolist()), dtype="float64")

    found = texts.select("doc_id", "fused", scored("text").alias("score"))
    return found.orderBy(F.col("score").desc(), F.col("fused").desc(), "doc_id").limit(k).select("doc_id", "score")
