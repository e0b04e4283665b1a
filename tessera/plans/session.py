"""A search session: build or load an index, search it in any mode, evaluate it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import query as Q
from tessera.functions import text as T
from tessera.operators import chunk, dense, evaluate, fusion, sparse, wildcard
from tessera.operators.index import Index
from tessera.sources.storage import held, new_path

MODES = ("keyword", "semantic", "hybrid")


@dataclass
class SearchSession:
    docs: DataFrame  # doc_id, text and what is to be shown
    index: Index
    vectors: DataFrame  # doc_id, chunk_id, embedding
    encoder: dense.Encoder = field(default_factory=dense.HashEncoder)
    reranker: fusion.Reranker | None = None
    english_only: bool = False
    synonyms: dict | None = None
    cells: dense.CellIndex | None = None  # approximate search reads some of its cells instead of all vectors

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, encoder: dense.Encoder | None = None, **options) -> SearchSession:
        encoder = encoder or dense.HashEncoder()
        path = path or new_path(docs.sparkSession, "session")
        index = Index.build(docs, f"{path}/index")
        docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/documents")  # so that a lookup prunes
        dense.encoded(chunk.semantic_chunks(docs, encoder), encoder).drop("text").write.parquet(f"{path}/vectors")
        spark = docs.sparkSession
        return cls(spark.read.parquet(f"{path}/documents"), index, spark.read.parquet(f"{path}/vectors"), encoder, **options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, encoder: dense.Encoder | None = None, **options) -> SearchSession:
        return cls(spark.read.parquet(f"{path}/documents"), Index.load(spark, f"{path}/index"), spark.read.parquet(f"{path}/vectors"), encoder or dense.HashEncoder(), **options)

    def keyword(self, query: str, k: int = fixed.TOP_K) -> DataFrame:
        return sparse.search(self.index, Q.parse(query, self.synonyms), k)

    def semantic(self, query: str, k: int = fixed.TOP_K) -> DataFrame:
        parsed = Q.parse(query, self.synonyms)
        vector = dense.weighted_vector(self.encoder, parsed.weighted_terms) if parsed.use_weighted_embedding else self.encoder.encode([f"query: {Q.plain(query)}"])[0].tolist()
        return self.cells.search(vector, k) if self.cells is not None else dense.search_by_vector(self.vectors, vector, k)

    def semantic_with_language(self, query: str, k: int = fixed.TOP_K) -> DataFrame:
        return self.semantic(query, k).withColumn("query_language", F.lit(Q.language(query)))

    def hybrid(self, query: str, k: int = fixed.TOP_K) -> DataFrame:
        """Weighted reciprocal ranks of both lists; where a reranker is set and the language allows it, blended with it."""
        reranked = self.reranker is not None and (not self.english_only or Q.language(query) == "en")
        depth = max(2 * k, fixed.RERANK_CANDIDATES if reranked else 0)
        # Two lists of at most depth rows, kept so that neither search runs twice.
        fused = fusion.reciprocal(held(self.keyword(query, depth)), held(self.semantic(query, depth)), Q.fusion_weights(Q.parse(query, self.synonyms)))
        if not reranked:
            return sparse.top(fused, k)
        fused = held(fused)
        return fusion.blend(fused, fusion.rerank(query, fused, self.docs, self.reranker, k), k)

    def details(self, query: str, k: int = fixed.TOP_K) -> DataFrame:
        return fusion.details(self.keyword(query, 2 * k), self.semantic(query, 2 * k), k)

    def ranked(self, query: str, mode: str = "hybrid", k: int = fixed.TOP_K) -> DataFrame:
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if Q.parse(query).type == "wildcard":
            return wildcard.search(self.index, query, k)
        return getattr(self, mode)(query, k)

    def search(self, query: str, mode: str = "hybrid", k: int = fixed.TOP_K) -> DataFrame:
        return results(self.ranked(query, mode, k), self.docs, query)

    def evaluate(self, judgments: DataFrame, name: str, modes: tuple[str, ...] = MODES, k: int = fixed.TOP_K) -> dict[str, DataFrame]:
        """Metrics by query for every mode; judgments has query_id, query, name, and name is a column of docs."""
        queries = {r["query_id"]: r["query"] for r in judgments.select("query_id", "query").distinct().collect()}  # the judged set
        return {m: evaluate.per_query(run_all(queries, lambda q, m=m: getattr(self, m)(q, k), self.docs, name), judgments) for m in modes}


def run_all(queries: dict[int, str], search: Callable[[str], DataFrame], docs: DataFrame, name: str) -> DataFrame:
    """query_id, name, rank of a search function's results for all queries."""
    out = None
    for query_id, query in queries.items():
        one = fusion.ranked(search(query)).withColumn("query_id", F.lit(query_id)).select("query_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    found = held(out)  # k rows a query
    ids = [r["doc_id"] for r in found.select("doc_id").distinct().collect()]
    names = docs.where(F.col("doc_id").isin(ids)).select("doc_id", T.normal_name(F.col(name).cast("string")).alias("name"))
    # A result without a document, as another table's vectors can give, was retrieved all the same and is not relevant.
    return found.join(names, "doc_id", "left").select("query_id", "name", "rank")


def results(ranked: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """rank, doc_id, score as shown, raw_score, snippet, language and the documents' other columns; k rows.

    The k ids are literals of the scan's filter: of documents sorted by doc_id a few row groups are read."""
    ranked = held(ranked)
    shown = fusion.ranked(ranked).select("doc_id", "rank", F.col("score").alias("raw_score"), fusion.display(F.col("score")).alias("score"))
    text = F.col("text")
    found = docs.where(F.col("doc_id").isin([r["doc_id"] for r in ranked.select("doc_id").collect()])).join(F.broadcast(shown), "doc_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "rank", "score", "raw_score", "snippet", "language")]
    return found.select("rank", "doc_id", "score", F.round("raw_score", 4).alias("raw_score"), T.snippet(text, query).alias("snippet"), T.language_label(text).alias("language"), *others).orderBy("rank")


def grid(keyword: DataFrame, semantic: DataFrame, reranked: DataFrame, weights: list[tuple[float, float, float]], k: int) -> DataFrame:
    """configuration, query_id, doc_id, rank of a linear fusion of three score lists (query_id, doc_id, score), for all
    weights at once: the lists meet a table of weights of a few rows."""
    from pyspark.sql import Window

    spark = keyword.sparkSession
    table = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weights)], "configuration int, w0 double, w1 double, w2 double")
    over, parts = Window.partitionBy("query_id"), None
    for i, scores in enumerate((keyword, semantic, reranked)):
        one = scores.select("query_id", "doc_id", fusion.min_max(F.col("score"), over).alias("x"), F.lit(i).alias("side"))
        parts = one if parts is None else parts.unionByName(one)
    weight = F.when(F.col("side") == 0, F.col("w0")).when(F.col("side") == 1, F.col("w1")).otherwise(F.col("w2"))
    total = parts.crossJoin(F.broadcast(table)).groupBy("configuration", "query_id", "doc_id").agg(F.sum(F.col("x") * weight).alias("score"))
    order = Window.partitionBy("configuration", "query_id").orderBy(F.round("score", sparse.DECIMALS).desc(), "doc_id")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
