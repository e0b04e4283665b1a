"""Dense vectors: encoders, exact and cell-pruned search, document vectors, clusters, similar documents.

Vectors are array columns; exact search is a broadcast query of one row against a scan, with TakeOrderedAndProject. The
approximate index deals vectors to K-means cells, is partitioned by cell on disk, and reads the nprobe nearest cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.query import raw_tokens, searched
from tessera.operators.sparse import DECIMALS, top


class Encoder(Protocol):
    """Texts to unit vectors; instances travel to executors, so models are loaded there on first use."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(1 << 18)
def hashed(token: str) -> int:
    """Of the term that a query makes of a token; -1 where it keeps none."""
    term = searched(token)
    return -1 if term is None else crc32(term.encode())


@dataclass(frozen=True)
class HashEncoder:
    """A deterministic stand-in for a model: signed hashes of a text's terms, to unit length."""

    dimensions: int = 384

    def encode(self, texts: list[str]) -> np.ndarray:
        found = [raw_tokens(text.lower()) for text in texts]
        hashes = np.fromiter(map(hashed, chain.from_iterable(found)), np.int64)
        at = np.repeat(np.arange(len(texts)), [len(x) for x in found]) * self.dimensions + hashes % self.dimensions
        kept = hashes >= 0
        out = np.bincount(at[kept], np.where(hashes[kept] >> 31, 1.0, -1.0), len(texts) * self.dimensions)
        out = out.reshape(len(texts), self.dimensions).astype(np.float32)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def encoded(rows: DataFrame, encoder: Encoder, text: str = "text", prefix: str = "passage: ") -> DataFrame:
    """rows with an embedding column; Arrow batches, one encoder call each."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder.encode([prefix + (t or "").strip() if (t or "").strip() else "" for t in batch[text].to_pylist()]) if len(batch) else np.zeros((0, 1), np.float32)
            flat = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], pa.array(vectors.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*names, "embedding"])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def pooled(chunks: DataFrame, k: int) -> DataFrame:
    """Documents by their best chunk, out of the best OVERSAMPLE * k chunks (so fewer than k may come back)."""
    best = chunks.orderBy(F.round("score", DECIMALS).desc(), "doc_id", "chunk_id").limit(fixed.OVERSAMPLE * k)
    return top(best.groupBy("doc_id").agg(F.max("score").alias("score")), k)


def search_by_vector(vectors: DataFrame, query: list[float], k: int = fixed.TOP_K) -> DataFrame:
    """Exact search over vectors (doc_id, chunk_id, embedding)."""
    return pooled(vectors.select("doc_id", "chunk_id", dot(F.col("embedding"), literal(query)).alias("score")), k)


def weighted_vector(encoder: Encoder, weights: dict[str, float]) -> list[float]:
    """Weighted sum of the terms' vectors, to unit length; empty terms and weights of zero or less are left out."""
    live = {t: w for t, w in weights.items() if t.strip() and w > 0}
    total = (encoder.encode([f"query: {t}" for t in live]) * np.array(list(live.values()))[:, None]).sum(axis=0) if live else np.zeros(1)
    size = float(np.linalg.norm(total))
    return (total / size if size else total).tolist()


def weighted_sum(vectors: DataFrame, weight: str = "weight") -> DataFrame:
    """The same for rows (embedding, weight): one row with the unit vector, summed by dimension."""
    parts = vectors.select(F.posexplode("embedding").alias("dim", "x"), F.col(weight).alias("w")).groupBy("dim").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("x"))
    whole = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("embedding"))


def document_vectors(vectors: DataFrame) -> DataFrame:
    """doc_id and the mean of its chunks' vectors, not brought to unit length again."""
    means = vectors.select("doc_id", F.posexplode("embedding").alias("dim", "x")).groupBy("doc_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("embedding"))


def similar(docs: DataFrame, doc_id: int, k: int = 5, clusters: DataFrame | None = None) -> DataFrame:
    """The k documents of the same cluster (of all, where it has none) with the greatest dot product, without itself."""
    target = docs.where(F.col("doc_id") == doc_id).select(F.col("embedding").alias("target")).limit(1)
    others = docs.where(F.col("doc_id") != doc_id)
    if clusters is not None:
        own = [r["cluster"] for r in clusters.where(F.col("doc_id") == doc_id).select("cluster").limit(1).collect()]
        if own:
            others = others.join(clusters.where(F.col("cluster") == own[0]), "doc_id", "left_semi")
    return top(others.crossJoin(F.broadcast(target)).select("doc_id", dot(F.col("embedding"), F.col("target")).alias("score")), k)


def kmeans(docs: DataFrame, k: int = fixed.CLUSTERS, runs: int = fixed.CLUSTER_RUNS, seed: int = fixed.CLUSTER_SEED) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, cluster) and the centres: the cheapest of several seeded runs, at most one cluster a document."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = docs.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    most = len(rows.limit(k).collect())
    models = [KMeans(k=min(k, most), seed=seed + r).fit(rows) for r in range(runs if most > 1 else 0)]
    if not models:
        return docs.select("doc_id", F.lit(0).alias("cluster")), np.zeros((most, 0))
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(rows).select("doc_id", F.col("prediction").alias("cluster")), np.array(best.clusterCenters())


def cluster_sizes(clusters: DataFrame, k: int) -> DataFrame:
    """cluster, size for all k clusters, empty ones too."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    return clusters.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster")).join(sizes, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"))


def cluster_of(clusters: DataFrame, doc_id: int) -> int:
    row = clusters.where(F.col("doc_id") == doc_id).first()
    return row["cluster"] if row else -1


@dataclass
class CellIndex:
    """Approximate search: K-means cells fitted on a bounded sample of vectors, every vector indexed.

    By default there are 32 cells, or more as the vectors grow (the square root of their number over 64), and 18 of 32 are
    read: fewer lose more than a tenth of the true neighbours of vectors without clear clusters (of 64 dimensions), where it
    takes over half of the rows to keep them. Vectors with clusters need less: `tuned` measures how much."""

    vectors: DataFrame  # with a cell column, partitioned by it
    centres: np.ndarray
    nprobe: int = 18

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = 50_000, nprobe: int | None = None) -> CellIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        cells = cells or max(32, round(vectors.count() ** 0.5 / 64))
        chosen = vectors.orderBy(F.xxhash64("doc_id", "chunk_id")).limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        model = KMeans(k=cells, seed=fixed.CLUSTER_SEED).fit(chosen)
        rows = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
        model.transform(rows).drop("features").withColumnRenamed("prediction", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return cls(vectors.sparkSession.read.parquet(path), np.array(model.clusterCenters()), nprobe or -(-cells * 18 // 32))

    def tuned(self, queries: list[list[float]], k: int = fixed.TOP_K, least: float = 0.9) -> CellIndex:
        """The same with the fewest cells read, by doubling, at which a list of queries has this recall on average."""
        exact = [{r["doc_id"] for r in self.search(q, k, len(self.centres)).collect()} for q in queries]
        nprobe = 1
        while nprobe < len(self.centres):
            found = [{r["doc_id"] for r in self.search(q, k, nprobe).collect()} for q in queries]
            if sum(len(a & b) / max(len(b), 1) for a, b in zip(found, exact, strict=True)) >= least * len(queries):
                break
            nprobe *= 2
        return CellIndex(self.vectors, self.centres, min(nprobe, len(self.centres)))

    def search(self, query: list[float], k: int = fixed.TOP_K, nprobe: int | None = None) -> DataFrame:
        distance = ((self.centres - np.asarray(query)) ** 2).sum(axis=1)
        near = np.argsort(distance)[: max(1, nprobe or self.nprobe)].tolist()
        return search_by_vector(self.vectors.where(F.col("cell").isin(near)), query, k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> float:
    """Share of the exact k documents that were found."""
    row = exact.agg(F.count("*").alias("n")).crossJoin(found.join(exact, "doc_id", "left_semi").agg(F.count("*").alias("hit"))).first()
    return row["hit"] / min(k, row["n"]) if row["n"] else 0.0


def perturbed(vectors: DataFrame, n: int, seed: int = 42, noise: float = 0.001) -> DataFrame:
    """n vectors with a little noise, to unit length again: queries for a benchmark."""
    chosen = vectors.orderBy(F.xxhash64("doc_id", "chunk_id", F.lit(seed))).limit(n)
    noisy = chosen.select("doc_id", "chunk_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x") + F.randn(seed) * noise)
    order = Window.partitionBy("doc_id", "chunk_id")
    unit = noisy.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(order)))
    return unit.groupBy("doc_id", "chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("embedding"))
