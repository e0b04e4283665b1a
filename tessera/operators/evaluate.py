"""Retrieval metrics over rankings (query_id, name, rank) and judgments (query_id, name), for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row for each judged query: precision, recall and F1 at k, reciprocal rank, average precision.

    precision divides by k even where fewer came back; a query without judgments or results has zeros."""
    truth = relevant.where("name is not null").distinct().withColumn("hit", F.lit(1))
    counts = relevant.groupBy("query_id").agg(F.countDistinct("name").alias("num_relevant"))
    rows = rankings.join(truth, ["query_id", "name"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at_hit", F.when(F.col("hit") == 1, so_far / F.col("rank")))
    totals = [F.count("*").alias("num_retrieved"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("at_hit").alias("gain")]
    totals += [F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"hits_{k}") for k in ks]
    both = counts.join(rows.groupBy("query_id").agg(*totals), "query_id", "left").fillna(0, ["num_retrieved", "gain", *(f"hits_{k}" for k in ks)])
    known = F.col("num_relevant") > 0
    out = [
        F.col("query_id"), F.col("num_retrieved"), F.col("num_relevant"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(known, F.col("gain") / F.col("num_relevant")).otherwise(0.0).alias("average_precision"),
    ]
    for k in ks:
        p, r = F.col(f"hits_{k}") / k, F.when(known, F.col(f"hits_{k}") / F.col("num_relevant")).otherwise(0.0)
        out += [p.alias(f"precision_{k}"), r.alias(f"recall_{k}"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias(f"f1_{k}")]
    return both.select(*out)


def aggregate(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over all queries, or over those of each group; MRR and MAP among them."""
    means = [c for c in metrics.columns if c.startswith(("precision_", "recall_", "f1_"))]
    return metrics.groupBy(*by).agg(F.count("*").alias("num_queries"), F.avg("reciprocal_rank").alias("mrr"), F.avg("average_precision").alias("map"), *[F.avg(c).alias(c) for c in means])


def compare(before: DataFrame, after: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """improved, hurt or unchanged by average precision, then by reciprocal rank."""
    pick = lambda df, name: df.select("query_id", F.col("average_precision").alias(f"ap_{name}"), F.col("reciprocal_rank").alias(f"rr_{name}"))
    both = pick(before, "before").join(pick(after, "after"), "query_id")
    ap, rr = F.col("ap_after") - F.col("ap_before"), F.col("rr_after") - F.col("rr_before")
    verdict = F.when(ap > epsilon, "improved").when(ap < -epsilon, "hurt").when(rr > epsilon, "improved").when(rr < -epsilon, "hurt").otherwise("unchanged")
    return both.select("query_id", ap.alias("delta_ap"), rr.alias("delta_rr"), verdict.alias("verdict"))


def failures(metrics: DataFrame) -> DataFrame:
    """Queries without any relevant result, or without one in the first five."""
    return metrics.where("reciprocal_rank = 0 or precision_5 = 0")


def best_configurations(results: DataFrame, n: int = 3) -> DataFrame:
    """Of a grid (configuration, mrr, map) the n best by the mean of both."""
    return results.withColumn("mean", F.round((F.col("mrr") + F.col("map")) / 2, 9)).orderBy(F.desc("mean"), "configuration").limit(n)


def guarded(results: DataFrame, loss: float = 0.03) -> DataFrame:
    """Configurations whose recall_5 is near the best one's, by precision, MAP and MRR."""
    best = F.max("recall_5").over(Window.partitionBy())  # a grid's few rows
    near = results.withColumn("best", best).where(F.col("recall_5") >= F.col("best") - loss - 1e-9).drop("best")
    return near.orderBy(*(F.round(m, 9).desc() for m in ("precision_5", "map", "mrr")))
