"""Structured Streaming: documents that arrive become tokens and running document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T
from tessera.operators.index import positions


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the tokens of every batch of a stream of docs (doc_id, text) under path, each batch once."""

    def append(batch: DataFrame, number: int) -> None:
        positions(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies(docs: DataFrame) -> DataFrame:
    """Running count of documents by term, as a streaming aggregation; a document comes once."""
    terms = F.array_distinct(F.filter(T.tokens(F.col("text")), T.is_indexed))
    return docs.select("doc_id", F.explode(terms).alias("term")).groupBy("term").agg(F.count("doc_id").alias("df"))


def collapsed(history: DataFrame, keep: int) -> DataFrame:
    """Of each user's runs of one action the latest, the newest `keep` of these (user_id, action, ts)."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    newer = F.lag("action").over(order)
    runs = history.withColumn("newer", newer).where(F.col("newer").isNull() | (F.col("newer") != F.col("action")))
    return runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("newer")
