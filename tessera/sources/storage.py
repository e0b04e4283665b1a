"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where one machine is the whole cluster, as in tests.
LOCAL = "/tmp/tessera-tables"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, spark.checkpoint.dir where none is set yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or (LOCAL if context.master.startswith("local") else None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet and read again: computed once, pruned by column, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df over every core: a table of fewer splits than that (one small file, say) is dealt by its key, others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def held(df: DataFrame) -> DataFrame:
    """A top-k result, computed once and kept as rows of the plan: only for lists whose length the caller bounds."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def deleted(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder of any store, index tables for instance; whether there was one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save_json(spark: SparkSession, path: str, value: object) -> None:
    """Settings, cleaned synonyms and the like: one JSON text, replaced as a whole."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str, otherwise: object = None) -> object:
    """What save_json wrote; otherwise where there is none or it is broken."""
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception:  # noqa: BLE001
        return otherwise


def append_history(rows: DataFrame, path: str) -> None:
    """Adds searches (user_id, action, ts, event_id) to the history under path; reading collapses and bounds it."""
    rows.select("event_id", "user_id", "action", "ts").write.mode("append").parquet(path)


def report(metrics: DataFrame) -> DataFrame:
    """line: an aggregate as text, a line for each measure in the order of its columns, four decimals."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for i, c in enumerate(metrics.columns)))
    return metrics.select(F.explode(pairs).alias("p")).select(F.col("p.i").alias("place"), F.format_string("%s: %.4f", F.col("p.name"), F.col("p.x")).alias("line"))
