"""Reading the input tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_path(folder: str, name: str) -> str:
    """A pattern that fits one table alone, be it a file or a folder of files.

    A stream's plain path has to be a folder.
    """
    return f"{folder}/{{{name}}}.parquet"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, for steps that compute a lot per row.

    One rule at any size: a scan that is planned in fewer parts than there are cores is dealt
    out, one with more is not shuffled. ``spark.sql.files.maxPartitionBytes`` sets the parts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(key).rdd.getNumPartitions()  # from the plan, nothing is read
    return df if parts >= cores else df.repartition(cores, key)


def table_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with ``ts`` as an instant (it is stored without a time zone)."""
    return instants(table(spark, folder, "events"))


def instants(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add a literal for each column the source lacks; a present null stays null."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def scan_documents(
    documents: DataFrame, labels: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, text, url, score``: the columns every later step uses, and those in ``keep``."""
    docs = documents
    if "url" not in docs.columns and "source" in docs.columns:
        docs = docs.withColumnRenamed("source", "url")
    if labels is not None:
        scores = labels.select("doc_id", F.col("quality").cast("double").alias("score"))
        docs = docs.join(scores, "doc_id", "left").fillna({"score": 0.0})
    docs = with_defaults(docs, {"url": "", "score": 0.0})
    return docs.select("doc_id", "text", "url", "score", *keep)
