"""Live event rates over tumbling windows, and the same over a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = "1 day"
DELAY = "1 hour"


def _rates(events: DataFrame, window: str) -> DataFrame:
    return events.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"))


def _flat(rates: DataFrame) -> DataFrame:
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return rates.select(
        F.col("window.start").alias("window_start"),
        "event_type",
        "events",
        (F.col("events") / seconds).alias("per_s"),
    )


def live_throughput(events: DataFrame, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """Counts and rates of windows that the watermark has closed."""
    return _flat(_rates(events.withWatermark("ts", delay), window))


def run_live_throughput(
    spark: SparkSession, events: DataFrame, folder: str, window: str = WINDOW, delay: str = DELAY
) -> DataFrame:
    """Drive the stream over all waiting files into Parquet and read that back."""
    query = (
        live_throughput(events, window, delay)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/progress")
        .option("path", f"{folder}/rates")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rates")


def batch_throughput(events: DataFrame, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """The batch twin: windows that end no later than the newest event less the delay."""
    newest = events.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("mark")).first()[0]
    return _flat(_rates(events, window).filter(F.col("window.end") <= F.lit(newest)))
