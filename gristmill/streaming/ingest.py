"""Incremental ingest of documents with Structured Streaming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import WORDS_PER_TOKEN
from gristmill.operators.filters import (
    MAX_CHARS,
    MIN_CHARS,
    TARGET_TOKENS,
    budget_cutoff,
    filter_length,
    measure,
)
from gristmill.operators.ordered import up_to
from gristmill.operators.shards import SHARD_ROWS, row_shards
from gristmill.session import stage


def stream_documents(
    spark: SparkSession, folder: str, schema, files_per_batch: int = 1000, pattern: str = "*.parquet"
) -> DataFrame:
    """Documents as a row stream over the files of a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
        .select("doc_id", "text", F.col("source").alias("url"))
    )


class BudgetMet(Exception):
    """Ends a stream before the batch at hand, which stays unread for a later call."""


@dataclass(frozen=True)
class Progress:
    """What the committed steps have left: the last step, closed shards and words, a met budget."""

    step: int
    batches: tuple[int, ...]
    words: int
    shards: int
    met_at: float | None


def _if_written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def progress(spark: SparkSession, folder: str) -> Progress:
    """Read from the manifest, whose rows of a step are written last and so commit it."""
    written = _if_written(spark, f"{folder}/manifest")
    if written is None:
        return Progress(-1, (), 0, 0, None)
    last = written.agg(F.max("step")).first()[0]
    totals = written.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("shard") + 1, F.lit(0)))
    words, shards = totals.first()
    # The stream repeats at most the latest batch.
    recent = written.filter((F.col("step") >= last - 2) & (F.col("batch") >= 0))
    batches = tuple(r[0] for r in recent.select("batch").distinct().collect())
    met = written.filter((F.col("step") == last) & F.col("met")).select("target").first()
    return Progress(last, batches, words, shards, met[0] if met else None)


def ingest_step(
    docs: DataFrame | None,
    batch: int,
    spark: SparkSession,
    folder: str,
    rows: int = SHARD_ROWS,
    shortest: int = MIN_CHARS,
    longest: int = MAX_CHARS,
    target_tokens: float = TARGET_TOKENS,
    words_per_token: float = WORDS_PER_TOKEN,
) -> None:
    """Take in one batch, or with ``docs`` None close the open shard.

    A step starts with the documents that the one before left waiting, in key order with the
    new ones. Full shards within the budget are written; the open shard and what lies beyond
    the budget wait in the step's ``pending`` folder, so nothing is lost and a raised target
    takes it in. A step is committed by its manifest rows, written last. A batch that is
    committed already is passed over, and one that is not is done again in the same folders.
    """
    spark = spark if docs is None else docs.sparkSession
    before = progress(spark, folder)
    if docs is not None:
        if batch in before.batches:
            return
        if before.met_at is not None and before.met_at >= target_tokens:
            raise BudgetMet
    waiting = _if_written(spark, f"{folder}/pending/step={before.step}")
    if docs is None:
        if waiting is None:
            return
        taken = waiting
    else:
        taken = filter_length(docs, shortest, longest)
        taken = taken if waiting is None else waiting.unionByName(taken)
    step = before.step + 1
    measured = stage(measure(taken), "measured")
    left = target_tokens - before.words / words_per_token
    count, words = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    # Well below the budget no document can be the one that reaches it, so none is looked for.
    near = words >= left * words_per_token * (1 - 1e-9)
    last = budget_cutoff(measured, left, words_per_token) if near and left > 0 else None
    within = up_to(["doc_id"], last) if left > 0 else F.lit(False)
    inside = measured.filter(within)
    if last is not None or left <= 0:
        count = inside.count()
    closed = before.shards + (-(-count // rows) if docs is None else count // rows)
    shards = row_shards(inside, rows, first_shard=before.shards)
    numbered = shards.assign(taken.filter(within))
    (
        numbered.filter(F.col("shard") < closed)
        .repartition("shard")
        .write.mode("overwrite")
        .partitionBy("shard")
        .option("compression", "zstd")
        .parquet(f"{folder}/raw/step={step}")
    )
    rest = numbered.filter(F.col("shard") >= closed).drop("shard").unionByName(taken.filter(~within))
    rest.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/pending/step={step}")
    manifest = (
        shards.assign(inside)
        .filter(F.col("shard") < closed)
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("num_rows"), F.sum("words").alias("words"))
    )
    # One row without a shard commits a step that closed none.
    commit = spark.range(1).select(
        *[F.lit(None).cast("long").alias(name) for name in ("shard", "num_rows", "words")]
    )
    (
        manifest.unionByName(commit)
        .withColumn("batch", F.lit(batch).cast("long"))
        .withColumn("target", F.lit(float(target_tokens)))
        .withColumn("met", F.lit(last is not None or left <= 0))
        .coalesce(1)
        .write.mode("overwrite")
        .parquet(f"{folder}/manifest/step={step}")
    )


def incremental_ingest(stream: DataFrame, folder: str, **settings) -> None:
    """Run the waiting files through ``ingest_step`` and close the open shard.

    At the budget the stream ends before the next batch, which is neither read nor marked as
    done. A later call goes on where this one ended, with what waits first.
    """
    spark = stream.sparkSession
    met = []

    def take(docs: DataFrame, batch: int) -> None:
        try:
            ingest_step(docs, batch, spark, folder, **settings)
        except BudgetMet:
            met.append(batch)
            raise

    query = (
        stream.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not met:  # it ended for another reason than the budget
            raise
    ingest_step(None, -1, spark, folder, **settings)


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    """All written documents with their shards; nothing of a step that was not committed."""
    last = progress(spark, folder).step
    rows = spark.read.parquet(f"{folder}/raw").filter(F.col("step") <= last)
    return rows.withColumn("shard", F.col("shard").cast("long"))


def ingest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(step, batch, shard, num_rows, words)`` of the closed shards."""
    rows = spark.read.parquet(f"{folder}/manifest").filter(F.col("shard").isNotNull())
    return rows.select("step", "batch", "shard", "num_rows", "words")
