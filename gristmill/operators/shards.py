"""Row-count shards, their manifest, resuming, and ingest statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import WORDS_PER_TOKEN, char_count, token_estimate, word_count
from gristmill.operators.ordered import BROADCAST_ROWS, Buckets, Ranges, div, running
from gristmill.session import stage

SHARD_ROWS = 50_000


def row_shards(keys: DataFrame, rows: int = SHARD_ROWS, key: str = "doc_id", first_shard: int = 0) -> Ranges:
    """Key ranges of ``rows`` consecutive keys each; ``keys`` should be staged."""
    buckets = Buckets.of(keys, F.col(key))
    ranked = running(keys.select(key), [key], buckets).filter((F.col("rank") - 1) % rows == 0)
    starts = ranked.select(
        (div(F.col("rank") - 1, rows) + first_shard).alias("shard"), F.col(key).alias("first_key")
    )
    return Ranges(key, "shard", buckets, stage(starts, "shard-starts"))


def shard_by_rows(
    docs: DataFrame, rows: int = SHARD_ROWS, key: str = "doc_id", first_shard: int = 0
) -> DataFrame:
    """Add ``shard``: consecutive runs of ``rows`` documents, the last one partial.

    Only keys are ordered. They are staged, so ``docs`` is read once for them, and texts are
    not shuffled: shard start keys are few and looked up per row.
    """
    return row_shards(stage(docs.select(key), "keys"), rows, key, first_shard).assign(docs)


def shard_manifest(sharded: DataFrame, words_per_token: float = WORDS_PER_TOKEN) -> DataFrame:
    """Rows, whole estimated tokens and text size per shard, from ``measure`` columns."""
    return (
        sharded.groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("num_rows"),
            F.sum("words").alias("words"),
            F.sum("text_chars").alias("text_chars"),
            F.sum("text_bytes").alias("text_bytes"),
        )
        .select(
            "shard",
            "num_rows",
            F.floor(token_estimate(F.col("words"), words_per_token)).alias("est_tokens"),
            "text_chars",
            "text_bytes",
        )
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("num_rows").alias("num_rows"),
        F.sum("est_tokens").alias("est_tokens"),
        F.sum("text_bytes").alias("text_bytes"),
    )


def unseen_keys(docs: DataFrame, written: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that no written shard holds, staged."""
    return stage(docs.select(key).join(written.select(key), key, "left_anti"), "unseen")


def unseen(docs: DataFrame, new_keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of ``new_keys``, found without shuffling texts where that is possible.

    After a run that went in key order, all documents from the lowest new key on are new,
    and one filter on the scan takes them. Otherwise the keys are joined.
    """
    lowest, count = new_keys.agg(F.min(key), F.count(F.lit(1))).first()
    if not count:
        return docs.limit(0)
    later = docs.filter(F.col(key) >= F.lit(lowest))
    if later.select(key).count() == count:
        return later
    return later.join(
        F.broadcast(new_keys) if count <= BROADCAST_ROWS else new_keys, key, "left_semi"
    )


def next_shard(written: DataFrame) -> int:
    last = written.agg(F.max("shard")).first()[0]
    return 0 if last is None else last + 1


def resume_ingest(
    docs: DataFrame, written: DataFrame, rows: int = SHARD_ROWS, key: str = "doc_id"
) -> DataFrame:
    """Shard only new documents, numbering on from the highest written shard."""
    new_keys = unseen_keys(docs, written, key)
    shards = row_shards(new_keys, rows, key, next_shard(written))
    return shards.assign(unseen(docs, new_keys, key))


def run_stats(
    docs: DataFrame,
    shortest: int,
    longest: int,
    shard_rows: int,
    target_tokens: float,
    dataset: str,
    words_per_token: float = WORDS_PER_TOKEN,
) -> DataFrame:
    """One row of totals over the documents a run has read (kept and skipped)."""
    chars = char_count(F.col("text"))
    kept = chars.between(shortest, longest)
    return docs.agg(
        F.count_if(kept).alias("total_docs"),
        F.sum(F.when(kept, word_count(F.col("text")))).alias("words"),
        F.sum(F.when(kept, chars)).alias("text_chars"),
        F.sum(F.when(kept, F.octet_length("text").cast("long"))).alias("text_bytes"),
        F.count_if(chars < shortest).alias("skipped_short"),
        F.count_if(chars > longest).alias("skipped_long"),
    ).select(
        F.ceil(F.col("total_docs") / shard_rows).alias("total_shards"),
        "total_docs",
        F.floor(token_estimate(F.col("words"), words_per_token)).alias("total_tokens_est"),
        "text_chars",
        "text_bytes",
        "skipped_short",
        "skipped_long",
        F.lit(dataset).alias("dataset"),
        F.lit(int(target_tokens)).cast("long").alias("target_tokens"),
    )


def ingest_progress(log: DataFrame, docs_needed: int) -> DataFrame:
    """Documents per second and minutes left after each batch of ``(batch, docs, elapsed_s)``."""
    buckets = Buckets.of(log, F.col("elapsed_s"))
    placed = running(log, ["elapsed_s", "batch"], buckets, {"ahead": ("sum", "docs")})
    total = F.col("ahead") + F.col("docs")
    speed = total / F.col("elapsed_s")
    return placed.select(
        "batch",
        total.alias("total_docs"),
        speed.alias("docs_per_s"),
        ((F.lit(docs_needed) - total) / F.greatest(speed, F.lit(1.0)) / 60).alias("eta_min"),
    )


def missing_shards(manifest: DataFrame, listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Manifest entries without a file."""
    return manifest.join(listing.select(*(keys or ["shard"])), keys or ["shard"], "left_anti")


def present_shards(manifest: DataFrame, listing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Manifest entries whose file exists."""
    return manifest.join(listing.select(*(keys or ["shard"])), keys or ["shard"], "left_semi")
