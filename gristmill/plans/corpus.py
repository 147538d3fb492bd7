"""Whole-table preparations that several queries start from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import hash_number
from gristmill.operators import blocks, chats, filters, packing, shards, splits, tokens
from gristmill.operators import runlog as log_ops
from gristmill.plans import settings as S
from gristmill.session import stage
from gristmill.sources.tables import scan_documents, spread, table, table_events


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return scan_documents(table(spark, folder, "documents"))


def measured_documents(spark: SparkSession, folder: str) -> DataFrame:
    """With the stored ``n_chars``, so that length filters reach the scan."""
    docs = table(spark, folder, "documents")
    return scan_documents(docs, keep=("n_chars",))


def spread_documents(spark: SparkSession, folder: str) -> DataFrame:
    return scan_documents(spread(table(spark, folder, "documents"), "doc_id"))


def kept_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = measured_documents(spark, folder)
    kept = filters.filter_length(docs, S.SHORTEST, S.LONGEST, docs["n_chars"]).drop("n_chars")
    return spread(kept, "doc_id")


def kept_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the kept documents; the one pass over their texts."""
    return stage(filters.measure(kept_documents(spark, folder)), "measured")


def budgeted_measures(spark: SparkSession, folder: str) -> DataFrame:
    return filters.take_until_budget(kept_measures(spark, folder), S.TARGET_TOKENS)


def sharded_measures(measured: DataFrame) -> DataFrame:
    """Shards of staged measures; their keys need no staging of their own."""
    return shards.row_shards(measured, S.RAW_SHARD_ROWS).assign(measured)


def budget_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: filter, estimate, stop at the budget, shard, and describe the shards."""
    return shards.shard_manifest(sharded_measures(budgeted_measures(spark, folder)))


def split_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Kept documents with raw shard and split."""
    docs = kept_documents(spark, folder)
    ranges = shards.row_shards(stage(docs.select("doc_id"), "keys"), S.RAW_SHARD_ROWS)
    return splits.split_by_shard(ranges.assign(docs), S.VAL_SHARD_SHARE, ranges.starts)


@dataclass(frozen=True)
class Corpus:
    """Encoded documents with their places in the token shards."""

    vocab: tokens.Vocabulary
    encoded: DataFrame
    packed: DataFrame

    @cached_property
    def stream(self) -> DataFrame:
        """``(split, doc_id, shard, start, n_tokens, tokens)``."""
        return packing.shard_stream(self.encoded, self.packed)

    @cached_property
    def members(self) -> DataFrame:
        """``(split, doc_id, n_tokens, tokens, shard, opens)``, without a shuffle of ids."""
        return packing.shard_members(self.encoded, self.packed)


def document_vocab(spark: SparkSession, folder: str) -> tokens.Vocabulary:
    docs = measured_documents(spark, folder)
    texts = spread(filters.drop_tiny(docs, chars=docs["n_chars"]), "doc_id")
    return tokens.load_vocab(tokens.build_vocab(tokens.pretokenize(texts), S.VOCAB_SIZE))


def encoded_documents(spark: SparkSession, folder: str, vocab: tokens.Vocabulary) -> DataFrame:
    texts = filters.drop_tiny(split_documents(spark, folder)).select("doc_id", "split", "text")
    return stage(tokens.encode_documents(texts, vocab), "encoded")


def token_corpus(spark: SparkSession, folder: str) -> Corpus:
    vocab = document_vocab(spark, folder)
    encoded = encoded_documents(spark, folder, vocab)
    packed = stage(packing.pack_token_shards(encoded, S.TOKEN_SHARD), "packed")
    return Corpus(vocab, encoded, packed)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def split_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Kept chats within the cap, shuffled and split: ``(conv_id, shuffle, split)``."""
    kept = chats.cap_samples(turns(spark, folder), S.MOST_SAMPLES, S.MIN_REPLY).filter("kept")
    return splits.split_head(
        stage(kept.select("conv_id"), "chats"), S.VAL_SAMPLE_SHARE, S.MIN_VAL_SAMPLES, S.SEED
    )


def chat_stream(spark: SparkSession, folder: str) -> tuple[tokens.Vocabulary, DataFrame]:
    """One continuous id stream per split, in shuffled order; rows are turns, not chats."""
    vocab = document_vocab(spark, folder)
    parts = chats.render_turns(turns(spark, folder), S.MIN_REPLY)
    parts = parts.join(split_chats(spark, folder), "conv_id")
    encoded = stage(tokens.encode_samples(parts, vocab), "encoded-chats")
    position = hash_number(F.col("shuffle"), 12)
    return vocab, blocks.concat_stream(encoded, ["shuffle", "conv_id", "turn"], position)


def step_log(spark: SparkSession, folder: str) -> DataFrame:
    """``(run, step, ts, loss, phase)`` from the event table."""
    events = table_events(spark, folder).select(
        "event_id",
        "ts",
        F.col("user_id").alias("run"),
        F.col("value").alias("loss"),
        F.col("event_type").alias("phase"),
    )
    return log_ops.number_steps(events, "run", "ts", "event_id")
