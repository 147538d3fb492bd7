"""Length filters, counts and budgets over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import WORDS_PER_TOKEN, char_count, strip, token_estimate, word_count
from gristmill.operators.ordered import Buckets, cutoff, up_to

MIN_CHARS = 200
MAX_CHARS = 100_000
MIN_TOKENIZED_CHARS = 10
TARGET_TOKENS = 7_000_000_000


def filter_length(
    docs: DataFrame, shortest: int = MIN_CHARS, longest: int = MAX_CHARS, chars: Column | None = None
) -> DataFrame:
    """Keep texts of ``shortest..longest`` characters, both ends included.

    Pass a stored length as ``chars`` and the filter reaches the Parquet scan.
    """
    size = char_count(F.col("text")) if chars is None else chars
    return docs.filter(size.between(shortest, longest))


def filter_counts(
    docs: DataFrame, shortest: int = MIN_CHARS, longest: int = MAX_CHARS, chars: Column | None = None
) -> DataFrame:
    size = char_count(F.col("text")) if chars is None else F.coalesce(chars, F.lit(0))
    return docs.agg(
        F.count_if(size.between(shortest, longest)).alias("kept"),
        F.count_if(size < shortest).alias("too_short"),
        F.count_if(size > longest).alias("too_long"),
    )


def drop_tiny(
    docs: DataFrame, shortest: int = MIN_TOKENIZED_CHARS, chars: Column | None = None
) -> DataFrame:
    size = char_count(F.col("text")) if chars is None else chars
    return docs.filter(size >= shortest)


def with_word_count(docs: DataFrame) -> DataFrame:
    return docs.withColumn("words", word_count(F.col("text")))


def measure(docs: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """Key, words, characters and bytes: all that budgets, shards and manifests look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        key,
        *keep,
        word_count(F.col("text")).alias("words"),
        char_count(F.col("text")).alias("text_chars"),
        F.octet_length(text).cast("long").alias("text_bytes"),
    )


def with_token_estimate(docs: DataFrame, words_per_token: float = WORDS_PER_TOKEN) -> DataFrame:
    return docs.withColumn("est_tokens", token_estimate(F.col("words"), words_per_token))


def budget_cutoff(
    docs: DataFrame,
    target_tokens: float = TARGET_TOKENS,
    words_per_token: float = WORDS_PER_TOKEN,
    key: str = "doc_id",
    buckets: Buckets | None = None,
) -> tuple | None:
    """Key of the document at which the running estimate reaches the target."""
    buckets = buckets or Buckets.of(docs, F.col(key))
    weight = F.col("words") if "words" in docs.columns else word_count(F.col("text"))
    return cutoff(docs, [key], buckets, weight, target_tokens * words_per_token)


def take_until_budget(
    docs: DataFrame,
    target_tokens: float = TARGET_TOKENS,
    words_per_token: float = WORDS_PER_TOKEN,
    key: str = "doc_id",
    buckets: Buckets | None = None,
) -> DataFrame:
    """Documents in key order until the estimate reaches the target, crossing row included.

    The budget becomes one key threshold, which the scan itself can apply.
    """
    return docs.filter(up_to([key], budget_cutoff(docs, target_tokens, words_per_token, key, buckets)))


def _first(docs: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the lowest keys. Keys are read first; texts only of those rows."""
    keys = docs.select("doc_id").orderBy("doc_id").limit(n).collect()
    if not keys:
        return docs.limit(0)
    return docs.filter(F.col("doc_id") <= F.lit(keys[-1][0])).orderBy("doc_id").limit(n)


def peek_documents(docs: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` documents with their sizes and the start of the text."""
    first = _first(docs, n)
    return with_token_estimate(with_word_count(first)).select(
        "doc_id",
        "url",
        "score",
        char_count(F.col("text")).alias("chars"),
        "words",
        "est_tokens",
        strip(F.substring("text", 1, 200)).alias("preview"),
    )


# Size of the public sample the estimate refers to.
SAMPLE_TOKENS = 10_000_000_000
SAMPLE_COMPRESSED_GB = 28
SAMPLE_RAW_GB = 75
DISK_BUFFER = 1.15


def size_estimate(
    docs: DataFrame,
    n: int = 3,
    target_tokens: float = TARGET_TOKENS,
    shard_rows: int = 50_000,
    words_per_token: float = WORDS_PER_TOKEN,
) -> DataFrame:
    """Documents, shards and disk needed for the target, judged by the first ``n`` documents."""
    first = _first(docs, n)
    seen = first.agg(
        F.sum(word_count(F.col("text"))).alias("words"), F.count(F.lit(1)).alias("docs")
    )
    mean = token_estimate(F.col("words"), words_per_token) / F.col("docs")
    share = target_tokens / SAMPLE_TOKENS
    return (
        seen.select(mean.alias("mean_tokens"))
        .withColumn("docs_needed", F.floor(F.lit(float(target_tokens)) / F.col("mean_tokens")))
        .withColumn("shards_needed", F.ceil(F.col("docs_needed") / F.lit(shard_rows)))
        .withColumn("sample_share", F.lit(share))
        .withColumn("compressed_gb", F.lit(share * SAMPLE_COMPRESSED_GB))
        .withColumn("raw_gb", F.lit(share * SAMPLE_RAW_GB))
        .withColumn("disk_gb", F.lit(share * SAMPLE_COMPRESSED_GB * DISK_BUFFER))
    )
