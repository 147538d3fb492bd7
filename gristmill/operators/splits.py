"""Train/validation splits and a reproducible shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import hash_number, seeded_hash
from gristmill.operators.ordered import Buckets, cutoff, running, up_to

VAL_SHARD_SHARE = 0.02
SEED = 42
VAL_SAMPLE_SHARE = 0.005
MIN_VAL_SAMPLES = 500


def split_by_shard(
    sharded: DataFrame, share: float = VAL_SHARD_SHARE, manifest: DataFrame | None = None
) -> DataFrame:
    """Add ``split``: the last ``max(1, int(n * share))`` shards validate, the rest train.

    With a ``manifest`` the shards are counted there. The border is one shard number, so no
    row moves.
    """
    shards = (sharded if manifest is None else manifest).select("shard").distinct()
    held_out = max(1, int(shards.count() * share))
    border = shards.orderBy(F.desc("shard")).limit(held_out).agg(F.min("shard")).first()[0]
    if border is None:
        return sharded.withColumn("split", F.lit("train"))
    return sharded.withColumn("split", F.when(F.col("shard") >= border, "val").otherwise("train"))


def shuffle_key(samples: DataFrame, seed: int = SEED, key: str = "conv_id") -> DataFrame:
    return samples.withColumn("shuffle", seeded_hash(seed, F.col(key)))


def shuffle_buckets(samples: DataFrame) -> Buckets:
    return Buckets.of(samples, hash_number(F.col("shuffle"), 12))


def seeded_shuffle(samples: DataFrame, seed: int = SEED, key: str = "conv_id") -> DataFrame:
    """Add ``position`` (from 0) in a random order that depends on seed and key only."""
    mixed = shuffle_key(samples, seed, key)
    ranked = running(mixed, ["shuffle", key], shuffle_buckets(mixed))
    return ranked.withColumn("position", F.col("rank") - 1).drop("rank", "_bucket")


def split_head(
    samples: DataFrame,
    share: float = VAL_SAMPLE_SHARE,
    at_least: int = MIN_VAL_SAMPLES,
    seed: int = SEED,
    key: str = "conv_id",
) -> DataFrame:
    """Add ``split``: the first ``max(at_least, int(n * share))`` of the shuffle validate."""
    mixed = shuffle_key(samples, seed, key)
    narrow = mixed.select(key, "shuffle")
    held_out = max(at_least, int(narrow.count() * share))
    border = cutoff(narrow, ["shuffle", key], shuffle_buckets(narrow), F.lit(1), held_out)
    return mixed.withColumn(
        "split", F.when(up_to(["shuffle", key], border), "val").otherwise("train")
    )
