"""Training blocks, windows and next-token pairs over token streams.

A stream is a set of rows ``(<stream columns>, start, n_tokens, tokens)``: runs of ids at
their positions. Rows are cut at block borders and grouped by block, so a group never holds
more than one block of ids and no single id is a row of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import hash_number
from gristmill.operators.ordered import Buckets, div, running

BATCH = 32
BLOCK = 2048


def concat_stream(encoded: DataFrame, order: Sequence[str], position: Column) -> DataFrame:
    """Add ``start``: each row's place in its split's one continuous stream."""
    buckets = Buckets.of(encoded, position)
    placed = running(encoded, order, buckets, {"start": ("sum", "n_tokens")}, ["split"])
    return placed.drop("rank", "_bucket")


def stream_positions(stream: DataFrame) -> DataFrame:
    """Long form ``(split, pos, token)``."""
    return stream.select("split", "start", F.posexplode("tokens").alias("at", "token")).select(
        "split", (F.col("start") + F.col("at")).alias("pos"), "token"
    )


def block_parts(stream: DataFrame, length: int, keys: Sequence[str]) -> DataFrame:
    """Each row's share of the blocks it touches: ``block``, ``low`` (position), ``part``."""
    end = F.col("start") + F.col("n_tokens") - 1
    # The id at a block's start also ends the block before it.
    first = F.greatest(div(F.col("start") - 1, length), F.lit(0))

    def share(block: Column) -> Column:
        low = F.greatest(block * length, F.col("start"))
        high = F.least((block + 1) * length, end)
        at, count = (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int")
        return F.struct(
            block.alias("block"), low.alias("low"), F.slice("tokens", at, count).alias("part")
        )

    shares = F.transform(F.sequence(first, div(end, length)), share)
    return stream.filter("n_tokens > 0").select(*keys, F.inline(shares))


def _in_order() -> Column:
    parts = F.array_sort(F.collect_list(F.struct("low", "part")))
    return F.flatten(F.transform(parts, lambda row: row["part"])).alias("ids")


def stream_blocks(stream: DataFrame, length: int, keys: Sequence[str]) -> DataFrame:
    """``ids`` of each block: ``length`` ids and the one after them, fewer at the end."""
    return block_parts(stream, length, keys).groupBy(*keys, "block").agg(_in_order())


def cut_blocks(
    stream: DataFrame,
    batch: int = BATCH,
    length: int = BLOCK,
    keys: Sequence[str] = ("split", "shard"),
) -> DataFrame:
    """``x`` and ``y`` (x shifted by one) of every full batch; the tail of a shard is dropped.

    A shard of n ids gives ``(n - 1) div (batch * length)`` batches of ``batch`` blocks.
    """
    keys = list(keys)
    totals = stream.groupBy(*keys).agg(
        F.max(F.col("start") + F.col("n_tokens")).alias("_ids")
    )
    batches = div(F.col("_ids") - 1, batch * length)
    return (
        stream_blocks(stream, length, keys)
        .join(totals, keys)
        .filter(F.col("block") < batches * batch)
        .select(
            *keys,
            div(F.col("block"), batch).alias("batch"),
            (F.col("block") % batch).alias("row"),
            F.slice("ids", 1, length).alias("x"),
            F.slice("ids", 2, length).alias("y"),
        )
    )


def repeat_epochs(blocks: DataFrame, epochs: int) -> DataFrame:
    """The same blocks again for each epoch, numbered from 0."""
    return blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def resume_stream(stream: DataFrame, shard: int, pos: int) -> DataFrame:
    """What a saved cursor leaves: later shards whole, its own shard from ``pos`` on.

    ``pos`` becomes position 0, so a changed batch shape goes on at the same id.
    """
    here = F.col("shard") == shard
    left = stream.filter(
        (F.col("shard") > shard) | (here & (F.col("start") + F.col("n_tokens") > pos))
    )
    skip = F.when(here, F.greatest(F.lit(pos) - F.col("start"), F.lit(0))).otherwise(F.lit(0))
    start = F.when(here, F.greatest(F.col("start") - pos, F.lit(0))).otherwise(F.col("start"))
    rest = F.slice("tokens", skip.cast("int") + 1, F.col("n_tokens").cast("int"))
    return left.withColumns(
        {"tokens": rest, "n_tokens": F.col("n_tokens") - skip, "start": start}
    )


def resume_blocks(
    stream: DataFrame,
    shard: int,
    pos: int,
    batch: int = BATCH,
    length: int = BLOCK,
    keys: Sequence[str] = ("split", "shard"),
) -> DataFrame:
    """Blocks after a cursor; batches of the cursor's shard count from the cursor."""
    return cut_blocks(resume_stream(stream, shard, pos), batch, length, keys)


def next_token_pairs(members: DataFrame, eot: int) -> DataFrame:
    """``(split, doc_id, token, next)`` for neighbours within a shard.

    ``members`` are documents with ``opens``, whether they are the first of their shard. Every
    document ends in ``eot``, so the id before any other one is known: no order and no shuffle.
    """
    before = F.when(~F.col("opens"), F.array(F.lit(eot))).otherwise(F.array().cast("array<int>"))
    ids = F.concat(before, F.col("tokens"))
    shifted = F.arrays_zip(
        F.slice(ids, 1, F.size(ids) - 1).alias("token"), F.slice(ids, 2, F.size(ids)).alias("next")
    )
    return members.select("split", "doc_id", F.explode(shifted).alias("pair")).select(
        "split", "doc_id", "pair.token", "pair.next"
    )


def sample_windows(
    stream: DataFrame, split: str, windows: int, length: int = BLOCK, seed: int = 42
) -> DataFrame:
    """``windows`` random starts in ``[0, n - length)`` with x of ``length`` ids and y after it.

    A window of ``length + 1`` ids touches at most two blocks, found by an equi-join.
    """
    stream = stream.filter(F.col("split") == split)
    total = stream.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] or 0
    room = total - length
    if room <= 0:
        raise ValueError("the stream is not longer than one window")
    spark = stream.sparkSession
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    starts = spark.range(windows).select(
        F.col("id").alias("window"), (hash_number(digest, 12) % room).alias("first")
    )
    touched = starts.select(
        "window",
        "first",
        F.explode(
            F.array(div(F.col("first"), length), div(F.col("first"), length) + 1)
        ).alias("block"),
    )
    # Only the parts of touched blocks are shuffled.
    parts = block_parts(stream, length, []).join(touched, "block")
    blocks = parts.groupBy("window", "first", "block").agg(_in_order())
    whole = F.array_sort(F.collect_list(F.struct("block", "ids")))
    joined = blocks.groupBy("window", "first").agg(whole.alias("found"))
    # Each block repeats the next one's first id; drop it from the first of two blocks.
    ids = F.concat(
        F.slice(F.col("found")[0]["ids"], 1, length),
        F.when(F.size("found") > 1, F.col("found")[1]["ids"]).otherwise(
            F.slice(F.col("found")[0]["ids"], length + 1, 1)
        ),
    )
    at = (F.col("first") % length).cast("int")
    return joined.select(
        "window",
        "first",
        F.slice(ids, at + 1, length).alias("x"),
        F.slice(ids, at + 2, length).alias("y"),
    )


def shard_windows(manifest: DataFrame, windows: int, length: int = BLOCK, seed: int = 42) -> DataFrame:
    """``(split, window, shard, first)``: hashed places of ``windows`` per split, within shards.

    ``manifest`` (``split, shard, tokens``) lists the shards that are longer than a window. The
    first half of a window's hash chooses the shard, the second the place in it.
    """
    by_shard = Window.partitionBy("split").orderBy("shard")  # a row per shard
    ranked = manifest.select("split", "shard", "tokens", (F.row_number().over(by_shard) - 1).alias("place"))
    counts = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("shards"))
    drawn = counts.select("split", "shards", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("window"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("window").cast("string")))
    half = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    placed = drawn.select("split", "window", half.alias("half"), (hash_number(digest, 8) % F.col("shards")).alias("place"))
    return placed.join(ranked, ["split", "place"]).select(
        "split", F.col("window").cast("long").alias("window"), "shard", (F.col("half") % (F.col("tokens") - length)).alias("first")
    )


def split_token_totals(stream: DataFrame) -> DataFrame:
    """Shards and tokens per split, from the stream itself."""
    per_shard = stream.groupBy("split", "shard").agg(
        F.sum("n_tokens").alias("tokens")
    )
    return per_shard.groupBy("split").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("tokens").alias("tokens")
    )
