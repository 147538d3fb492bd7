"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.ordered import div
from gristmill.session import new_folder, stage

SHARDS = 40
BUCKET_BYTES = 16 << 20
SLOTS = 1 << 20
SEED = 42
OVERHEAD = 16


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _slot(seed: int, slots: int) -> Column:
    """Uniform hash slot of a record. Copies of a text under other ids fall elsewhere."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(slots))


def slotted(
    docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, slots: int = SLOTS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """``(doc, slot)`` of every row, and rows and bytes per slot.

    Rows that repeat id and text share a hash slot. The rows of slots over ``bucket_bytes``, or
    over four times the mean where that is more, are written once with a number each, which
    deals them over all slots. There are fewer such slots than a quarter of ``slots``, which
    bounds the broadcast.
    """
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc")

    def counted(rows: DataFrame) -> DataFrame:
        size = record_bytes(F.col("doc.text"))
        return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))

    rows = docs.select(whole, _slot(seed, slots).alias("slot"))
    first = stage(counted(rows), "slots")
    mean = (first.agg(F.sum("bytes")).first()[0] or 0) / slots
    hot = first.filter(F.col("bytes") > max(bucket_bytes, 4 * mean)).select("slot")
    if hot.isEmpty():
        return rows, first
    dealt = F.pmod(F.xxhash64(F.lit(seed), "doc.doc_id", "number"), F.lit(slots))
    numbered = rows.join(F.broadcast(hot), "slot", "left_semi").select(
        "doc", F.monotonically_increasing_id().alias("number")
    )
    spread = stage(numbered, "hot-rows").select("doc", dealt.alias("slot"))
    apart = first.join(F.broadcast(hot), "slot", "left_anti").unionByName(counted(spread))
    again = apart.groupBy("slot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return rows.join(F.broadcast(hot), "slot", "left_anti").unionByName(spread), stage(again, "dealt-slots")


def shuffle_into_shards(
    docs: DataFrame,
    path: str,
    shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    slots: int = SLOTS,
    seed: int = SEED,
) -> None:
    """Write all rows of ``docs`` to ``path``, randomly permuted and cut into equal shards.

    The files are Parquet under ``shard=<k>`` with the whole row as ``doc`` and its ``slot``,
    gapless from 0 in each shard. Row counts of any two shards differ by at most one.

    A first look counts rows and bytes per hash slot; whole slots make up buckets of about
    ``bucket_bytes``, and the counts give each bucket its place in the global order. Pass one
    scatters the rows to their buckets, the only time that texts move. Pass two takes a bucket
    into memory, puts it in a fixed order, permutes it by Fisher-Yates (the built-in ``shuffle``)
    and writes it out. One bucket is the most a task holds; a slot with a single huge record is
    the one thing that makes a bucket larger. The cut into shards is by place alone. Reruns
    agree, but for rows that repeat id and text by megabytes: those are dealt out by the order
    in which they are read.

    Nulls are ordinary values, an empty table writes no file, repeated rows are kept, and extra
    columns of any orderable type travel inside ``doc``, so that no name can clash.
    """
    records, counted = slotted(docs, bucket_bytes, slots, seed)
    rows, size = counted.agg(F.sum("rows"), F.sum("bytes")).first()
    if not rows:
        return
    buckets = min(slots, max(1, math.ceil(size / bucket_bytes)))

    def bucket(of: Column) -> Column:
        return div(of * F.lit(buckets), slots).cast("int")

    totals = counted.groupBy(bucket(F.col("slot")).alias("bucket")).agg(F.sum("rows").alias("rows"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row per bucket, and there are no more buckets than slots: that bounds the broadcast.
    places = stage(
        totals.select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("ahead")),
        "buckets",
    )

    # A bucket is a partition of its own, so a task holds one and its permutation depends on
    # the seed and the bucket alone.
    scattered = records.select(bucket(F.col("slot")).alias("bucket"), "doc").repartitionById(
        buckets, F.col("bucket")
    )
    held = scattered.groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "doc.doc_id", "doc.text"), "doc"))).alias("all")
    )
    permuted = held.join(F.broadcast(places), "bucket").select(
        "ahead", F.shuffle("all", seed).alias("all")
    )
    placed = permuted.select("ahead", F.posexplode("all").alias("at", "record")).select(
        F.col("record.doc").alias("doc"), (F.col("ahead") + F.col("at")).alias("place")
    )
    shard = div(F.col("place") * F.lit(shards), rows)
    first = F.ceil(shard * F.lit(rows) / F.lit(shards)).cast("long")
    placed.select(
        "doc", (F.col("place") - first).alias("slot"), shard.cast("int").alias("shard")
    ).write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, docs: DataFrame) -> DataFrame:
    """``(doc, slot, shard)`` of all written shards; no rows if nothing was written."""
    row = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"),
        F.lit(0).cast("long").alias("slot"),
        F.lit(0).alias("shard"),
    )
    try:
        return spark.read.schema(row.schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return row.filter(F.lit(False))


def shard_rows(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The digest of the written shards: a row per document with its place.

    ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``. The law is ``rows``: counts
    differ by at most one. Sizes and checksums are taken from the written texts; a null text has
    checksum 0, that of an empty one.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    shuffle_into_shards(docs, path, shards, **options)
    text = F.col("doc.text")
    return read_shards(spark, path, docs).select(
        F.col("doc.doc_id").alias("doc_id"),
        record_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
