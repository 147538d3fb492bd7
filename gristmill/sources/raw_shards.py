"""Raw Parquet shards, their manifest file, checksums, and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.token_files import with_md5

MANIFEST = (
    "shard long, path string, num_rows long, est_tokens long, bytes long, md5 string, ts timestamp"
)
ROW_GROUP_BYTES = 64 * 1024 * 1024


def write_raw_shards(sharded: DataFrame, path: str) -> None:
    """One zstd file per shard, in a ``shard=<n>`` folder.

    ``n_chars`` is stored along, so later length filters can skip row groups.
    """
    (
        sharded.withColumn("n_chars", F.length(F.coalesce(F.col("text"), F.lit(""))))
        .repartition("shard")
        .sortWithinPartitions("shard", "doc_id")
        .write.partitionBy("shard")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .mode("overwrite")
        .parquet(path)
    )


def read_raw_shards(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(path)
    return shards.withColumn("shard", F.col("shard").cast("long"))


def raw_shard_files(spark: SparkSession, path: str, checksums: bool = True) -> DataFrame:
    """``(shard, path, bytes[, md5])`` of the files, hashed piece by piece; without checksums
    nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet"
    ).load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long")
    listed = files.select(shard.alias("shard"), "path", F.col("length").alias("bytes"))
    return with_md5(listed) if checksums else listed


def file_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Join counted shards with their files into the manifest's final form."""
    return manifest.join(files, "shard").select(
        "shard", "path", "num_rows", "est_tokens", "bytes", "md5", F.current_timestamp().alias("ts")
    )


def write_json_report(report: DataFrame, path: str) -> None:
    """One JSON object per row; nested columns stay nested."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_manifest(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """The manifest in shard order, from JSON lines or from ``one_array`` over many lines."""
    return spark.read.schema(MANIFEST).option("multiLine", one_array).json(path).orderBy("shard")


def verify_checksums(manifest: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Each entry with its stored and found checksum, whether a file is there and whether they match."""
    found = files.select(*keys, F.col("md5").alias("found"))
    return manifest.join(found, keys, "left").select(
        *keys,
        "md5",
        "found",
        F.col("found").isNotNull().alias("present"),
        F.col("md5").eqNullSafe(F.col("found")).alias("match"),
    )
