"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, those of the largest doc_ids first. The line hashes of a batch are
merge-anti-joined with the runs of the earlier batches: what no run holds is added as a run of
its own, the rest is noted as sightings. Whenever a level has ``FANOUT`` runs they are merged
into one of the next level. So a hash lies in exactly one run, and its documents are counted over
that run and the sightings.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower
from gristmill.operators.ordered import BUCKET, Buckets
from gristmill.session import new_folder, stage

LEAST_POINTS = 20
LEAST_DOCS = 3
BATCHES = 8
FANOUT = 4
# The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _cut(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, lines)``: rows are told apart by id and text, as ids may repeat."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tag"), F.split(text, "\n", -1).alias("lines"))


def keyed_lines(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """``(doc_id, tag, pos, key)`` of every line with a key of ``least_points`` or more.

    ``key`` is 128 bits of the line's key, ``pos`` the line's number from 0.
    """
    lines = _cut(docs).select("doc_id", "tag", F.posexplode("lines").alias("pos", "line"))
    long_enough = lines.filter(F.octet_length("line") >= least_points)  # before any other work
    keyed = long_enough.withColumn("line", line_key(F.col("line")))
    return keyed.filter(F.char_length("line") >= least_points).select(
        "doc_id", "tag", "pos", F.unhex(F.md5("line")).alias("key")
    )


def holders(lines: DataFrame) -> DataFrame:
    """``(key, docs, last_id, last_tag)``: the documents that hold a key, and the largest.

    A document is a doc_id; a row without one is a document by its text, below every id. Both
    aggregations combine before they shuffle, so a line that a third of all documents hold is a
    few rows a task.
    """
    own = F.when(F.col("doc_id").isNull(), F.col("tag")).alias("tag")
    return (
        lines.select("key", "doc_id", own)
        .distinct()
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.max("doc_id").alias("last_id"),
            F.max("tag").alias("last_tag"),
        )
    )


def _summed(parts: list[DataFrame]) -> DataFrame:
    """Holders of all ``parts`` together; bucketed tables of one number of buckets do not move."""
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("key")
        .agg(F.sum("docs").alias("docs"), F.max("last_id").alias("last_id"), F.max("last_tag").alias("last_tag"))
    )


class LineRuns:
    """Runs on several levels, and the sightings of keys that a run held already.

    A run is a table bucketed and sorted by key in the shared folder, so that joining it moves
    and sorts nothing. ``close`` takes the tables out of the catalog again.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.sightings: list[DataFrame] = []
        self.tables: list[str] = []

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        (
            run.write.format("parquet")
            .option("path", new_folder(self.spark, "line-run"))
            .bucketBy(self.buckets, "key")
            .sortBy("key")
            .saveAsTable(name)
        )
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """One batch of ``holders``; no document may be in two batches."""
        whole = self._write(batch)
        fresh = whole
        for run in self.runs():
            fresh = fresh.join(run.select("key").hint("merge"), "key", "left_anti")
        if self.runs():
            fresh = self._write(fresh)
            seen = whole.join(fresh.select("key").hint("merge"), "key", "left_anti")
            self.sightings.append(seen)
        self._put(fresh, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        """Runs are merged bucket by bucket, where they lie; their keys differ."""
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self._write(_summed(self.levels[level]))
            self.levels[level] = []
            self._put(merged, level + 1)

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """``(key, last_id, last_tag)`` of the keys that at least ``least_docs`` documents hold."""
        return _summed([*self.runs(), *self.sightings]).filter(F.col("docs") >= least_docs).drop("docs")

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []


def repeated_lines(
    lines: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``LineRuns.repeated`` over all ``lines``, which should be staged, batch by batch.

    Batches are ranges of doc_id that hold about equally many lines; a number of them, not a
    size, so that anti-joins read the runs equally often however large the table is.
    """
    spark = lines.sparkSession
    position = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))
    buckets = Buckets.of(lines, position, batches)
    runs = LineRuns(spark, fanout)
    try:
        for bucket in reversed(range(len(buckets.bounds) - 1)):
            part = buckets.tag(lines.filter(buckets.inside(bucket))).filter(F.col(BUCKET) == bucket)
            runs.add(holders(part))
        return stage(runs.repeated(least_docs), "repeated-lines")
    finally:
        runs.close()


def dedup_lines(
    docs: DataFrame,
    least_points: int = LEAST_POINTS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``(doc_id, tag, lines, gone, kept)``, a row per row of ``docs``.

    Keys of at least ``least_points`` code points that at least ``least_docs`` documents hold
    lose all their lines except in the largest document that holds them, where each of them
    stays. ``gone`` has the numbers of the lines that go (null: none), ``kept`` the other lines.

    A null or empty text is one empty line. Rows that repeat a doc_id are one document when
    documents are counted and compared, but each loses only lines of its own. A row with a null
    doc_id is a document by its text, smaller than every id; equal texts without an id are one,
    and of different ones the greatest hash of the text counts as the largest. An empty table
    gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.

    Texts are read twice and move at most once, to the numbers of their lines to drop; if those
    are small enough for Spark to broadcast, they do not move.
    """
    lines = stage(keyed_lines(docs.select("doc_id", "text"), least_points), "keyed-lines")
    repeated = repeated_lines(lines, least_docs, batches, fanout)
    largest = F.when(F.col("last_id").isNull(), F.col("tag") == F.col("last_tag")).otherwise(
        F.coalesce(F.col("doc_id") == F.col("last_id"), F.lit(False))
    )
    drops = (
        lines.join(repeated, "key")
        .filter(~largest)
        .groupBy("doc_id", "tag")
        .agg(F.collect_set("pos").alias("gone"))  # at most the lines of one text
    )
    cut, drops = _cut(docs.select("doc_id", "text")).alias("all"), stage(drops, "line-drops").alias("drop")
    same = (F.col("all.tag") == F.col("drop.tag")) & F.col("all.doc_id").eqNullSafe(F.col("drop.doc_id"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.get("lines", i))
    )
    joined = cut.join(drops, same, "left").select("all.*", "drop.gone")
    return joined.withColumn("kept", kept)


def line_report(deduped: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of a result of ``dedup_lines``."""
    return deduped.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
