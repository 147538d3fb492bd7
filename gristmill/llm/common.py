"""Column expressions and small tables that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ordered import Buckets

# The space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Runs without white space, in order; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept. Plain ASCII texts take the fast way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_mark(text: Column) -> Column:
    """128 bits of a text; with the id it names a row whose id others repeat or lack."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def whole_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """``(row, doc_id, *keys, mark)``: rows as one value, so that no name can clash."""
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row")
    return docs.select(row, "doc_id", *keys, text_mark(F.col("text")).alias("mark"))


def one_of_each(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` lets stay, one of rows that repeat id and text.

    ``judged`` is a written table ``(doc_id, mark, n, stays)``, a row per id and text of
    ``docs``. Only rows that stay and are repeated are grouped, with partial aggregates.
    """

    def among(rows: DataFrame, named: DataFrame, kind: str) -> DataFrame:
        same = F.col("doc.doc_id").eqNullSafe(F.col("named.doc_id")) & (F.col("doc.mark") == F.col("named.mark"))
        return rows.alias("doc").join(named.alias("named"), same, kind)

    kept = among(whole_rows(docs), judged.filter("NOT stays"), "left_anti")
    again = judged.filter("stays AND n > 1")
    if not again.isEmpty():
        several = among(kept, again, "left_semi").dropDuplicates(["doc_id", "mark"])
        kept = among(kept, again, "left_anti").unionByName(several)
    return kept.select("row.*")


def even_buckets(position: Column, low: float, high: float, count: int) -> Buckets:
    """``count`` equally wide buckets over ``low..high`` and one more on either side."""
    step = (high - low) / max(count, 1)
    return Buckets(position, (-math.inf, *(low + step * i for i in range(count + 1)), math.inf))
