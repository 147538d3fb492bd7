"""I-Match fingerprints over randomised lexicons of mid-frequency terms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import letter_words
from gristmill.operators.ordered import BUCKET, Buckets
from gristmill.session import stage

# Terms whose inverse document frequency, ln(documents / documents with the term), is in here.
BAND = (2.0, 7.0)
# Each lexicon keeps a term with probability 2 ** -k, for every k twice.
RATES = tuple(k for k in range(2, 10) for _ in range(2))
DIGITS = 8
EMPTY = "0" * DIGITS
BUCKET_ROWS = 100_000


def term_set(text: Column) -> Column:
    """Distinct terms: lower-cased runs of letters and digits."""
    return F.array_distinct(letter_words(text))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``(term, mask)``: terms inside the band with the lexicons (bits) that keep them.

    Frequencies are over all documents and whole texts. Whether a lexicon keeps a term depends
    on the term alone. A term within the band is in at least exp(-7) of the documents, so there
    are at most exp(7), about 1,100, times as many terms as a document has on average, however
    many documents there are: that bound is what allows the broadcast.
    """
    # The outer form keeps Spark from adding a filter that would match the pattern again.
    listed = docs.select(F.explode_outer(term_set(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    counted = listed.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(docs.count())) / F.col("df"))
    inside = stage(counted.filter(idf.between(*band)).select("term"), "band")
    hashed = inside.withColumn("digest", F.sha2("term", 256))
    bits = [
        F.when(
            F.conv(F.substring("digest", 4 * j + 1, 4), 16, 10).cast("int") < (1 << (16 - k)), 1 << j
        ).otherwise(0)
        for j, k in enumerate(RATES)
    ]
    return hashed.select("term", sum(bits, F.lit(0)).alias("mask")).filter("mask > 0")


def signatures(ordered: Column, whole: Column) -> Column:
    """Per lexicon, a hash of the sorted distinct terms it keeps; zeros if it keeps none.

    A text with no term in any lexicon has the digest ``whole`` of its text in every place, so it
    is like an equal text and unlike all others.

    ``ordered`` is a sorted array of (term, mask) structs. It is used once per lexicon, so it
    should be a computed column, not an expression.
    """

    def kept(bit: int) -> Column:
        mine = F.filter(ordered, lambda t: t["mask"].bitwiseAND(F.lit(bit)) != 0)
        return F.array_join(F.transform(mine, lambda t: t["term"]), " ")

    joined = F.array(*[kept(1 << j) for j in range(len(RATES))])
    marks = F.transform(
        joined,
        lambda terms: F.when(terms == "", EMPTY).otherwise(F.substring(F.md5(terms.cast("binary")), 1, DIGITS)),
    )
    alone = F.array_repeat(F.substring(whole, 1, DIGITS), len(RATES))
    return F.when(F.size(ordered) == 0, alone).otherwise(marks)


def likeness(a: Column, b: Column) -> Column:
    """Share of lexicons that agree, among those that keep a term of either; 1 if all are equal."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != EMPTY)), lambda same: same))
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != EMPTY) | (y != EMPTY)), lambda some: some))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(agree / F.nullif(used, F.lit(0)), F.lit(0.0)))


def fingerprint_text(marks: Column) -> Column:
    return F.array_join(marks, "")


def _with_next(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """``(_bucket, row, extra, doc_id, text, next_text)``: texts beside the next, descending ids.

    Rows are put into buckets of the id; texts move once, to their bucket. The largest row of
    each bucket also goes, as an extra one, to the end of the bucket above it, and the largest
    of all to the lowest bucket.
    """
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select("doc_id")
    parallel = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = Buckets.of(ids, place, max(parallel, math.ceil(ids.count() / bucket_rows)))
    rows = buckets.tag(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    heads = buckets.tag(ids).groupBy(BUCKET).agg(F.max("doc_id").alias("doc_id"))
    heads = stage(heads, "heads")
    # A row per bucket; ties on the largest id are settled by the text.
    tops = rows.alias("r").join(
        F.broadcast(heads.alias("h")),
        (F.col(f"r.{BUCKET}") == F.col(f"h.{BUCKET}")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")),
    ).select("r.*")
    tops = stage(tops.groupBy(BUCKET).agg(F.max(F.struct("doc_id", "text")).alias("top")), "tops")
    along = Window.orderBy(BUCKET)
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = F.coalesce(F.lag("top").over(along), F.last("top").over(everything))
    extra = tops.select(BUCKET, below.alias("top")).select(
        F.lit(-1).cast("long").alias("row"), F.col("top.doc_id").alias("doc_id"), F.col("top.text").alias("text"),
        BUCKET, F.lit(True).alias("extra"),
    )
    every = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    inside = Window.partitionBy(BUCKET).orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return every.withColumn("next_text", F.lead("text").over(inside)).withColumn(
        "at", F.row_number().over(inside)
    )


def edited(text: Column, n: Column, next_text: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the next text."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprint_pairs(docs: DataFrame, band: tuple[float, float] = BAND, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, marks, edited_marks, near_edited, near_next)``.

    ``marks`` are the signatures of the whole text. Null texts count as empty; a text without
    terms in any lexicon has its own digest as marks, and is like equal texts alone. Repeated
    rows stay; equal ids are ordered by text, null ids come last. An empty table gives no row.

    The frequencies cost one shuffle of term counts, the texts are moved once, and terms are
    matched with the broadcast lexicon and gathered per document where they are.
    """
    words = stage(lexicon(docs, band), "lexicon")
    n = F.length("text")
    sides = _with_next(docs.select("doc_id", "text"), bucket_rows).select(
        BUCKET, "at", "extra", "doc_id", "text", n.alias("n_chars"),
        F.when(~F.col("extra"), edited(F.col("text"), n, F.col("next_text"))).alias("edited"),
    )

    none = F.lit(None).cast("string")

    def entry(number: int, term: Column, own_sha: Column = none, sha: Column = none) -> Column:
        return F.struct(
            F.lit(number).alias("side"), term.alias("term"), own_sha.alias("own_sha"), sha.alias("sha")
        )

    def side(text: Column, number: int) -> Column:
        return F.transform(term_set(text), lambda w: entry(number, w))

    # The last entry, without a term, keeps documents that have no term at all. It alone has the
    # digests: beside the others they would be worked out for every term.
    digests = [F.sha2("text", 256), F.sha2("edited", 256)]
    entries = F.concat(side(F.col("text"), 0), side(F.col("edited"), 1), F.array(entry(2, none, *digests)))
    listed = sides.select(BUCKET, "at", "extra", "doc_id", "n_chars", F.explode(entries).alias("e")).select(
        BUCKET, "at", "extra", "doc_id", "n_chars", "e.*"
    )
    found = listed.join(F.broadcast(words), "term", "left").filter("mask IS NOT NULL OR side = 2")
    term = F.struct("term", "mask")
    last = F.col("side") == 2
    gathered = found.groupBy(BUCKET, "at").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, term))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, term))).alias("other"),
        F.first(F.when(last, F.struct("extra", "doc_id", "n_chars", "own_sha", "sha")), ignorenulls=True).alias("doc"),
    )
    marked = gathered.select(
        BUCKET, "at", "doc.*",
        signatures(F.col("own"), F.col("doc.own_sha")).alias("marks"),
        signatures(F.col("other"), F.col("doc.sha")).alias("edited_marks"),
    )
    following = F.lead("marks").over(Window.partitionBy(BUCKET).orderBy("at"))
    beside = marked.withColumn("next_marks", following).filter(~F.col("extra"))
    return beside.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        "marks",
        "edited_marks",
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
