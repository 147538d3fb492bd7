"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import hash_number
from gristmill.llm.common import even_buckets, space_words, text_mark, whole_rows
from gristmill.operators.ordered import cutoff, div, running
from gristmill.session import stage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 42
BUCKET_ROWS = 100_000
DIGITS = 12
AT_ONCE = 1_000  # copies of one row that a task makes from one row
ORDER = ["v", "turn", "epoch", "key"]


def word_size(text: Column) -> Column:
    """Number of runs without white space; 0 for a null text."""
    return F.size(space_words(text)).cast("long")


def measured(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(row, doc_id, source, *keep, size, key)``; ``key`` puts the rows into a seeded random order.

    ``row`` tells repeated rows apart. Rows that share a key have the same id and size, so it
    does not matter which of them comes first.
    """
    size = word_size(F.col("text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", *keep, size.alias("size")
    ).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), named, F.lit(":"), F.col("size").cast("string"))))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS
) -> DataFrame:
    """``(source, turn, source_size, target)``, a row per source.

    Sources in code point order, null last, take the weights in turn. The targets share all
    sizes by weight; one that would pass ``most`` times its source's size stops there and the
    rest is shared by weight again, until none is above: that is the water level at which the
    sum of min(weight * level, cap) is the total, found in one sorted pass over the sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn(
        "turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("turn") - 1) % len(weights) + 1
    )
    capped = ranked.withColumns(
        {"weight": weight.cast("double"), "cap": (F.col("source_size") * most).cast("double")}
    )
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    onward = fullest.rowsBetween(0, Window.unboundedFollowing)
    everything = fullest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level)
    free = F.col("cap") >= F.col("weight") * F.col("level")
    water = F.first(F.when(free, F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(water, F.lit(0.0)))
    return levels.select("source", "turn", "source_size", target.alias("target"))


def _finish(epoch: Column) -> Column:
    """Virtual finish time: the source's words up to this document over the source's target."""
    return (epoch * F.col("source_size") + F.col("cum")) / F.col("target")


def _upto(key: tuple | None, v: Column, epoch: Column) -> Column:
    """Whether a pass comes strictly before the first one that no longer fits."""
    if key is None:
        return F.lit(True)
    mine = [v, F.col("turn"), epoch, F.col("key")]
    result = F.lit(False)
    for value, own in reversed(list(zip(key, mine, strict=True))):
        result = (own < F.lit(value)) | ((own == F.lit(value)) & result)
    return result


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, row)`` for every row of ``docs``,
    with the columns ``keep`` besides.

    Each source is a queue of its documents in seeded random order, passed up to ``most``
    times. A pass of a document finishes at virtual time (words of its source so far) / (target
    of its source), so at any time all queues are equally far. All passes in order of finish
    time, cut off before the one that would exceed the total of all sizes, are the mix;
    ``copies`` counts the passes it takes. No document is taken more than ``most`` times.

    Words are counted in the one pass over texts; the rest moves rows of a few numbers. A
    source of any size is spread over hash buckets of about ``bucket_rows`` rows, with prefix
    sums over bucket totals, and the cut is one key found in one bucket of virtual time.

    A null text has size 0 and, like a blank one, adds nothing. Null sources are one source.
    Repeated rows are rows of their own. An empty table gives an empty result. Other columns
    are not read.
    """
    sizes = stage(measured(docs.select("doc_id", "text", "source", *keep), seed, keep), "sizes")
    rows = sizes.count()
    targets = stage(source_targets(sizes, weights, most), "targets")
    known = sizes.alias("s").join(
        targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))
    ).select("s.*", "t.turn", "t.source_size", "t.target")
    known = stage(known.drop("source").withColumn("position", hash_number(F.col("key"), DIGITS)), "queued")
    count = max(1, math.ceil(rows / bucket_rows))
    hashed = even_buckets(F.col("position"), 0, 16**DIGITS, count)
    queued = running(known, ["key", "row"], hashed, {"ahead": ("sum", "size")}, ["turn"])
    queued = stage(queued.withColumn("cum", F.col("ahead") + F.col("size")), "queues")
    served = queued.filter("target > 0")
    passes = served.select(
        "turn", "key", "size", "cum", "source_size", "target",
        F.explode(F.array(*[F.lit(e) for e in range(most)])).alias("epoch"),
    ).select("turn", "key", "size", "epoch", _finish(F.col("epoch")).alias("v"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # A unit of virtual time holds all sizes once; sources far above their target go on longer.
    latest = passes.agg(F.max("v")).first()[0] or 1.0
    timed = even_buckets(F.col("v"), 0, latest, max(1, math.ceil(latest)) * count)
    first_out = cutoff(passes, ORDER, timed, F.col("size"), total + 1)
    copies = sum(
        (_upto(first_out, _finish(F.lit(e)), F.lit(e)).cast("int") for e in range(most)), F.lit(0)
    )
    taken = F.when(F.col("target") > 0, copies).otherwise(F.lit(0))
    named = targets.select("turn", "source")
    return queued.withColumn("copies", taken).join(named, "turn").select(
        "doc_id", "size", "source", "source_size", "target", "copies", "row", *keep
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it, all columns kept.

    Rows are matched with the plan by id, source and text, nulls included. Of rows that repeat
    all three one stands for all, as often as the mix takes them together, so the words that
    come out are those of the plan; a row that appears very often is dealt out over all tasks.
    """
    marked = docs.select("doc_id", "source", "text", text_mark(F.col("text")).alias("mark"))
    plan = mix(marked, keep=("mark",), **options)
    wanted = plan.groupBy("doc_id", "source", "mark").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")
    )
    wanted = stage(wanted.filter("copies > 0"), "mix")
    rows = whole_rows(docs, "source")
    same = (
        F.col("doc.doc_id").eqNullSafe(F.col("mix.doc_id"))
        & F.col("doc.source").eqNullSafe(F.col("mix.source"))
        & (F.col("doc.mark") == F.col("mix.mark"))
    )

    def taken(some: DataFrame) -> DataFrame:
        return rows.alias("doc").join(some.alias("mix"), same).select("doc.*", "mix.copies")

    def repeated(row: str, times: Column) -> Column:
        return F.explode(F.array_repeat(F.col(row), times.cast("int"))).alias("row")

    mixed = taken(wanted.filter("n = 1")).select(repeated("row", F.col("copies")))
    several = wanted.filter("n > 1")
    if not several.isEmpty():
        one = taken(several).dropDuplicates(["doc_id", "source", "mark"])
        shares = one.select(
            "row", "copies", F.explode(F.sequence(F.lit(0), div(F.col("copies") - 1, AT_ONCE))).alias("share")
        )
        dealt = shares.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        here = F.least(F.lit(AT_ONCE), F.col("copies") - F.col("share") * AT_ONCE)
        mixed = mixed.unionByName(dealt.select(repeated("row", here)))
    return mixed.select("row.*")
