"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower, one_of_each, space_words, text_mark
from gristmill.llm.components import connected_components
from gristmill.session import stage

WIDTH = 4
BITS = 64
DISTANCE = 4
# Three segments share at most four differing bits, so one of them differs by at most one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIR = 0x0000000100000001


def fingerprints(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, fp)``: the 64-bit SimHash of the word shingles of each row's whole text.

    A-Z are lower-cased; words are runs without white space; shingles are ``width`` words
    joined by a space, repeats included (fewer words: all of them). Each is hashed by XXH64
    with seed 42. A bit is 1 if set in over half of the hashes. A text without words, also a
    null one, has fingerprint 0. Repeated rows each keep a row; a null doc_id stays null.

    The shingles exist only inside one generated loop. Each of 32 sums counts two bits, and the
    partial sums of a document are complete before the only shuffle, a row per document.
    """
    words = space_words(ascii_lower(F.col("text")))
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *keep, words.alias("w")
    ).withColumn("n", F.size("w"))
    places = cut.select(
        "row", "doc_id", *keep, "w", "n",
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))).alias("i"),
    )
    word = [F.get("w", F.col("i") + k) for k in range(width)]
    spaced = [x for w in word for x in (F.lit(" "), w)][1:]
    shingle = F.when(F.col("n") >= width, F.concat(*spaced)).otherwise(F.array_join("w", " "))
    hashed = places.select(
        "row", "doc_id", *keep, F.when(F.col("n") > 0, F.xxhash64(shingle)).alias("h")
    )
    half = BITS // 2
    counted = hashed.groupBy("row", "doc_id", *keep).agg(
        F.count("h").alias("n"),
        *[
            F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(PAIR))).alias(f"s{k}")
            for k in range(half)
        ],
    )
    parts = []
    for k in range(half):
        low = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{k}", 32)
        parts += [(low, k), (high, k + half)]
    bits = [
        F.shiftleft(F.when(count * 2 > F.col("n"), 1).otherwise(0).cast("long"), place)
        for count, place in parts
    ]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return counted.select("doc_id", *keep, F.coalesce(bits[0], F.lit(0).cast("long")).alias("fp"))


def _variants(fp: Column) -> Column:
    """The 64 one-wildcard values: one segment of the fingerprint with one bit taken out."""
    found = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            found.append(rest.bitwiseOR(F.lit((start + bit) << 22)))
    return F.array(*found)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _spread(fps: DataFrame) -> DataFrame:
    """A few bytes a row become many rows, so they are dealt out to all tasks first."""
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def stars(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``(fp, pivot)`` to the least fingerprint that shares a segment, if it is near.

    In a crowd of close copies these few edges, three a fingerprint at most, connect nearly all.
    """
    segments = F.array(
        *[
            F.shiftrightunsigned("fp", start)
            .bitwiseAND(F.lit((1 << width) - 1))
            .bitwiseOR(F.lit(number << 22))
            for number, (start, width) in enumerate(SEGMENTS)
        ]
    )
    listed = _spread(fps).select("fp", F.explode(segments).alias("key"))
    pivots = listed.groupBy("key").agg(F.min("fp").alias("pivot"))
    near = (_apart("fp", "pivot") <= distance) & (F.col("fp") != F.col("pivot"))
    # Spark sizes rows of an explode as those before it, so the hint keeps them from a broadcast.
    return listed.join(pivots.hint("merge"), "key").filter(near).select("fp", "pivot").distinct()


def _first_meeting(a: str, b: str, key: str) -> Column:
    """Whether this variant is the one at which a pair counts: the first of its first segment.

    Two fingerprints with an equal segment meet in all of its variants, those that differ in
    one bit of it in the variant without that bit.
    """
    apart = F.col(a).bitwiseXOR(F.col(b))
    slot = F.shiftright(key, 22)
    counts, earlier = F.lit(False), F.lit(False)
    for start, width in SEGMENTS:
        inside = apart.bitwiseAND(F.lit(_signed(((1 << width) - 1) << start)))
        here = slot.between(start, start + width - 1)
        counts |= here & ~earlier & ((inside != 0) | (slot == start))
        earlier |= F.bit_count(inside) <= 1
    return counts


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def links(labelled: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs of different labels ``(a, b)`` with fingerprints at most ``distance`` bits apart.

    Two fingerprints within four bits agree in at least one of the variants, so they meet in
    that variant's bucket, where the exact distance is part of the join. Pairs of one label
    are connected already and do not come out, and every other pair comes out once.

    The 64 rows of a fingerprint are shuffled, never broadcast: Spark sizes them as one row.
    """
    listed = _spread(labelled).select("fp", "root", F.explode(_variants(F.col("fp"))).alias("key"))
    met = listed.alias("x").join(
        listed.alias("y").hint("merge"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.root") < F.col("y.root"))
        & (_apart("x.fp", "y.fp") <= distance)
        & _first_meeting("x.fp", "y.fp", "x.key"),
    )
    return met.select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()


def labels(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``nodes`` with ``root``: the pivot's pivot, a fingerprint that is connected by stars.

    Two steps bring a crowd of close copies to very few labels; they need not be the least.
    """
    least = stars(nodes.select("fp"), distance).groupBy("fp").agg(F.min("pivot").alias("pivot"))
    least = stage(least, "pivots")
    again = least.select(F.col("fp").alias("pivot"), F.col("pivot").alias("root"))
    two = least.join(again, "pivot", "left").select("fp", F.coalesce("root", "pivot").alias("root"))
    joined = nodes.join(two, "fp", "left")
    return joined.withColumn("root", F.coalesce("root", "fp"))


def _grouped(docs: DataFrame, width: int, distance: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, fp, root, component_id)``; ``root`` is one fingerprint of the group."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"three segments find at most {DISTANCE} differing bits")
    found = stage(fingerprints(docs.select("doc_id", "text", *keep), width, keep), "fingerprints")
    nodes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    labelled = stage(labels(nodes, distance), "labels")
    ties = labelled.filter("fp != root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    roots = connected_components(ties.unionByName(links(labelled, distance)))
    rooted = labelled.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stage(rooted.withColumn("root", F.coalesce("root", "fp")), "roots")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return found.join(named, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def near_groups(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row: the smallest doc_id reachable by links.

    Equal fingerprints are one node, however many rows share them. Empty and null texts have
    fingerprint 0 and are linked like any other. A group whose doc_ids are all null has a null
    component. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    return _grouped(docs, width, distance).select("doc_id", "fp", "component_id")


def near_deduplicate(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group, all columns kept.

    The one with the smallest doc_id stays; null ids come last, texts of one id in the order of
    their marks. Rows are named by id and text, so another text under the id of a removed copy
    is judged by itself; of rows that repeat both, one stays. Texts move at most once.
    """
    marked = docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    groups = stage(_grouped(marked, width, distance, ("mark",)), "near-groups")
    rows = groups.groupBy("doc_id", "mark", "root").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    least = groups.groupBy("root").agg(F.min(order).alias("least"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))
    judged = rows.join(least, "root").select("doc_id", "mark", "n", stays.alias("stays"))
    return one_of_each(docs, stage(judged, "near-judged"))
