"""Interaction audit of document filters by exact constrained least squares.

Which filters a document fails is a bit mask, so a corpus is a few counts per part and mask.
From them all 32 coalitions are tabulated: how many documents a set of filters removes. Steps of
an order are differences of two coalitions. Shapley values solve the least squares problem over
all coalitions with Shapley kernel weights, under the constraint that the values add up to what
all filters remove; its normal equations are solved once in fractions, for any table of counts.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import space_words
from gristmill.session import stage

FILTERS = "ABCDE"
# The bounds of the five filters.
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"


def _text_failures(text: Column) -> Column:
    """The mask of filters A to D, which look at one text."""
    words = F.size("words")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    conditions = [
        words < LEAST_WORDS,
        F.size(F.array_distinct("words")) * 100 < words * DISTINCT_PERCENT,
        capitals * 100 > F.char_length(text) * CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for place, fails in enumerate(conditions):
        mask = mask + F.when(fails, 1 << place).otherwise(0)
    return mask


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, failed, good, toxic)`` per row: its ``lang``, failed filters, and labels.

    A null text is an empty one, a null ``lang`` the part ''. A row fails E if a smaller doc_id
    has an identical text anywhere in the table; a null doc_id is neither smaller nor larger
    than another, so it never fails E and makes none fail. Rows that repeat the smallest doc_id
    of a text all pass. A document is good or toxic if any of its rows in ``labels`` says so;
    rows without a label, a null label or a null doc_id are neither.

    Each text is read once, for a row of a few bytes. Copies are found by joining each text's
    smallest doc_id on both text and id, so that a text with very many copies is no hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    marked = read.withColumn("words", space_words(F.col("text"))).select(
        "doc_id",
        "part",
        _text_failures(F.col("text")).alias("failed"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    marked = stage(marked, "failures")
    firsts = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    verdicts = labels.groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    joined = marked.join(firsts, ["digest", "doc_id"], "left").join(verdicts, "doc_id", "left")
    return joined.select(
        "part",
        (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def _solved(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    """The inverse, by elimination in fractions."""
    size = len(matrix)
    rows = [[*row, *(Fraction(i == j) for j in range(size))] for i, row in enumerate(matrix)]
    for at in range(size):
        pivot = next(i for i in range(at, size) if rows[i][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for i in range(size):
            if i != at and rows[i][at]:
                rows[i] = [x - rows[i][at] * y for x, y in zip(rows[i], rows[at], strict=True)]
    return [row[size:] for row in rows]


@cache
def shapley_weights(players: int) -> tuple[tuple[int, ...], ...]:
    """Per player a whole weight for each coalition; the weighted sum of the coalitions' values
    is ``players!`` times the player's Shapley value, that is its total over all orders.

    With kernel weights k(S) = (n-1) / (C(n,|S|) |S| (n-|S|)), the sum of k(S) (v(S) - sum of
    the values in S)^2 is least, with values adding up to v of all, where A x + m = b and sum(x)
    = v(all): A sums k(S) over the coalitions that hold both players, b sums k(S) v(S).
    """
    every = (1 << players) - 1
    kernel = {
        s: Fraction(players - 1, comb(players, k := s.bit_count()) * k * (players - k)) for s in range(1, every)
    }
    holds = [[bool(s >> i & 1) for i in range(players)] for s in range(every + 1)]
    normal = [
        [sum((k for s, k in kernel.items() if holds[s][i] and holds[s][j]), Fraction(0)) for j in range(players)]
        + [Fraction(1)]
        for i in range(players)
    ]
    inverse = _solved([*normal, [Fraction(1)] * players + [Fraction(0)]])
    weights = []
    for i in range(players):
        row = [Fraction(0)] * (every + 1)
        for s, k in kernel.items():
            row[s] = k * sum(inverse[i][j] for j in range(players) if holds[s][j])
        row[every] = inverse[i][players]
        scaled = [x * factorial(players) for x in row]
        if any(x.denominator != 1 for x in scaled):
            raise ArithmeticError("the values over all orders must be whole")
        weights.append(tuple(int(x) for x in scaled))
    return tuple(weights)


def coalitions(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per ``part``: its rows, and arrays of the documents, good and toxic ones that each
    set of filters (by its mask) removes. The counts per mask are complete before any sum."""
    counted = failed.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )

    def removed(column: str) -> Column:
        return F.array(
            *[
                F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(0))
                for s in range(1 << len(filters))
            ]
        ).alias(column)

    return counted.groupBy("part").agg(
        F.sum("docs").alias("rows"), removed("docs"), removed("good"), removed("toxic")
    )


def audit(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, as counts of documents of the part.

    ``failed`` has ``part``, ``failed`` (a mask, bit i for filter i), ``good`` and ``toxic``.
    ``kept`` after the step, ``removed`` here, ``redundant`` (fails the step's filter, removed
    earlier), ``unique_fails`` (fails no other), ``good_lost`` and ``toxic_lost`` here, and
    ``shapley``, the filter's removals added up over all orders. An empty table has no parts.
    """
    table = coalitions(failed, filters)
    weights = shapley_weights(len(filters))
    every = (1 << len(filters)) - 1
    shapley = F.array(
        *[sum((F.get("docs", F.lit(s)) * w for s, w in enumerate(row) if w), F.lit(0)) for row in weights]
    )
    alone = F.array(
        *[F.get("docs", F.lit(every)) - F.get("docs", F.lit(every ^ (1 << i))) for i in range(len(filters))]
    )
    orders = F.split(F.lit(",".join(map("".join, permutations(filters)))), ",")
    parts = table.withColumns({"shapley": shapley, "alone": alone})
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")
    )

    def place(letter: Column) -> Column:
        return F.instr(F.lit(filters), letter) - 1

    bits = [
        F.when(F.col("step") > j + 1, F.call_function("shiftleft", F.lit(1), place(F.substring("filter_order", j + 1, 1))))
        .otherwise(0)
        for j in range(len(filters) - 1)
    ]
    own = place(F.call_function("substring", F.col("filter_order"), F.col("step"), F.lit(1)))
    placed = steps.withColumns({"own": own, "before": sum(bits, F.lit(0))}).withColumn(
        "after", F.col("before") + F.call_function("shiftleft", F.lit(1), F.col("own"))
    )
    here = {c: F.get(c, F.col("after")) - F.get(c, F.col("before")) for c in ("docs", "good", "toxic")}
    fails = F.get("docs", F.call_function("shiftleft", F.lit(1), F.col("own")))
    return placed.select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.get("docs", F.col("after"))).alias("kept"),
        here["docs"].alias("removed"),
        (fails - here["docs"]).alias("redundant"),
        F.get("alone", F.col("own")).alias("unique_fails"),
        here["good"].alias("good_lost"),
        here["toxic"].alias("toxic_lost"),
        F.get("shapley", F.col("own")).alias("shapley"),
    )
