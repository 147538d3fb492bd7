"""Substring dedup: hash normalised units of all texts and keep each unit's first occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import stage

LINE_WORDS = 5
CLAUSE_WORDS = 6
FLUSH = 20_000
SCHEMA = "doc_id long, mark long, unit string, line_at long, start long, n_chars long, d1 long, d2 long"
# Clauses tile a line: up to the marks that end a clause and the white space after them.
CLAUSE = re.compile(
    r"(?:[^.!?,;:]|[.!?,;:]+[^.!?,;:\x20\x09-\x0D])+[.!?,;:]*[\x20\x09-\x0D]*"
    r"|[.!?,;:]+[\x20\x09-\x0D]*"
)
WORD = re.compile(r"[^\W_]+")


def _digest(words: list[str]) -> tuple[int, int]:
    """128 bits of the normalised unit, as two signed numbers."""
    found = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))
    return int.from_bytes(found[:8], "big", signed=True), int.from_bytes(found[8:], "big", signed=True)


def _runs(sizes: list[int], least: int) -> set[tuple[int, int]]:
    """First and last clause of the shortest runs of at least ``least`` words that begin or end
    at a shorter clause."""
    found = set()
    for k, size in enumerate(sizes):
        if size >= least:
            continue
        for step in (1, -1):
            total, at = size, k
            while total < least and 0 <= at + step < len(sizes):
                at += step
                total += sizes[at]
            if total >= least:
                found.add((min(k, at), max(k, at)))
    return found


def units_of(text: str, line_words: int, clause_words: int, runs: bool = False) -> Iterator[tuple]:
    """``(unit, line_at, start, n_chars, d1, d2)`` of a text, in one scan; with ``runs`` also
    neighbouring clauses taken together where one of them is too short to be a unit."""
    at = 0
    for line in text.split("\n"):
        clauses = list(CLAUSE.finditer(line))
        words = [WORD.findall(c.group().lower()) for c in clauses]
        every = [w for some in words for w in some]
        if len(every) >= line_words:
            yield "line", at, at, len(line), *_digest(every)
        # A line that is a single clause is counted once, as a line.
        if len(clauses) > 1:
            for clause, some in zip(clauses, words, strict=True):
                if len(some) >= clause_words:
                    yield "clause", at, at + clause.start(), len(clause.group()), *_digest(some)
            for a, b in sorted(_runs(list(map(len, words)), clause_words)) if runs else ():
                start, end = clauses[a].start(), clauses[b].end()
                yield "run", at, at + start, end - start, *_digest([w for some in words[a : b + 1] for w in some])
        at += len(line) + 1


def units(
    docs: DataFrame, line_words: int = LINE_WORDS, clause_words: int = CLAUSE_WORDS, runs: bool = False
) -> DataFrame:
    """``(doc_id, mark, unit, line_at, start, n_chars, d1, d2)``: the units of every whole text.

    ``mark`` is a hash of the text, which tells rows of one id, or without one, apart.

    Units are lines of at least ``line_words`` words and, inside lines, clauses of at least
    ``clause_words``, so that a passage set into the middle of a line is found too. A unit is
    normalised to lower-cased runs of letters and digits. Offsets and lengths are code points
    of the original text.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for doc_id, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else doc_id
                for unit in units_of(text, line_words, clause_words, runs):
                    rows.append((doc_id, mark, *unit))
                    if len(rows) >= FLUSH:
                        yield framed(rows)
                        rows = []
        yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"doc_id": "Int64"})

    known = docs.filter(F.col("text").isNotNull())
    return known.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInPandas(cut, SCHEMA)


def find_repeats(
    docs: DataFrame, line_words: int = LINE_WORDS, clause_words: int = CLAUSE_WORDS, runs: bool = False
) -> DataFrame:
    """``(doc_id, start, n_chars, unit, kept_doc_id, kept_start)``: the units to take out.

    Of all occurrences of a unit in the corpus the first by (doc_id, start) is kept; null ids
    come last, and texts of one id or without one in the order of their hashes. A clause is left
    out where its whole line goes. Offsets are those of the original text. With ``runs`` a
    clause too short to be a unit is reported within runs of neighbours, which may overlap.

    Digests are grouped with partial minima, so a unit that a third of all rows share is a row
    per task; occurrences move once, as a few numbers, and the join on the digest is one that
    adaptive execution splits. Null texts have no units. Rows that repeat id and text are one
    document. Empty tables give no row.
    """
    found = _repeats(docs, line_words, clause_words, runs)
    return found.drop("mark").distinct()


def _repeats(docs: DataFrame, line_words: int, clause_words: int, runs: bool) -> DataFrame:
    """``find_repeats`` with the ``mark`` of the text that each row is about."""
    found = stage(units(docs, line_words, clause_words, runs), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "start")
    first = found.groupBy("d1", "d2").agg(
        F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    later = found.join(first, ["d1", "d2"]).filter(
        ~F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))
        | (F.col("mark") != F.col("kept.mark"))
        | (F.col("start") != F.col("kept.start"))
    )
    line = Window.partitionBy("doc_id", "mark", "line_at")
    gone = F.max(F.col("unit") == "line").over(line)
    return (
        later.withColumn("line_gone", gone)
        .filter((F.col("unit") == "line") | ~F.col("line_gone"))
        .select(
            "doc_id",
            "mark",
            "start",
            "n_chars",
            "unit",
            F.col("kept.doc_id").alias("kept_doc_id"),
            F.col("kept.start").alias("kept_start"),
        )
        .distinct()
    )


def remove_repeats(
    docs: DataFrame, line_words: int = LINE_WORDS, clause_words: int = CLAUSE_WORDS, runs: bool = True
) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``; other columns and rows as they are.

    Short clauses go with the repeated runs they lie in, so a repeated passage inside a line has
    no holes. What is cut has an earlier occurrence that stays or points to one still earlier.
    Spans are cut out of the text they were found in, not out of another one of the same id.
    """
    spans = _repeats(docs, line_words, clause_words, runs).groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("start", "n_chars"))).alias("spans")
    )
    same = F.col("doc.doc_id").eqNullSafe(F.col("cut.doc_id")) & (
        F.xxhash64("doc.text") == F.col("cut.mark")
    )
    rows = docs.alias("doc").join(spans.alias("cut"), same, "left")
    kept = F.aggregate(
        "cut.spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(
                a["text"],
                F.substring(F.col("doc.text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
            ).alias("text"),
            F.greatest(s["start"] + s["n_chars"], a["at"]).alias("at"),
        ),
        lambda a: F.concat(a["text"], F.substring(F.col("doc.text"), a["at"] + 1, F.length("doc.text"))),
    )
    text = F.when(F.col("cut.spans").isNull(), F.col("doc.text")).otherwise(kept)
    return rows.select(
        *[text.alias("text") if name == "text" else F.col(f"doc.`{name}`") for name in docs.columns]
    )
