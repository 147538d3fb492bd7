"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import letter_words, text_mark
from gristmill.session import stage

# Five positions that must agree (1) among some that may differ (0).
MASKS = ("110111", "1101011", "11010011")
WINDOW = 16
SIMILARITY = 0.8
BLOCK_TOKENS = 200_000


def _tokens(text: Column) -> Column:
    return F.transform(letter_words(text), lambda w: F.xxhash64(w))


def _seed(tokens: str, at: Column, mask: str, number: int) -> Column:
    """Hash of the tokens that the mask selects; null where it reaches past the end."""
    picked = [F.get(tokens, at + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(number), *picked))


def _placed(rows: DataFrame, tokens: str, *keep: str) -> DataFrame:
    shortest = min(map(len, MASKS))
    last = F.size(tokens) - shortest
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    return rows.select(*keep, tokens, F.explode(places).alias(f"{tokens}_at"))


def _agree(i: Column) -> Column:
    """Whether position ``i`` of the item and the aligned one of the document hold the same token.

    Positions outside of either agree with nothing.
    """
    token = F.get("b", i)
    return F.coalesce(F.get("t", F.col("start") + i) == token, F.lit(False))


def _further(mask: str) -> list[int]:
    """Positions that agree, besides those of a hit of ``mask``, if it also hits one place earlier."""
    ones = {k for k, bit in enumerate(mask) if bit == "1"}
    return sorted({k - 1 for k in ones} - ones)


def _first_hit() -> Column:
    """Whether the mask does not hit one place earlier on the same alignment.

    Every alignment with a hit keeps the first of each unbroken run of hits, so it is compared
    about once, also where one word repeated makes every place hit every other one.
    """
    further = [_further(mask) for mask in MASKS]
    agreed = []
    for number in range(max(map(len, further))):
        places = [some[number] if number < len(some) else some[0] for some in further]
        at = F.element_at(F.array(*map(F.lit, places)), F.col("mask") + 1)
        agreed.append(_agree(F.col("b_at") + at))
    return ~reduce(Column.__and__, agreed)


def _overlaps(
    docs: DataFrame, seeds: DataFrame, items: DataFrame, window: int, similarity: float, keys: tuple[str, ...]
) -> DataFrame:
    """Verified overlaps of all documents with one block of the benchmark.

    One pass and no shuffle of documents: token places exist only inside a generated loop, the
    two broadcast look-ups keep those that hit, and the windows of their alignments are compared
    there, once for each run of hits. The loop ends in the partial maximum of ``best``, so a
    task holds no row with the tokens of a text but the one at hand.
    """
    placed = _placed(docs, "t", *keys)
    hits = placed.select(
        *keys,
        "t",
        "t_at",
        F.posexplode(F.array(*[_seed("t", F.col("t_at"), m, n) for n, m in enumerate(MASKS)])).alias("mask", "seed"),
    )
    found = hits.join(F.broadcast(seeds), "seed").join(F.broadcast(items), "item_id")
    aligned = found.withColumn("start", F.col("t_at") - F.col("b_at")).filter(_first_hit())
    size = F.least(F.size("b"), F.lit(window))
    windows = aligned.select(
        *keys, "item_id", "start", "t", "b", size.alias("compared"),
        F.explode(F.sequence(F.lit(0), F.size("b") - size)).alias("low"),
    )
    matched = sum((_agree(F.col("low") + k).cast("int") for k in range(window)), F.lit(0))
    enough = F.ceil(F.col("compared") * F.lit(similarity) - F.lit(1e-9))
    compared = windows.select(*keys, "item_id", "start", "compared", matched.alias("matched")).filter(
        F.col("matched") >= enough
    )
    best = F.col("matched").cast("long") * (1 << 33) + (F.lit(1 << 31) - F.col("start"))
    return compared.select(*keys, "item_id", "compared", best.alias("best"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    block_tokens: int = BLOCK_TOKENS,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``(*keys, item_id, start, matched, compared, similarity)``: overlaps with a benchmark.

    ``keys`` are the columns that name a document.

    Texts are read whole as lower-cased runs of letters and digits. Every place of a document
    and of a benchmark item is hashed under each of three fixed masks; a shared hash fixes an
    alignment. It counts if some run of ``window`` aligned tokens (all of a shorter item)
    agrees in at least ``similarity`` of its positions, so substituted words are tolerated.
    One row per document and item, with the best alignment (``start`` is the token of the
    document that meets the first of the item, negative if it begins earlier).

    The benchmark goes out in blocks of at most ``block_tokens`` tokens, counted beforehand, so
    what is broadcast is bounded; each further block is another pass over the documents.
    Items of the same tokens are one item, under the smallest id. Items of fewer tokens than the
    shortest mask, null or empty texts and empty tables find nothing. Null doc_ids are kept, a
    null item_id is shown as -1; rows that repeat a doc_id give one row. A word repeated very
    often meets every place of an item that repeats it; of those only the first of each
    alignment is compared.
    """
    least = min(map(len, MASKS))
    tokens = benchmark.select("item_id", _tokens(F.col("text")).alias("b")).filter(F.size("b") >= least)
    items = tokens.groupBy("b").agg(F.min("item_id").alias("item_id"))
    items = items.withColumn("item_id", F.coalesce("item_id", F.lit(-1)))
    items = stage(items, "benchmark")
    total = items.agg(F.sum(F.size("b"))).first()[0] or 0
    texts = docs.select(*keys, _tokens(F.col("text")).alias("t"))
    blocks = max(1, math.ceil(total / block_tokens))
    number = F.pmod(F.xxhash64("b"), F.lit(blocks))
    parts = []
    for block in range(blocks):
        some = items.filter(number == block).select("item_id", "b")
        places = _placed(some, "b", "item_id")
        seeds = places.select(
            "item_id",
            "b_at",
            F.explode(F.array(*[_seed("b", F.col("b_at"), m, n) for n, m in enumerate(MASKS)])).alias("seed"),
        ).filter("seed IS NOT NULL")
        parts.append(_overlaps(texts, seeds, some, window, similarity, keys))
    scored = reduce(DataFrame.unionByName, parts)
    # One number holds the agreeing positions above the start, the earliest one being largest.
    best = scored.groupBy(*keys, "item_id", "compared").agg(F.max("best").alias("best"))
    matched = F.shiftright("best", 33).cast("int")
    return best.select(
        *keys,
        "item_id",
        (F.lit(1 << 31) - F.col("best").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("start"),
        matched.alias("matched"),
        "compared",
        (matched / F.col("compared")).alias("similarity"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; all columns kept.

    Documents are named by id and text, so neither another text under the id of a contaminated
    one nor another text without an id goes with it. What is found is a narrow written table.
    """
    marked = docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    found = find_contamination(marked, benchmark, keys=("doc_id", "mark"), **options)
    gone = stage(found.select("doc_id", "mark").distinct(), "contaminated").alias("gone")
    same = F.col("all.doc_id").eqNullSafe(F.col("gone.doc_id")) & (
        text_mark(F.col("all.text")) == F.col("gone.mark")
    )
    return docs.alias("all").join(gone, same, "left_anti")
