"""Packing whole documents into token shards, exactly as a sequential writer would.

A shard closes at the first document whose running total reaches the last close plus the
shard size, so each border depends on the one before. Every bucket of the order works out,
for any open position it may inherit, where its last close would be: a piecewise constant
map. Such maps compose, so a tree over the buckets composes them upwards, a few neighbours at
a time, and hands the open positions down again. No step of it takes place on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.ordered import BUCKET, Buckets, Ranges, cutoff, div, running, up_to
from gristmill.session import stage

SHARD_TOKENS = 100_000_000
FAN = 16

# A node of the tree: the running totals at which it begins and ends and, for a first close
# wanted at a total in (low, high], the last close in it and the number of its closes.
MAP = "split string, node int, begin long, end long, low array<long>, high array<long>, last array<long>, closed array<long>"
STATE = "split string, node int, opened long, first_shard long"


def _merged(low, high, last, closed) -> dict[str, np.ndarray]:
    """Neighbouring ranges with the same outcome as one."""
    new = np.concatenate([[True], (last[1:] != last[:-1]) | (closed[1:] != closed[:-1])])
    end = np.concatenate([new[1:], [True]])
    return {"low": low[new], "high": high[end], "last": last[new], "closed": closed[new]}


def _closes(size: int):
    """The map of one bucket of one split."""

    def closes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("through")
        total = rows["through"].to_numpy()
        begin = total[0] - rows["n_tokens"].iloc[0]
        count = len(total)
        hop = np.searchsorted(total, total + size)  # next close; count = outside
        last, closed = np.arange(count), np.ones(count, np.int64)
        inside = np.flatnonzero(hop < count)
        while len(inside):  # follow the hops, doubling their length each time
            target = hop[inside]
            last[inside], closed[inside], hop[inside] = (
                last[target],
                closed[inside] + closed[target],
                hop[target],
            )
            inside = inside[hop[inside] < count]
        low = np.concatenate([[begin], total[:-1]])
        first = low < begin + size  # the inherited position lies before this bucket
        found = _merged(low[first], total[first], total[last[first]], closed[first])
        node = {"split": rows["split"].iloc[0], "node": rows[BUCKET].iloc[0], "begin": begin, "end": total[-1]}
        return pd.DataFrame([node | found])

    return closes


def _after(node: dict, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where closes are wanted inside ``node``; there the last close and the number of closes."""
    inside = wanted <= node["end"]
    at = np.searchsorted(node["high"], wanted[inside])
    return inside, node["last"][at], node["closed"][at]


def _then(first: dict, second: dict, size: int) -> dict:
    """The map of two neighbours together.

    Closes of the first node lead on into the second; where the first has none, the position is
    handed on as it is.
    """
    last, closed = first["last"].copy(), first["closed"].copy()
    inside, at, more = _after(second, last + size)
    last[inside], closed[inside] = at, closed[inside] + more
    beyond = second["low"] < first["begin"] + size
    if first["end"] >= first["begin"] + size:
        beyond[:] = False
    columns = zip(
        (first["low"], first["high"], last, closed),
        (second[c][beyond] for c in ("low", "high", "last", "closed")),
        strict=True,
    )
    return {"begin": first["begin"], "end": second["end"]} | _merged(*map(np.concatenate, columns))


def _composed(size: int):
    """Up the tree: the map of a parent, whose children are at most ``FAN``."""

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        first, *others = rows.sort_values("node").to_dict("records")
        whole = first
        for other in others:
            whole = _then(whole, other, size)
        return pd.DataFrame([whole | {"split": first["split"], "node": first["node"] // FAN}])

    return compose


def _descended(size: int):
    """Down the tree: with which open position and shard number each child begins."""

    def descend(rows: pd.DataFrame) -> pd.DataFrame:
        found, opened, shard = [], None, None
        for child in rows.sort_values("node").to_dict("records"):
            if opened is None:
                opened, shard = child["opened"], child["first_shard"]
            found.append((child["split"], child["node"], opened, shard))
            inside, last, closed = _after(child, np.array([opened + size]))
            if inside[0]:
                opened, shard = int(last[0]), shard + int(closed[0])
        return pd.DataFrame(found, columns=["split", "node", "opened", "first_shard"])

    return descend


def _starts(maps: DataFrame, buckets: int, size: int) -> DataFrame:
    """``STATE`` of every bucket, by a tree scan in log(buckets) steps.

    A node's map has a range per document within one shard size of its begin at most, however
    many documents it stands for, and mostly very few: closes soon coincide.
    """
    levels, nodes = [maps], buckets
    while nodes > 1:
        parents = levels[-1].groupBy("split", div(F.col("node"), FAN)).applyInPandas(_composed(size), MAP)
        levels.append(stage(parents, "shard-maps"))
        nodes = -(-nodes // FAN)
    start = F.lit(0).cast("long")
    states = levels.pop().select("split", "node", start.alias("opened"), start.alias("first_shard"))
    for maps in reversed(levels):
        parents = states.withColumnRenamed("node", "parent")
        children = maps.withColumn("parent", div(F.col("node"), FAN)).join(parents, ["split", "parent"])
        states = children.groupBy("split", "parent").applyInPandas(_descended(size), STATE)
    return states


def _place(size: int):
    """Per bucket with its start known: the shard of each document and its place in it."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("through")
        total = rows["through"].to_numpy()
        borders = [rows["opened"].iloc[0]]
        while (at := np.searchsorted(total, borders[-1] + size)) < len(total):
            borders.append(total[at])
        borders = np.array(borders)
        before = total - rows["n_tokens"].to_numpy()
        passed = np.searchsorted(borders, before, side="right") - 1
        return pd.DataFrame(
            {
                "split": rows["split"],
                "doc_id": rows["doc_id"],
                "shard": rows["first_shard"] + passed,
                "start": before - borders[passed],
                "n_tokens": rows["n_tokens"],
            }
        )

    return place


def pack_token_shards(docs: DataFrame, size: int = SHARD_TOKENS, buckets: int | None = None) -> DataFrame:
    """``(split, doc_id, shard, start, n_tokens)`` for documents in ``doc_id`` order per split.

    Whole documents only: a shard overshoots ``size`` by part of its last document, and the
    remainder forms the last shard. ``docs`` needs ``split, doc_id, n_tokens``.
    """
    narrow = docs.select("split", "doc_id", "n_tokens")
    order = Buckets.of(narrow, F.col("doc_id"), buckets)
    ordered = running(narrow, ["doc_id"], order, {"before": ("sum", "n_tokens")}, ["split"])
    placed = stage(
        ordered.select(
            "split", BUCKET, "doc_id", "n_tokens", (F.col("before") + F.col("n_tokens")).alias("through")
        ),
        "running-tokens",
    )
    maps = stage(placed.groupBy("split", BUCKET).applyInPandas(_closes(size), MAP), "shard-maps")
    states = _starts(maps, len(order.bounds) - 1, size).withColumnRenamed("node", BUCKET)
    return (
        placed.join(stage(states, "shard-starts"), ["split", BUCKET])
        .groupBy("split", BUCKET)
        .applyInPandas(
            _place(size), "split string, doc_id long, shard long, start long, n_tokens long"
        )
    )


def token_shard_ranges(packed: DataFrame) -> Ranges:
    """The packed shards as ``doc_id`` ranges per split, for placing the documents' ids."""
    starts = packed.groupBy("split", "shard").agg(F.min("doc_id").alias("first_key"))
    buckets = Buckets.of(packed, F.col("doc_id"))
    return Ranges("doc_id", "shard", buckets, stage(starts, "token-shards"), ("split",))


def shard_members(encoded: DataFrame, packed: DataFrame) -> DataFrame:
    """Encoded documents with ``shard`` and ``opens``, whether they are their shard's first.

    Ids are not moved: the shards' first keys are looked up per document.
    """
    placed = token_shard_ranges(packed).assign(encoded, first_key=True)
    return placed.withColumn("opens", F.col("doc_id") == F.col("first_key")).drop("first_key")


def shard_stream(encoded: DataFrame, packed: DataFrame) -> DataFrame:
    """Encoded documents with ``shard`` and ``start``.

    Ids are shuffled once, by shard, and what follows per shard or block stays in place. A
    window holds one shard, whose size packing bounds.
    """
    inside = (
        Window.partitionBy("split", "shard")
        .orderBy("doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return token_shard_ranges(packed).assign(encoded).withColumn("start", before)


def cap_tokens(docs: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """Documents up to the one that reaches ``most`` tokens, and whether the cap was hit."""
    if not most:
        return docs, False
    narrow = docs.select("doc_id", "n_tokens")
    last = cutoff(narrow, ["doc_id"], Buckets.of(narrow, F.col("doc_id")), F.col("n_tokens"), most)
    return docs.filter(up_to(["doc_id"], last)), last is not None


# Fixed values of the token file layout.
HEADER_BYTES = 256 * 4
TOKEN_BYTES = 2


def token_manifest(packed: DataFrame, files: DataFrame | None = None, capped: DataFrame | None = None) -> DataFrame:
    """Documents and tokens per token shard.

    With ``files``, the manifest that writing has left, each with its ``file_bytes`` and ``md5``;
    with ``capped`` (``split, capped``) whether the shard's split ended at a token cap.
    """
    manifest = packed.groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")
    )
    if files is not None:
        written = files.select("split", "shard", F.col("bytes").alias("file_bytes"), "md5")
        manifest = manifest.join(written, ["split", "shard"], "left")
    return manifest if capped is None else manifest.join(capped, "split", "left")


def split_totals(manifest: DataFrame) -> DataFrame:
    """Shards, documents and tokens per split."""
    return manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("docs").alias("docs"),
        F.sum("tokens").alias("tokens"),
    )


def _described(findings: DataFrame) -> DataFrame:
    """Findings as lines of text: ``train_00003: size 120``."""
    name = F.concat("split", F.lit("_"), F.lpad(F.col("shard").cast("string"), 5, "0"))
    line = F.concat(name, F.lit(": "), "rule", F.lit(" "), F.coalesce("detail", F.lit("null")))
    return findings.select("level", line.alias("line"))


def dataset_meta(manifest: DataFrame, vocab_size: int, findings: DataFrame | None = None) -> DataFrame:
    """One nested row: settings, both splits with their shards, the grand total, and the
    ``findings`` of the checks as ``errors`` and ``warnings``.

    Shards and findings go through one aggregation; the row lists each of them, as the report
    is meant to.
    """
    columns = [c for c in ("shard", "docs", "tokens", "file_bytes", "md5", "capped") if c in manifest.columns]
    shard = F.struct(*columns)
    rows = manifest.withColumns({"level": F.lit(None).cast("string"), "line": F.lit(None).cast("string")})
    if findings is not None:
        rows = rows.unionByName(_described(findings), allowMissingColumns=True)

    def part(split: str):
        here = F.col("split") == split
        return F.struct(
            F.coalesce(F.sum(F.when(here, F.col("tokens"))), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum(F.when(here, F.col("docs"))), F.lit(0)).alias("total_docs"),
            F.count_if(here).alias("n_shards"),
            F.array_sort(F.collect_list(F.when(here, shard))).alias("shards"),
        ).alias(split)

    def lines(level: str):
        return F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("line"))))

    return rows.agg(
        part("train"),
        part("val"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        lines("error").alias("errors"),
        lines("warning").alias("warnings"),
    ).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.lit(vocab_size).alias("vocab_size"),
        F.lit(vocab_size - 1).alias("eot_token"),
        F.lit("uint16").alias("dtype"),
        F.lit(HEADER_BYTES // 4).alias("header_ints"),
        "train",
        "val",
        "total_tokens",
        "errors",
        "warnings",
    )


def size_report(manifest: DataFrame) -> DataFrame:
    """Bytes of each split's files, with and without headers, in both kinds of megabyte."""
    plain = F.col("tokens") * TOKEN_BYTES
    return split_totals(manifest).select(
        "split",
        "tokens",
        "shards",
        plain.alias("token_bytes"),
        (plain + F.col("shards") * HEADER_BYTES).alias("file_bytes"),
        (plain / 1e6).alias("mb"),
        (plain / float(1024 * 1024)).alias("mib"),
    )
