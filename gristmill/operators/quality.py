"""Checks of token shards. Each returns rows ``(split, shard, level, rule, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the token file header.
MAGIC = 20240520
VERSION = 1
HEADER_INTS = 256
TOKEN_BYTES = 2
COUNT_TOLERANCE = 100


def _finding(shards: DataFrame, bad: Column, level: str, rule: str, detail: Column) -> DataFrame:
    return shards.filter(bad).select(
        "split",
        "shard",
        F.lit(level).alias("level"),
        F.lit(rule).alias("rule"),
        detail.cast("string").alias("detail"),
    )


def check_missing(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Error: a shard of the manifest has no file."""
    absent = manifest.join(listing.select("split", "shard"), ["split", "shard"], "left_anti")
    return _finding(absent, F.lit(True), "error", "missing", F.col("tokens"))


def check_header(headers: DataFrame, vocab_size: int) -> DataFrame:
    """Error: wrong or absent magic number. Warning: other vocabulary size, behind a right magic."""
    wrong = ~F.col("magic").eqNullSafe(F.lit(MAGIC))
    other = ~wrong & (F.col("vocab_size") != vocab_size)
    return _finding(headers, wrong, "error", "magic", F.col("magic")).unionByName(
        _finding(headers, other, "warning", "vocab", F.col("vocab_size"))
    )


def check_count(counted: DataFrame, expected: DataFrame) -> DataFrame:
    """Warning: token count more than 100 off the expected one."""
    both = counted.select("split", "shard", "tokens").join(
        expected.select("split", "shard", F.col("tokens").alias("expected")), ["split", "shard"]
    )
    off = F.abs(F.col("tokens") - F.col("expected"))
    return _finding(both, off > COUNT_TOLERANCE, "warning", "count", F.col("tokens"))


def check_size(headers: DataFrame) -> DataFrame:
    """Error: payload is not two bytes per token of the header, or the header has no count."""
    odd = ~F.col("payload_bytes").eqNullSafe(F.col("tokens") * TOKEN_BYTES)
    return _finding(headers, odd, "error", "size", F.col("payload_bytes"))


def shard_facts(stream: DataFrame) -> DataFrame:
    """Largest and first id of each shard; every id is looked at."""
    return stream.groupBy("split", "shard").agg(
        F.max(F.array_max("tokens")).alias("max_token"),
        F.min_by(F.get("tokens", F.lit(0)), "start").alias("first_token"),
        F.sum("n_tokens").alias("tokens"),
    )


def check_range(facts: DataFrame, vocab_size: int) -> DataFrame:
    """Error: an id outside the vocabulary."""
    return _finding(
        facts, F.col("max_token") >= vocab_size, "error", "range", F.col("max_token")
    )


def check_start(facts: DataFrame, eot: int) -> DataFrame:
    """Warning: a shard begins with end-of-text."""
    return _finding(
        facts, F.col("first_token") == eot, "warning", "start", F.col("first_token")
    )


def all_findings(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def findings(
    manifest: DataFrame, headers: DataFrame, facts: DataFrame, vocab_size: int, eot: int
) -> list[DataFrame]:
    """All checks in order. A wrong header or size ends the checks of its file: the rest of it
    means nothing, so a faulty file has one error."""
    shard = ["split", "shard"]
    header = check_header(headers, vocab_size)
    unread = header.filter("level = 'error'").select(*shard)
    sized = headers.join(unread, shard, "left_anti")
    size = check_size(sized)
    broken = unread.unionByName(size.select(*shard))
    sound, ids = headers.join(broken, shard, "left_anti"), facts.join(broken, shard, "left_anti")
    return [
        check_missing(manifest, headers),
        header,
        size,
        check_count(sound, manifest),
        check_range(ids, vocab_size),
        check_start(ids, eot),
    ]


def validation_report(findings: list[DataFrame]) -> DataFrame:
    """One row: errors, warnings, and whether the data passed."""
    return (
        all_findings(findings)
        .agg(
            F.count_if(F.col("level") == "error").alias("errors"),
            F.count_if(F.col("level") == "warning").alias("warnings"),
        )
        .withColumn("passed", F.col("errors") == 0)
    )
