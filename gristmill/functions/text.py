"""Text expressions with Python's idea of white space, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points at which str.split() and str.strip() cut.
WHITESPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS_PER_TOKEN = 0.74


def words(text: Column) -> Column:
    """White-space separated words. Splitting is ~6x faster than matching the negated class."""
    return F.array_remove(F.split(text, f"[{WHITESPACE}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def token_estimate(word_total: Column, words_per_token: float = WORDS_PER_TOKEN) -> Column:
    """Estimated tokens of an exact word count; sums divide once, at the end."""
    return word_total / F.lit(words_per_token)


def char_count(text: Column) -> Column:
    """Code points; an absent text counts as empty."""
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def seeded_hash(seed: int, key: Column) -> Column:
    """Hex digest that orders rows randomly but alike on every cluster layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(digest: Column, digits: int = 8) -> Column:
    """Leading hex digits as a number, growing with the digest's own order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
