"""Multi-turn chats to training text.

Turns stay flat rows as long as possible, so a chat of any length is never one value until
a caller asks for the rendered string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import char_count, strip
from gristmill.operators.ordered import Buckets, cutoff, div, up_to
from gristmill.session import stage

# Speaker names and the text around each turn.
HUMAN_ROLES = ("human", "user")
ASSISTANT_ROLES = ("gpt", "assistant")
HUMAN_MARK = "### Human:"
ASSISTANT_MARK = "### Assistant:"
END_OF_TEXT = "<|endoftext|>"

MIN_REPLY_CHARS = 30
MIN_TURNS = 2
MAX_SAMPLES = 750_000


def group_turns(turns: DataFrame) -> DataFrame:
    """One row per chat with its turns in order, collected in two levels."""
    parts = turns.groupBy("conv_id", div(F.col("turn"), 256).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    return parts.groupBy("conv_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "turns"))), lambda p: p["turns"])
        ).alias("turns")
    )


def clean_turns(turns: DataFrame) -> DataFrame:
    """Add ``speaker`` (null for other roles) and ``value``, the stripped text."""
    role = strip(F.coalesce(F.col("role"), F.lit("")))
    speaker = F.when(role.isin(*HUMAN_ROLES), "Human").when(role.isin(*ASSISTANT_ROLES), "Assistant")
    value = strip(F.coalesce(F.col("text"), F.lit("")))
    return turns.select("conv_id", "turn", speaker.alias("speaker"), value.alias("value"))


def normalize_roles(turns: DataFrame) -> DataFrame:
    """Turns of the two known speakers; other roles are dropped."""
    return clean_turns(turns).filter(F.col("speaker").isNotNull())


def drop_empty_turns(turns: DataFrame) -> DataFrame:
    return clean_turns(turns).filter(F.col("value") != "")


def conversation_flags(turns: DataFrame, min_reply: int = MIN_REPLY_CHARS) -> DataFrame:
    """Per chat: raw turns, rendered parts, and whether a non-empty reply is too short."""
    spoken = F.col("value") != ""
    short = (F.col("speaker") == "Assistant") & spoken & (char_count(F.col("value")) < min_reply)
    return clean_turns(turns).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("raw_turns"),
        F.count_if(spoken & F.col("speaker").isNotNull()).alias("parts"),
        F.coalesce(F.bool_or(short), F.lit(False)).alias("short_reply"),
    )


def reject_short_reply(turns: DataFrame, min_reply: int = MIN_REPLY_CHARS) -> DataFrame:
    """Turns of chats without a short reply."""
    short = conversation_flags(turns, min_reply).filter("short_reply").select("conv_id")
    return turns.join(short, "conv_id", "left_anti")


def min_turns(turns: DataFrame, least: int = MIN_TURNS) -> DataFrame:
    """Turns of chats that are long enough before and after dropping what is not rendered."""
    enough = (
        conversation_flags(turns)
        .filter((F.col("raw_turns") >= least) & (F.col("parts") >= least))
        .select("conv_id")
    )
    return turns.join(enough, "conv_id", "left_semi")


def accept(flags: DataFrame, least: int = MIN_TURNS) -> DataFrame:
    """Add ``kept``: the verdict of all chat rules together."""
    return flags.withColumn(
        "kept",
        (F.col("raw_turns") >= least) & (F.col("parts") >= least) & ~F.col("short_reply"),
    )


def accepted(turns: DataFrame, min_reply: int = MIN_REPLY_CHARS, least: int = MIN_TURNS) -> DataFrame:
    return accept(conversation_flags(turns, min_reply), least).filter("kept").select("conv_id")


def render_turns(
    turns: DataFrame, min_reply: int = MIN_REPLY_CHARS, least: int = MIN_TURNS
) -> DataFrame:
    """Accepted chats as ``(conv_id, turn, part)`` rows of training text."""
    human = F.concat(F.lit(f"{HUMAN_MARK} "), "value", F.lit("\n"))
    assistant = F.concat(F.lit(f"{ASSISTANT_MARK} "), "value", F.lit(f"{END_OF_TEXT}\n"))
    spoken = clean_turns(turns).filter(F.col("speaker").isNotNull() & (F.col("value") != ""))
    return spoken.join(accepted(turns, min_reply, least), "conv_id", "left_semi").select(
        "conv_id",
        "turn",
        F.when(F.col("speaker") == "Human", human).otherwise(assistant).alias("part"),
    )


def render_chat(
    turns: DataFrame, min_reply: int = MIN_REPLY_CHARS, least: int = MIN_TURNS
) -> DataFrame:
    """One training text per accepted chat, concatenated in two levels."""

    def in_order(position: str, text: str):
        rows = F.array_sort(F.collect_list(F.struct(position, text)))
        return F.array_join(F.transform(rows, lambda row: row[text]), "")

    parts = render_turns(turns, min_reply, least)
    stretches = parts.groupBy("conv_id", div(F.col("turn"), 256).alias("stretch")).agg(
        in_order("turn", "part").alias("text")
    )
    return stretches.groupBy("conv_id").agg(in_order("stretch", "text").alias("text"))


def format_counts(
    turns: DataFrame, min_reply: int = MIN_REPLY_CHARS, least: int = MIN_TURNS
) -> DataFrame:
    return accept(conversation_flags(turns, min_reply), least).agg(
        F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped")
    )


def cap_samples(
    turns: DataFrame,
    most: int = MAX_SAMPLES,
    min_reply: int = MIN_REPLY_CHARS,
    least: int = MIN_TURNS,
) -> DataFrame:
    """Verdicts of the chats read until ``most`` are kept; later chats are not read."""
    verdicts = accept(conversation_flags(turns, min_reply), least).select("conv_id", "kept")
    verdicts = stage(verdicts, "verdicts")  # one pass over the texts
    buckets = Buckets.of(verdicts, F.col("conv_id"))
    last = cutoff(verdicts, ["conv_id"], buckets, F.col("kept").cast("long"), most)
    return verdicts.filter(up_to(["conv_id"], last))


def build_prompt(question):
    """The text that asks the model one question (a column expression)."""
    return F.concat(F.lit(f"{HUMAN_MARK} "), question, F.lit(f"\n{ASSISTANT_MARK}"))


def extract_answer(text):
    """After the last assistant mark, before the first end marker, stripped."""
    reply = F.substring_index(text, ASSISTANT_MARK, -1)
    return strip(F.substring_index(reply, END_OF_TEXT, 1))


def extract_question(text):
    """Between the first human mark and the line's end, stripped."""
    after = F.element_at(F.split(text, HUMAN_MARK, 3), 2)
    return strip(F.substring_index(after, "\n", 1))
