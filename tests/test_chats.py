"""Chat rules on hand-made turns."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import chats

LONG = "a reply of more than thirty characters"


def turns(spark, *talks):
    rows = [
        (conv, turn, role, value)
        for conv, talk in enumerate(talks)
        for turn, (role, value) in enumerate(talk)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def rendered(spark, *talks):
    return {r.conv_id: r.text for r in chats.render_chat(turns(spark, *talks)).collect()}


def test_roles(spark):
    talk = [(r, LONG) for r in ("human", "user", "gpt", "assistant", " user ", "User", "system", None)]
    found = chats.normalize_roles(turns(spark, talk)).orderBy("turn").collect()
    assert [r.speaker for r in found] == ["Human", "Human", "Assistant", "Assistant", "Human"]


def test_format(spark):
    assert rendered(spark, [("human", " q\n"), ("gpt", LONG)]) == {
        0: f"### Human: q\n### Assistant: {LONG}<|endoftext|>\n"
    }


def test_short_reply_rejects_the_chat(spark):
    found = rendered(
        spark,
        [("user", "q"), ("gpt", "x" * 29)],
        [("user", "q"), ("gpt", "x" * 30)],
        [("user", "q"), ("gpt", "  "), ("gpt", LONG)],
        [("user", "q"), ("gpt", LONG), ("gpt", "short")],
    )
    assert set(found) == {1, 2}


def test_too_few_turns(spark):
    found = rendered(
        spark,
        [("user", "q")],
        [("system", "s"), ("user", "q")],
        [("user", "q"), ("user", "r")],
        [("user", "q"), ("user", "")],
    )
    assert set(found) == {2}


def test_counts_and_cap(spark):
    talks = [[("user", "q"), ("gpt", LONG if i % 3 else "short")] for i in range(12)]
    table = turns(spark, *talks)
    assert tuple(chats.format_counts(table).first()) == (8, 4)
    verdicts = chats.cap_samples(table, 3).collect()
    assert {r.conv_id: r.kept for r in verdicts} == {
        0: False, 1: True, 2: True, 3: False, 4: True
    }
    assert chats.cap_samples(table, 99).count() == 12


def test_many_turns_stay_in_order(spark):
    talk = [("user" if i % 2 else "gpt", f"{LONG} {i}") for i in range(1000)]
    text = rendered(spark, talk)[0]
    assert [line.rsplit(" ", 1)[1].split("<")[0] for line in text.splitlines()] == [
        str(i) for i in range(1000)
    ]
    grouped = chats.group_turns(turns(spark, talk)).first()
    assert [t.turn for t in grouped.turns] == list(range(1000))


@pytest.mark.parametrize(
    "text, answer",
    [
        ("### Human: q\n### Assistant: a b <|endoftext|>\nmore", "a b"),
        ("### Assistant: old<|endoftext|> ### Assistant: new<|endoftext|>x", "new"),
        ("no mark", "no mark"),
    ],
)
def test_answer(spark, text, answer):
    assert spark.range(1).select(chats.extract_answer(F.lit(text))).first()[0] == answer


def test_prompt_and_question(spark):
    prompt = chats.build_prompt(F.lit("What?"))
    row = spark.range(1).select(prompt.alias("p"), chats.extract_question(prompt).alias("q")).first()
    assert row.p == "### Human: What?\n### Assistant:"
    assert row.q == "What?"
