"""The filter audit against a simulation of every order, document by document."""

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest

from gristmill.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(doc_id, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ""
    found += "A" * (len(words) < 100)
    found += "B" * (100 * len(set(words)) < 80 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    found += "D" * bool(re.search("[#$%&*|]", text))
    smaller = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, *_ in rows)
    return found + "E" * smaller


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = [(lang or "", d, fails(d, text or "", rows)) for d, text, lang, *_ in rows]
    found, shapley = {}, {}
    for part in {p for p, _, _ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [(d, f) for p, d, f in docs if p == part]
            for step, letter in enumerate(order, 1):
                failing = sum(letter in f for p, _, f in docs if p == part)
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                found[part, order, step] = [
                    len(left), len(gone), failing - len(gone),
                    sum(f == letter for p, _, f in docs if p == part),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in found.items()}


def result(docs, labels):
    rows = filter_audit.audit(filter_audit.failures(docs, labels)).collect()
    found = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in rows}
    assert len(found) == len(rows)
    return found


def words(n, more="", distinct=None):
    return " ".join(f"word{i % (distinct or n)}" for i in range(n)) + more


ROWS = [
    (1, words(120), "en"),
    (2, words(120), "en"),  # a copy
    (3, words(120), "de"),  # a copy in another part
    (4, words(99), "en"),
    (5, words(100), "en"),
    (6, words(200, distinct=159), "de"),  # just under 80 percent
    (7, words(200, distinct=160), "de"),
    (8, words(120).upper(), "de"),
    (9, words(120, " # and a symbol"), None),
    (10, None, None),
    (11, "", "fr"),  # a copy of the null text
    (None, words(120), "en"),
    (None, words(120), "en"),
    (2, "another text with the id 2 & a symbol", "en"),
    (1, words(120), "en"),  # repeats the smallest id: no copy of a smaller one
    (12, "\x0b \t", "fr"),
    (13, words(3, "| ") * 5000, "fr"),
    (14, "É" * 50 + "A" * 6, ""),
]
LABEL_ROWS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 0, None), (8, 1, 1), (10, 1, 1), (None, 1, 1), (99, 1, 1)]


def test_simulated_orders(spark, documents):
    docs = documents(ROWS, clash=("part", "failed", "words", "digest", "good", "quality"))
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    expected = brute(ROWS, LABEL_ROWS)
    assert len(expected) == 4 * 120 * 5
    assert result(docs, labels) == expected


def test_empty_tables(spark, documents):
    assert result(documents([]), spark.createDataFrame([], LABELS)) == {}
    rows = [(1, "a", "en")]
    assert result(documents(rows), spark.createDataFrame([], LABELS)) == brute(rows, [])


def test_many_copies_of_one_text(spark, documents):
    rows = [(n, words(120), "en") for n in range(400)] + [(400, words(120, " &"), "en")] * 100
    assert result(documents(rows), spark.createDataFrame([], LABELS)) == brute(rows, [])


@pytest.mark.parametrize("players", [2, 3, 5])
def test_least_squares_gives_shapley_values(players):
    """Against the marginal contributions, for any values of the coalitions."""
    every = 1 << players
    values = [0] + [hash((players, s)) % 1000 for s in range(1, every)]
    weights = filter_audit.shapley_weights(players)
    for i in range(players):
        expected = sum(
            Fraction(factorial(k := s.bit_count()) * factorial(players - k - 1), 1) * (values[s | 1 << i] - values[s])
            for s in range(every)
            if not s >> i & 1
        )
        assert sum(w * v for w, v in zip(weights[i], values, strict=True)) == expected
