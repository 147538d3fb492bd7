"""Contamination against a comparison of every place with every item."""

import random
import re

import pytest

from gristmill.llm import decontaminate


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, window=16, similarity=0.8):
    found = {}
    by_tokens = {}
    for i, t in items:
        by_tokens.setdefault(tuple(tokens(t)), []).append(i)
    for d, text in docs:
        t = tokens(text)
        for b, ids in by_tokens.items():
            if len(b) < 6:
                continue
            for start in range(-len(b) + 1, len(t)):
                same = [0 <= start + k < len(t) and t[start + k] == b[k] for k in range(len(b))]
                seeds = any(
                    start + k >= 0 and start + k + len(m) <= len(t) and k + len(m) <= len(b)
                    and all(same[k + j] for j, bit in enumerate(m) if bit == "1")
                    for m in decontaminate.MASKS for k in range(len(b))
                )
                if not seeds:
                    continue
                size = min(len(b), window)
                best = max(sum(same[k : k + size]) for k in range(len(b) - size + 1))
                if best >= similarity * size - 1e-9:
                    key = (d, min(ids))
                    found[key] = max(found.get(key, (0, 0)), (best, -start))
    return {(d, i, -early, best) for (d, i), (best, early) in found.items()}


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(4)
    words = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([5, 6, 7, 8, 12, 16, 20, 30, 45])]
    rows += [(20, rows[6][1].upper() + "!"), (21, None), (22, ""), (23, "two words")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def contaminated(df):
    return {(r.doc_id, r.item_id, r.start, r.matched) for r in df.collect()}


def test_equals_brute_force(spark, documents, benchmark):
    rng = random.Random(8)
    rows = []
    for n in range(80):
        words = [f"b{rng.randrange(60)}" if rng.random() < 0.3 else f"d{rng.randrange(500)}" for _ in range(40)]
        if n % 2:
            item = tokens(rng.choice(benchmark[:9])[1])
            low = rng.randrange(max(1, len(item) // 2))
            piece = [w if rng.random() > 0.15 else "other" for w in item[low:]]
            at = rng.randrange(len(words))
            words[at:at] = piece
        rows.append((n, " ".join(words)))
    rows += [(100, None), (101, ""), (102, benchmark[1][1]), (102, benchmark[1][1]), (None, benchmark[6][1])]
    docs = documents(rows, clash=("t", "b", "seed", "item_id", "start", "matched"))
    expected = brute(rows, benchmark)
    assert contaminated(decontaminate.find_contamination(docs, table(spark, benchmark))) == expected
    blocks = decontaminate.find_contamination(docs, table(spark, benchmark), block_tokens=40)
    assert contaminated(blocks) == expected
    assert len(expected) > 10


def test_substituted_words_are_tolerated(spark, documents):
    words = [f"q{i}" for i in range(40)]
    changed = [w if i % 6 else "changed" for i, w in enumerate(words)]
    half = [w if i % 2 else "changed" for i, w in enumerate(words)]
    docs = documents([(1, "x " * 30 + " ".join(changed) + " y" * 9), (2, " ".join(half)), (3, "clean text of other words")])
    kept = decontaminate.decontaminate(docs, table(spark, [(1, " ".join(words))]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert kept.columns == docs.columns


def test_long_text_and_empty_tables(spark, documents, benchmark):
    long = " ".join(f"z{i}" for i in range(60_000)) + " " + benchmark[8][1]
    found = decontaminate.find_contamination(documents([(1, long)]), table(spark, benchmark)).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in found] == [(1, 8, 60_000)]
    assert decontaminate.find_contamination(documents([]), table(spark, benchmark)).count() == 0
    docs = documents([(1, "some text that stays here as it is")])
    assert decontaminate.decontaminate(docs, table(spark, [])).count() == 1


def test_only_the_contaminated_text_of_an_id_goes(spark, documents, benchmark):
    leak = "before " + benchmark[8][1] + " after"
    rows = [(None, leak), (None, "clean and without id"), (None, None), (5, leak), (5, "clean under the same id"), (6, leak)]
    kept = decontaminate.decontaminate(documents(rows, clash=("mark", "t")), table(spark, benchmark))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, rows[1][1]), (None, None), (5, rows[4][1])}


def test_words_repeated_very_often(spark, documents):
    rows = [(1, "a " * 300), (2, "a " * 20 + "b " * 40 + "a " * 20), (3, "a b " * 60), (4, "c " * 300)]
    items = [(1, "a " * 30), (2, "a b " * 12), (3, "b " * 6 + "a " * 14)]
    found = decontaminate.find_contamination(documents(rows), table(spark, items))
    assert contaminated(found) == brute(rows, items)
    large = [(1, "a " * 4_000), (2, "clean words of no item at all, many of them")]
    kept = decontaminate.decontaminate(documents(large), table(spark, [(1, "a " * 50)]))
    assert [r.doc_id for r in kept.collect()] == [2]
