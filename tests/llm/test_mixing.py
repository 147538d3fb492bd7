"""Targets and the mix against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from gristmill.llm import mixing


def plain_targets(sizes):
    """Shares by weight; what passes three times a source's size goes round again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = [(i, s, size(t)) for i, t, s in rows]
    by_source = defaultdict(int)
    for _, s, n in docs:
        by_source[s] += n
    target = plain_targets(by_source)
    turn = {s: k for k, s in enumerate(sorted(by_source, key=lambda s: (s is None, (s or "").encode())))}
    key = lambda i, n: hashlib.md5(f"42:{'null' if i is None else i}:{n}".encode()).hexdigest()
    passes = []
    for s in by_source:
        cum = 0
        for i, _, n in sorted((d for d in docs if d[1] == s), key=lambda d: key(d[0], d[2])):
            cum += n
            for epoch in range(3) if target[s] > 0 else ():
                passes.append(((epoch * by_source[s] + cum) / target[s], turn[s], epoch, key(i, n), (i, s, n)))
    taken, budget = Counter(), sum(by_source.values())
    for *_, doc in sorted(passes, key=lambda p: p[:4]):
        if doc[2] > budget:
            break
        budget -= doc[2]
        taken[doc] += doc[2]
    return target, Counter((i, n, by_source[s], round(target[s], 4), 0) for i, s, n in docs), taken


def rows_of(plan):
    return plan.select("doc_id", "source", "size", "copies", "target", "source_size").collect()


def check(spark, documents, rows, **options):
    docs = documents([(i, t, None, s) for i, t, s in rows], clash=("turn", "row", "key", "v", "rank", "copies"))
    plan = rows_of(mixing.mix(docs, **options))
    target, _, taken = plain_mix(rows)
    assert len(plan) == len(rows)
    got = Counter()
    for r in plan:
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        got[r.doc_id, r.source, r.size] += r.size * r.copies
    assert +got == +taken
    total = sum(r.size for r in plan)
    assert sum(got.values()) <= total
    return plan


def corpus(n):
    sources = ["b", "a", "zz", "é", "Z", None, "hot"]
    return [(i, "word " * (1 + i * 7 % 23), "hot" if i % 3 == 0 else sources[i % 7]) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [7, 100_000])
def test_equals_a_plain_queue(spark, documents, bucket_rows):
    plan = check(spark, documents, corpus(300), bucket_rows=bucket_rows)
    by_source = defaultdict(int)
    for r in plan:
        by_source[r.source] += r.size * r.copies
    for r in plan:
        assert abs(by_source[r.source] - r.target) <= 23


def test_capped_sources_are_passed_three_times(spark, documents):
    rows = [(1, "a b c", "a"), (2, "a", "a")] + [(10 + i, "w " * 10, "b") for i in range(30)] + [(99, "x y", "c")]
    plan = {r.doc_id: r.copies for r in check(spark, documents, rows)}
    assert plan[1] == plan[2] == plan[99] == 3


def test_nulls_blank_repeated_and_long_rows(spark, documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (None, "p q", None), (None, None, None)]
    rows += [(4, "same text here", "a")] * 3 + [(5, "long " * 50_000, "b"), (6, "b", "b")]
    check(spark, documents, rows)


def test_all_blank_and_empty_tables(spark, documents):
    blank = rows_of(mixing.mix(documents([(1, None, None, "a"), (2, "", None, "b")])))
    assert [(r.size, r.target) for r in blank] == [(0, 0.0), (0, 0.0)]
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mixed_documents(documents([])).count() == 0


def test_the_mix_repeats_whole_rows(spark, documents):
    docs = documents([(i, t, "en", s) for i, t, s in corpus(120)], clash=("copies", "size"))
    plan = {r.doc_id: r.copies for r in rows_of(mixing.mix(docs))}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(plan)


def test_reruns_agree(spark, documents):
    docs = documents([(i, t, None, s) for i, t, s in corpus(200)])
    first = sorted(map(str, rows_of(mixing.mix(docs))))
    assert first == sorted(map(str, rows_of(mixing.mix(docs.repartition(5)))))


@pytest.mark.parametrize("same", [False, True])
def test_rows_without_an_id_and_repeated_rows_come_out_as_planned(spark, documents, same):
    rows = [(None, "one of equal size " * 2 + ("x" if same else f"x{i}"), None, "a") for i in range(30)]
    rows += [(i, "b c d " * 3, None, "b") for i in range(40)]
    docs = documents(rows, clash=("mark", "_share", "n"))
    planned = sum(r.size * r.copies for r in rows_of(mixing.mix(docs)) if r.source == "a")
    mixed = [r for r in mixing.mixed_documents(docs).collect() if r.source == "a"]
    assert sum(len(r.text.split()) for r in mixed) == planned > 0


def test_a_row_taken_very_often(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "AT_ONCE", 7)
    docs = documents([(1, "a b c", None, "a")] * 50 + [(2, "d e", None, "b")] * 50)
    planned = Counter()
    for r in rows_of(mixing.mix(docs)):
        planned[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mixed_documents(docs).collect()) == planned
