"""Bigram scores and penalised candidates against plain versions."""

import math
import random

import pytest

from gristmill.operators import ngram, runlog
from gristmill.session import new_folder, release, stage


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(6)
    return {(a, b): rng.randrange(1, 40) for a in range(4) for b in rng.sample(range(60), 40)}


def test_a_penalised_candidate_drops_out_and_another_moves_in(spark, counts):
    rng = random.Random(9)
    prompts = [(d, 0 if d % 10 else rng.randrange(4), rng.sample(range(60), 5)) for d in range(60)]
    scores = ngram.candidate_scores(
        spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "token int, next int, n long")
    )
    frame = spark.createDataFrame(prompts, "doc_id long, context int, recent array<int>")
    found = {}
    for r in ngram.penalised_top_k(frame, scores, k=8, penalty=1.5, most_recent=5).collect():
        found.setdefault(r.doc_id, {})[r.next] = round(r.score, 9)
    changed = 0
    for doc, context, recent in prompts:
        raw = {b: math.log(n) for (a, b), n in counts.items() if a == context}
        lowered = {b: s / 1.5 if b in recent else s for b, s in raw.items()}
        border = sorted(lowered.values(), reverse=True)[7]
        assert found[doc] == {b: round(s, 9) for b, s in lowered.items() if s >= border}
        before = sorted(raw.values(), reverse=True)[7]
        changed += set(found[doc]) != {b for b, s in raw.items() if s >= before}
    assert changed > 0


@pytest.mark.parametrize("head", [1, 20, 1000])
def test_document_loss_does_not_depend_on_the_broadcast_head(spark, counts, head):
    rng = random.Random(3)
    pairs = [(d, rng.randrange(5), rng.randrange(-1, 62)) for d in range(12) for _ in range(80)]
    bigrams = spark.createDataFrame([(a, b, n) for (a, b), n in counts.items()], "token int, next int, n long")
    frame = spark.createDataFrame(pairs, "doc_id long, token int, next int")
    found = {r.doc_id: r for r in ngram.document_perplexity(frame, bigrams, 70, head).collect()}
    total = {a: sum(n for (t, _), n in counts.items() if t == a) for a in range(5)}
    for doc in range(12):
        losses = [-math.log((counts.get((a, b), 0) + 1) / (total[a] + 70)) for d, a, b in pairs if d == doc and b != -1]
        assert found[doc].targets == len(losses)
        assert found[doc].loss == pytest.approx(sum(losses) / len(losses))


def test_drawn_ids_are_as_frequent_as_their_softmax(spark):
    scores = {7: 3.0, 8: 2.5, 9: 2.0, 10: 1.0, 11: 0.2}
    frame = spark.createDataFrame([(1, i, s) for i, s in scores.items()], "context int, next int, score double")
    prompts = spark.createDataFrame([(d, 1, [7, 3]) for d in range(6000)], "doc_id long, context int, recent array<int>")
    drawn = [r.next for r in ngram.sample_next(prompts, frame, k=4, penalty=1.5, temperature=0.9).collect()]
    raised = {i: math.exp((s / 1.5 if i == 7 else s) / 0.9) for i, s in scores.items() if i != 11}
    for i, weight in raised.items():
        p = weight / sum(raised.values())
        assert abs(drawn.count(i) / 6000 - p) < 4 * math.sqrt(p * (1 - p) / 6000)
    assert len(drawn) == 6000 and set(drawn) == set(raised)
    again = [r.next for r in ngram.sample_next(prompts.repartition(3), frame, k=4, penalty=1.5, temperature=0.9).collect()]
    assert sorted(again) == sorted(drawn)


def test_phase_shares_add_up(spark):
    rows = [(1, 0, p, float(i + 1)) for i, p in enumerate(["a", "b", "c", "b"])]
    frame = spark.createDataFrame(rows, "run int, step int, phase string, seconds double")
    row = runlog.phase_share(frame, ["a", "b", "c"]).first()
    assert row.a_percent + row.b_percent + row.c_percent == pytest.approx(100)


def test_released_folders_are_gone(spark):
    release(spark)
    staged = stage(spark.range(3).toDF("x"), "kept-for-a-while")
    new_folder(spark, "never-written")
    assert staged.count() == 3
    assert release(spark) == 1
    assert release(spark) == 0
