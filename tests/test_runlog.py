"""Training-log analysis against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gristmill.functions import runlog as rates
from gristmill.operators import ngram
from gristmill.operators import runlog as log_ops

START = datetime(2024, 1, 1)


def log(spark, runs):
    rows = [
        (run, step, START + timedelta(seconds=2 * step + step % 3), float(loss))
        for run, losses in runs.items()
        for step, loss in enumerate(losses)
    ]
    return spark.createDataFrame(rows, "run long, step long, ts timestamp, loss double")


def values(df, column):
    return {(r.run, r.step): r[column] for r in df.collect()}


def smoothed(losses, decay):
    state, out = 0.0, []
    for x in losses:
        state = decay * state + (1 - decay) * x if state else x
        out.append(state)
    return out


def test_smoothing_fixture(spark):
    found = values(log_ops.smooth_loss(log(spark, {1: [4, 2, 0]})), "loss_smooth")
    assert [found[1, i] for i in range(3)] == pytest.approx([4, 3.9, 3.705])


def smooth_runs():
    draw = random.Random(1)
    return {
        1: [draw.uniform(0, 9) for _ in range(2500)],
        2: [0, 0, 0, 5, 0, 0, 1],
        3: [0, 0],
        4: [3] + [0] * 1200 + [2],
        5: [draw.choice([0, 0, 0, 2.5]) for _ in range(900)],
        6: [7, 1e-300] + [0] * 300 + [4] + [0] * 330 + [1, 0, 0] + [0] * 1100 + [9, 8],
        7: [1] + [0] * 1074 + [3] + [0] * 1075 + [3, 2] + [0] * 1073 + [5],
    }


@pytest.mark.parametrize("decay", [0.1, 0.5, 0.51, 0.95])
@pytest.mark.parametrize("chunk", [50, 700])
def test_smoothing_over_many_chunks(spark, decay, chunk):
    runs = smooth_runs()
    found = values(log_ops.smooth_loss(log(spark, runs), decay, chunk), "loss_smooth")
    for run, losses in runs.items():
        expected = smoothed(losses, decay)
        assert [found[run, i] for i in range(len(losses))] == pytest.approx(expected, rel=1e-9, abs=1e-200)


@pytest.mark.parametrize("decay", [0.1, 0.3, 0.5, 0.9])
def test_maps_of_chunks_give_the_averages_of_the_fold(decay):
    """Any cut into chunks, without Spark: each chunk begins with the fold's own average."""
    for losses in smooth_runs().values():
        states = [0.0, *smoothed(losses, decay)]
        for size in (1, 2, 7, 333, 1100):
            maps = [log_ops._chunk_map(losses[k : k + size], decay) for k in range(0, len(losses), size)]
            found = log_ops._states_before(maps, decay)
            expected = states[: len(losses) : size]
            assert found == pytest.approx(expected, rel=1e-9, abs=1e-200)
            assert [x == 0 for x in found] == [x == 0 for x in expected]


def test_smoothing_leaves_nulls_out_and_keeps_columns(spark):
    rows = [(1, 0, 4.0, "a"), (1, 1, None, "b"), (1, 2, 2.0, None)]
    found = log_ops.smooth_loss(spark.createDataFrame(rows, "run long, step long, loss double, chunk string"), 0.5)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 4.0, "a", 4.0), (1, 1, None, "b", 4.0), (1, 2, 2.0, None, 3.0)]
    with pytest.raises(ValueError, match="decay"):
        log_ops.smooth_loss(found, 1.0)


@pytest.mark.parametrize("chunk", [3, 7, 10_000])
def test_step_times_and_rolling_mean(spark, chunk):
    table = log(spark, {1: range(40), 2: range(5)})
    timed = log_ops.step_times(table, chunk)
    rolled = log_ops.rolling_step_time(table, 6, chunk)
    times = values(timed, "step_us")
    means = values(rolled, "mean_step_s")
    for run, n in ((1, 40), (2, 5)):
        at = [2 * s + s % 3 for s in range(n)]
        spent = [None] + [at[i] - at[i - 1] for i in range(1, n)]
        assert [times[run, i] for i in range(n)] == [None if s is None else s * 1e6 for s in spent]
        for i in range(n):
            last = [s for s in spent[max(0, i - 5) : i + 1] if s is not None]
            assert means[run, i] == (sum(last) / len(last) if last else None)
    assert rolled.count() == 45


def test_best_so_far(spark):
    found = log_ops.best_so_far(log(spark, {1: [3, 2, 2, 1], 2: [5, 6]}))
    improved = values(found, "improved")
    assert [improved[1, i] for i in range(4)] == [True, True, False, True]
    best = values(found, "best")
    assert [best[1, i] for i in range(4)] + [best[2, 1]] == [3, 2, 2, 1, 5]


def test_best_checkpoint_takes_the_first(spark):
    row = log_ops.best_checkpoint(log(spark, {1: [3, 1, 2, 1]})).first()
    assert (row.step, row.loss) == (1, 1.0)


def test_retention(spark):
    saved = spark.createDataFrame([(1, s) for s in range(0, 3001, 500)], "run long, step long")
    found = log_ops.retain_last(saved).collect()
    assert sorted(r.step for r in found if r.kept) == [1000, 1500, 2000, 2500, 3000]
    assert [r.step for r in found if r.latest] == [3000]


def test_steps_of_a_hot_run(spark):
    rows = [(i, START + timedelta(seconds=i % 50), 1 if i % 3 else i % 5) for i in range(900)]
    events = spark.createDataFrame(rows, "id long, ts timestamp, run long")
    found = log_ops.number_steps(events, "run", "ts", "id").collect()
    for run in {r[2] for r in rows}:
        ordered = sorted((ts, i) for i, ts, r in rows if r == run)
        expected = {i: at for at, (_, i) in enumerate(ordered)}
        assert {r.id: r.step for r in found if r.run == run} == expected


def test_schedules(spark):
    def at(rate, *steps):
        rows = spark.createDataFrame([(s,) for s in steps], "step long").orderBy("step")
        return [r[0] for r in rows.select(rate(F.col("step"))).collect()]

    assert at(rates.pretrain_rate, 0, 612, 613, 6131, 9999) == pytest.approx(
        [3e-4 / 613, 3e-4, 3e-4, 3e-5, 3e-5]
    )
    assert at(rates.tuning_rate, 0, 300, 25_000, 25_001) == pytest.approx([0, 2e-5, 2e-6, 2e-6])


def test_perplexity_clamp(spark):
    df = spark.createDataFrame([(3.04,), (25.0,)], "loss double")
    found = sorted(r[0] for r in df.select(rates.perplexity(F.col("loss"))).collect())
    assert found == pytest.approx([math.exp(3.04), math.exp(20)])


def test_warmup_counts_from_the_first_logged_step(spark):
    found = log_ops.warmup_flag(log(spark, {1: range(9)}).filter("step >= 4")).collect()
    assert sorted(r.step for r in found if r.warming_up) == [4, 5, 6]


def test_phase_share(spark):
    rows = [(1, 0, "data", 1.0), (1, 0, "forward", 3.0), (1, 0, "backward", 6.0)]
    phases = spark.createDataFrame(rows, "run long, step long, phase string, seconds double")
    row = log_ops.phase_share(phases, ["data", "forward", "backward"]).first()
    assert tuple(row)[2:] == pytest.approx((10.0, 30.0, 60.0))


def test_phase_share_of_no_time(spark):
    """As the SQL has it: 0 / 0 is NaN, a part of nothing is infinite, null seconds stay null."""
    rows = [(1, 0, "data", 0.0), (2, 0, "data", 2.0), (2, 0, "forward", -2.0), (3, 0, "data", None), (4, 0, "data", 2.0)]
    phases = spark.createDataFrame(rows, "run long, step long, phase string, seconds double")
    found = {r.run: tuple(r)[2:] for r in log_ops.phase_share(phases, ["data", "forward"]).collect()}
    assert all(math.isnan(share) for share in found.pop(1))
    assert found == {2: (math.inf, -math.inf), 3: (None, None), 4: (100.0, 0.0)}


def test_top_k_keeps_ties(spark):
    rows = [(1, i, s) for i, s in enumerate([5.0, 4.0, 4.0, 3.0])]
    scores = spark.createDataFrame(rows, "context long, next long, score double")
    assert sorted(r.next for r in ngram.top_k_next(scores, 2).collect()) == [0, 1, 2]
    weighted = ngram.softmax_group(scores, 0.5).collect()
    raised = [math.exp(s / 0.5) for s in (5.0, 4.0, 4.0, 3.0)]
    assert {r.next: r.p for r in weighted} == pytest.approx(
        {i: e / sum(raised) for i, e in enumerate(raised)}
    )


def test_penalty_ignores_the_sign(spark):
    rows = [(1, 2.0, [1, 2, 1]), (2, -2.0, [1, 2]), (3, 2.0, [1, 2])]
    scores = spark.createDataFrame(rows, "next int, score double, recent array<int>")
    found = {r.next: r.score for r in ngram.repetition_penalty(scores).collect()}
    assert found == pytest.approx({1: 2 / 1.15, 2: -2 / 1.15, 3: 2.0})


def test_draws_follow_the_weights(spark):
    rows = [(c, n, p) for c in range(4000) for n, p in ((7, 0.25), (8, 0.75))]
    weighted = spark.createDataFrame(rows, "context long, next long, p double")
    drawn = ngram.weighted_draw(weighted).collect()
    assert len(drawn) == 4000
    assert sum(r.next == 8 for r in drawn) / 4000 == pytest.approx(0.75, abs=0.03)


def test_loss_leaves_ignored_targets_out(spark):
    pairs = spark.createDataFrame(
        [("train", 0, 1, 2), ("train", 0, 1, 2), ("train", 0, 1, 3), ("val", 1, 1, 2), ("val", 1, 1, -1)],
        "split string, doc_id long, token int, next int",
    )
    counts = ngram.pair_counts(pairs)
    bigrams = ngram.bigram_counts(counts)
    found = {r["split"]: (r.targets, r.loss) for r in ngram.bigram_loss(counts, bigrams, 10).collect()}
    assert found["val"] == (1, pytest.approx(-math.log(3 / 13)))
    assert found["train"] == (3, pytest.approx(-(2 * math.log(3 / 13) + math.log(2 / 13)) / 3))
