"""Analysis of training logs ``(run, step, ts, loss)``.

Runs may be of any length and one run may hold most rows, so nothing windows over a whole
run: running totals go over buckets, and look-backs over chunks that repeat a few rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.runlog import perplexity, utilisation
from gristmill.operators.ordered import Buckets, div, running, with_context
from gristmill.session import stage

LOG_EVERY = 10
LAST_STEPS = 100
KEEP_LAST = 5
WARMUP_STEPS = 3
DECAY = 0.95
CHUNK = 10_000


def number_steps(events: DataFrame, run: str, ts: str, tie: str) -> DataFrame:
    """Add ``step``: from 0, by time within each run."""
    buckets = Buckets.of(events, F.unix_micros(F.col(ts)))
    ranked = running(events, [ts, tie], buckets, group=[run])
    return ranked.withColumn("step", F.col("rank") - 1).drop("rank", "_bucket")


def log_every(log: DataFrame, n: int = LOG_EVERY) -> DataFrame:
    return log.filter(F.col("step") % n == 0)


def _since_previous() -> Column:
    order = Window.partitionBy("run", "_chunk").orderBy("step")
    return F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))


def step_times(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``step_us``: microseconds since the run's previous step, null on its first."""
    cut = with_context(log, "step", 1, chunk).withColumn("step_us", _since_previous())
    return cut.filter(~F.col("_context")).drop("_chunk", "_context")


def step_throughput(log: DataFrame, tokens_per_step: int) -> DataFrame:
    """Add ``step_s`` and ``tokens_per_s``."""
    timed = step_times(log).withColumn("step_s", F.col("step_us") / 1e6)
    return timed.withColumn(
        "tokens_per_s", F.try_divide(F.lit(tokens_per_step), F.col("step_s"))
    )


def rolling_step_time(log: DataFrame, last: int = LAST_STEPS, chunk: int = CHUNK) -> DataFrame:
    """Add ``step_us`` and ``mean_step_s``, the mean of the last ``last`` step times.

    Times are summed as whole numbers. One shuffle serves both: a chunk sees ``last`` steps
    before it, the first of which only times the second.
    """
    recent = Window.partitionBy("run", "_chunk").orderBy("step").rowsBetween(1 - last, 0)
    mean = F.sum("step_us").over(recent) / F.count("step_us").over(recent) / 1e6
    return (
        with_context(log, "step", last, max(chunk, last))
        .withColumn("step_us", _since_previous())
        .withColumn("mean_step_s", mean)
        .filter(~F.col("_context"))
        .drop("_chunk", "_context")
    )


def cumulative_tokens(log: DataFrame, tokens_per_step: int) -> DataFrame:
    """Add ``tokens_total``, counting the steps before a resumed run's first one."""
    return log.withColumn("tokens_total", (F.col("step") + 1) * tokens_per_step)


def fold(losses: Sequence[float], state: float, decay: float) -> list[float]:
    """The average after each loss; a missing one (not a number) changes nothing."""
    states = []
    for loss in losses:
        if loss == loss:
            state = decay * state + (1 - decay) * loss if state else loss
        states.append(state)
    return states


def _faded(state: float, steps: int, decay: float) -> float:
    """The average after ``steps`` losses of zero, which may round it down to zero."""
    if decay <= 0.5:
        while state and steps:
            state, steps = decay * state, steps - 1
        return state
    return max(state * decay**steps, 5e-324) if state else 0.0


def _chunk_map(losses: Sequence[float], decay: float) -> tuple:
    """A chunk as a map from the average before it to the one after it.

    ``(zeros, fresh, scale, offset, losses)``. First come ``zeros`` losses of zero. An average
    that is zero then restarts, and ``fresh`` comes out; another one, s, gives scale * s + offset.
    Where every average drops to zero further on, all come to the same, and the scale is zero.
    Greater averages drop later, so the least and the greatest possible one decide; where
    they differ, the losses themselves are the map.
    """
    known = [loss for loss in losses if loss == loss]
    zeros = next((k for k, loss in enumerate(known) if loss), len(known))
    rest = known[zeros:]
    if not rest:
        return zeros, None, None, None, None
    fresh = fold(rest, 0.0, decay)[-1]
    least = fold(rest[1:], (1 - decay) * rest[0], decay)
    if decay > 0.5 or 0.0 not in least:
        return zeros, fresh, decay ** len(rest), least[-1] if least else (1 - decay) * rest[0], None
    if 0.0 in fold(rest, sys.float_info.max, decay):
        return zeros, fresh, 0.0, fresh, None
    return zeros, None, None, None, rest


def _states_before(chunks: Sequence[tuple], decay: float) -> list[float]:
    """The average with which each chunk of a run begins."""
    state, states = 0.0, []
    for zeros, fresh, scale, offset, losses in chunks:
        states.append(state)
        state = _faded(state, int(zeros), decay)
        if losses is not None and len(losses):
            state = fold(losses, state, decay)[-1]
        elif fresh is not None and fresh == fresh:
            state = scale * state + offset if state else fresh
    return states


def smooth_loss(log: DataFrame, decay: float = DECAY, chunk: int = 10_000) -> DataFrame:
    """Add ``loss_smooth``: ``e = decay * e + (1 - decay) * x``, and x itself where e is zero.

    ``step`` counts 0, 1, 2, ... per run. Any ``decay`` between zero and one: a small one may
    round the average of many losses of zero down to zero, which then restarts. Losses are not
    negative; a null one leaves the average as it is.

    A scan over maps: runs are cut into chunks of steps, each of which is a map from the average
    before it to the one after it, affine but for restarts. A run's maps, a row per chunk, give
    every chunk its first average, and the chunks then go through their steps in parallel. So a
    run of any length is spread over all tasks, and rows are shuffled once.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between zero and one")
    row = F.struct(*[F.col(f"`{name}`") for name in log.columns]).alias("row")
    rows = F.array_sort(F.collect_list(F.struct(F.col("step"), row))).alias("rows")
    chunks = stage(log.groupBy("run", div(F.col("step"), chunk).alias("chunk")).agg(rows), "log-chunks")
    losses = F.transform("rows", lambda r: r["row"]["loss"].cast("double"))

    @F.pandas_udf("zeros long, fresh double, scale double, offset double, losses array<double>")
    def as_map(losses: pd.Series) -> pd.DataFrame:
        maps = [_chunk_map(np.asarray(one, float).tolist(), decay) for one in losses]
        return pd.DataFrame(maps, columns=["zeros", "fresh", "scale", "offset", "losses"])

    def begin(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values("chunk")
        columns = [maps[name] for name in ("zeros", "fresh", "scale", "offset", "losses")]
        states = _states_before(list(zip(*columns, strict=True)), decay)
        return maps[["run", "chunk"]].assign(state=states)

    kind = dict(log.dtypes)["run"]
    maps = chunks.select("run", "chunk", as_map(losses).alias("map")).select("run", "chunk", "map.*")
    begins = maps.groupBy("run").applyInPandas(begin, f"run {kind}, chunk long, state double")

    @F.pandas_udf("array<double>")
    def averages(losses: pd.Series, state: pd.Series) -> pd.Series:
        pairs = zip(losses, state, strict=True)
        return pd.Series([fold(np.asarray(one, float).tolist(), first, decay) for one, first in pairs])

    smoothed = chunks.join(stage(begins, "log-states"), ["run", "chunk"]).select(
        "rows", averages(losses, F.col("state")).alias("smooth")
    )
    paired = F.arrays_zip(F.col("rows.row").alias("row"), F.col("smooth").alias("smooth"))
    return smoothed.select(F.explode(paired).alias("one")).select(
        "one.row.*", F.col("one.smooth").alias("loss_smooth")
    )


def warmup_flag(log: DataFrame, steps: int = WARMUP_STEPS) -> DataFrame:
    """Add ``warming_up`` on the first steps after a run's first logged one."""
    start = log.groupBy("run").agg(F.min("step").alias("_start"))
    return (
        log.join(start, "run")
        .withColumn("warming_up", F.col("step") < F.col("_start") + steps)
        .drop("_start")
    )


def phase_share(phases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Percent of each step's time per phase, from ``(run, step, phase, seconds)``.

    A step whose seconds add up to zero has shares as of floating point: nothing of zero is NaN.
    """
    total = F.sum("seconds")

    def share(name: str) -> Column:
        part = F.coalesce(F.sum(F.when(F.col("phase") == name, F.col("seconds"))), F.lit(0.0))
        return F.when(total == 0, part * float("inf")).otherwise(F.try_divide(part, total)) * 100

    return phases.groupBy("run", "step").agg(*[share(name).alias(f"{name}_percent") for name in names])


def mean_eval_loss(batches: DataFrame) -> DataFrame:
    """Mean batch loss per evaluation step and split."""
    return batches.groupBy("step", "split").agg(
        F.count(F.lit(1)).alias("batches"), F.avg("loss").alias("loss")
    )


def best_so_far(log: DataFrame) -> DataFrame:
    """Add ``best`` (running minimum) and ``improved`` (strictly below all before)."""
    buckets = Buckets.of(log, F.col("step"))
    placed = running(log, ["step"], buckets, {"_best": ("min", "loss")}, ["run"])
    return (
        placed.withColumn("best", F.least("_best", "loss"))
        .withColumn("improved", F.col("_best").isNull() | (F.col("loss") < F.col("_best")))
        .drop("_best", "rank", "_bucket")
    )


def best_checkpoint(log: DataFrame) -> DataFrame:
    """Step of the lowest loss per run, the first one on ties."""
    return (
        log.groupBy("run")
        .agg(F.min(F.struct("loss", "step")).alias("_best"))
        .select("run", F.col("_best.step").alias("step"), F.col("_best.loss").alias("loss"))
    )


def checkpoints(log: DataFrame, every: int) -> DataFrame:
    """Steps at which a checkpoint is written: each ``every``-th but the first."""
    return log.filter((F.col("step") > 0) & (F.col("step") % every == 0)).select("run", "step")


def retain_last(saved: DataFrame, n: int = KEEP_LAST) -> DataFrame:
    """Add ``kept`` on the newest ``n`` checkpoints per run and ``latest`` on the newest."""
    ranked = running(saved, ["step"], Buckets.of(saved, F.col("step")), group=["run"])
    totals = saved.groupBy("run").agg(F.count(F.lit(1)).alias("_saved"))
    return (
        ranked.join(totals, "run")
        .withColumn("kept", F.col("rank") > F.col("_saved") - n)
        .withColumn("latest", F.col("rank") == F.col("_saved"))
        .drop("rank", "_bucket", "_saved")
    )


def run_summary(log: DataFrame, tokens_per_step: int, parameters: float) -> DataFrame:
    """One row per run. Rates cover the steps after the first logged one, which time it."""
    totals = log.groupBy("run").agg(
        F.count(F.lit(1)).alias("steps"),
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6).alias("_s"),
        F.max_by("loss", "step").alias("final_loss"),
        F.min("loss").alias("best_loss"),
    )
    rate = F.try_divide((F.col("steps") - 1) * tokens_per_step, F.col("_s"))
    return totals.select(
        "run",
        "steps",
        (F.col("_s") / 3600).alias("hours"),
        (F.col("steps") * tokens_per_step).alias("tokens"),
        rate.alias("tokens_per_s"),
        utilisation(rate, parameters).alias("mfu"),
        "final_loss",
        perplexity(F.col("final_loss")).alias("final_perplexity"),
        "best_loss",
        perplexity(F.col("best_loss")).alias("best_perplexity"),
    )
