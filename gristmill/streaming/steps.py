"""Step logs as streams: step times, rates, running best and smoothed loss while a run goes on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.runlog import DECAY, fold

STATE = (
    "next long, last_us long, best double, smooth double, "
    "waiting array<long>, waiting_us array<long>, waiting_loss array<double>"
)
START = (0, None, None, 0.0, [], [], [])


def advance(state: Sequence, steps: np.ndarray, times: np.ndarray, losses: np.ndarray, decay: float) -> tuple:
    """A run's state after some of its steps, in any order, and the steps that follow on now.

    Steps after a gap wait in the state until it is filled; steps seen before are passed over.
    """
    following, last, best, smooth, *waiting = state
    held = [np.concatenate([np.asarray(w, new.dtype), new]) for w, new in zip(waiting, (steps, times, losses), strict=True)]
    numbers, first = np.unique(held[0], return_index=True)
    new = numbers >= following
    numbers, times, losses = numbers[new], held[1][first[new]], held[2][first[new]]
    ready = int((numbers == following + np.arange(len(numbers))).sum())
    rest = [x[ready:].tolist() for x in (numbers, times, losses)]
    numbers, times, losses = numbers[:ready], times[:ready], losses[:ready]
    if not ready:
        return (following, last, best, smooth, *rest), None

    spent = np.diff(times, prepend=times[0] if last is None else last).astype(float)
    if last is None:
        spent[0] = np.nan
    before = np.fmin.accumulate(np.concatenate([[np.nan if best is None else best], losses]))
    averages = fold(losses.tolist(), smooth, decay)
    out = pd.DataFrame(
        {"step": numbers, "us": times, "loss": losses, "step_us": spent, "best": before[1:], "loss_smooth": averages}
    )
    # As in the table's twin, any loss improves on none, and a missing one is not compared.
    out["improved"] = np.where(np.isnan(before[:-1]), True, losses < before[:-1])
    out["improved"] = out["improved"].astype(object).where(np.isnan(before[:-1]) | ~np.isnan(losses), None)
    best = None if np.isnan(before[-1]) else float(before[-1])
    return (following + ready, int(times[-1]), best, float(averages[-1]), *rest), out


def follow_steps(log: DataFrame, tokens_per_step: int, decay: float = DECAY) -> DataFrame:
    """``(run, step, ts, loss, step_s, tokens_per_s, best, improved, loss_smooth)`` of a stream.

    ``log`` is a stream of ``(run, step, ts, loss)`` whose steps count 0, 1, 2, ... per run. Rows
    of a run may come in any order and more than once: each step comes out once, as soon as all
    before it are there, with the values that ``step_throughput``, ``best_so_far`` and
    ``smooth_loss`` give for the finished table. A null or not-a-number loss changes neither
    best nor average and comes out as null; rows without a step or a time are passed over.

    A run's state is six values and the steps that wait. A task holds of a run what one
    micro-batch brings, which the source's ``maxFilesPerTrigger`` bounds, not the run.
    """
    kind = dict(log.dtypes)["run"]
    rows = log.filter("step IS NOT NULL AND ts IS NOT NULL").select(
        "run",
        F.col("step").cast("long").alias("step"),
        F.unix_micros("ts").alias("us"),
        F.coalesce(F.col("loss").cast("double"), F.lit(float("nan"))).alias("loss"),
    )

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(chunks), ignore_index=True)
        known = state.get if state.exists else START
        news = (batch["step"].to_numpy(np.int64), batch["us"].to_numpy(np.int64), batch["loss"].to_numpy(float))
        after, out = advance(known, *news, decay)
        state.update(after)
        if out is not None:
            out.insert(0, "run", pd.Series([key[0]] * len(out), dtype=batch["run"].dtype))
            yield out

    shape = (
        f"run {kind}, step long, us long, loss double, step_us double, best double, loss_smooth double, improved boolean"
    )
    walked = rows.groupBy("run").applyInPandasWithState(step, shape, STATE, "append", GroupStateTimeout.NoTimeout)

    def number(name: str) -> F.Column:
        return F.nullif(F.col(name), F.lit(float("nan")))

    seconds = number("step_us") / 1e6
    return walked.select(
        "run",
        "step",
        F.timestamp_micros("us").alias("ts"),
        number("loss").alias("loss"),
        seconds.alias("step_s"),
        F.try_divide(F.lit(tokens_per_step), seconds).alias("tokens_per_s"),
        number("best").alias("best"),
        "improved",
        "loss_smooth",
    )


def run_follow_steps(
    spark: SparkSession, log: DataFrame, folder: str, tokens_per_step: int, decay: float = DECAY
) -> DataFrame:
    """Drive the stream over all waiting files into Parquet and read that back.

    Called again with the same ``folder``, it goes on where it stopped.
    """
    query = (
        follow_steps(log, tokens_per_step, decay)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/progress")
        .option("path", f"{folder}/steps")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/steps")
