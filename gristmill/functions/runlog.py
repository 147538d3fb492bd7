"""Column expressions of a training run: schedules, perplexity, utilisation, progress."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK_TFLOPS = 312.0
FLOPS_PER_PARAMETER = 6
MAX_EXPONENT = 20


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(float(MAX_EXPONENT))))


def utilisation(tokens_per_s: Column, parameters: float, peak: float = PEAK_TFLOPS) -> Column:
    """Share of the accelerator's peak, counting 6 operations per parameter and token."""
    return tokens_per_s * (FLOPS_PER_PARAMETER * parameters) / 1e12 / peak


def _cosine(step: Column, first: int, last: int, top: float, floor: float) -> Column:
    done = (step - first) / float(last - first)
    return F.lit(floor) + 0.5 * (1.0 + F.cos(F.lit(math.pi) * done)) * (top - floor)


def pretrain_rate(
    step: Column, warmup: int = 613, last: int = 6131, top: float = 3e-4, floor: float = 3e-5
) -> Column:
    """Warm-up reaches the top at its last step; the floor holds from ``last`` on."""
    return (
        F.when(step < warmup, F.lit(top) * (step + 1) / float(warmup))
        .when(step >= last, F.lit(floor))
        .otherwise(_cosine(step, warmup, last, top, floor))
    )


def tuning_rate(
    step: Column, warmup: int = 300, last: int = 25_000, top: float = 2e-5, floor: float = 2e-6
) -> Column:
    """Warm-up starts at zero; the floor holds after ``last``."""
    return (
        F.when(step < warmup, F.lit(top) * step / float(warmup))
        .when(step > last, F.lit(floor))
        .otherwise(_cosine(step, warmup, last, top, floor))
    )


def progress_percent(step: Column, steps: int) -> Column:
    return (step + 1) / float(steps) * 100


def hours_left(mean_step_s: Column, step: Column, steps: int) -> Column:
    return mean_step_s * (F.lit(steps) - step - 1) / 3600
