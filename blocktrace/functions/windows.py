"""Expressions over a window of past intervals (``array<double>``, oldest first).

A predictor is any function from that array column to a double column; the
baselines below need no training. All of them stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Predictor = Callable[[Column], Column]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def newest(inputs: Column, k: int) -> Column:
    """The last `k` elements, or all of a shorter array."""
    size = F.least(F.lit(k), F.size(inputs))
    return F.slice(inputs, -size, size)


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    size = F.size(values)
    upper = F.element_at(ordered, (F.floor(size / 2) + 1).cast("int"))
    lower = F.element_at(ordered, F.floor((size + 1) / 2).cast("int"))
    return (lower + upper) / 2


def logged(inputs: Column) -> Column:
    return F.transform(inputs, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))


def last_interval(inputs: Column) -> Column:
    return F.element_at(inputs, -1)


def mean_interval(inputs: Column) -> Column:
    return _mean(inputs)


def median_interval(inputs: Column) -> Column:
    return _median(inputs)


def moving_average(k: int) -> Predictor:
    if k < 1:
        raise ValueError("window must be >= 1")
    return lambda inputs: _mean(newest(inputs, k))


def ema(alpha: float) -> Predictor:
    """Exponential average whose weights over the finite window sum to one."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1.0:
        return last_interval

    def predict(inputs: Column) -> Column:
        decayed = F.aggregate(inputs, F.lit(0.0), lambda s, x: alpha * x + (1.0 - alpha) * s)
        return decayed / (1.0 - F.pow(F.lit(1.0 - alpha), F.size(inputs)))

    return predict


#: Row labels of the comparison tables.
BASELINES: dict[str, Predictor] = {
    "last_interval": last_interval,
    "mean_interval": mean_interval,
    "median_interval": median_interval,
    "moving_average_3": moving_average(3),
    "ema_0.5": ema(0.5),
}


def python_predictor(function: Callable[[pd.Series], pd.Series]) -> Predictor:
    """Wrap a user's vectorised Python predictor (Arrow batches, not rows)."""
    return F.pandas_udf(function, "double")


def window_features(inputs: Column) -> Column:
    """L logged intervals followed by eight summary values of the window."""
    return summaries(logged(inputs))


def moments(values: Column, finish: Callable[[Column], Column] | None = None) -> Column:
    """Count, mean and sum of squared deviations of an array, in one walk without cancellation."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), zero.alias("mean"), zero.alias("dev"))

    def add(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"),
                        (acc["dev"] + (x - acc["mean"]) * (x - mean)).alias("dev"))

    return F.aggregate(values, start, add, finish)


def summaries(values: Column) -> Column:
    """The features of a window of logged intervals."""
    mean = _mean(values)
    deviation = moments(values, lambda m: F.sqrt(m["dev"] / m["n"]))
    return F.concat(values, F.array(
        mean,
        deviation,
        F.array_min(values),
        F.array_max(values),
        _median(values),
        F.element_at(values, -1),
        F.element_at(values, -1) - F.element_at(values, 1),
        _mean(newest(values, 3)),
    ))
