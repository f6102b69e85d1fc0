"""log1p standardisation fitted on training intervals only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.functions.windows import moments

#: Standard deviations at or below this count as zero.
MIN_STD = 1e-12
#: Log-space clip before the exponential.
LOG_LIMIT = 50.0


def _merged(left: Column, right: Column) -> Column:
    """Count, mean and squared deviations of two groups together."""
    n = left["n"] + right["n"]
    gap = right["mean"] - left["mean"]
    return F.struct(
        n.alias("n"),
        (left["mean"] + gap * right["n"] / n).alias("mean"),
        (left["dev"] + right["dev"] + gap * gap * left["n"] * right["n"] / n).alias("dev"))


def fit_scaler(train: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of log1p over all inputs and targets.

    Each row is reduced to its count, mean and squared deviations, so the window
    is never exploded and no large squares are subtracted: equal values give a
    deviation of zero, hence a divisor of 1. Rows of one length merge in an
    aggregate; the few lengths of a key are merged afterwards.
    """
    pool = F.concat("inputs", F.array("target"))
    values = F.transform(pool, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))
    per_row = train.select(*keys, moments(values).alias("_m"))
    by_length = per_row.groupBy(*keys, F.col("_m.n").alias("_size")).agg(
        F.count(F.lit(1)).cast("double").alias("_rows"), F.avg("_m.mean").alias("_mean"),
        F.var_pop("_m.mean").alias("_spread"), F.sum("_m.dev").alias("_dev"))
    n = F.col("_size") * F.col("_rows")
    parts = by_length.groupBy(*keys).agg(F.collect_list(F.struct(
        n.alias("n"), F.col("_mean").alias("mean"), (F.col("_dev") + n * F.col("_spread")).alias("dev"))).alias("_p"))
    fitted = parts.withColumn("_all", F.reduce(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))),
                                               F.col("_p")[0], _merged))
    std = F.sqrt(F.col("_all.dev") / F.col("_all.n"))
    return fitted.select(*keys, F.col("_all.mean").alias("mean"),
                         F.when(std > MIN_STD, std).otherwise(F.lit(1.0)).alias("std"))


def require_training(train: DataFrame) -> DataFrame:
    if train.isEmpty():
        raise ValueError("cannot fit on an empty training split")
    return train


def scale(values: Column, mean: Column, std: Column) -> Column:
    return F.transform(values, lambda x: (F.log1p(F.greatest(x, F.lit(0.0))) - mean) / std)


def from_log(value: Column) -> Column:
    """log1p space back to microseconds, never negative."""
    clipped = F.least(F.greatest(value, F.lit(-LOG_LIMIT)), F.lit(LOG_LIMIT))
    return F.greatest(F.expm1(clipped), F.lit(0.0))


def unscale(value: Column, mean: Column, std: Column) -> Column:
    return from_log(value * std + mean)
