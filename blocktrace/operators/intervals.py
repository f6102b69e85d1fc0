"""Rewrite intervals, windows of intervals, and the running-mean rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.plans.ordered import ordered_columns, ordered_prefix
from blocktrace.plans.storage import attach
from blocktrace.schemas import KEY, LBA_KEY, TRACE_ORDER


def write_events(trace: DataFrame) -> DataFrame:
    return trace.filter(F.col("operation") == "W")


def write_prefix(trace: DataFrame, max_writes: int | None) -> DataFrame:
    """The first `max_writes` writes of each trace."""
    writes = write_events(trace)
    return writes if max_writes is None else ordered_prefix(writes, KEY, TRACE_ORDER, n=max_writes)


def row_prefix(trace: DataFrame, max_rows: int) -> DataFrame:
    """Writes among the first `max_rows` rows of any operation."""
    return write_events(ordered_prefix(trace, KEY, TRACE_ORDER, n=max_rows))


def rewrite_intervals(trace: DataFrame) -> DataFrame:
    """Time since the previous write of the same block, for every rewrite.

    First writes have no interval and are absent; zero is a real interval.
    `position` numbers a block's intervals from 0.
    """
    writes = write_events(trace).select("trace_id", "lba", "timestamp", "seq")
    placed = ordered_columns(writes, LBA_KEY, TRACE_ORDER,
                             running={"_nth": F.lit(1).cast("long")},
                             past={"_before": ("timestamp", 1)})
    return (placed.filter(F.size("_before") == 1)
            .select("trace_id", "lba", "timestamp", "seq",
                    (F.col("timestamp") - F.col("_before")[0]).alias("interval"),
                    (F.col("_nth") - 1).alias("position")))


def build_sequences(trace: DataFrame, length: int) -> DataFrame:
    """Windows of `length` intervals with the interval that follows them.

    A sample never crosses blocks and is stamped with the time its target is
    known. Intervals are differences of the last ``length + 2`` write times, so
    intervals and windows come out of one pass over one partitioning.
    """
    if length < 1:
        raise ValueError("sequence length must be >= 1")
    writes = write_events(trace).select("trace_id", "lba", "timestamp", "seq")
    placed = ordered_columns(writes, LBA_KEY, TRACE_ORDER,
                             running={"_nth": F.lit(1).cast("long")},
                             past={"_before": ("timestamp", length + 1)})
    before = F.col("_before")
    gaps = F.zip_with(F.slice(before, 2, length), F.slice(before, 1, length),
                      lambda later, earlier: (later - earlier).cast("double"))
    return (placed.filter(F.size("_before") == length + 1)
            .select("trace_id", "lba", "timestamp",
                    (F.col("_nth") - 1).alias("position"),
                    gaps.alias("inputs"),
                    (F.col("timestamp") - before[length]).cast("double").alias("target")))


def rule_statistic(trace: DataFrame, min_history: int, *, fraction: float | None = None,
                   max_writes: int | None = None) -> DataFrame:
    """Mean of a block's earlier intervals, as known just before each write.

    Earlier intervals telescope, so the mean is the span of earlier writes over
    their count; it is null until `min_history` intervals exist. `fraction`
    keeps only the earliest share of the write stream.
    """
    if min_history < 1:
        raise ValueError("min_history must be >= 1")
    writes = write_prefix(trace, max_writes).select("trace_id", "lba", "timestamp", "seq")
    if fraction is not None:
        writes = ordered_prefix(writes, KEY, TRACE_ORDER, fraction=fraction)
    placed = ordered_columns(writes, LBA_KEY, TRACE_ORDER,
                             running={"_nth": F.lit(1).cast("long")},
                             past={"_before": ("timestamp", 1)},
                             first={"_first": "timestamp"})
    history = F.col("_nth") - 1
    mean = (F.col("_before")[0] - F.col("_first")) / history
    return placed.select("trace_id", "lba", "timestamp", "seq",
                         F.greatest(history, F.lit(0)).alias("history"),
                         F.when(history >= min_history, mean).alias("mean_interval"))


def rule_temperature(trace: DataFrame, threshold: float | DataFrame, min_history: int, *,
                     max_writes: int | None = None) -> DataFrame:
    """HOT / COLD from the running mean, UNKNOWN with too little history.

    `threshold` is one number, or a table of ``rule_threshold`` per trace; with a
    table, a write with enough history in a trace without a threshold fails.
    """
    return labelled_by_rule(rule_statistic(trace, min_history, max_writes=max_writes), threshold)


def labelled_by_rule(known: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """The same for rows of ``rule_statistic``."""
    kept = [*known.columns, "temperature"]
    cut = F.lit(threshold) if not isinstance(threshold, DataFrame) else F.col("rule_threshold")
    if isinstance(threshold, DataFrame):
        missing = F.raise_error(F.concat(F.lit("no rule threshold for trace "), F.col("trace_id"))).cast("double")
        known = attach(known, threshold.select("trace_id", "rule_threshold"), KEY, "left").withColumn(
            "rule_threshold", F.when(cut.isNull() & F.col("mean_interval").isNotNull(), missing).otherwise(cut))
    return known.withColumn(
        "temperature",
        F.when(F.col("mean_interval").isNull(), "UNKNOWN")
        .when(F.col("mean_interval") <= cut, "HOT").otherwise("COLD")).select(*kept)
