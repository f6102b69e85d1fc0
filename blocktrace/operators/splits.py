"""Chronological splits. A trace is always split before it is pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.operators.intervals import rule_statistic
from blocktrace.plans.ordered import ordered_columns, ordered_prefix, percentiles
from blocktrace.plans.storage import attach, settle
from blocktrace.schemas import KEY, SAMPLE_ORDER, TRACE_ORDER


#: Traces an error message names at most.
NAMED_IN_ERRORS = 10


def _check_shares(train: float, val: float) -> None:
    if not 0.0 < train < 1.0 or not 0.0 < val < 1.0:
        raise ValueError("split shares must be in (0, 1)")
    if train + val >= 1.0:
        raise ValueError("split shares must leave room for a test split")


def chronological_split(samples: DataFrame, train: float = 0.70, val: float = 0.15,
                        keys: list[str] = KEY, time: str = "timestamp") -> DataFrame:
    """Add ``split``; no instant of a trace appears in two splits.

    A row is in train when fewer than ``round(train * n)`` rows of its trace are
    strictly earlier, which is the index cut moved past ties; likewise for
    validation. Splits may come out empty on heavy ties, so check the sizes.
    """
    _check_shares(train, val)
    n = F.col("_total")
    first, second = F.bround(F.lit(train) * n), F.bround(F.lit(train + val) * n)
    rows = settle(samples, "samples")
    counts = settle(rows.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n")), "instants")
    earlier = ordered_columns(counts, keys, [time], running={"_earlier": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ends = attach(earlier, totals, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("_earlier") < first, F.col(time))).alias("_t1"),
        F.max(F.when(F.col("_earlier") < second, F.col(time))).alias("_t2"))
    named = F.when(F.col(time) <= F.col("_t1"), "train").when(F.col(time) <= F.col("_t2"), "val")
    return attach(rows, ends, keys).withColumn("split", named.otherwise("test")) \
        .drop("_t1", "_t2").select(*samples.columns, "split")


def chronological_prefix(samples: DataFrame, fraction: float) -> DataFrame:
    if not 0.0 < fraction <= 1.0:
        raise ValueError("fraction must be in (0, 1]")
    return ordered_prefix(samples, KEY, SAMPLE_ORDER, fraction=fraction)


def cap_samples(samples: DataFrame, max_sequences: int) -> DataFrame:
    """First `max_sequences` samples of each trace; may cut a tie."""
    return ordered_prefix(samples, KEY, SAMPLE_ORDER, n=max_sequences)


def order_chronologically(samples: DataFrame) -> DataFrame:
    return samples.orderBy("trace_id", *SAMPLE_ORDER)


def pool_splits(split_samples: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """Forget the trace of already split samples, optionally for some traces only."""
    if "split" not in split_samples.columns:
        raise ValueError("split each trace before pooling")
    if traces is not None:
        split_samples = split_samples.join(traces.select("trace_id"), "trace_id", "left_semi")
    return split_samples.drop("trace_id")


def split_sizes(split_samples: DataFrame) -> DataFrame:
    """train / val / test / total per trace."""
    parts = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    return split_samples.groupBy("trace_id").agg(*parts, F.count(F.lit(1)).alias("total"))


def _check_percentile(percentile: float) -> None:
    if not 0.0 < percentile < 100.0:
        raise ValueError("percentile must be in (0, 100)")


def hot_threshold(split_samples: DataFrame, percentile: float = 30.0,
                  keys: list[str] = KEY) -> DataFrame:
    """Hot/cold cut-off per trace, from training targets only."""
    _check_percentile(percentile)
    train = split_samples.filter(F.col("split") == "train").select(*keys, "target")
    if train.isEmpty():
        raise ValueError("cannot derive a threshold from an empty training split")
    return percentiles(train, keys, "target", {"hot_threshold": percentile / 100.0})


def rule_threshold(trace: DataFrame, min_history: int, fraction: float = 0.70,
                   percentile: float = 30.0, max_writes: int | None = None,
                   known: DataFrame | None = None) -> DataFrame:
    """Cut-off for the running-mean rule, from its own statistic in training time.

    A trace whose training period never reaches `min_history` has no cut-off;
    the call fails and names such traces. `known` is the settled ``rule_statistic``
    of all these writes, if there is one: a write's mean depends on earlier writes
    alone, so the training period's statistic is the earliest share of its rows.
    """
    _check_percentile(percentile)
    early = rule_statistic(trace, min_history, fraction=fraction, max_writes=max_writes) if known is None \
        else ordered_prefix(known, KEY, TRACE_ORDER, fraction=fraction)
    observed = settle(early.filter(F.col("mean_interval").isNotNull()).select("trace_id", "mean_interval"), "rule")
    silent = trace.select("trace_id").distinct().join(observed, KEY, "left_anti").orderBy("trace_id")
    named = [row["trace_id"] for row in silent.limit(NAMED_IN_ERRORS).collect()]
    if named:
        raise ValueError(f"no block has enough rewrites in the training period of {', '.join(map(str, named))}")
    return percentiles(observed, KEY, "mean_interval", {"rule_threshold": percentile / 100.0})
