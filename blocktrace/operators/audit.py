"""Data-quality checks as queries that return the violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.operators.joins import overlap
from blocktrace.plans.storage import attach
from blocktrace.schemas import PREDICTED_POLICY



def unequal_workloads(runs: DataFrame) -> DataFrame:
    """Groups whose policies did not replay one identical workload, or lack MIXED."""
    group = runs.groupBy("trace", "total_segments").agg(
        F.count_distinct("total_write_requests").alias("write_counts"),
        F.count_distinct("logical_bytes_written").alias("logical_sizes"),
        F.count_distinct("seed").alias("seeds"),
        F.count_if(F.col("policy") == "MIXED").alias("mixed_runs"))
    return group.filter((F.col("write_counts") != 1) | (F.col("logical_sizes") != 1)
                        | (F.col("seeds") != 1) | (F.col("mixed_runs") == 0))


def broken_accounting(runs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Runs where physical != logical + copied, or WAF is not physical / logical."""
    physical, logical = F.col("physical_bytes_written"), F.col("logical_bytes_written")
    # Zero logical bytes with any physical byte is a violation, not an error.
    ratio = F.when(logical == 0, 1.0).otherwise(F.try_divide(physical, logical))
    return runs.withColumns({
        "bytes_differ": physical != logical + F.col("gc_bytes_copied"),
        "waf_differs": F.abs(F.col("waf") - ratio) > tolerance}) \
        .filter(F.col("bytes_differ") | F.col("waf_differs"))


def misused_cold_log(runs: DataFrame, predicted_policy: str = PREDICTED_POLICY) -> DataFrame:
    """MIXED runs that used the cold log and segregated runs that did not."""
    cold = F.col("cold_stream_writes")
    return runs.filter(((F.col("policy") == "MIXED") & (cold != 0))
                       | (F.col("policy").isin("RULE_BASED", predicted_policy) & (cold == 0)))


def degenerate_labels(runs: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Runs whose classified writes are almost all hot or almost all cold."""
    classified = F.col("total_write_requests") - F.col("unpredicted_writes")
    hot = F.try_divide(classified - F.col("cold_stream_writes"), classified)
    return runs.filter(F.col("policy") != "MIXED").withColumn("hot_share", hot) \
        .filter((F.col("hot_share") < low) | (F.col("hot_share") > high))


def unfair_comparison(comparison: DataFrame, families: list[str], variants: list[str]) -> DataFrame:
    """Targets not scored on one test split and length, or lacking a family or variant."""
    group = comparison.groupBy("target_trace").agg(
        F.count_distinct("test_samples").alias("test_sizes"),
        F.count_distinct("sequence_length").alias("lengths"),
        *[F.count_if(F.col("family") == f).alias(f"family_{f}") for f in families],
        F.count_if(~F.col("family").isin(families)).alias("other_families"),
        *[F.count_if(F.col("model_type") == v).alias(f"variant_{v}") for v in variants],
        F.count_if(F.lower("hot_threshold_source").contains("test")).alias("test_thresholds"))
    bad = (F.col("test_sizes") != 1) | (F.col("lengths") != 1) \
        | (F.col("other_families") > 0) | (F.col("test_thresholds") > 0)
    for name in [f"family_{f}" for f in families] + [f"variant_{v}" for v in variants]:
        bad = bad | (F.col(name) == 0)
    return group.filter(bad)


def role_leaks(roles: DataFrame) -> DataFrame:
    """Traces that are both trained on and evaluated on."""
    pretrain = roles.filter(F.col("role") == "pretrain")
    checked = roles.filter(F.col("role").isin("target", "external"))
    return overlap(pretrain, checked, ["trace_id"])


def require_targets(roles: DataFrame) -> None:
    if roles.filter(F.col("role") == "target").isEmpty():
        raise ValueError("no held-out target exists")


def split_leaks(split_samples: DataFrame) -> DataFrame:
    """Traces whose splits touch or overlap in time."""
    def edge(part: str, function) -> Column:
        return function(F.when(F.col("split") == part, F.col("timestamp")))

    ends = split_samples.groupBy("trace_id").agg(
        edge("train", F.max).alias("train_last"), edge("val", F.min).alias("val_first"),
        edge("val", F.max).alias("val_last"), edge("test", F.min).alias("test_first"))
    return ends.filter((F.col("train_last") >= F.col("val_first"))
                       | (F.col("val_last") >= F.col("test_first"))
                       | (F.col("train_last") >= F.col("test_first")))


def samples_in_two_splits(split_samples: DataFrame) -> DataFrame:
    return split_samples.groupBy("trace_id", "timestamp").agg(
        F.min("split").alias("_a"), F.max("split").alias("_b")) \
        .filter(F.col("_a") != F.col("_b")).select("trace_id", "timestamp")


def windows_with_future(samples: DataFrame, first_writes: DataFrame) -> DataFrame:
    """Samples whose window reaches outside the past of their own target.

    The window and its target must fit between the first write of the block and
    the target time. `first_writes` has one row per block (``first_write``), so
    the join cannot multiply rows.
    """
    spent = F.aggregate("inputs", F.lit(0.0), lambda s, x: s + x) + F.col("target")
    joined = samples.join(first_writes, ["trace_id", "lba"], "left")
    return joined.filter(F.col("first_write").isNull()
                         | (F.col("timestamp") - spent < F.col("first_write"))
                         | (F.col("target") < 0)).select("trace_id", "lba", "timestamp", "position")


def bad_model_records(models: DataFrame) -> DataFrame:
    """Model records without a positive training threshold, with mixed lengths, or trained on their target.

    `pretrain_traces`, where the records have it, is each model's own list of
    training workloads; a roles table may be right while a model was trained on
    something else. A record without a list or without a target passes.
    """
    lengths = models.groupBy("target_trace").agg(
        F.count_distinct("sequence_length").alias("lengths"))
    missing = F.coalesce(F.col("hot_threshold"), F.lit(0.0)) <= 0
    from_test = F.lower(F.coalesce("hot_threshold_source", F.lit(""))).contains("test")
    own = F.lit(False)
    if "pretrain_traces" in models.columns:
        own = F.coalesce(F.array_contains("pretrain_traces", F.col("target_trace")), F.lit(False))
    return attach(models, lengths, ["target_trace"]).withColumns({
        "no_threshold": missing, "threshold_from_test": from_test,
        "mixed_lengths": F.col("lengths") > 1, "trained_on_target": own}) \
        .filter(F.col("no_threshold") | F.col("threshold_from_test") | F.col("mixed_lengths") | own)
