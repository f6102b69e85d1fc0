"""Write placement as data: temperatures, streams, segments and block lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.functions.labels import write_stream
from blocktrace.operators.intervals import labelled_by_rule, rule_statistic, write_events
from blocktrace.operators.joins import assign_predictions
from blocktrace.plans.ordered import ordered_columns, ordered_prefix, with_ordinal
from blocktrace.plans.storage import attach, settle
from blocktrace.schemas import KEY, LBA_KEY, PREDICTED_POLICY, TRACE_ORDER


def policy_temperatures(trace: DataFrame, predictions: DataFrame, prediction_order: list[str], *,
                        rule_threshold: float | DataFrame, min_history: int,
                        max_writes: int | None = None, predicted_policy: str = PREDICTED_POLICY,
                        known: DataFrame | None = None) -> DataFrame:
    """The same writes under the MIXED, RULE_BASED and predicted policies.

    `rule_threshold` is one number or a table of one threshold per trace. The
    writes are planned once: the rule's temperature stands beside each write
    before it meets its prediction, and a write then becomes a row per policy.
    `known` is the settled ``rule_statistic`` of these writes, if there is one.
    """
    kept = ["trace_id", "timestamp", "lba", "seq"]
    if known is None:
        known = settle(rule_statistic(trace, min_history, max_writes=max_writes), "known")
    ruled = labelled_by_rule(known, rule_threshold).select(*kept, F.col("temperature").alias("_ruled"))
    both = assign_predictions(ruled, predictions, prediction_order)
    said = {"MIXED": F.lit("UNKNOWN"), "RULE_BASED": F.col("_ruled"), predicted_policy: F.col("temperature")}
    rows = F.array(*[F.struct(F.lit(policy).alias("policy"), label.alias("temperature")) for policy, label in said.items()])
    return both.select(*kept, F.inline(rows)).select("policy", *kept, "temperature")


def route(placed: DataFrame) -> DataFrame:
    """Add the write stream each write enters."""
    return placed.withColumn("stream", write_stream(F.col("policy"), F.col("temperature")))


def placement_counters(routed: DataFrame, block_bytes: int = 4096) -> DataFrame:
    return routed.groupBy("trace_id", "policy").agg(
        F.count(F.lit(1)).alias("total_write_requests"),
        F.count_if(F.col("stream") == "MAIN").alias("main_stream_writes"),
        F.count_if(F.col("stream") == "COLD").alias("cold_stream_writes"),
        F.count_if(F.col("temperature") == "HOT").alias("hot_placements"),
        F.count_if(F.col("temperature") == "COLD").alias("cold_placements"),
        F.count_if(F.col("temperature") == "UNKNOWN").alias("unpredicted_writes"),
        (F.count(F.lit(1)) * block_bytes).alias("logical_bytes_written"))


def prediction_coverage(counters: DataFrame) -> DataFrame:
    total = F.col("total_write_requests")
    return counters.withColumn("prediction_coverage", F.when(total == 0, 0.0).otherwise(
        1.0 - F.col("unpredicted_writes") / total))


def replayed_requests(trace: DataFrame, max_writes: int) -> DataFrame:
    """Reads, discards and writes met until the `max_writes`-th write."""
    writes = write_events(trace).select("trace_id", *TRACE_ORDER)
    place = [F.col(c) for c in TRACE_ORDER]
    last = ordered_prefix(writes, KEY, TRACE_ORDER, n=max_writes).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct(*place)).alias("_last"))
    stop = last.withColumn("_last", F.when(F.col("_n") == max_writes, F.col("_last"))).drop("_n")
    met = attach(trace, stop, KEY, "left").filter(
        F.col("_last").isNull() | (F.struct(*place) <= F.col("_last")))
    return met.groupBy("trace_id").agg(
        F.count_if(F.col("operation") == "R").alias("read_requests"),
        F.count_if(F.col("operation") == "D").alias("discard_requests"),
        F.count_if(F.col("operation") == "W").alias("write_requests"))


def block_versions(writes: DataFrame, keys: list[str] = LBA_KEY) -> DataFrame:
    """When each written version is replaced; null while it is still live."""
    return ordered_columns(writes, keys, TRACE_ORDER, following={
        "valid_to": "timestamp", "next_seq": "seq"}).withColumnRenamed("timestamp", "valid_from")


def live_blocks_at(trace: DataFrame, times: list[int]) -> DataFrame:
    """Distinct blocks written up to each given time."""
    born = write_events(trace).groupBy("trace_id", "lba").agg(F.min("timestamp").alias("_born"))
    counts = born.groupBy("trace_id").agg(F.array(*[
        F.struct(F.lit(t).cast("long").alias("instant"), F.count_if(F.col("_born") <= t).alias("live_blocks"))
        for t in times]).alias("_c"))
    return counts.select("trace_id", F.inline("_c"))


def live_blocks_after(trace: DataFrame, counts: list[int]) -> DataFrame:
    """Distinct blocks written by the first n writes, for each given n."""
    writes = with_ordinal(write_events(trace).select("trace_id", "lba", *TRACE_ORDER), KEY, TRACE_ORDER, "_nth")
    born = writes.groupBy("trace_id", "lba").agg(F.min("_nth").alias("_born"))
    table = born.groupBy("trace_id").agg(F.array(*[
        F.struct(F.lit(n).cast("long").alias("after_writes"), F.count_if(F.col("_born") < n).alias("live_blocks"))
        for n in counts]).alias("_c"))
    return table.select("trace_id", F.inline("_c"))
