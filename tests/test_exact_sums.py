"""Sums that no long or double holds exactly on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocktrace.catalog import QUERIES
from blocktrace.operators import stats


def test_spans_add_up_past_a_long(make_trace):
    far = 6 * 10**18
    trace = make_trace([(0, 1), (0, 2), (far, 1), (far + 2, 2)])
    mean = stats.interval_mean(stats.lba_profile(trace)).first()["mean_rewrite_interval_us"]
    assert mean == float(far + 1)


def test_pooled_targets_are_summed_as_whole_numbers(spark, tmp_path):
    """Targets of two centuries: their sums pass 2^53, where doubles lose the last digits."""
    year = 31_557_600_000_000
    times = {user: [18 * year * i + (7919 * user * i) % 1009 + user for i in range(12)] for user in range(45)}
    rows = sorted((t, user) for user, instants in times.items() for t in instants)
    events = spark.createDataFrame([(i, t, user, "click") for i, (t, user) in enumerate(rows)],
                                   "event_id long, us long, user_id long, event_type string")
    events.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type") \
        .write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["win8_split_then_pool"](spark, str(tmp_path)).collect()
    assert sum(row["n"] for row in found) == 6 * len(times)
    assert sum(row["target_sum"] for row in found) == sum(t[-1] - t[5] for t in times.values())
