"""Streaming operators: late rows, repeated keys, and state that leaves."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from blocktrace.catalog.stream import Replay
from blocktrace.plans.layout import TASK_ROWS_CONF
from blocktrace.plans.storage import new_folder
from blocktrace.streaming import streams

HOUR = 3_600_000_000
WRITES = "trace_id string, timestamp long, lba long, seq long"
OFFERS = "trace_id string, timestamp long, lba long, predicted_rewrite_interval double, predicted_class string, place long"


def feed(source, name, rows, schema):
    source.spark.createDataFrame(rows, schema).write.mode("append").parquet(source.paths[name])


class Steps(Replay):
    """A replay whose slices are given by the test."""

    def __init__(self, steps, **tables):
        super().__init__("timestamp", **tables)
        self.steps = steps

    def run(self, writer):
        for step in self.steps:
            for name, rows in step.items():
                feed(self, name, rows, self.tables[name].schema)
            self.once(writer)


def test_late_predictions_and_repeated_keys(spark):
    steps = [
        {"writes": [("a", HOUR, 1, 10), ("a", HOUR, 1, 11), ("a", HOUR, 2, 12), ("a", 2 * HOUR, 3, 13)],
         # Two offers for one key: the smaller place wins, whatever the order of the rows.
         "offers": [("a", HOUR, 1, 9.0, "COLD", 5), ("a", HOUR, 1, 7.0, "HOT", 4)]},
        {"writes": [("a", 30 * HOUR, 9, 14)], "offers": [("a", 2 * HOUR, 3, 3.0, "HOT", 6), ("a", 30 * HOUR, 8, 1.0, "HOT", 7)]},
        # The watermark has passed the first writes: this offer comes too late for block 2.
        {"writes": [("a", 60 * HOUR, 9, 15)], "offers": [("a", HOUR, 2, 2.0, "HOT", 8), ("a", 60 * HOUR, 8, 1.0, "HOT", 9)]},
        {"writes": [("a", 90 * HOUR, 9, 16)], "offers": [("a", 90 * HOUR, 8, 1.0, "HOT", 9)]}]
    source = Steps(steps, writes=spark.createDataFrame([], WRITES), offers=spark.createDataFrame([], OFFERS))
    joined = streams.assign_predictions_stream(source.stream("writes"), source.stream("offers"), "place")
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "InPandas" not in plan
    rows = {r.seq: (r.predicted_rewrite_interval, r.temperature) for r in source.collect_append(joined).collect()}
    assert rows == {10: (7.0, "HOT"), 11: (None, "UNKNOWN"), 12: (None, "UNKNOWN"), 13: (3.0, "HOT"),
                    14: (None, "UNKNOWN"), 15: (None, "UNKNOWN")}
    assert source.dropped == 1


def test_late_writes_are_dropped_and_counted(spark):
    schema = "timestamp long, lba long, size int, operation string, trace_id string, seq long"

    def write(hour, seq):
        return (int(hour * HOUR), 1, 1, "W", "a", seq)

    steps = [{"trace": [write(24, 0), write(24.5, 1), write(30, 2)]},
             {"trace": [write(29.5, 3), write(25, 4)]},  # the first is still in time, the second is not
             {"trace": [write(100, 5)]}]
    source = Steps(steps, trace=spark.createDataFrame([], schema))
    out = source.collect_append(streams.write_rate_stream(source.stream("trace"), "1 hour", "1 hour"))
    assert {r.window_start // HOUR: r.writes for r in out.collect()} == {24: 2, 29: 1, 30: 1}
    assert source.dropped == 1


def test_rule_state_goes_from_batch_to_batch(spark):
    folder = new_folder(spark, "rule")
    rows = [("a", 1, t, i) for i, t in enumerate([0, 5, 9, 4, 14, 14, 30])] + [("a", 2, 3, 7), ("b", 1, 8, 8)]
    schema = "trace_id string, lba long, timestamp long, seq long"
    table = spark.createDataFrame(rows, schema)
    spark.conf.set(TASK_ROWS_CONF, "2")
    try:
        got = {}
        for batch, (low, high) in enumerate([(0, 3), (3, 4), (4, 9)]):
            for _ in range(2):  # a batch that is run again changes nothing
                part = table.filter(F.col("seq").between(low, high - 1))
                found = streams.rule_temperature_batch(part, batch, folder, 5.0, 2).collect()
            got |= {r.seq: (r.history, r.mean_interval, r.temperature) for r in found}
    finally:
        spark.conf.unset(TASK_ROWS_CONF)
    # Going back from 9 to 4 is no interval; the next one counts from 4.
    assert got == {0: (0, None, "UNKNOWN"), 1: (0, None, "UNKNOWN"), 2: (1, None, "UNKNOWN"), 3: (2, 4.5, "HOT"),
                   4: (2, 4.5, "HOT"), 5: (3, 19 / 3, "COLD"), 6: (4, 4.75, "HOT"), 7: (0, None, "UNKNOWN"),
                   8: (0, None, "UNKNOWN")}
    versions = spark.read.parquet(f"{folder}/state").select("batch").distinct().collect()
    assert {r.batch for r in versions} == {1, 2}


def test_predictions_meet_writes_in_one_state(spark):
    """Two aggregations and two joins kept ten stores in each partition; one aggregation keeps one."""
    source = Steps([{"writes": [("a", HOUR, 1, 10), ("a", HOUR, 1, 9)], "offers": [("a", HOUR, 1, 9.0, "HOT", 5)]},
                    {"writes": [("a", 90 * HOUR, 9, 16)], "offers": [("a", 90 * HOUR, 8, 1.0, "HOT", 9)]}],
                   writes=spark.createDataFrame([], WRITES), offers=spark.createDataFrame([], OFFERS))
    joined = streams.assign_predictions_stream(source.stream("writes"), source.stream("offers"), "place")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = {r.seq: r.temperature for r in source.collect_append(joined).collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == {9: "HOT", 10: "UNKNOWN"}
    states = list(Path(source.log, "state").iterdir())
    assert [state.name for state in states] == ["0"]
    assert len([part for part in states[0].iterdir() if part.name.isdigit()]) <= spark.sparkContext.defaultParallelism
