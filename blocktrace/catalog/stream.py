"""Queries that run a Structured Streaming job over a whole table and read its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktrace.catalog.common import (
    CAP,
    MIN_HISTORY,
    PREDICTIONS,
    SAMPLES,
    SOURCE_ORDER,
    TRACE,
    checked_sql,
    predictions,
    query,
    requests,
    requests_sql,
    rounded,
    trace_events,
)
from blocktrace.catalog.place import ASSIGNED
from blocktrace.catalog.trace import ALL_WRITES, RULE, RULE_CUT
from blocktrace.plans.storage import new_folder
from blocktrace.streaming import streams

SLICES = 4


class Replay:
    """Tables fed to a stream slice by slice, in the order of a column.

    Each slice arrives as new files and is processed before the next one is
    written, as if the trace were growing.
    """

    def __init__(self, order: str, **tables: DataFrame) -> None:
        self.order = order
        self.tables = tables
        self.spark = next(iter(tables.values())).sparkSession
        self.paths = {name: new_folder(self.spark, name) for name in tables}
        self.log = new_folder(self.spark, "log")
        self.dropped = 0
        for name, table in tables.items():
            table.limit(0).write.parquet(self.paths[name])

    def stream(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(self.tables[name].schema).parquet(self.paths[name])

    def run(self, writer) -> None:
        """Process every slice with the same query and checkpoint."""
        edges = [t.agg(F.min(self.order).alias("a"), F.max(self.order).alias("b")).first()
                 for t in self.tables.values()]
        low, high = min(e["a"] for e in edges), max(e["b"] for e in edges)
        cuts = [low + (high - low) * i // SLICES for i in range(1, SLICES)]
        bounds = [None, *cuts, None]
        for start, stop in zip(bounds, bounds[1:]):
            for name, table in self.tables.items():
                if start is not None:
                    table = table.filter(F.col(self.order) >= start)
                if stop is not None:
                    table = table.filter(F.col(self.order) < stop)
                table.write.mode("append").parquet(self.paths[name])
            self.once(writer)

    def once(self, writer) -> None:
        """Process what has arrived.

        Each partition of a state writes files in every micro-batch, so there are no more of them than cores.
        """
        setting, cores = "spark.sql.shuffle.partitions", self.spark.sparkContext.defaultParallelism
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(min(int(before), cores)))
        try:
            running = writer.option("checkpointLocation", self.log).trigger(availableNow=True).start()
            running.awaitTermination()
        finally:
            self.spark.conf.set(setting, before)
        # Rows that came after the watermark had passed them.
        self.dropped += sum(state["numRowsDroppedByWatermark"] for progress in running.recentProgress
                            for state in progress["stateOperators"])

    def collect_append(self, stream: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "sink")
        self.run(stream.writeStream.format("parquet").option("path", path).outputMode("append"))
        return self.spark.read.schema(stream.schema).parquet(path)


@query("st1_normalize_stream", f"""WITH {requests_sql()}, {checked_sql('req', "'F'")},
rows_ AS (SELECT trace_id, raw_ts, operation, unnest(range(first_block, last_block + 1)) AS lba FROM chk WHERE reject_reason IS NULL)
SELECT trace_id, raw_ts AS timestamp, lba, operation, count(*) AS n FROM rows_ GROUP BY ALL""")
def st1(spark: SparkSession, folder: str) -> DataFrame:
    source = Replay("l_orderkey", requests=requests(spark, folder))
    rows = source.collect_append(streams.normalize_stream(source.stream("requests"), "F", CAP, SOURCE_ORDER))
    return rows.groupBy("trace_id", "timestamp", "lba", "operation").agg(F.count(F.lit(1)).alias("n"))


@query("st2_rule_temperature_stream", f"""WITH {TRACE}, {ALL_WRITES}, {RULE}
SELECT trace_id, lba, timestamp, seq, history, round(mean_interval, 1) AS mean_interval,
       CASE WHEN mean_interval IS NULL THEN 'UNKNOWN' WHEN mean_interval <= {RULE_CUT} THEN 'HOT' ELSE 'COLD' END AS temperature
FROM ruled""")
def st2(spark: SparkSession, folder: str) -> DataFrame:
    writes = trace_events(spark, folder).filter(F.col("operation") == "W")
    source, out = Replay("seq", writes=writes), new_folder(spark, "temperature")
    source.run(streams.rule_temperature_stream(source.stream("writes"), out, RULE_CUT, MIN_HISTORY))
    return rounded(streams.read_temperature(spark, out), 1, "mean_interval")


@query("st3_assign_predictions_stream", f"""WITH {SAMPLES}, {PREDICTIONS}, {ASSIGNED}
SELECT trace_id, timestamp, lba, seq, round(predicted_rewrite_interval, 3) AS predicted_rewrite_interval, temperature
FROM assigned WHERE seq >= 0""")
def st3(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides arrive slice by slice; a far later row on either side closes all waits."""
    writes = trace_events(spark, folder).filter(F.col("operation") == "W").select("trace_id", "timestamp", "lba", "seq")
    made = predictions(spark, folder).withColumn("order", F.col("occ"))
    closing = writes.groupBy("trace_id").agg((F.max("timestamp") + 10**11).alias("timestamp")).select(
        "trace_id", "timestamp", F.lit(-1).cast("long").alias("lba"), F.lit(-1).cast("long").alias("seq"))
    source = Replay("timestamp", writes=writes.unionByName(closing),
                    predictions=made.unionByName(closing.drop("seq"), allowMissingColumns=True))
    joined = streams.assign_predictions_stream(source.stream("writes"), source.stream("predictions"), order="order")
    return rounded(source.collect_append(joined), 3, "predicted_rewrite_interval").filter(F.col("seq") >= 0)


@query("st4_write_rate_stream", f"""WITH {TRACE}
SELECT trace_id, (timestamp // 3600000000) * 3600000000 AS window_start, count(*) AS writes
FROM writes GROUP BY ALL""")
def st4(spark: SparkSession, folder: str) -> DataFrame:
    """A write far later than all others closes the last windows; its own stays open."""
    trace = trace_events(spark, folder)
    closing = trace.groupBy("trace_id").agg((F.max("timestamp") + 10**12).alias("timestamp"), F.max("seq").alias("seq")).select(
        "timestamp", F.lit(-1).cast("long").alias("lba"), F.lit(1).alias("size"), F.lit("W").alias("operation"), "trace_id", "seq")
    source = Replay("seq", trace=trace.unionByName(closing))
    return source.collect_append(streams.write_rate_stream(source.stream("trace"), "1 hour", "1 day"))


@query("st5_disorder_stream", """WITH e AS (
  SELECT event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (ORDER BY event_id) AS p, event_id % 10 = 9 AS moved,
         lag(event_id % 10 = 9) OVER (ORDER BY event_id) AS p_moved FROM events),
x AS (SELECT CASE WHEN moved THEN t - 3600000000 ELSE t END AS t, CASE WHEN p_moved THEN p - 3600000000 ELSE p END AS p FROM e)
SELECT 'events' AS trace_id, count(*) FILTER (t < p) AS out_of_order_rows FROM x""")
def st5(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth row is moved an hour back."""
    trace = trace_events(spark, folder).withColumn(
        "timestamp", F.when(F.col("seq") % 10 == 9, F.col("timestamp") - 3_600_000_000).otherwise(F.col("timestamp")))
    out = new_folder(spark, "disorder")
    source = Replay("seq", trace=trace)
    source.run(streams.disorder_stream(source.stream("trace"), out))
    return streams.read_disorder(spark, out)
