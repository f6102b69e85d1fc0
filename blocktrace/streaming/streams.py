"""Structured Streaming forms of the trace operators.

Micro-batches are sized by the source (``maxFilesPerTrigger`` and the like),
which also bounds the rows one key can bring into a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from blocktrace.operators.clean import Limits, accepted, check_requests, expand_blocks
from blocktrace.plans.ordered import ordered_columns
from blocktrace.plans.storage import settle
from blocktrace.schemas import KEY, RAW_ORDER


def normalize_stream(requests: DataFrame, device: str | None = None,
                     limits: Limits = Limits(), order: list[str] = RAW_ORDER) -> DataFrame:
    """Validated block rows of a request stream.

    Only an explicit device can be selected, since the other policies need a
    full count, and times stay unrebased, since the first one is not known.
    """
    if device in ("auto", "dominant"):
        raise ValueError("a stream needs an explicit device")
    if device is not None:
        requests = requests.withColumn("device_selected", F.lit(device))
    kept = [c for c in order if c in requests.columns]
    return expand_blocks(accepted(check_requests(requests, limits))).select(
        F.col("raw_ts").alias("timestamp"), "lba", F.lit(1).alias("size"), "operation",
        "trace_id", *kept, "block_index")


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that an earlier micro-batch wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class VersionedState:
    """Keyed state of a stream as one Parquet table per micro-batch.

    Batch `n` reads version ``n - 1`` and writes version `n`, so a batch that is
    run again sees and leaves the same tables. Versions before the last one are
    of no use to any replay and are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema

    def path(self, batch: int) -> str:
        return f"{self.folder}/state/batch={batch}"

    def before(self, batch: int) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(batch - 1))

    def write(self, table: DataFrame, batch: int) -> DataFrame:
        table.write.mode("overwrite").parquet(self.path(batch))
        if batch > 1:
            _drop(self.spark, self.path(batch - 2))
        return self.spark.read.schema(self.schema).parquet(self.path(batch))


BLOCK = ["trace_id", "lba"]
BLOCK_STATE = "trace_id string, lba long, last_ts long, intervals long, total long"
TEMPERATURE = ("trace_id string, lba long, timestamp long, seq long, history long, "
               "mean_interval double, temperature string")


def rule_temperature_batch(writes: DataFrame, batch: int, folder: str, threshold: float, min_history: int) -> DataFrame:
    """Temperature of the writes of one micro-batch from the running mean of their block's intervals.

    State per block: last write time, number of intervals, their sum. A write is
    classified before it is counted. A time below the last one adds no interval.
    Within the batch a block's rows are ordered in chunks, so that a hot block
    is many tasks; state comes in by a join and goes out as the next version.
    """
    state = VersionedState(writes.sparkSession, folder, BLOCK_STATE)
    near = ordered_columns(writes.select("trace_id", "lba", "timestamp", "seq"), BLOCK, ["seq"],
                           past={"_before": ("timestamp", 1)})
    last = F.coalesce(F.try_element_at("_before", F.lit(1)), F.col("last_ts"))
    gap = F.col("timestamp") - last
    counted = F.coalesce(gap >= 0, F.lit(False))
    joined = settle(near.join(state.before(batch), BLOCK, "left").select(
        *BLOCK, "timestamp", "seq", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"_{c}") for c in ("intervals", "total")],
        counted.cast("long").alias("_one"), F.when(counted, gap).otherwise(0).cast("long").alias("_gap")), "gaps")
    grown = joined.groupBy(*BLOCK).agg(F.max_by("timestamp", "seq").alias("_last"), F.sum("_one").alias("_more"),
                                       F.sum("_gap").alias("_sum"))
    merged = state.before(batch).join(grown, BLOCK, "full").select(
        *BLOCK, F.coalesce("_last", "last_ts").alias("last_ts"),
        *[(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).cast("long").alias(old)
          for old, new in (("intervals", "_more"), ("total", "_sum"))])
    state.write(merged, batch)
    summed = ordered_columns(joined, BLOCK, ["seq"], running={"_n": F.col("_one"), "_time": F.col("_gap")})
    history = (F.col("_intervals") + F.col("_n")).cast("long")
    mean = F.when(history >= min_history, (F.col("_total") + F.col("_time")).cast("double") / history)
    return summed.select(
        *BLOCK, "timestamp", "seq", history.alias("history"), mean.alias("mean_interval"),
        F.when(mean.isNull(), "UNKNOWN").when(mean <= threshold, "HOT").otherwise("COLD").alias("temperature"))


def rule_temperature_stream(writes: DataFrame, folder: str, threshold: float, min_history: int) -> DataStreamWriter:
    """Writer that classifies the writes of a stream into ``folder/temperature``; read them by ``read_temperature``."""
    if min_history < 1:
        raise ValueError("min_history must be >= 1")

    def classify(rows: DataFrame, batch: int) -> None:
        rule_temperature_batch(rows, batch, folder, threshold, min_history) \
            .write.mode("overwrite").parquet(f"{folder}/temperature/batch={batch}")

    return writes.writeStream.foreachBatch(classify)


def read_temperature(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TEMPERATURE + ", batch long").parquet(f"{folder}/temperature").drop("batch")


#: Event time of timestamp 0: one day after the epoch. A row at the initial watermark (time zero) counts as late.
CLOCK_START_US = 86_400_000_000


def assign_predictions_stream(writes: DataFrame, predictions: DataFrame, order: str,
                              delay: str = "1 hour") -> DataFrame:
    """Writes and predictions joined as both arrive, one prediction per write.

    The first prediction of a (trace, time, block) key in `order` serves the
    first write of the key; all other writes are UNKNOWN. Both sides are one
    stream, aggregated by key, so there is a single state: a row per key with
    its best offer and its writes. It waits until the watermark, `delay` behind
    the newest times of the slower side, has passed the time of the key, and
    then leaves the state. A row that comes later than that is dropped, and
    counted as such in the progress of the query; a late prediction leaves its
    write UNKNOWN.
    """
    key = ["trace_id", "timestamp", "lba", "event_time"]

    def timed(rows: DataFrame) -> DataFrame:
        clock = F.timestamp_micros(F.col("timestamp") + CLOCK_START_US)
        return rows.withColumn("event_time", clock).withWatermark("event_time", delay)

    offer = F.struct(order, "predicted_rewrite_interval", "predicted_class")
    asked = timed(writes).select(*key, F.struct("seq").alias("_write"))
    # A key with a null matches nothing.
    offered = timed(predictions).dropna(subset=["trace_id", "lba"]).select(*key, offer.alias("_offer"))
    met = asked.unionByName(offered, allowMissingColumns=True).groupBy(*key).agg(
        F.collect_list("_write").alias("_writes"), F.min("_offer").alias("_offer"))
    placed = met.select(*key, "_offer", F.array_min("_writes.seq").alias("_first"), F.inline("_writes"))
    served = F.when(F.col("seq") == F.col("_first"), F.col("_offer"))
    return placed.select("trace_id", "timestamp", "lba", "seq",
                         served["predicted_rewrite_interval"].alias("predicted_rewrite_interval"),
                         F.coalesce(served["predicted_class"], F.lit("UNKNOWN")).alias("temperature"))


def write_rate_stream(trace: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Writes per tumbling window; rows later than `delay` are dropped in append mode."""
    timed = trace.filter(F.col("operation") == "W").withColumn(
        "event_time", F.timestamp_micros("timestamp"))
    counts = timed.withWatermark("event_time", delay).groupBy(
        F.window("event_time", width).alias("w"), "trace_id").agg(F.count(F.lit(1)).alias("writes"))
    return counts.select("trace_id", F.unix_micros("w.start").alias("window_start"), "writes")


def disorder_batch(rows: DataFrame, batch: int, folder: str) -> DataFrame:
    """Rows per trace of one micro-batch that go back in time against the row before.

    The last time of each trace is kept as state, so the first row of a batch
    is compared with the batch before it.
    """
    spark = rows.sparkSession
    near = ordered_columns(rows.select("trace_id", "seq", "timestamp"), KEY, ["seq"],
                           past={"_before": ("timestamp", 1)})
    inside = near.groupBy("trace_id").agg(
        F.count_if(F.col("timestamp") < F.try_element_at("_before", F.lit(1))).alias("inside"),
        F.min_by("timestamp", "seq").alias("first_ts"), F.max_by("timestamp", "seq").alias("last_ts"))
    state = VersionedState(spark, folder, "trace_id string, last_ts long")
    joined = inside.join(state.before(batch).withColumnRenamed("last_ts", "before"), "trace_id", "full")
    state.write(joined.select("trace_id", F.coalesce("last_ts", "before").alias("last_ts")), batch)
    late = F.coalesce(F.col("inside"), F.lit(0)) + F.coalesce(
        (F.col("first_ts") < F.col("before")).cast("long"), F.lit(0))
    return joined.filter(F.col("inside").isNotNull()).select("trace_id", late.alias("out_of_order_rows"))


def disorder_stream(trace: DataFrame, folder: str) -> DataStreamWriter:
    """Writer that counts out-of-order rows per micro-batch into ``folder/counts``."""
    def count(rows: DataFrame, batch: int) -> None:
        disorder_batch(rows, batch, folder).write.mode("overwrite").parquet(
            f"{folder}/counts/batch={batch}")

    return trace.writeStream.foreachBatch(count)


def read_disorder(spark: SparkSession, folder: str) -> DataFrame:
    counts = spark.read.schema("trace_id string, out_of_order_rows long, batch long").parquet(f"{folder}/counts")
    return counts.groupBy("trace_id").agg(F.sum("out_of_order_rows").alias("out_of_order_rows"))
