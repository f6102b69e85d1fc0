"""Scans and sinks of the normalized trace, prediction, run and statistics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocktrace.plans.ordered import with_ordinal
from blocktrace.schemas import KEY, NORMALIZED, OPERATIONS, PREDICTION, RAW_ORDER, RUN
from blocktrace.sources.raw import place_files


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


TRACE_TEXT = _text_schema(["timestamp", "lba", "size", "operation", "trace_id"])
PREDICTION_TEXT = _text_schema([f.name for f in PREDICTION.fields])


def read_text_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header that must name the contract's columns; all values text.

    File, split of the file and ``line_id`` keep the order of the rows.
    """
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"),
                         F.col("_metadata.file_block_start").alias("block_start"),
                         F.monotonically_increasing_id().alias("line_id"))
    return place_files(placed, spark, path)


def _whole(name: str) -> Column:
    return F.trim(name).try_cast("bigint")


def check_trace(rows: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to normalized rows given as text."""
    ts, lba, size = _whole("timestamp"), _whole("lba"), _whole("size")
    reason = (F.when(ts.isNull() | (ts < 0) | lba.isNull(), "malformed")
              .when(lba < 0, "negative_lba")
              .when(size.isNull() | (size <= 0), "malformed")
              .when(size != 1, "non_unit_size")
              .when(~F.coalesce(F.trim("operation").isin(OPERATIONS), F.lit(False)), "unknown_operation"))
    return rows.withColumn("reject_reason", reason)


def typed_trace(checked: DataFrame) -> DataFrame:
    """Rows that passed, in the types of the contract; `seq` numbers them in file order."""
    # Typed before they are put in order: numbers take less memory there than their text.
    good = checked.filter(F.col("reject_reason").isNull()).select(
        _whole("timestamp").alias("timestamp"), _whole("lba").alias("lba"),
        F.trim("operation").alias("operation"), "trace_id", *RAW_ORDER)
    return with_ordinal(good, KEY, RAW_ORDER, "seq").select(
        "timestamp", "lba", F.lit(1).alias("size"), "operation", "seq", "trace_id")


def check_predictions(rows: DataFrame) -> DataFrame:
    """Add ``reject_reason``; an unreadable label is never taken for COLD."""
    ts, lba = _whole("timestamp"), _whole("lba")
    interval = F.trim("predicted_rewrite_interval").try_cast("double")
    named = F.trim("predicted_class").isin("HOT", "COLD", "1", "0")
    reason = (F.when(ts.isNull() | (ts < 0) | lba.isNull() | (lba < 0) | interval.isNull(), "malformed")
              .when(~F.coalesce(named, F.lit(False)), "unknown_class"))
    return rows.withColumn("reject_reason", reason)


def typed_predictions(checked: DataFrame) -> DataFrame:
    """Usable predictions with labels 1 and 0 spelled HOT and COLD."""
    text = F.trim("predicted_class")
    good = checked.filter(F.col("reject_reason").isNull())
    return good.select(
        _whole("timestamp").alias("timestamp"), _whole("lba").alias("lba"),
        F.trim("predicted_rewrite_interval").try_cast("double").alias("predicted_rewrite_interval"),
        F.when(text == "1", "HOT").when(text == "0", "COLD").otherwise(text).alias("predicted_class"),
        "model_version", "trace_id", "line_id")


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("trace_id", F.coalesce("reject_reason", F.lit("ok")).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("records"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Normalized Parquet table; filters on trace_id prune folders."""
    return spark.read.schema(NORMALIZED).parquet(path)


def write_trace(trace: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per workload.

    Rows are spread by time ranges inside each workload, so a single large
    workload is written by many tasks.
    """
    columns = [f.name for f in NORMALIZED.fields]
    (trace.select(*columns).repartitionByRange("trace_id", "timestamp", "seq")
     .sortWithinPartitions("trace_id", "timestamp", "seq")
     .write.mode(mode).partitionBy("trace_id").parquet(path))


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chronological files with the interval rounded to three decimals."""
    columns = [f.name for f in PREDICTION.fields]
    rounded = predictions.withColumn(
        "predicted_rewrite_interval", F.bround("predicted_rewrite_interval", 3)).select(*columns)
    (rounded.repartitionByRange("trace_id", "timestamp", "lba")
     .sortWithinPartitions("trace_id", "timestamp", "lba").write.mode(mode).parquet(path))


def append_runs(runs: DataFrame, path: str) -> None:
    """Add finished runs; the columns are fixed by the contract."""
    runs.select(*[F.col(f.name).cast(f.dataType) for f in RUN.fields]).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(path)


def write_statistics(statistics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    statistics.write.mode(mode).json(path)


def read_statistics(spark: SparkSession, path: str, schema: T.StructType,
                    multi_line: bool = False) -> DataFrame:
    """A folder of statistics documents, one object per line or per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_inventory(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table.write.mode(mode).option("header", True).csv(path)
