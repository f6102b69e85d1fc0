"""Readers for the public block-trace text formats.

Every reader returns one row per source line in the columns of
``schemas.REQUEST``, plus ``extra_columns`` for lines with too many fields.
Values that cannot be read as whole numbers become null and are rejected, with
a count, by ``operators.clean``. Compressed ``.gz`` and ``.bz2`` files are read
through the stock codecs; ``.bz2`` stays splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocktrace.functions.labels import (
    FIU_OPERATIONS,
    MSR_OPERATIONS,
    SYSTOR_OPERATIONS,
    map_operation,
)
from blocktrace.plans.storage import attach

# Units of the source formats.
TICKS_PER_MICROSECOND = 10
NANOSECONDS_PER_MICROSECOND = 1000
MICROSECONDS_PER_SECOND = 1_000_000
SECTOR_BYTES = 512

LINE = T.StructType([T.StructField("line", T.StringType())])
#: A character that occurs in no trace, so that a whole line is one CSV field.
NO_SEPARATOR = "\x01"


def read_lines(spark: SparkSession, paths: str | list[str], header: bool = False) -> DataFrame:
    """Non-blank lines with their place: file, split of the file, line."""
    reader = spark.read.schema(LINE).option("sep", NO_SEPARATOR).option("quote", "") \
        .option("header", header)
    lines = reader.csv(paths).select(
        "line", F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"))
    return place_files(lines, spark, paths) \
        .filter(F.length(F.trim(F.coalesce("line", F.lit("")))) > 0)


def place_files(lines: DataFrame, spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Replace the path by the place of the file in name order.

    The listing is a scan of paths alone, in the same spelling as the lines
    have them, so that lines are matched without looking into their path.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("_path")).distinct()
    # Names may be encoded; a plus sign stands for itself.
    name = F.url_decode(F.replace("_path", F.lit("+"), F.lit("%2B")))
    places = listed.select("_path", (F.row_number().over(Window.orderBy(name)) - 1).cast("int").alias("file_index"))
    joined = attach(lines, places, ["_path"], "left")
    unknown = F.raise_error(F.concat(F.lit("file is not in the listing: "), F.col("_path")))
    return joined.withColumn("file_index", F.when(F.col("file_index").isNull(), unknown.cast("int"))
                             .otherwise(F.col("file_index"))).drop("_path")


def _whole(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")


def _requests(lines: DataFrame, trace_id: Column, fields: Column, width: int, *,
              raw_ts: Column, offset: Column, size: Column, operation: Column,
              device: Column) -> DataFrame:
    return lines.withColumn("_f", fields).select(
        trace_id.alias("trace_id"), raw_ts.alias("raw_ts"), offset.alias("offset_bytes"),
        size.alias("size_bytes"), operation.alias("operation"), device.alias("device"),
        (F.size("_f") > width).alias("extra_columns"), "file_index", "block_start", "line_id")


def _field(i: int) -> Column:
    return F.try_element_at("_f", F.lit(i + 1))


def parse_msr(lines: DataFrame, trace_id: Column) -> DataFrame:
    """``Timestamp,Hostname,DiskNumber,Type,Offset,Size,ResponseTime``; 100 ns ticks.

    The published files have no header; a stray one is not a record.
    """
    lines = lines.filter(F.lower(F.trim(F.split_part("line", F.lit(","), F.lit(1)))) != "timestamp")
    return _requests(
        lines, trace_id, F.split("line", ","), 7,
        raw_ts=_div(_whole(_field(0)), TICKS_PER_MICROSECOND),
        offset=_whole(_field(4)), size=_whole(_field(5)),
        operation=map_operation(_field(3), MSR_OPERATIONS),
        device=F.concat(F.trim(_field(1)), F.lit("_"), F.trim(_field(2))))


def _div(value: Column, by: int) -> Column:
    """Whole-number division rounding down."""
    return F.floor((value - F.pmod(value, F.lit(by).cast("bigint"))).cast("decimal(20,0)") / by).cast("bigint")


def parse_fiu(lines: DataFrame, trace_id: Column) -> DataFrame:
    """``ts_ns pid process lba size op major minor md5``; nanoseconds, 512-byte sectors."""
    return _requests(
        lines, trace_id, F.split(F.trim("line"), r"\s+"), 9,
        raw_ts=_div(_whole(_field(0)), NANOSECONDS_PER_MICROSECOND),
        offset=F.try_multiply(_whole(_field(3)), F.lit(SECTOR_BYTES).cast("bigint")),
        size=F.try_multiply(_whole(_field(4)), F.lit(SECTOR_BYTES).cast("bigint")),
        operation=map_operation(_field(5), FIU_OPERATIONS),
        device=F.concat(_field(6), F.lit(":"), _field(7)))


def parse_systor(lines: DataFrame, trace_id: Column) -> DataFrame:
    """``Timestamp,Response,IOType,LUN,Offset,Size``; fractional seconds, half-even to µs."""
    seconds = F.trim(_field(0)).try_cast("double")
    micros = F.bround(seconds * F.lit(float(MICROSECONDS_PER_SECOND)))
    return _requests(
        lines, trace_id, F.split("line", ","), 6,
        raw_ts=micros.try_cast("bigint"),
        offset=_whole(_field(4)), size=_whole(_field(5)),
        operation=map_operation(_field(2), SYSTOR_OPERATIONS),
        device=F.trim(_field(3)))


def read_msr(spark: SparkSession, paths: str | list[str], trace_id: str) -> DataFrame:
    return parse_msr(read_lines(spark, paths), F.lit(trace_id))


def read_fiu(spark: SparkSession, paths: str | list[str], trace_id: str) -> DataFrame:
    return parse_fiu(read_lines(spark, paths), F.lit(trace_id))


def read_systor(spark: SparkSession, paths: str | list[str], trace_id: str) -> DataFrame:
    """Hourly files of one LUN; the first line of each file is its header."""
    return parse_systor(read_lines(spark, paths, header=True), F.lit(trace_id))


READERS = {"msr": read_msr, "fiu": read_fiu, "systor": read_systor}


def read_requests(spark: SparkSession, dataset: str, paths: str | list[str], trace_id: str) -> DataFrame:
    if dataset not in READERS:
        raise ValueError(f"unknown dataset {dataset!r}; expected one of {sorted(READERS)}")
    return READERS[dataset](spark, paths, trace_id)
