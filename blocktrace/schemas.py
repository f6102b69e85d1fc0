"""Fixed column contracts. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["trace_id"]
LBA_KEY = ["trace_id", "lba"]
TRACE_ORDER = ["timestamp", "seq"]
RAW_ORDER = ["file_index", "block_start", "line_id"]
SAMPLE_ORDER = ["timestamp", "lba", "position"]

OPERATIONS = ["W", "R", "D"]
#: Name of the policy that follows predictions, unless a run table says otherwise.
PREDICTED_POLICY = "PREDICTED"

NORMALIZED = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("lba", T.LongType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("trace_id", T.StringType()),
])

REQUEST = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("raw_ts", T.LongType()),
    T.StructField("offset_bytes", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("operation", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("file_index", T.IntegerType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("line_id", T.LongType()),
])

PREDICTION = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("lba", T.LongType()),
    T.StructField("predicted_rewrite_interval", T.DoubleType()),
    T.StructField("predicted_class", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("trace_id", T.StringType()),
])

RUN = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("trace", T.StringType()),
    T.StructField("policy", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("total_segments", T.LongType()),
    T.StructField("blocks_per_segment", T.LongType()),
    T.StructField("block_size_bytes", T.LongType()),
    T.StructField("gc_reserved_segments", T.LongType()),
    T.StructField("gc_separate_stream", T.IntegerType()),
    T.StructField("target_utilization", T.DoubleType()),
    T.StructField("seed", T.LongType()),
    T.StructField("total_write_requests", T.LongType()),
    T.StructField("logical_bytes_written", T.LongType()),
    T.StructField("physical_bytes_written", T.LongType()),
    T.StructField("gc_bytes_copied", T.LongType()),
    T.StructField("valid_blocks_migrated", T.LongType()),
    T.StructField("gc_count", T.LongType()),
    T.StructField("main_stream_writes", T.LongType()),
    T.StructField("cold_stream_writes", T.LongType()),
    T.StructField("unpredicted_writes", T.LongType()),
    T.StructField("waf", T.DoubleType()),
])
