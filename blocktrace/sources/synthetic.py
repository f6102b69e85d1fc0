"""Synthetic write traces: skewed or uniform traffic over a block range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _trace(writes: DataFrame, trace_id: str) -> DataFrame:
    return writes.select(
        F.col("id").alias("timestamp"), F.col("lba").cast("long").alias("lba"),
        F.lit(1).alias("size"), F.lit("W").alias("operation"),
        F.col("id").alias("seq"), F.lit(trace_id).alias("trace_id"))


def skewed_writes(spark: SparkSession, n: int, lba_range: int, hot_ratio: float,
                  hot_traffic_ratio: float, seed: int = 42, trace_id: str = "synthetic") -> DataFrame:
    """`hot_ratio` of the blocks receive `hot_traffic_ratio` of the writes."""
    if lba_range <= 0:
        raise ValueError("lba_range must be > 0")
    if not 0.0 < hot_ratio < 1.0:
        raise ValueError("hot_ratio must be in (0, 1)")
    if not 0.0 <= hot_traffic_ratio <= 1.0:
        raise ValueError("hot_traffic_ratio must be in [0, 1]")
    hot = max(1, int(lba_range * hot_ratio))
    cold = lba_range - hot
    draw = F.floor(F.rand(seed + 1) * F.when(F.col("is_hot"), hot).otherwise(max(cold, 1)))
    writes = spark.range(n).withColumn("is_hot", (F.rand(seed) < hot_traffic_ratio) | F.lit(cold == 0)) \
        .withColumn("lba", F.when(F.col("is_hot"), draw).otherwise(draw + hot))
    return _trace(writes, trace_id)


def uniform_writes(spark: SparkSession, n: int, lba_range: int, seed: int = 42,
                   trace_id: str = "synthetic") -> DataFrame:
    if lba_range <= 0:
        raise ValueError("lba_range must be > 0")
    return _trace(spark.range(n).withColumn("lba", F.floor(F.rand(seed) * lba_range)), trace_id)
