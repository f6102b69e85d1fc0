"""Ordered chunks that keep one hot key from becoming one task.

A window over ``(trace, lba)`` or over a whole trace puts a key's rows into one
task. When a key holds a third of a large table that task never ends. So rows
are range partitioned by keys and order, and each row keeps the number of its
partition: a chunk is a run of neighbouring rows, whatever the weight of a key
or of a tied value, and chunk numbers never decrease in the row order. Chunks
are computed separately and stitched together afterwards (see ``ordered.py``).

The number of chunks follows the row count alone, not the keys: a table that one
task may order is one chunk. Where no key is heavy, whole keys are dealt to that number of tasks
instead, and there is nothing to stitch. Spark compares the columns in their own types, so
neighbouring large numbers stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting: rows one task may order by itself.
TASK_ROWS_CONF = "spark.blocktrace.taskRows"
DEFAULT_TASK_ROWS = 8_000_000

CHUNK = "_layout_chunk"


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_ROWS_CONF, str(DEFAULT_TASK_ROWS)))


def chunk_count(spark: SparkSession, rows: int) -> int:
    """Rows that one task may order are one chunk; more are cut into chunks that are half full on average.

    The bounds of chunks come from a sample, hence the other half.
    """
    most = task_rows(spark)
    return 1 if rows <= most else max(spark.sparkContext.defaultParallelism, math.ceil(2 * rows / most))


#: Sampled rows that a heavy key has on average: one of an eighth of what a task may order.
HEAVY_SEEN = 100


def heavy_key(df: DataFrame, keys: list[str]) -> bool:
    """True if a key looks too heavy to be ordered in one task beside others.

    Keys are counted in a sample, in which a heavy key has about `HEAVY_SEEN` rows. The answer
    only chooses between two layouts that give the same rows.
    """
    fraction = min(1.0, 8 * HEAVY_SEEN / task_rows(df.sparkSession))
    seen = df.select(*keys) if fraction == 1.0 else df.select(*keys).sample(fraction, seed=1)
    most = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return most / fraction > task_rows(df.sparkSession) / 8


def with_chunk(df: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """Add the number of its chunk to each row.

    Bounds are sampled anew whenever a range partitioning is planned. So the
    number has to be written down with whatever is computed per chunk, by the
    same query, before anything else may read it.
    """
    spread = df.repartitionByRange(chunks, *dict.fromkeys([*keys, *order]))
    return spread.withColumn(CHUNK, F.spark_partition_id())
