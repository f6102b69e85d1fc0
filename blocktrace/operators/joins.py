"""Writes joined with their predictions, and set checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.plans.ordered import ordered_columns
from blocktrace.plans.storage import settle
from blocktrace.schemas import KEY

WRITE_KEY = ["trace_id", "timestamp", "lba"]


def assign_predictions(writes: DataFrame, predictions: DataFrame, order: list[str]) -> DataFrame:
    """Each write with its temperature; a prediction serves one write.

    Of several predictions for a key the first (by `order`) is kept, and the
    first write of the key takes it; other writes are UNKNOWN. Both "firsts"
    are aggregations, so a key repeated without limit is reduced before the
    shuffle, and the final join key contains `seq` and cannot be skewed.
    """
    chosen = predictions.groupBy(*WRITE_KEY).agg(F.min_by(
        F.struct("predicted_rewrite_interval", "predicted_class"),
        F.struct(*order)).alias("_p"))
    takers = writes.groupBy(*WRITE_KEY).agg(F.min("seq").alias("seq"))
    matched = takers.join(chosen, WRITE_KEY).select(
        "trace_id", "timestamp", "lba", "seq", "_p.predicted_rewrite_interval",
        F.col("_p.predicted_class").alias("temperature"))
    return (writes.join(matched, [*WRITE_KEY, "seq"], "left")
            .withColumn("temperature", F.coalesce("temperature", F.lit("UNKNOWN"))))


def prediction_audit(writes: DataFrame, checked: DataFrame) -> DataFrame:
    """How predictions met writes, one row per trace.

    `checked` is a prediction table with ``reject_reason``. A repeated key is a
    duplicate only at an instant some write asked for; elsewhere it is unmatched.
    A trace known from any of the two tables has a row.
    """
    writes = settle(writes.select(*WRITE_KEY, "seq"), "writes")
    valid = checked.filter(F.col("reject_reason").isNull())
    offered = settle(valid.groupBy(*WRITE_KEY).agg(F.count(F.lit(1)).alias("_p")), "offered")
    asked = writes.groupBy(*WRITE_KEY).agg(F.count(F.lit(1)).alias("_w"))
    instants = writes.select("trace_id", "timestamp").distinct()
    both = asked.join(offered, WRITE_KEY, "full").groupBy("trace_id").agg(
        F.coalesce(F.sum("_w"), F.lit(0)).alias("lookups"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("_valid"),
        F.count_if(F.col("_w").isNotNull() & F.col("_p").isNotNull()).alias("rows_matched"))
    repeats = (offered.filter(F.col("_p") > 1)
               .join(instants, ["trace_id", "timestamp"], "left_semi")
               .groupBy("trace_id").agg(F.sum(F.col("_p") - 1).alias("duplicate_key_rows")))
    rows = checked.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("reject_reason") == "malformed").alias("malformed_rows"),
        F.count_if(F.col("reject_reason") == "unknown_class").alias("unknown_class_rows"))
    late = ordered_columns(writes.select("trace_id", "seq", "timestamp"), KEY, ["seq"],
                           past={"_before": ("timestamp", 1)})
    disorder = late.groupBy("trace_id").agg(F.coalesce(F.bool_or(
        F.col("timestamp") < F.try_element_at("_before", F.lit(1))), F.lit(False))
        .alias("out_of_order_input"))
    # Both cover writes and usable predictions; rows also covers traces with rejects only.
    table = both.join(rows, "trace_id", "full")
    for part in (repeats, disorder):
        table = table.join(part, "trace_id", "left")
    zero = F.lit(0).cast("long")
    table = table.fillna(0, ["lookups", "_valid", "rows_matched"])
    duplicates = F.coalesce("duplicate_key_rows", zero)
    return table.select(
        "trace_id", F.coalesce("rows_read", zero).alias("rows_read"), "rows_matched", "lookups",
        (F.col("lookups") - F.col("rows_matched")).alias("lookup_misses"),
        (F.col("_valid") - F.col("rows_matched") - duplicates).alias("unmatched_predictions"),
        duplicates.alias("duplicate_key_rows"),
        F.coalesce("malformed_rows", zero).alias("malformed_rows"),
        F.coalesce("unknown_class_rows", zero).alias("unknown_class_rows"),
        F.coalesce("out_of_order_input", F.lit(False)).alias("out_of_order_input"))


def keys_without_write(predictions: DataFrame, writes: DataFrame) -> DataFrame:
    """Prediction keys that no write has; empty for a sound prediction table."""
    asked = writes.select(*WRITE_KEY).distinct()
    return predictions.select(*WRITE_KEY).distinct().join(asked, WRITE_KEY, "left_anti")


def overlap(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows two sets share; empty when they are disjoint."""
    return left.select(*columns).intersect(right.select(*columns))


def union_tables(*tables: DataFrame) -> DataFrame:
    """Result tables stacked by column name; absent columns become null."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first
