"""Query registry, and the given tables seen as traces, requests and runs.

Each registered query runs over whole tables. Its SQL, when there is one, is a
full statement over the same tables; the shared parts are the constants below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktrace.functions.windows import median_interval
from blocktrace.operators.clean import Limits, check_requests
from blocktrace.operators.evaluate import predict_all
from blocktrace.operators.intervals import build_sequences
from blocktrace.operators.splits import chronological_split, hot_threshold
from blocktrace.plans.storage import attach, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LENGTH = 5
MIN_HISTORY = 5
PERCENTILE = 30.0
CAP = Limits(max_blocks=6)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Times in the given tables carry no zone; reading them as UTC matches the SQL.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def r(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


# -- events as a normalized trace ------------------------------------------

def _events(spark: SparkSession, folder: str, trace_id: Column) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.lit("events").alias("_source"), micros("ts").alias("_ts"), F.col("user_id").alias("lba"),
        F.lit(1).alias("size"),
        F.when(F.col("event_type") == "view", "R").otherwise("W").alias("operation"),
        trace_id.alias("trace_id"), F.col("event_id").alias("seq"))
    start = events.groupBy("_source").agg(F.min("_ts").alias("_start"))
    return attach(events, start, ["_source"]).select(
        (F.col("_ts") - F.col("_start")).alias("timestamp"), "lba", "size", "operation", "trace_id", "seq")


def trace_events(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder, F.lit("events"))


def trace_multi(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as three traces."""
    return _events(spark, folder, F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")))


def _trace_sql(trace_id: str) -> str:
    return f"""trace AS (
  SELECT epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS timestamp, user_id AS lba,
         1 AS size, CASE WHEN event_type = 'view' THEN 'R' ELSE 'W' END AS operation,
         {trace_id} AS trace_id, event_id AS seq
  FROM events),
writes AS (SELECT * FROM trace WHERE operation = 'W')"""


TRACE = _trace_sql("'events'")
MULTI = _trace_sql("'t' || (user_id % 3)")

INTERVALS = """iv AS (
  SELECT trace_id, lba, timestamp, seq,
         timestamp - lag(timestamp) OVER w AS interval,
         row_number() OVER w - 2 AS position
  FROM writes WINDOW w AS (PARTITION BY trace_id, lba ORDER BY timestamp, seq)
  QUALIFY row_number() OVER w > 1)"""


def sequences_sql(length: int = LENGTH) -> str:
    return f"""smp AS (
  SELECT trace_id, lba, timestamp, position, interval::DOUBLE AS target,
         list(interval::DOUBLE) OVER (PARTITION BY trace_id, lba ORDER BY position
              ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING) AS inputs
  FROM iv QUALIFY position >= {length})"""


SPLIT = """ranked AS (
  SELECT *, rank() OVER (PARTITION BY trace_id ORDER BY timestamp) - 1 AS earlier,
         count(*) OVER (PARTITION BY trace_id) AS total FROM smp),
sp AS (
  SELECT trace_id, lba, timestamp, position, inputs, target,
         CASE WHEN earlier < round_even(0.70::DOUBLE * total, 0) THEN 'train'
              WHEN earlier < round_even((0.70::DOUBLE + 0.15::DOUBLE) * total, 0) THEN 'val'
              ELSE 'test' END AS split FROM ranked)"""

THRESHOLD = """thr AS (
  SELECT trace_id, quantile_cont(target, 0.3) AS hot_threshold FROM sp
  WHERE split = 'train' GROUP BY trace_id)"""

SAMPLES = f"{TRACE}, {INTERVALS}, {sequences_sql()}, {SPLIT}, {THRESHOLD}"
MULTI_SAMPLES = f"{MULTI}, {INTERVALS}, {sequences_sql()}, {SPLIT}, {THRESHOLD}"

BASELINE_COLUMNS = {
    "last_interval": "inputs[5]",
    "mean_interval": "list_sum(inputs) / 5",
    "median_interval": "list_sort(inputs)[3]",
    "moving_average_3": "(inputs[3] + inputs[4] + inputs[5]) / 3",
    "ema_0.5": "(inputs[5] / 2 + inputs[4] / 4 + inputs[3] / 8 + inputs[2] / 16 + inputs[1] / 32)"
               " / (1 - 1 / 32::DOUBLE)",
}


def predicted_sql(source: str, where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"SELECT trace_id, lba, timestamp, position, target, '{name}' AS predictor,"
        f" ({expression})::DOUBLE AS predicted FROM {source} WHERE {where}"
        for name, expression in BASELINE_COLUMNS.items())


LABELLED = """lab AS (
  SELECT g.*, hot_threshold, target <= hot_threshold AS actual_hot,
         predicted <= hot_threshold AS predicted_hot
  FROM guess g JOIN thr USING (trace_id))"""
SCORED = f"""guess AS ({predicted_sql('sp', "split = 'test'")}),
{LABELLED}"""

# -- exact metrics in SQL, over `lab` ---------------------------------------

#: Millionths as whole numbers: sums are exact, and a half of a tenth is rounded up like Spark does.
MILLIONTHS = "sum((abs(predicted - target)::VARCHAR::DECIMAL(30, 6) * 1000000)::HUGEINT)"
REGRESSION_COLUMNS = f"""((20 * {MILLIONTHS} + 1000000 * count(*)) // (2000000 * count(*)))::DOUBLE / 10 AS mae_us,
       round(sqrt(avg((predicted - target) * (predicted - target))), 1) AS rmse_us,
       round(quantile_cont(abs(predicted - target), 0.5), 1) AS median_abs_error_us,
       round(avg(abs(ln(1 + greatest(predicted, 0)) - ln(1 + greatest(target, 0)))), 6) AS mae_log1p"""

CONFUSION = """conf AS (
  SELECT trace_id, predictor, count(*) AS n,
         count(*) FILTER (actual_hot AND predicted_hot) AS true_positives,
         count(*) FILTER (NOT actual_hot AND predicted_hot) AS false_positives,
         count(*) FILTER (NOT actual_hot AND NOT predicted_hot) AS true_negatives,
         count(*) FILTER (actual_hot AND NOT predicted_hot) AS false_negatives
  FROM lab GROUP BY ALL),
rates AS (
  SELECT *, (true_positives + true_negatives) / n AS accuracy,
         coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS precision,
         coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS recall,
         (true_positives + false_negatives) / n AS actual_hot_fraction,
         (true_positives + false_positives) / n AS predicted_hot_fraction
  FROM conf),
cls AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates)"""

AUC = """hist AS (
  SELECT trace_id, predictor, predicted, count(*) FILTER (actual_hot) AS hot,
         count(*) FILTER (NOT actual_hot) AS cold FROM lab GROUP BY ALL),
cum AS (
  SELECT *, sum(hot) OVER (PARTITION BY trace_id, predictor ORDER BY predicted) AS upto FROM hist),
auc AS (
  SELECT trace_id, predictor,
         (sum(cold * (upto - hot / 2)) / nullif(sum(hot)::DOUBLE * sum(cold), 0))::DOUBLE AS roc_auc
  FROM cum GROUP BY ALL)"""

REGRESSION = f"""reg AS (
  SELECT trace_id, predictor, count(*) AS test_samples, {REGRESSION_COLUMNS}
  FROM lab GROUP BY ALL)"""

SCORES = f"{SCORED}, {REGRESSION}, {CONFUSION}, {AUC}"


def split_samples(spark: SparkSession, folder: str, multi: bool = False) -> DataFrame:
    trace = (trace_multi if multi else trace_events)(spark, folder)
    return chronological_split(build_sequences(trace, LENGTH))


# -- predictions over the events trace --------------------------------------

def predictions(spark: SparkSession, folder: str, duplicates: bool = True, multi: bool = False,
                trace: DataFrame | None = None) -> DataFrame:
    """Median-of-window predictions; every tenth block repeats its rows with the class flipped.

    They are for the events as one trace or, if `multi`, as three; or for a settled `trace`.
    """
    # Split samples are stored rows joined with a few cuts: cheap to read twice.
    samples = split_samples(spark, folder, multi) if trace is None else chronological_split(build_sequences(trace, LENGTH))
    guessed = predict_all(samples, {"median_interval": median_interval})
    made = attach(guessed, hot_threshold(samples, PERCENTILE), ["trace_id"]).select(
        "trace_id", "timestamp", "lba", F.col("predicted").alias("predicted_rewrite_interval"),
        F.when(F.col("predicted") <= F.col("hot_threshold"), "HOT").otherwise("COLD")
        .alias("predicted_class"), F.lit(0).alias("occ"))
    if not duplicates:
        return made
    flipped = F.when(F.col("predicted_class") == "HOT", "COLD").otherwise("HOT")
    once = F.struct("predicted_class", "occ")
    twice = F.array(once, F.struct(flipped.alias("predicted_class"), F.lit(1).alias("occ")))
    rows = F.when(F.col("lba") % 10 == 0, twice).otherwise(F.array(once))
    return made.select("trace_id", "timestamp", "lba", "predicted_rewrite_interval", F.inline(rows))


PREDICTIONS = """made AS (
  SELECT trace_id, timestamp, lba, list_sort(inputs)[3] AS predicted_rewrite_interval,
         CASE WHEN list_sort(inputs)[3] <= hot_threshold THEN 'HOT' ELSE 'COLD' END AS predicted_class,
         0 AS occ
  FROM sp JOIN thr USING (trace_id)),
pred AS (
  SELECT * FROM made UNION ALL
  SELECT trace_id, timestamp, lba, predicted_rewrite_interval,
         CASE predicted_class WHEN 'HOT' THEN 'COLD' ELSE 'HOT' END, 1
  FROM made WHERE lba % 10 = 0)"""

# -- lineitem as raw requests -----------------------------------------------

SOURCE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def requests(spark: SparkSession, folder: str, *, dirty: bool = True,
             per_device: bool = False) -> DataFrame:
    """Requests of two devices, with bad records mixed in when `dirty`."""
    line = table(spark, folder, "lineitem")
    device = F.col("l_linestatus")
    trace = F.concat(F.lit("lineitem_"), device) if per_device else F.lit("lineitem")
    ts, offset = micros("l_shipdate"), F.col("l_suppkey") * 409600 + F.col("l_partkey") * 1000
    size = (F.col("l_quantity") * 512).cast("bigint")
    operation = F.when(F.col("l_returnflag") == "R", "R").otherwise("W")
    if dirty:
        ts = F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") < 0.02), F.lit(None)).otherwise(ts)
        offset = F.when(F.col("l_discount") > 0.095, F.lit(-1)).otherwise(offset)
        size = F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(size)
        operation = (F.when(F.col("l_tax") > 0.075, "FLUSH")
                     .when((F.col("l_tax") > 0.065) & (F.col("l_linenumber") == 1), "SYNC")
                     .when((F.col("l_tax") > 0.055) & (F.col("l_linenumber") == 2), "D")
                     .otherwise(operation))
    return line.select(trace.alias("trace_id"), ts.alias("raw_ts"), offset.alias("offset_bytes"),
                       size.alias("size_bytes"), operation.alias("operation"),
                       device.alias("device"), *SOURCE_ORDER)


def checked(spark: SparkSession, folder: str) -> DataFrame:
    return check_requests(requests(spark, folder, per_device=True), CAP)


def requests_sql(dirty: bool = True, per_device: bool = False) -> str:
    trace = "'lineitem_' || l_linestatus" if per_device else "'lineitem'"
    ts, offset = "epoch_us(l_shipdate)", "l_suppkey * 409600 + l_partkey * 1000"
    size = "CAST(l_quantity * 512 AS BIGINT)"
    operation = "CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'W' END"
    if dirty:
        ts = f"CASE WHEN l_linenumber = 6 AND l_tax < 0.02 THEN NULL ELSE {ts} END"
        offset = f"CASE WHEN l_discount > 0.095 THEN -1 ELSE {offset} END"
        size = f"CASE WHEN l_linenumber = 7 THEN 0 ELSE {size} END"
        operation = f"""CASE WHEN l_tax > 0.075 THEN 'FLUSH'
           WHEN l_tax > 0.065 AND l_linenumber = 1 THEN 'SYNC'
           WHEN l_tax > 0.055 AND l_linenumber = 2 THEN 'D' ELSE {operation} END"""
    return f"""req AS (
  SELECT {trace} AS trace_id, {ts} AS raw_ts, {offset} AS offset_bytes, {size} AS size_bytes,
         {operation} AS operation, l_linestatus AS device,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""


ORDER_SQL = ", ".join(SOURCE_ORDER)


def checked_sql(source: str = "req", device: str | None = None, cap: int = 6) -> str:
    other = f"WHEN device <> {device} THEN 'other_device'" if device else ""
    return f"""blk AS (
  SELECT *, CASE WHEN offset_bytes BETWEEN 0 AND 1125899906842624 AND size_bytes > 0 AND raw_ts IS NOT NULL
                 THEN offset_bytes // 4096 END AS first_block,
         CASE WHEN offset_bytes BETWEEN 0 AND 1125899906842624 AND size_bytes > 0 AND raw_ts IS NOT NULL
                 THEN (offset_bytes + size_bytes - 1) // 4096 END AS last_block FROM {source}),
chk AS (
  SELECT *, last_block - first_block + 1 AS n_blocks,
         CASE {other}
              WHEN raw_ts IS NULL OR offset_bytes IS NULL OR size_bytes IS NULL THEN 'malformed'
              WHEN operation NOT IN ('W', 'R', 'D') THEN 'unknown_operation'
              WHEN offset_bytes NOT BETWEEN 0 AND 1125899906842624 THEN 'bad_offset'
              WHEN size_bytes <= 0 THEN 'bad_size'
              WHEN last_block - first_block + 1 > {cap} THEN 'oversized' END AS reject_reason
  FROM blk)"""


CHECKED = f"{requests_sql(per_device=True)}, {checked_sql()}"

# -- lineitem as a table of finished runs -----------------------------------


def runs(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    policy = (F.when(F.col("l_returnflag") == "N", "MIXED")
              .when(F.col("l_returnflag") == "R", "RULE_BASED").otherwise("PREDICTED"))
    model = (F.when(F.col("l_returnflag") == "N", "none").when(F.col("l_returnflag") == "R", "rule")
             .otherwise(F.element_at(F.array(F.lit("scratch"), F.lit("pretrained"),
                                             F.lit("pretrained_finetuned")),
                                     (F.col("l_linenumber") % 3 + 1).cast("int"))))
    blocks = F.col("l_quantity").cast("bigint")
    table_ = line.groupBy(
        F.lit("lineitem").alias("dataset"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("trace"),
        policy.alias("policy"), model.alias("model_type"),
        (F.lit(800) + 100 * (F.col("l_partkey") % 3)).alias("total_segments"),
        (F.lit(0.70) + F.lit(0.05) * (F.col("l_partkey") % 3)).alias("target_utilization")).agg(
        F.count(F.lit(1)).alias("total_write_requests"),
        (F.sum(blocks) * 4096).alias("logical_bytes_written"),
        (F.sum(blocks % 7) * 4096).alias("gc_bytes_copied"),
        F.count_if(F.col("l_linestatus") == "F").alias("_cold"),
        F.count_if(F.col("l_tax") < 0.015).alias("unpredicted_writes"))
    cold = F.when(F.col("policy") == "MIXED", 0).otherwise(F.col("_cold"))
    return table_.withColumns({
        "physical_bytes_written": F.col("logical_bytes_written") + F.col("gc_bytes_copied"),
        "valid_blocks_migrated": F.expr("gc_bytes_copied div 4096"),
        "gc_count": F.expr("gc_bytes_copied div 262144"),
        "cold_stream_writes": cold, "main_stream_writes": F.col("total_write_requests") - cold,
        "blocks_per_segment": F.lit(64), "block_size_bytes": F.lit(4096),
        "gc_reserved_segments": F.lit(2), "gc_separate_stream": F.lit(1), "seed": F.lit(42)}) \
        .withColumn("waf", F.col("physical_bytes_written") / F.col("logical_bytes_written")).drop("_cold")


RUNS = """runs0 AS (
  SELECT 'lineitem' AS dataset, 't' || (l_suppkey % 3) AS trace,
         CASE l_returnflag WHEN 'N' THEN 'MIXED' WHEN 'R' THEN 'RULE_BASED' ELSE 'PREDICTED' END AS policy,
         CASE l_returnflag WHEN 'N' THEN 'none' WHEN 'R' THEN 'rule'
              ELSE ['scratch', 'pretrained', 'pretrained_finetuned'][l_linenumber % 3 + 1] END AS model_type,
         800 + 100 * (l_partkey % 3) AS total_segments,
         0.70::DOUBLE + 0.05::DOUBLE * (l_partkey % 3) AS target_utilization,
         count(*) AS total_write_requests,
         (sum(CAST(l_quantity AS BIGINT)) * 4096)::BIGINT AS logical_bytes_written,
         (sum(CAST(l_quantity AS BIGINT) % 7) * 4096)::BIGINT AS gc_bytes_copied,
         count(*) FILTER (l_linestatus = 'F') AS cold,
         count(*) FILTER (l_tax < 0.015) AS unpredicted_writes
  FROM lineitem GROUP BY ALL),
runs AS (
  SELECT * EXCLUDE (cold), logical_bytes_written + gc_bytes_copied AS physical_bytes_written,
         gc_bytes_copied // 4096 AS valid_blocks_migrated, gc_bytes_copied // 262144 AS gc_count,
         CASE policy WHEN 'MIXED' THEN 0 ELSE cold END AS cold_stream_writes,
         total_write_requests - CASE policy WHEN 'MIXED' THEN 0 ELSE cold END AS main_stream_writes,
         64 AS blocks_per_segment, 4096 AS block_size_bytes, 2 AS gc_reserved_segments,
         1 AS gc_separate_stream, 42 AS seed,
         (logical_bytes_written + gc_bytes_copied) / logical_bytes_written AS waf
  FROM runs0)"""

MIXED_BASE = """base AS (
  SELECT trace, round_even(target_utilization * 100, 1) AS utilization_pct,
         arg_min(waf, total_segments) AS mixed_waf,
         arg_min(valid_blocks_migrated, total_segments) AS mixed_migrated,
         arg_min(gc_bytes_copied, total_segments) AS mixed_gc
  FROM runs WHERE policy = 'MIXED' GROUP BY ALL)"""

CONFIGURATION = """CASE WHEN policy <> 'PREDICTED' THEN policy
     WHEN model_type = 'scratch' THEN 'LSTM scratch'
     WHEN model_type = 'pretrained' THEN 'LSTM pretrained'
     WHEN model_type = 'pretrained_finetuned' THEN 'LSTM pretrained+finetuned'
     ELSE 'LSTM ' || model_type END"""
