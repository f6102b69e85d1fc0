"""Queries over raw requests, source formats and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktrace.catalog.common import (
    CAP,
    CHECKED,
    INTERVALS,
    MULTI,
    ORDER_SQL,
    PREDICTIONS,
    RUNS,
    SAMPLES,
    SOURCE_ORDER,
    TRACE,
    checked,
    checked_sql,
    micros,
    predictions,
    query,
    requests,
    requests_sql,
    rounded,
    runs,
    table,
    trace_events,
    trace_multi,
)
from blocktrace.catalog.trace import PROFILE, SUMMARY, SUMMARY_COLUMNS, TOP
from blocktrace.functions.labels import MSR_OPERATIONS, map_operation
from blocktrace.operators import clean, selection, stats
from blocktrace.plans.storage import new_folder, settle
from blocktrace.sources import raw, tables, workloads

# -- lineitem written in the source formats and read back ---------------------

#: Seconds between the start of the Windows and the Unix clock.
WINDOWS_OFFSET_US = 11_644_473_600_000_000


def _line_parts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    return line.select(
        micros("l_shipdate").alias("us"), F.col("l_linestatus").alias("device"),
        (F.col("l_suppkey") * 409600 + F.col("l_partkey") * 1000).alias("offset"),
        (F.col("l_quantity") * 512).cast("bigint").alias("size"),
        F.col("l_returnflag").alias("flag"), "l_linenumber", "l_tax", *more)


def msr_lines(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """Requests as MSR text; some lines carry odd types, bad numbers or spare columns."""
    parts = _line_parts(spark, folder, *(["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"] if ordered else []))
    if ordered:
        parts = parts.orderBy(*SOURCE_ORDER)
    kind = (F.when(F.col("flag") == "R", "Read").when(F.col("flag") == "N", " write ")
            .when(F.col("l_linenumber") == 1, "").otherwise("Flush"))
    offset = F.when((F.col("l_linenumber") == 6) & (F.col("l_tax") < 0.015), "bad") \
        .otherwise(F.col("offset").cast("string"))
    spare = F.when((F.col("l_linenumber") == 7) & (F.col("l_tax") < 0.015), ",x").otherwise("")
    return parts.select(F.concat(
        ((F.col("us") + WINDOWS_OFFSET_US) * 10 + 7).cast("string"), F.lit(",hm,"),
        F.when(F.col("device") == "F", "0").otherwise("1"), F.lit(","), kind, F.lit(","), offset,
        F.lit(","), F.col("size").cast("string"), F.lit(",100"), spare).alias("value"))


def fiu_lines(spark: SparkSession, folder: str) -> DataFrame:
    parts = _line_parts(spark, folder)
    return parts.select(F.concat_ws(
        " ", (F.col("us") * 1000 + 999).cast("string"), F.lit("2552 kjournald"),
        F.expr("cast(offset div 512 as string)"), F.expr("cast(size div 512 as string)"),
        F.when(F.col("flag") == "R", "RS").when(F.col("flag") == "N", "D").otherwise("w"),
        F.lit("6"), F.when(F.col("device") == "F", "0").otherwise("1"), F.lit("abc")).alias("value"))


def systor_lines(spark: SparkSession, folder: str) -> DataFrame:
    parts = _line_parts(spark, folder).withColumn("us", F.col("us") + F.col("l_linenumber") * 13118)
    seconds = (F.col("us").cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(26,9)")
    kind = F.when(F.col("flag") == "R", "R").when(F.col("flag") == "N", "").otherwise("W")
    return parts.select(F.concat_ws(
        ",", seconds.cast("string"), F.lit("0.001"), kind,
        F.when(F.col("device") == "F", "0").otherwise("1"),
        F.col("offset").cast("string"), F.col("size").cast("string")).alias("value"))


def _written(lines: DataFrame, suffix: str = "", header: str | None = None) -> str:
    path = new_folder(lines.sparkSession, "lines")
    if header is None:
        options = {"compression": suffix} if suffix else {}
        lines.write.options(**options).text(path)
    else:
        lines.select(F.col("value").alias(header)).write.option("header", True) \
            .option("sep", raw.NO_SEPARATOR).option("quote", "").csv(path)
    return path


READ_COLUMNS = ["raw_ts", "offset_bytes", "size_bytes", "operation", "device", "extra_columns"]


def _counted(frame: DataFrame) -> DataFrame:
    return frame.groupBy(*READ_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


MSR_SQL = f"""SELECT epoch_us(l_shipdate) + {WINDOWS_OFFSET_US} AS raw_ts,
       CASE WHEN l_linenumber = 6 AND l_tax < 0.015 THEN NULL ELSE l_suppkey * 409600 + l_partkey * 1000 END AS offset_bytes,
       CAST(l_quantity * 512 AS BIGINT) AS size_bytes,
       CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'N' THEN 'W' ELSE
            CASE WHEN l_linenumber = 1 THEN 'BLANK' ELSE 'FLUSH' END END AS operation,
       CASE l_linestatus WHEN 'F' THEN 'hm_0' ELSE 'hm_1' END AS device,
       (l_linenumber = 7 AND l_tax < 0.015) AS extra_columns, count(*) AS n
FROM lineitem GROUP BY ALL"""


@query("src1_read_msr", MSR_SQL)
def src1(spark, folder):
    return _counted(raw.read_msr(spark, _written(msr_lines(spark, folder)), "msr_hm"))


@query("src2_read_fiu", """SELECT epoch_us(l_shipdate) AS raw_ts,
       ((l_suppkey * 409600 + l_partkey * 1000) // 512) * 512 AS offset_bytes,
       CAST(l_quantity * 512 AS BIGINT) AS size_bytes,
       CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'N' THEN 'D' ELSE 'W' END AS operation,
       CASE l_linestatus WHEN 'F' THEN '6:0' ELSE '6:1' END AS device, FALSE AS extra_columns, count(*) AS n
FROM lineitem GROUP BY ALL""")
def src2(spark, folder):
    return _counted(raw.read_fiu(spark, _written(fiu_lines(spark, folder)), "fiu_homes"))


@query("src3_read_systor", """SELECT epoch_us(l_shipdate) + l_linenumber * 13118 AS raw_ts,
       l_suppkey * 409600 + l_partkey * 1000 AS offset_bytes, CAST(l_quantity * 512 AS BIGINT) AS size_bytes,
       CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'N' THEN 'BLANK' ELSE 'W' END AS operation,
       CASE l_linestatus WHEN 'F' THEN '0' ELSE '1' END AS device, FALSE AS extra_columns, count(*) AS n
FROM lineitem GROUP BY ALL""")
def src3(spark, folder):
    path = _written(systor_lines(spark, folder), header="Timestamp,Response,IOType,LUN,Offset,Size")
    return _counted(raw.read_systor(spark, path, "systor_lun0"))


@query("src4_read_gzip", MSR_SQL)
def src4_gzip(spark, folder):
    return _counted(raw.read_msr(spark, _written(msr_lines(spark, folder), "gzip"), "msr_hm"))


@query("src4_read_bzip2", MSR_SQL)
def src4_bzip2(spark, folder):
    return _counted(raw.read_msr(spark, _written(msr_lines(spark, folder), "bzip2"), "msr_hm"))


@query("src5_read_statistics", f"""WITH {TRACE}
SELECT trace_id, count(*) AS block_requests, count(*) FILTER (operation = 'W') AS write_blocks,
       count(*) FILTER (operation = 'R') AS read_blocks,
       round(count(*) FILTER (operation = 'W') * 100::DOUBLE / count(*), 6) AS write_percentage
FROM trace GROUP BY trace_id""")
def src5(spark, folder):
    mix = rounded(stats.access_mix(trace_events(spark, folder)), 6, "write_percentage")
    path = new_folder(spark, "statistics")
    tables.write_statistics(mix, path)
    return tables.read_statistics(spark, path, mix.schema)


@query("src6_discover_workloads", """WITH hours AS (
  SELECT DISTINCT strftime(ts, '%Y%m%d%H') AS stamp, user_id % 3 AS lun FROM events)
SELECT 'systor' AS dataset, 'systor_lun' || lun AS trace_id, count(*) AS files,
       min(stamp) || '-LUN' || lun || '.csv' AS first_file FROM hours GROUP BY lun
UNION ALL SELECT 'msr', 'msr_vol_' || (user_id % 5), 1, 'vol_' || (user_id % 5) || '.csv.gz' FROM events GROUP BY user_id % 5""")
def src6(spark, folder):
    """Files written from the events: one SYSTOR file per hour and LUN, one MSR file per volume, and noise."""
    events = table(spark, folder, "events")
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHH")
    hourly = events.select(F.concat(hour, F.lit("-LUN"), (F.col("user_id") % 3).cast("string"),
                                    F.lit(".csv")).alias("name")).distinct()
    volumes = events.select(F.concat(F.lit("vol_"), (F.col("user_id") % 5).cast("string"),
                                     F.lit(".csv.gz")).alias("name")).distinct()
    noise = volumes.select(F.explode(F.array(
        F.lit("README.txt"), F.lit("MD5.txt"), F.lit("all.tar.gz"), F.concat("name", F.lit(".part")))).alias("name")).distinct()

    def listed(names: DataFrame, dataset: str) -> DataFrame:
        path = new_folder(spark, dataset)
        workloads.write_files(names, path)
        return workloads.list_files(spark, path)

    found = workloads.discover(listed(hourly.unionByName(noise), "systor"), "systor").unionByName(
        workloads.discover(listed(volumes.unionByName(noise), "msr"), "msr"))
    first = F.element_at(F.split(F.min_by("path", "file_index"), "/"), -1)
    return found.groupBy("dataset", "trace_id").agg(F.count(F.lit(1)).alias("files"), first.alias("first_file"))


def _dirty_trace_text(spark, folder) -> DataFrame:
    """The events trace as text rows, some of them broken."""
    part = F.col("seq") % 50
    return trace_events(spark, folder).select(
        F.when(part == 1, F.concat(F.col("timestamp").cast("string"), F.lit("x")))
        .otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(part == 2, "-5").otherwise(F.col("lba").cast("string")).alias("lba"),
        F.when(part == 3, "2").when(part == 4, "0").otherwise("1").alias("size"),
        F.when(part == 5, "WRITE").otherwise(F.col("operation")).alias("operation"), "trace_id", "seq")


def _round_trip(rows: DataFrame, schema) -> DataFrame:
    path = new_folder(rows.sparkSession, "text")
    rows.select(*schema.fieldNames()).write.option("header", True).csv(path)
    return tables.read_text_table(rows.sparkSession, path, schema)


@query("src7_check_trace", f"""WITH {TRACE}
SELECT trace_id, CASE seq % 50 WHEN 1 THEN 'malformed' WHEN 2 THEN 'negative_lba' WHEN 3 THEN 'non_unit_size'
       WHEN 4 THEN 'malformed' WHEN 5 THEN 'unknown_operation' ELSE 'ok' END AS reason, count(*) AS records
FROM trace GROUP BY ALL""")
def src7(spark, folder):
    rows = _round_trip(_dirty_trace_text(spark, folder), tables.TRACE_TEXT)
    return tables.reason_counts(tables.check_trace(rows))


@query("src7_typed_trace", f"""WITH {TRACE}
SELECT trace_id, timestamp, lba, size, operation, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS seq
FROM trace WHERE seq % 50 NOT BETWEEN 1 AND 5""")
def src7_typed(spark, folder):
    rows = _round_trip(_dirty_trace_text(spark, folder).orderBy("seq"), tables.TRACE_TEXT)
    return tables.typed_trace(tables.check_trace(rows))


@query("src8_check_predictions", f"""WITH {TRACE},
marked AS (SELECT *, seq % 40 AS part FROM writes)
SELECT trace_id, CASE part WHEN 1 THEN 'malformed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'malformed'
       ELSE CASE WHEN lba % 2 = 0 THEN 'HOT' ELSE 'COLD' END END AS outcome, count(*) AS records
FROM marked GROUP BY ALL""")
def src8(spark, folder):
    part = F.col("seq") % 40
    label = F.when(F.col("lba") % 2 == 0, F.when(part < 20, "HOT").otherwise("1")) \
        .otherwise(F.when(part < 20, " COLD ").otherwise("0"))
    text = trace_events(spark, folder).filter(F.col("operation") == "W").select(
        F.col("timestamp").cast("string").alias("timestamp"),
        F.when(part == 3, "-1").otherwise(F.col("lba").cast("string")).alias("lba"),
        F.when(part == 1, "oops").otherwise((F.col("timestamp") / 2).cast("string")).alias("predicted_rewrite_interval"),
        F.when(part == 2, "LUKEWARM").otherwise(label).alias("predicted_class"),
        F.lit("m1").alias("model_version"), "trace_id")
    rows = settle(tables.check_predictions(_round_trip(text, tables.PREDICTION_TEXT)), "rows")
    good = tables.typed_predictions(rows).select("trace_id", F.col("predicted_class").alias("outcome"))
    bad = rows.filter(F.col("reject_reason").isNotNull()).select("trace_id", F.when(
        F.col("reject_reason") == "malformed", "malformed").otherwise("rejected").alias("outcome"))
    return good.unionByName(bad).groupBy("trace_id", "outcome").agg(F.count(F.lit(1)).alias("records"))


@query("src10_verify_checksums", """SELECT CASE user_id % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FAILED' ELSE 'UNVERIFIED' END AS status,
       count(DISTINCT user_id) AS files FROM events GROUP BY 1""")
def src10(spark, folder):
    """One file per user; a third published correctly, half of them as SHA-256, a third wrongly, a third not at all."""
    events = table(spark, folder, "events")
    path, user = new_folder(spark, "raw"), F.col("user_id")
    name = F.concat(F.lit("users="), F.expr("user_id div 1000").cast("string"), F.lit("/"), user.cast("string"), F.lit(".txt"))
    files = settle(events.groupBy("user_id").agg(F.concat(F.sum("event_id").cast("string"), F.lit("\n")).alias("value"))
                   .withColumn("name", name), "files")
    workloads.write_files(files.repartition("user_id"), path)
    digest = F.when(user % 6 == 0, F.sha2("value", 256)).when(user % 3 == 0, F.md5("value")).otherwise(F.lit("0" * 32))
    published = files.filter(user % 3 < 2).select(F.concat(digest, F.lit("  *"), "name").alias("value"))
    checksums = workloads.read_checksums(spark, _written(published))
    done = workloads.verify_checksums(spark, path, checksums, depth=2)
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


# -- sinks --------------------------------------------------------------------

@query("snk1_write_trace", f"WITH {MULTI} "
       "SELECT trace_id, timestamp, lba, size, operation, seq FROM trace")
def snk1(spark, folder):
    path = new_folder(spark, "trace")
    tables.write_trace(trace_multi(spark, folder), path)
    return tables.read_trace(spark, path)


@query("snk2_write_predictions", f"""WITH {SAMPLES}, {PREDICTIONS}
SELECT timestamp, lba, round_even(predicted_rewrite_interval, 3) AS predicted_rewrite_interval, predicted_class,
       'median_interval' AS model_version, trace_id FROM pred""")
def snk2(spark, folder):
    path = new_folder(spark, "predictions")
    made = predictions(spark, folder).withColumn("model_version", F.lit("median_interval"))
    tables.write_predictions(made, path)
    from blocktrace.schemas import PREDICTION
    return spark.read.schema(PREDICTION).parquet(path)


@query("snk3_append_runs", f"""WITH {RUNS}
SELECT dataset, trace, policy, model_type, total_segments, blocks_per_segment, block_size_bytes, gc_reserved_segments,
       gc_separate_stream, target_utilization, seed, total_write_requests, logical_bytes_written, physical_bytes_written,
       gc_bytes_copied, valid_blocks_migrated, gc_count, main_stream_writes, cold_stream_writes, unpredicted_writes, waf
FROM runs""")
def snk3(spark, folder):
    path = new_folder(spark, "runs")
    table_ = settle(runs(spark, folder), "runs")
    tables.append_runs(table_.filter(F.col("policy") == "MIXED"), path)
    tables.append_runs(table_.filter(F.col("policy") != "MIXED"), path)
    return tables.read_runs(spark, path)


@query("snk4_write_inventory", """WITH d AS (SELECT 'lineitem_' || l_linestatus AS trace_id, count(*) AS records FROM lineitem GROUP BY ALL)
SELECT trace_id, records FROM d""")
def snk4(spark, folder):
    path = new_folder(spark, "inventory")
    counts = clean.parse_counters(checked(spark, folder)).select(
        "trace_id", F.col("raw_records_read").alias("records")).orderBy("trace_id")
    tables.write_inventory(counts, path)
    return spark.read.schema(counts.schema).option("header", True).csv(path)


# -- cleaning -----------------------------------------------------------------

@query("cln1_map_operation", """SELECT CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'N' THEN 'W' ELSE
       CASE l_linenumber WHEN 1 THEN 'BLANK' WHEN 2 THEN 'BLANK' WHEN 3 THEN 'D' ELSE 'TRIM' END END AS operation,
       count(*) AS n FROM lineitem GROUP BY 1""")
def cln1(spark, folder):
    line = table(spark, folder, "lineitem")
    odd = (F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, "  ")
           .when(F.col("l_linenumber") == 3, "d").otherwise("Trim"))
    text = F.when(F.col("l_returnflag") == "R", " read").when(F.col("l_returnflag") == "N", "Write").otherwise(odd)
    return line.select(map_operation(text, MSR_OPERATIONS).alias("operation")) \
        .groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


DOMINANT = f"""{requests_sql()},
dev AS (SELECT trace_id, device, count(*) AS n FROM req GROUP BY ALL),
sel AS (SELECT trace_id, arg_max(device, n) AS device_selected FROM dev GROUP BY trace_id),
r2 AS (SELECT * FROM req JOIN sel USING (trace_id)), {checked_sql('r2', 'device_selected')}"""


@query("cln2_reject_reasons", f"""WITH {DOMINANT}
SELECT trace_id, reject_reason, count(*) AS records FROM chk WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def cln2(spark, folder):
    chosen = clean.select_device(requests(spark, folder), "dominant", SOURCE_ORDER)
    return clean.reject_counts(clean.check_requests(chosen, CAP))


@query("cln3_accepted_requests", f"""WITH {CHECKED}
SELECT trace_id, raw_ts, offset_bytes, size_bytes, n_blocks, count(*) AS n FROM chk WHERE reject_reason IS NULL GROUP BY ALL""")
def cln3(spark, folder):
    return clean.accepted(checked(spark, folder)).groupBy(
        "trace_id", "raw_ts", "offset_bytes", "size_bytes", "n_blocks").agg(F.count(F.lit(1)).alias("n"))


@query("cln4_dominant_device", """WITH dev AS (SELECT l_linestatus AS device, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'lineitem' AS trace_id, arg_max(device, n) AS device_selected FROM dev""")
def cln4(spark, folder):
    return clean.dominant_devices(clean.device_counts(requests(spark, folder), SOURCE_ORDER))


@query("cln4_explicit_device", f"""WITH {requests_sql()}, {checked_sql('req', "'F'")}
SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS records FROM chk GROUP BY 1""")
def cln4_explicit(spark, folder):
    chosen = clean.select_device(requests(spark, folder), "F", SOURCE_ORDER)
    done = clean.check_requests(chosen, CAP)
    return done.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("records"))


@query("cln5_expand_blocks", f"""WITH {CHECKED},
rows_ AS (SELECT trace_id, unnest(range(first_block, last_block + 1)) AS lba, operation FROM chk WHERE reject_reason IS NULL)
SELECT trace_id, lba, operation, count(*) AS n FROM rows_ GROUP BY ALL""")
def cln5(spark, folder):
    blocks = clean.expand_blocks(clean.accepted(checked(spark, folder)))
    return blocks.groupBy("trace_id", "lba", "operation").agg(F.count(F.lit(1)).alias("n"))


@query("cln6_rebase", f"""WITH {CHECKED}, kept AS (SELECT * FROM chk WHERE reject_reason IS NULL),
t0 AS (SELECT trace_id, min(raw_ts) AS start FROM kept GROUP BY trace_id)
SELECT trace_id, raw_ts - start AS timestamp, count(*) AS n FROM kept JOIN t0 USING (trace_id) GROUP BY ALL""")
def cln6(spark, folder):
    return clean.rebase(clean.accepted(checked(spark, folder))).groupBy("trace_id", "timestamp").agg(
        F.count(F.lit(1)).alias("n"))


@query("cln7_normalize", f"""WITH {CHECKED}, kept AS (SELECT * FROM chk WHERE reject_reason IS NULL),
t0 AS (SELECT trace_id, min(raw_ts) AS start FROM kept GROUP BY trace_id),
rows_ AS (SELECT *, unnest(range(first_block, last_block + 1)) AS lba FROM kept JOIN t0 USING (trace_id))
SELECT trace_id, raw_ts - start AS timestamp, lba, operation, 1 AS size,
       row_number() OVER (PARTITION BY trace_id ORDER BY raw_ts, {ORDER_SQL}, lba) - 1 AS seq FROM rows_""")
def cln7(spark, folder):
    return clean.normalize(checked(spark, folder), SOURCE_ORDER)


@query("cln9_request_prefix", f"""WITH {requests_sql(per_device=True)}
SELECT trace_id, {ORDER_SQL} FROM req
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY {ORDER_SQL}) <= 1500""")
def cln9(spark, folder):
    return clean.request_prefix(requests(spark, folder, per_device=True), 1500, SOURCE_ORDER).select(
        "trace_id", *SOURCE_ORDER)


@query("cln12_structural_check", f"""WITH {requests_sql(per_device=True)},
head AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY {ORDER_SQL}) <= 2000),
{checked_sql('head')},
c AS (SELECT trace_id, count(*) AS raw_records_read,
             coalesce(sum(n_blocks) FILTER (reject_reason IS NULL), 0)::BIGINT AS blocks_emitted,
             count(*) FILTER (reject_reason IS NOT NULL) AS dropped_total FROM chk GROUP BY trace_id)
SELECT *, CASE WHEN blocks_emitted = 0 THEN 'no record survived validation'
               WHEN dropped_total / raw_records_read > 0.5 THEN 'more than half of the records rejected'
               ELSE 'ok' END AS verdict,
       (blocks_emitted > 0 AND dropped_total / raw_records_read <= 0.5) AS passed FROM c""")
def cln12(spark, folder):
    return clean.structural_check(requests(spark, folder, per_device=True), CAP, SOURCE_ORDER)


# -- parse audit --------------------------------------------------------------

def _seen(condition: str) -> str:
    return f"count(*) FILTER ((reject_reason IS NULL OR reject_reason = 'oversized') AND {condition})"


@query("agg1_parse_counters", f"""WITH {CHECKED}
SELECT trace_id, count(*) AS raw_records_read, count(*) FILTER (reject_reason IS NULL) AS records_accepted,
       sum(n_blocks) FILTER (reject_reason IS NULL)::BIGINT AS blocks_emitted,
       sum(n_blocks) FILTER (reject_reason IS NULL AND operation = 'W')::BIGINT AS write_blocks,
       sum(n_blocks) FILTER (reject_reason IS NULL AND operation = 'R')::BIGINT AS read_blocks,
       count(*) FILTER (reject_reason = 'malformed') AS dropped_malformed,
       count(*) FILTER (reject_reason = 'unknown_operation') AS dropped_unknown_operation,
       count(*) FILTER (reject_reason = 'bad_offset') AS dropped_bad_offset,
       count(*) FILTER (reject_reason = 'bad_size') AS dropped_bad_size,
       count(*) FILTER (reject_reason = 'oversized') AS dropped_oversized_request,
       count(*) FILTER (reject_reason = 'other_device') AS dropped_other_device,
       count(*) FILTER (reject_reason IS NOT NULL) AS dropped_total,
       min(raw_ts) FILTER (reject_reason IS NULL) AS first_raw_timestamp,
       max(raw_ts) FILTER (reject_reason IS NULL) AS last_raw_timestamp FROM chk GROUP BY trace_id""")
def agg1(spark, folder):
    table_ = clean.parse_counters(checked(spark, folder))
    return table_.drop("skipped_extra_columns", "total_bytes", "write_records", "read_records",
                       "discard_records", "unaligned_requests", "multi_block_requests")


@query("agg2_request_counters", f"""WITH {CHECKED}
SELECT trace_id, sum(size_bytes) FILTER (reject_reason IS NULL OR reject_reason = 'oversized')::BIGINT AS total_bytes,
       {_seen("operation = 'W'")} AS write_records, {_seen("operation = 'R'")} AS read_records,
       {_seen("operation = 'D'")} AS discard_records, {_seen('offset_bytes % 4096 <> 0')} AS unaligned_requests,
       {_seen('n_blocks > 1')} AS multi_block_requests FROM chk GROUP BY trace_id""")
def agg2(spark, folder):
    return clean.parse_counters(checked(spark, folder)).select(
        "trace_id", "total_bytes", "write_records", "read_records", "discard_records",
        "unaligned_requests", "multi_block_requests")


@query("agg3_disorder_counts", f"""WITH {CHECKED},
rows_ AS (SELECT *, unnest(range(n_blocks)) AS block FROM chk WHERE reject_reason IS NULL),
near AS (SELECT trace_id, raw_ts, lag(raw_ts) OVER (PARTITION BY trace_id ORDER BY {ORDER_SQL}, block) AS before FROM rows_)
SELECT trace_id, count(*) FILTER (raw_ts < before) AS out_of_order_records,
       count(*) FILTER (raw_ts = before) AS duplicate_timestamps FROM near GROUP BY trace_id""")
def agg3(spark, folder):
    return clean.disorder_counts(checked(spark, folder), SOURCE_ORDER)


@query("agg11_unknown_examples", f"""WITH {CHECKED},
odd AS (SELECT trace_id, operation, min(({ORDER_SQL})) AS first_seen FROM chk
        WHERE reject_reason = 'unknown_operation' GROUP BY ALL)
SELECT trace_id, operation, row_number() OVER (PARTITION BY trace_id ORDER BY first_seen) AS rank FROM odd
QUALIFY rank <= 5""")
def agg11(spark, folder):
    return clean.unknown_operation_examples(checked(spark, folder), SOURCE_ORDER)


@query("agg12_device_map", """SELECT 'lineitem' AS trace_id, l_linestatus AS device, count(*) AS records
FROM lineitem GROUP BY ALL""")
def agg12(spark, folder):
    mapped = clean.device_record_map(clean.device_counts(requests(spark, folder), SOURCE_ORDER))
    return mapped.select("trace_id", F.explode("device_record_counts").alias("device", "records"))


#: The lines of `msr_lines` as requests; the busiest device is kept.
CHAIN = f"""ln AS (
  SELECT 'msr_hm' AS trace_id, epoch_us(l_shipdate) + {WINDOWS_OFFSET_US} AS raw_ts,
         CASE WHEN l_linenumber = 6 AND l_tax < 0.015 THEN NULL ELSE l_suppkey * 409600 + l_partkey * 1000 END AS offset_bytes,
         CAST(l_quantity * 512 AS BIGINT) AS size_bytes,
         CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'N' THEN 'W' ELSE
              CASE WHEN l_linenumber = 1 THEN 'BLANK' ELSE 'FLUSH' END END AS operation,
         CASE l_linestatus WHEN 'F' THEN 'hm_0' ELSE 'hm_1' END AS device,
         l_linenumber = 7 AND l_tax < 0.015 AS extra, {ORDER_SQL} FROM lineitem),
dom AS (SELECT device AS d FROM ln GROUP BY device ORDER BY count(*) DESC, min(({ORDER_SQL})) LIMIT 1),
{checked_sql("ln", "(SELECT d FROM dom)", 2048).replace("chk AS (", "chk0 AS (")},
chk AS (SELECT * REPLACE (CASE WHEN extra THEN 'extra_columns' ELSE reject_reason END AS reject_reason) FROM chk0),
kept AS (SELECT *, unnest(range(n_blocks)) AS block FROM chk WHERE reject_reason IS NULL),
trace AS (SELECT trace_id, raw_ts - min(raw_ts) OVER (PARTITION BY trace_id) AS timestamp, first_block + block AS lba,
                 operation, raw_ts, row_number() OVER (PARTITION BY trace_id ORDER BY raw_ts, {ORDER_SQL}, block) AS seq,
                 lag(raw_ts) OVER (PARTITION BY trace_id ORDER BY {ORDER_SQL}, block) AS before FROM kept),
writes AS (SELECT * FROM trace WHERE operation = 'W')"""


def _dropped(reason: str) -> str:
    return f"count(*) FILTER (reject_reason = '{reason}')"


@query("e1_raw_to_statistics", f"""WITH {CHAIN}, {PROFILE}, {TOP}, {INTERVALS}, {SUMMARY},
aud AS (SELECT trace_id, count(*) FILTER (reject_reason IS DISTINCT FROM 'extra_columns') AS raw_records_read,
               count(*) FILTER (reject_reason IS NULL) AS records_accepted,
               {_dropped('other_device')} AS dropped_other_device, {_dropped('malformed')} AS dropped_malformed,
               {_dropped('unknown_operation')} AS dropped_unknown_operation, {_dropped('bad_offset')} AS dropped_bad_offset,
               {_dropped('bad_size')} AS dropped_bad_size, {_dropped('oversized')} AS dropped_oversized_request,
               count(*) FILTER (reject_reason <> 'extra_columns') AS dropped_total,
               {_dropped('extra_columns')} AS skipped_extra_columns,
               sum(size_bytes) FILTER (reject_reason IS NULL OR reject_reason = 'oversized')::BIGINT AS total_bytes,
               {_seen("operation = 'W'")} AS write_records, {_seen("operation = 'R'")} AS read_records,
               {_seen("operation = 'D'")} AS discard_records, {_seen('offset_bytes % 4096 <> 0')} AS unaligned_requests,
               {_seen('n_blocks > 1')} AS multi_block_requests,
               min(raw_ts) FILTER (reject_reason IS NULL) AS first_raw_timestamp,
               max(raw_ts) FILTER (reject_reason IS NULL) AS last_raw_timestamp FROM chk GROUP BY trace_id),
per AS (SELECT trace_id, count(*) AS block_requests, count(*) AS blocks_emitted,
               count(*) FILTER (operation = 'W') AS write_blocks, count(*) FILTER (operation = 'R') AS read_blocks,
               count(*) FILTER (raw_ts < before) AS out_of_order_records,
               count(*) FILTER (raw_ts = before) AS duplicate_timestamps,
               round(count(*) FILTER (operation = 'W') * 100::DOUBLE / count(*), 6) AS write_percentage,
               count(DISTINCT lba) AS unique_lbas, min(lba) AS lba_min, max(lba) AS lba_max,
               max(lba) - min(lba) + 1 AS lba_span,
               round((max(timestamp) - min(timestamp)) / 1e6::DOUBLE, 6) AS duration_seconds FROM trace GROUP BY trace_id),
rew AS (SELECT trace_id, count(*) AS unique_written_lbas, (sum(w) - count(*))::BIGINT AS rewrite_events,
               round((sum(w) - count(*))::DOUBLE / sum(w), 6) AS rewrite_ratio,
               count(*) FILTER (w > 1) AS lbas_written_more_than_once,
               round(count(*) FILTER (w > 1) / count(*)::DOUBLE, 6) AS repeated_write_lba_fraction,
               max(w) AS max_writes_to_single_lba FROM prof WHERE w > 0 GROUP BY trace_id),
done AS (SELECT aud.*, per.* EXCLUDE (trace_id), rew.* EXCLUDE (trace_id),
                last_raw_timestamp - first_raw_timestamp AS duration_microseconds,
                round(top1pct_lba_write_share, 6) AS top1pct_lba_write_share,
                round(mean_rewrite_interval_us, 1) AS mean_rewrite_interval_us,
                round(median_rewrite_interval_us, 1) AS median_rewrite_interval_us,
                round(p90_rewrite_interval_us, 1) AS p90_rewrite_interval_us,
                round(p99_rewrite_interval_us, 1) AS p99_rewrite_interval_us,
                round(total_bytes::DOUBLE / greatest(records_accepted, 1), 6) AS mean_request_size_bytes
         FROM aud JOIN per USING (trace_id) JOIN rew USING (trace_id) JOIN share USING (trace_id) JOIN summ USING (trace_id))
SELECT *, 0::BIGINT AS other_devices, 0::BIGINT AS other_device_records, 'msr' AS dataset,
       write_blocks >= 200000 AND rewrite_ratio >= 0.3 AND unique_written_lbas >= 5000 AND duration_seconds >= 3600 AS eligible,
       concat_ws('; ', CASE WHEN write_blocks < 200000 THEN 'write_blocks ' || format('{{:,}}', write_blocks) || ' < 200,000' END,
         CASE WHEN rewrite_ratio < 0.3 THEN 'rewrite_ratio ' || format('{{:.3f}}', rewrite_ratio) || ' < 0.3' END,
         CASE WHEN unique_written_lbas < 5000 THEN 'unique_written_lbas ' || format('{{:,}}', unique_written_lbas) || ' < 5,000' END,
         CASE WHEN duration_seconds < 3600 THEN 'duration_seconds ' || format('{{:,.0f}}', duration_seconds) || ' < 3,600' END)
         AS ineligible_reasons FROM done""")
def e1(spark, folder):
    """Raw lines to audit, normalized trace, statistics and eligibility in one go."""
    lines = raw.read_msr(spark, _written(msr_lines(spark, folder, ordered=True)), "msr_hm")
    chosen = clean.select_device(lines, "dominant")
    done = settle(clean.check_requests(chosen), "checked")
    audit = clean.parse_audit(done).withColumn("dataset", F.lit("msr"))
    statistics = stats.trace_statistics(clean.normalize(done), audit)
    table_ = selection.with_eligibility(statistics).drop(
        "device_record_counts", "unknown_operation_examples", "reasons")
    shares = ["write_percentage", "duration_seconds", "rewrite_ratio", "repeated_write_lba_fraction",
              "top1pct_lba_write_share", "mean_request_size_bytes"]
    return rounded(rounded(table_, 6, *shares), 1, *SUMMARY_COLUMNS)
