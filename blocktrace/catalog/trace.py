"""Queries over normalized traces: statistics, intervals, samples, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocktrace.catalog.common import (
    BASELINE_COLUMNS,
    INTERVALS,
    LENGTH,
    MIN_HISTORY,
    MULTI,
    MULTI_SAMPLES,
    PERCENTILE,
    SAMPLES,
    TRACE,
    CHECKED,
    checked,
    query,
    r,
    requests,
    rounded,
    sequences_sql,
    split_samples,
    table,
    trace_events,
    trace_multi,
)
from blocktrace.functions import capacity, scaling, windows
from blocktrace.functions.labels import temperature
from blocktrace.operators import clean, evaluate, intervals, splits, stats
from blocktrace.plans.storage import attach, settle


def join_list(values, digits: int | None = None):
    """Array as text, so results compare as plain values."""
    item = (lambda x: F.round(x, digits).cast("string")) if digits is not None \
        else (lambda x: x.cast("bigint").cast("string"))
    return F.concat_ws(",", F.transform(values, item))


# -- statistics --------------------------------------------------------------

PROFILE = """prof AS (
  SELECT trace_id, lba, count(*) AS accesses, count(*) FILTER (operation = 'W') AS w,
         min(timestamp) FILTER (operation = 'W') AS first_write,
         max(timestamp) FILTER (operation = 'W') AS last_write FROM trace GROUP BY ALL)"""


@query("agg4_access_mix", f"""WITH {MULTI}
SELECT trace_id, count(*) AS block_requests, count(*) FILTER (operation = 'W') AS write_blocks,
       count(*) FILTER (operation = 'R') AS read_blocks,
       round(count(*) FILTER (operation = 'W') * 100::DOUBLE / count(*), 6) AS write_percentage
FROM trace GROUP BY trace_id""")
def agg4(spark, folder):
    return rounded(stats.access_mix(trace_multi(spark, folder)), 6, "write_percentage")


@query("agg5_footprint", f"""WITH {MULTI}
SELECT trace_id, count(DISTINCT lba) AS unique_lbas, min(lba) AS lba_min, max(lba) AS lba_max,
       max(lba) - min(lba) + 1 AS lba_span FROM trace GROUP BY trace_id""")
def agg5(spark, folder):
    return stats.footprint(stats.lba_profile(trace_multi(spark, folder)))


#: Relative deviation of the sketch, and how many of them an estimate may be off.
SKETCH_ERROR, SKETCH_DEVIATIONS = 0.02, 5


@query("agg5_approximate_footprint", f"""WITH {MULTI}
SELECT trace_id, count(DISTINCT lba) AS unique_lbas, TRUE AS within_error FROM trace GROUP BY trace_id""")
def agg5_approximate(spark, folder):
    """Whether the sketch is close to the exact count of each trace."""
    trace = settle(trace_multi(spark, folder), "trace")
    exact = stats.footprint(stats.lba_profile(trace)).select("trace_id", "unique_lbas")
    gap = F.abs(F.col("approx_unique_lbas") / F.col("unique_lbas") - 1)
    return exact.join(stats.approximate_footprint(trace, SKETCH_ERROR), "trace_id").select(
        "trace_id", "unique_lbas", (gap <= SKETCH_DEVIATIONS * SKETCH_ERROR).alias("within_error"))


@query("agg6_duration_and_size", f"""WITH {CHECKED},
kept AS (SELECT * FROM chk WHERE reject_reason IS NULL),
seen AS (SELECT trace_id, sum(size_bytes) AS bytes FROM chk
         WHERE reject_reason IS NULL OR reject_reason = 'oversized' GROUP BY trace_id)
SELECT trace_id, round((max(raw_ts) - min(raw_ts)) / 1e6::DOUBLE, 6) AS duration_seconds,
       round(any_value(bytes)::DOUBLE / count(*), 6) AS mean_request_size_bytes
FROM kept JOIN seen USING (trace_id) GROUP BY trace_id""")
def agg6(spark, folder):
    requests_ = checked(spark, folder)
    audit = clean.parse_counters(requests_)
    trace = clean.accepted(requests_).withColumn("timestamp", F.col("raw_ts"))
    return rounded(stats.duration_and_size(trace, audit), 6, "duration_seconds", "mean_request_size_bytes")


@query("agg7_rewrite_profile", f"""WITH {MULTI}, {PROFILE}
SELECT trace_id, count(*) AS unique_written_lbas, (sum(w) - count(*))::BIGINT AS rewrite_events,
       round((sum(w) - count(*))::DOUBLE / sum(w), 6) AS rewrite_ratio,
       count(*) FILTER (w > 1) AS lbas_written_more_than_once,
       round(count(*) FILTER (w > 1) / count(*)::DOUBLE, 6) AS repeated_write_lba_fraction,
       max(w) AS max_writes_to_single_lba
FROM prof WHERE w > 0 GROUP BY trace_id""")
def agg7(spark, folder):
    profile = stats.lba_profile(trace_multi(spark, folder))
    return rounded(stats.rewrite_profile(profile), 6, "rewrite_ratio", "repeated_write_lba_fraction")


TOP = """top AS (
  SELECT trace_id, w, row_number() OVER (PARTITION BY trace_id ORDER BY w DESC) AS place,
         count(*) OVER (PARTITION BY trace_id) AS n, sum(w) OVER (PARTITION BY trace_id) AS total
  FROM prof WHERE w > 0),
share AS (
  SELECT trace_id, sum(w)::DOUBLE / any_value(total)::DOUBLE AS top1pct_lba_write_share FROM top
  WHERE place <= greatest(1, round_even(0.01::DOUBLE * n, 0)) GROUP BY trace_id)"""


@query("agg8_top_share", f"""WITH {MULTI}, {PROFILE}, {TOP}
SELECT trace_id, round(top1pct_lba_write_share, 6) AS top1pct_lba_write_share FROM share""")
def agg8(spark, folder):
    return rounded(stats.top_share(stats.lba_profile(trace_multi(spark, folder))), 6,
                   "top1pct_lba_write_share")


SUMMARY = """summ AS (
  SELECT trace_id, avg(interval)::DOUBLE AS mean_rewrite_interval_us,
         quantile_cont(interval, 0.5) AS median_rewrite_interval_us,
         quantile_cont(interval, 0.9) AS p90_rewrite_interval_us,
         quantile_cont(interval, 0.99) AS p99_rewrite_interval_us FROM iv GROUP BY trace_id)"""
SUMMARY_COLUMNS = ["mean_rewrite_interval_us", "median_rewrite_interval_us",
                   "p90_rewrite_interval_us", "p99_rewrite_interval_us"]


def _sql_rounded(columns: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query("agg9_interval_summary", f"""WITH {MULTI}, {INTERVALS}, {SUMMARY}
SELECT trace_id, {_sql_rounded(SUMMARY_COLUMNS, 1)} FROM summ""")
def agg9(spark, folder):
    trace = trace_multi(spark, folder)
    return rounded(stats.interval_summary(trace, stats.lba_profile(trace)), 1, *SUMMARY_COLUMNS)


@query("agg10_empty_trace_defaults", f"""WITH {MULTI}, {PROFILE}, {TOP}, {INTERVALS}, {SUMMARY},
names AS (SELECT DISTINCT trace_id FROM trace UNION SELECT 'empty_trace'),
base AS (SELECT trace_id, count(*) AS block_requests, count(DISTINCT lba) AS unique_lbas FROM trace GROUP BY trace_id)
SELECT n.trace_id, coalesce(block_requests, 0) AS block_requests, coalesce(unique_lbas, 0) AS unique_lbas,
       round(coalesce(top1pct_lba_write_share, 0), 6) AS top1pct_lba_write_share,
       round(coalesce(mean_rewrite_interval_us, 0), 1) AS mean_rewrite_interval_us,
       round(coalesce(median_rewrite_interval_us, 0), 1) AS median_rewrite_interval_us,
       round(p90_rewrite_interval_us, 1) AS p90_rewrite_interval_us,
       round(p99_rewrite_interval_us, 1) AS p99_rewrite_interval_us
FROM names n LEFT JOIN base USING (trace_id) LEFT JOIN share USING (trace_id) LEFT JOIN summ USING (trace_id)""")
def agg10(spark, folder):
    trace = trace_multi(spark, folder)
    names = trace.select("trace_id").distinct().unionByName(spark.range(1).select(
        F.lit("empty_trace").alias("trace_id")))
    profile = settle(stats.lba_profile(trace), "profile")
    base = profile.groupBy("trace_id").agg(F.sum("accesses").alias("block_requests"),
                                           F.count(F.lit(1)).alias("unique_lbas"))
    measured = base.join(stats.top_share(profile), "trace_id", "left") \
        .join(stats.interval_summary(trace, profile), "trace_id", "left")
    full = stats.with_empty_defaults(measured, names)
    return rounded(full, 1, *SUMMARY_COLUMNS).withColumn(
        "top1pct_lba_write_share", r("top1pct_lba_write_share"))


@query("agg13_replay_footprint", f"""WITH {MULTI},
prefix AS (SELECT * FROM writes QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, seq) <= 500)
SELECT trace_id, count(DISTINCT lba) AS distinct_lbas, count(*) AS writes FROM prefix GROUP BY trace_id""")
def agg13(spark, folder):
    return stats.replay_footprint(trace_multi(spark, folder), 500)


@query("agg14_write_rate", f"""WITH {MULTI},
span AS (SELECT trace_id, min(timestamp) AS low, max(timestamp) - min(timestamp) AS span
         FROM writes GROUP BY trace_id),
counts AS (SELECT trace_id, least(118, ((timestamp - low) * 119) // span) AS bin, count(*) AS writes
           FROM writes JOIN span USING (trace_id) GROUP BY ALL),
grid AS (SELECT trace_id, low, span, unnest(range(119)) AS bin FROM span)
SELECT trace_id, bin, round((low / 1e6::DOUBLE + bin * (span / 119e6::DOUBLE)) / 3600, 6) AS start_hours,
       coalesce(writes, 0) AS writes,
       round(coalesce(writes, 0) / (span / 119e6::DOUBLE), 6) AS writes_per_second
FROM grid LEFT JOIN counts USING (trace_id, bin)""")
def agg14(spark, folder):
    return rounded(stats.write_rate(trace_multi(spark, folder)), 6, "start_hours", "writes_per_second")


@query("agg15_interval_ecdf", f"""WITH {MULTI}, {INTERVALS},
pos AS (SELECT trace_id, interval, row_number() OVER (PARTITION BY trace_id ORDER BY interval) - 1 AS index,
               count(*) OVER (PARTITION BY trace_id) AS n FROM iv WHERE interval > 0)
SELECT trace_id, index, interval, round((index + 1) / n::DOUBLE, 6) AS ecdf FROM pos
WHERE n >= 100 AND index % greatest(1, n // 4000) = 0""")
def agg15(spark, folder):
    found = intervals.rewrite_intervals(trace_multi(spark, folder))
    return rounded(stats.interval_ecdf(found), 6, "ecdf")


@query("agg16_lba_popularity", f"""WITH {MULTI}, {PROFILE},
place AS (SELECT trace_id, w, row_number() OVER (PARTITION BY trace_id ORDER BY w DESC) AS rank FROM prof WHERE w > 0)
SELECT trace_id, w AS writes, min(rank) AS first_rank, max(rank) AS last_rank FROM place GROUP BY ALL""")
def agg16(spark, folder):
    return stats.lba_popularity(stats.lba_profile(trace_multi(spark, folder)))


@query("agg17_lorenz_curve", f"""WITH {MULTI}, {PROFILE},
place AS (SELECT trace_id, w, row_number() OVER win AS rank, sum(w) OVER win AS upto,
                 count(*) OVER (PARTITION BY trace_id) AS n, sum(w) OVER (PARTITION BY trace_id) AS total
          FROM prof WHERE w > 0 WINDOW win AS (PARTITION BY trace_id ORDER BY w DESC, lba ROWS UNBOUNDED PRECEDING))
SELECT trace_id, w AS writes, round(max(rank) * 100::DOUBLE / any_value(n), 6) AS lba_share_pct,
       round(max(upto)::DOUBLE * 100 / any_value(total)::DOUBLE, 6) AS write_share_pct FROM place GROUP BY ALL""")
def agg17(spark, folder):
    curve = stats.lorenz_curve(stats.lba_profile(trace_multi(spark, folder)))
    return rounded(curve, 6, "lba_share_pct", "write_share_pct")


@query("agg18_composition", f"""WITH {MULTI}
SELECT trace_id, round(count(*) FILTER (operation = 'W') / 1e6::DOUBLE, 9) AS writes_millions,
       round(count(*) FILTER (operation = 'R') / 1e6::DOUBLE, 9) AS reads_millions,
       round(count(*) FILTER (operation = 'W') * 100::DOUBLE / count(*), 6) AS write_percentage
FROM trace GROUP BY trace_id""")
def agg18(spark, folder):
    shown = stats.composition(stats.access_mix(trace_multi(spark, folder)))
    return rounded(rounded(shown, 9, "writes_millions", "reads_millions"), 6, "write_percentage")


# -- prefixes ----------------------------------------------------------------

@query("cln8_write_events", f"WITH {TRACE} SELECT trace_id, timestamp, lba, seq FROM writes")
def cln8(spark, folder):
    return intervals.write_events(trace_events(spark, folder)).select("trace_id", "timestamp", "lba", "seq")


@query("cln10_write_prefix", f"""WITH {MULTI}
SELECT trace_id, timestamp, lba, seq FROM writes
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, seq) <= 1000""")
def cln10(spark, folder):
    return intervals.write_prefix(trace_multi(spark, folder), 1000).select("trace_id", "timestamp", "lba", "seq")


@query("cln11_row_prefix", f"""WITH {MULTI},
head AS (SELECT * FROM trace QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, seq) <= 1000)
SELECT trace_id, timestamp, lba, seq FROM head WHERE operation = 'W'""")
def cln11(spark, folder):
    return intervals.row_prefix(trace_multi(spark, folder), 1000).select("trace_id", "timestamp", "lba", "seq")


# -- intervals and samples ---------------------------------------------------

@query("win1_rewrite_intervals", f"""WITH {TRACE}, {INTERVALS}
SELECT trace_id, lba, timestamp, interval FROM iv""")
def win1(spark, folder):
    return intervals.rewrite_intervals(trace_events(spark, folder)).select("trace_id", "lba", "timestamp", "interval")


#: Expanded lineitem blocks as a write stream with heavy timestamp ties.
TIED = f"""{CHECKED},
kept AS (SELECT *, row_number() OVER (ORDER BY raw_ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
         FROM chk WHERE reject_reason IS NULL),
rows_ AS (SELECT trace_id, raw_ts, r, operation, unnest(range(first_block, last_block + 1)) AS lba FROM kept),
iv AS (SELECT trace_id, lba, raw_ts, r, raw_ts - lag(raw_ts) OVER w AS interval, row_number() OVER w - 2 AS position
       FROM rows_ WHERE operation = 'W' WINDOW w AS (PARTITION BY trace_id, lba ORDER BY raw_ts, r)
       QUALIFY row_number() OVER w > 1)"""


@query("win1_intervals_with_ties", f"""WITH {TIED}
SELECT trace_id, lba, interval, position, count(*) AS n FROM iv GROUP BY ALL""")
def win1_ties(spark, folder):
    trace = clean.normalize(checked(spark, folder), order=_source_order())
    found = intervals.rewrite_intervals(trace)
    return found.groupBy("trace_id", "lba", "interval", "position").agg(F.count(F.lit(1)).alias("n"))


def _source_order():
    from blocktrace.catalog.common import SOURCE_ORDER
    return SOURCE_ORDER


@query("win2_interval_position", f"""WITH {TRACE}, {INTERVALS}
SELECT trace_id, lba, timestamp, position FROM iv""")
def win2(spark, folder):
    return intervals.rewrite_intervals(trace_events(spark, folder)).select("trace_id", "lba", "timestamp", "position")


@query("win3_build_sequences", f"""WITH {TRACE}, {INTERVALS}, {sequences_sql()}
SELECT trace_id, lba, timestamp, position, target::BIGINT AS target,
       array_to_string(list_transform(inputs, lambda x: x::BIGINT), ',') AS inputs FROM smp""")
def win3(spark, folder):
    return intervals.build_sequences(trace_events(spark, folder), LENGTH).select(
        "trace_id", "lba", "timestamp", "position", F.col("target").cast("bigint").alias("target"),
        join_list(F.col("inputs")).alias("inputs"))


@query("win4_order_chronologically", f"""WITH {MULTI}, {INTERVALS}, {sequences_sql()}
SELECT trace_id, lba, timestamp, position FROM smp""")
def win4(spark, folder):
    samples = intervals.build_sequences(trace_multi(spark, folder), LENGTH)
    return splits.order_chronologically(samples).select("trace_id", "lba", "timestamp", "position")


@query("win5_chronological_split", f"""WITH {MULTI_SAMPLES}
SELECT trace_id, lba, timestamp, position, split FROM sp""")
def win5(spark, folder):
    return split_samples(spark, folder, multi=True).select("trace_id", "lba", "timestamp", "position", "split")


@query("win5_split_with_ties", """WITH ranked AS (
  SELECT l_returnflag AS trace_id, epoch_us(l_shipdate) AS timestamp,
         rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) - 1 AS earlier,
         count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
SELECT trace_id, CASE WHEN earlier < round_even(0.70::DOUBLE * total, 0) THEN 'train'
            WHEN earlier < round_even((0.70::DOUBLE + 0.15::DOUBLE) * total, 0) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM ranked GROUP BY ALL""")
def win5_ties(spark, folder):
    from blocktrace.catalog.common import micros
    rows = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("trace_id"), micros("l_shipdate").alias("timestamp"))
    return splits.chronological_split(rows).groupBy("trace_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("win6_chronological_prefix", f"""WITH {MULTI}, {INTERVALS}, {sequences_sql()}
SELECT trace_id, lba, timestamp, position FROM smp
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, lba, position)
        <= round_even(0.25::DOUBLE * count(*) OVER (PARTITION BY trace_id), 0)""")
def win6(spark, folder):
    samples = intervals.build_sequences(trace_multi(spark, folder), LENGTH)
    return splits.chronological_prefix(samples, 0.25).select("trace_id", "lba", "timestamp", "position")


@query("win7_cap_samples", f"""WITH {MULTI}, {INTERVALS}, {sequences_sql()}
SELECT trace_id, lba, timestamp, position FROM smp
QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, lba, position) <= 700""")
def win7(spark, folder):
    samples = intervals.build_sequences(trace_multi(spark, folder), LENGTH)
    return splits.cap_samples(samples, 700).select("trace_id", "lba", "timestamp", "position")


@query("win8_split_then_pool", f"""WITH {MULTI_SAMPLES}
SELECT split, count(*) AS n, sum(target)::BIGINT AS target_sum, min(timestamp) AS first_ts,
       max(timestamp) AS last_ts FROM sp GROUP BY split""")
def win8(spark, folder):
    pooled = splits.pool_splits(split_samples(spark, folder, multi=True))
    # Targets are whole; past 2^53 a sum of doubles depends on the order of the rows.
    whole = F.col("target").cast("decimal(19,0)")
    return pooled.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(whole).cast("bigint").alias("target_sum"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("win9_split_sizes", f"""WITH {MULTI_SAMPLES}
SELECT trace_id, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
       count(*) FILTER (split = 'test') AS test, count(*) AS total FROM sp GROUP BY trace_id""")
def win9(spark, folder):
    return splits.split_sizes(split_samples(spark, folder, multi=True))


RULE = f"""ruled AS (
  SELECT trace_id, lba, timestamp, seq, greatest(row_number() OVER w - 2, 0) AS history,
         CASE WHEN row_number() OVER w - 2 >= {MIN_HISTORY}
              THEN (lag(timestamp) OVER w - first(timestamp) OVER w)::DOUBLE / (row_number() OVER w - 2)
         END AS mean_interval
  FROM pre WINDOW w AS (PARTITION BY trace_id, lba ORDER BY timestamp, seq))"""
EARLY = """pre AS (SELECT * FROM writes
  QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, seq)
          <= round_even(0.70::DOUBLE * count(*) OVER (PARTITION BY trace_id), 0))"""
ALL_WRITES = "pre AS (SELECT * FROM writes)"


@query("win10_rule_statistic", f"""WITH {MULTI}, {EARLY}, {RULE}
SELECT trace_id, lba, timestamp, history, round(mean_interval, 3) AS mean_interval FROM ruled""")
def win10(spark, folder):
    found = intervals.rule_statistic(trace_multi(spark, folder), MIN_HISTORY, fraction=0.70)
    return rounded(found, 3, "mean_interval").select("trace_id", "lba", "timestamp", "history", "mean_interval")


#: Cut-off of ten hours in microseconds; it labels both ways on the events trace.
RULE_CUT = 3.6e10


@query("win11_rule_temperature", f"""WITH {MULTI}, {ALL_WRITES}, {RULE}
SELECT trace_id, lba, timestamp, CASE WHEN mean_interval IS NULL THEN 'UNKNOWN'
       WHEN mean_interval <= {RULE_CUT} THEN 'HOT' ELSE 'COLD' END AS temperature FROM ruled""")
def win11(spark, folder):
    return intervals.rule_temperature(trace_multi(spark, folder), RULE_CUT, MIN_HISTORY).select(
        "trace_id", "lba", "timestamp", "temperature")


# -- functions over windows --------------------------------------------------

SCALER = """pool AS (SELECT trace_id, unnest(list_append(inputs, target)) AS x FROM sp WHERE split = 'train'),
scaler AS (SELECT trace_id, avg(ln(1 + greatest(x, 0))) AS mean,
                  CASE WHEN stddev_pop(ln(1 + greatest(x, 0))) > 1e-12 THEN stddev_pop(ln(1 + greatest(x, 0)))
                       ELSE 1 END AS std FROM pool GROUP BY trace_id)"""


def _scaler(samples):
    return scaling.fit_scaler(samples.filter(F.col("split") == "train"), ["trace_id"])


@query("fn1_fit_scaler", f"""WITH {MULTI_SAMPLES}, {SCALER}
SELECT trace_id, round(mean, 6) AS mean, round(std, 6) AS std FROM scaler""")
def fn1(spark, folder):
    return rounded(_scaler(split_samples(spark, folder, multi=True)), 6, "mean", "std")


@query("fn2_scale", f"""WITH {MULTI_SAMPLES}, {SCALER}
SELECT trace_id, lba, timestamp, round((ln(1 + greatest(inputs[1], 0)) - mean) / std, 5) AS oldest,
       round((ln(1 + greatest(inputs[5], 0)) - mean) / std, 5) AS newest FROM sp JOIN scaler USING (trace_id)""")
def fn2(spark, folder):
    samples = split_samples(spark, folder, multi=True)
    scaled = attach(samples, _scaler(samples), ["trace_id"]).withColumn(
        "z", scaling.scale(F.col("inputs"), F.col("mean"), F.col("std")))
    return scaled.select("trace_id", "lba", "timestamp", r(F.col("z")[0], 5).alias("oldest"),
                         r(F.element_at("z", -1), 5).alias("newest"))


@query("fn3_unscale", f"""WITH {MULTI_SAMPLES}, {SCALER},
z AS (SELECT trace_id, lba, timestamp, std, mean, (position % 23) - 11 AS v FROM sp JOIN scaler USING (trace_id))
SELECT trace_id, lba, timestamp,
       round(ln(1 + greatest(exp(least(greatest(v * std + mean, -50), 50)) - 1, 0)), 5) AS log_interval FROM z""")
def fn3(spark, folder):
    samples = split_samples(spark, folder, multi=True)
    back = scaling.unscale((F.col("position") % 23 - 11).cast("double"), F.col("mean"), F.col("std"))
    return attach(samples, _scaler(samples), ["trace_id"]).select(
        "trace_id", "lba", "timestamp", r(F.log1p(back), 5).alias("log_interval"))


@query("fn4_window_features", f"""WITH {SAMPLES},
lg AS (SELECT trace_id, lba, timestamp, list_transform(inputs, lambda x: ln(1 + greatest(x, 0))) AS v FROM sp)
SELECT trace_id, lba, timestamp, round(v[1], 5) AS f1, round(v[2], 5) AS f2, round(v[3], 5) AS f3,
       round(v[4], 5) AS f4, round(v[5], 5) AS f5, round(list_avg(v), 5) AS f6,
       round(list_stddev_pop(v), 5) AS f7, round(list_min(v), 5) AS f8, round(list_max(v), 5) AS f9,
       round(list_sort(v)[3], 5) AS f10, round(v[5], 5) AS f11, round(v[5] - v[1], 5) AS f12,
       round((v[3] + v[4] + v[5]) / 3, 5) AS f13 FROM lg""")
def fn4(spark, folder):
    samples = split_samples(spark, folder).withColumn("f", windows.window_features(F.col("inputs")))
    return samples.select("trace_id", "lba", "timestamp",
                          *[r(F.col("f")[i], 5).alias(f"f{i + 1}") for i in range(LENGTH + 8)])


def _baseline_query(name: str, label: str):
    @query(name, f"""WITH {SAMPLES}
SELECT trace_id, lba, timestamp, round(({BASELINE_COLUMNS[label]})::DOUBLE, 3) AS predicted FROM sp""")
    def run(spark, folder):
        samples = intervals.build_sequences(trace_events(spark, folder), LENGTH)
        return samples.select("trace_id", "lba", "timestamp",
                              r(windows.BASELINES[label](F.col("inputs")), 3).alias("predicted"))
    return run


_baseline_query("fn5_last_interval", "last_interval")
_baseline_query("fn6_mean_interval", "mean_interval")
_baseline_query("fn7_median_interval", "median_interval")
_baseline_query("fn8_moving_average", "moving_average_3")
_baseline_query("fn9_ema", "ema_0.5")


@query("fn10_predict_all", f"""WITH {SAMPLES},
guess AS ({" UNION ALL ".join(
    f"SELECT trace_id, lba, timestamp, '{n}' AS predictor, ({e})::DOUBLE AS predicted FROM sp"
    for n, e in BASELINE_COLUMNS.items())})
SELECT trace_id, lba, timestamp, predictor, round(predicted, 3) AS predicted FROM guess""")
def fn10(spark, folder):
    samples = intervals.build_sequences(trace_events(spark, folder), LENGTH)
    return rounded(evaluate.predict_all(samples), 3, "predicted").select(
        "trace_id", "lba", "timestamp", "predictor", "predicted")


@query("fn11_classify", f"""WITH {MULTI_SAMPLES}
SELECT trace_id, lba, timestamp, CASE WHEN target <= hot_threshold THEN 'HOT' ELSE 'COLD' END AS temperature
FROM sp JOIN thr USING (trace_id)""")
def fn11(spark, folder):
    samples = settle(split_samples(spark, folder, multi=True), "samples")
    cut = splits.hot_threshold(samples, PERCENTILE)
    return attach(samples, cut, ["trace_id"]).select(
        "trace_id", "lba", "timestamp", temperature(F.col("target"), F.col("hot_threshold")).alias("temperature"))


@query("fn12_hot_threshold", f"""WITH {MULTI_SAMPLES}
SELECT trace_id, round(hot_threshold, 3) AS hot_threshold FROM thr""")
def fn12(spark, folder):
    return rounded(splits.hot_threshold(split_samples(spark, folder, multi=True), PERCENTILE), 3, "hot_threshold")


@query("fn12_pooled_threshold", f"""WITH {MULTI_SAMPLES}
SELECT 1 AS pool, round(quantile_cont(target, 0.3), 3) AS hot_threshold FROM sp WHERE split = 'train'""")
def fn12_pooled(spark, folder):
    pooled = splits.pool_splits(split_samples(spark, folder, multi=True)).withColumn("pool", F.lit(1))
    return rounded(splits.hot_threshold(pooled, PERCENTILE, ["pool"]), 3, "hot_threshold")


@query("fn13_rule_threshold", f"""WITH {MULTI}, {EARLY}, {RULE}
SELECT trace_id, round(quantile_cont(mean_interval, 0.3), 1) AS rule_threshold FROM ruled
WHERE mean_interval IS NOT NULL GROUP BY trace_id""")
def fn13(spark, folder):
    return rounded(splits.rule_threshold(trace_multi(spark, folder), MIN_HISTORY), 1, "rule_threshold")


@query("fn14_device_segments", f"""WITH {MULTI},
d AS (SELECT trace_id, count(DISTINCT lba) AS distinct_lbas FROM writes GROUP BY trace_id),
u AS (SELECT *, unnest([0.70::DOUBLE, 0.80::DOUBLE, 0.85::DOUBLE]) AS utilization FROM d)
SELECT trace_id, utilization, distinct_lbas,
       greatest(1, ceil(distinct_lbas / (utilization * 8)), ceil(distinct_lbas / 8::DOUBLE) + 5)::BIGINT AS segments FROM u""")
def fn14(spark, folder):
    sized = stats.replay_footprint(trace_multi(spark, folder), None).withColumn(
        "utilization", F.explode(F.array(*[F.lit(u) for u in (0.70, 0.80, 0.85)])))
    return sized.select("trace_id", "utilization", "distinct_lbas", capacity.device_segments(
        F.col("distinct_lbas"), F.col("utilization"), 8).alias("segments"))


@query("cln4_device_counts", """SELECT 'lineitem' AS trace_id, l_linestatus AS device, count(*) AS records
FROM lineitem GROUP BY ALL""")
def cln4_counts(spark, folder):
    counts = clean.device_counts(requests(spark, folder), _source_order())
    return counts.select("trace_id", "device", "records")
