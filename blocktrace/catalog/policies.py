"""Queries over run tables, result tables, audits and workload selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocktrace.catalog.common import (
    CONFIGURATION,
    CONFUSION,
    MIXED_BASE,
    MULTI,
    MULTI_SAMPLES,
    REGRESSION,
    RUNS,
    SCORED,
    query,
    r,
    rounded,
    runs,
    split_samples,
    table,
    trace_multi,
)
from blocktrace.catalog.score import _comparison, _labelled
from blocktrace.functions import capacity
from blocktrace.operators import audit, compare, evaluate, intervals, joins, selection, splits, stats
from blocktrace.plans.storage import settle

UTIL1 = "round_even(target_utilization * 100, 1)"
UTIL0 = "round_even(target_utilization * 100, 0)::INTEGER"


def _change(column: str, base: str) -> str:
    return f"CASE WHEN {base} <> 0 THEN round(({column} - {base})::DOUBLE / {base} * 100, 5) END"


ABLATION = f"""{RUNS}, {MIXED_BASE},
abl AS (
  SELECT runs.*, {UTIL1} AS utilization_pct, {CONFIGURATION} AS configuration,
         round(1 - unpredicted_writes / total_write_requests, 6) AS prediction_coverage,
         {_change('waf', 'mixed_waf')} AS waf_vs_mixed_pct,
         {_change('valid_blocks_migrated', 'mixed_migrated')} AS migrations_vs_mixed_pct,
         {_change('gc_bytes_copied', 'mixed_gc')} AS gc_bytes_vs_mixed_pct
  FROM runs JOIN base ON runs.trace = base.trace AND {UTIL1} = base.utilization_pct)"""
CHANGES = ["waf_vs_mixed_pct", "migrations_vs_mixed_pct", "gc_bytes_vs_mixed_pct"]
RUN_KEY = ["trace", "total_segments", "policy", "model_type"]
KEY_SQL = ", ".join(RUN_KEY)


def _ablation(spark, folder):
    return rounded(compare.ablation(settle(runs(spark, folder), "runs")), 5, *CHANGES)


@query("jn3_mixed_baseline", f"""WITH {RUNS}, {MIXED_BASE}
SELECT runs.trace, total_segments, policy, model_type, round(waf, 9) AS waf, round(mixed_waf, 9) AS mixed_waf
FROM runs JOIN base ON runs.trace = base.trace AND {UTIL1} = base.utilization_pct""")
def jn3(spark, folder):
    joined = compare.with_mixed_baseline(settle(runs(spark, folder), "runs"))
    return rounded(joined.select(*RUN_KEY, "waf", "mixed_waf"), 9, "waf", "mixed_waf")


@query("jn3_groups_without_baseline", f"""WITH {RUNS}
SELECT trace, {UTIL1} AS utilization_pct, count(*) AS runs FROM runs
WHERE NOT (policy = 'MIXED' AND total_segments = 900) GROUP BY ALL HAVING count(*) FILTER (policy = 'MIXED') = 0""")
def jn3_missing(spark, folder):
    kept = runs(spark, folder).filter(~((F.col("policy") == "MIXED") & (F.col("total_segments") == 900)))
    return compare.groups_without_baseline(kept)


@query("jn4_control_check", f"""WITH {RUNS}
SELECT trace, total_segments, round(waf + CASE WHEN total_segments = 900 THEN 0.001 ELSE 0 END, 9) AS waf,
       round(waf, 9) AS waf_existing FROM runs WHERE policy = 'MIXED' AND total_segments = 900""")
def jn4(spark, folder):
    old = settle(runs(spark, folder), "runs")
    new = old.withColumn("waf", F.col("waf") + F.when(F.col("total_segments") == 900, 0.001).otherwise(0.0))
    return rounded(compare.control_check(new, old), 9, "waf", "waf_existing")


CELLS = f"""{RUNS}, b AS (SELECT trace, total_segments, arg_min(waf, (policy, model_type)) AS mixed_waf
  FROM runs WHERE policy = 'MIXED' GROUP BY ALL),
chg AS (SELECT runs.*, mixed_waf, (waf / mixed_waf - 1) * 100 AS waf_change,
               CASE WHEN policy = 'PREDICTED' THEN 'LSTM ' || model_type ELSE policy END AS configuration
        FROM runs LEFT JOIN b USING (trace, total_segments)),
cells AS (SELECT configuration AS policy, trace AS workload, {UTIL0} AS utilization_pct, waf,
                 waf_change AS change_vs_mixed_pct FROM chg WHERE policy <> 'MIXED')"""


def _combined(spark, folder):
    """Existing runs plus the same runs under new model names, as if replayed."""
    old = settle(runs(spark, folder), "runs")
    return compare.combine_runs(old, old.filter(F.col("policy") == "RULE_BASED").withColumn("model_type", F.lit("xgboost")))


def _cells(spark, folder):
    old = settle(runs(spark, folder), "runs")
    labelled = compare.combine_runs(old, old.filter(F.lit(False)))
    return compare.waf_cells(compare.waf_change(labelled))


@query("set1_union_tables", f"""WITH {RUNS}
SELECT trace, total_segments, policy, model_type, round(waf, 9) AS waf,
       CASE WHEN policy = 'PREDICTED' THEN 'LSTM ' || model_type ELSE policy END AS configuration FROM runs
UNION ALL SELECT trace, total_segments, policy, 'xgboost', round(waf, 9), 'xgboost' FROM runs WHERE policy = 'RULE_BASED'""")
def set1(spark, folder):
    return rounded(_combined(spark, folder).select(*RUN_KEY, "waf", "configuration"), 9, "waf")


@query("pc1_ablation", f"""WITH {ABLATION}
SELECT {KEY_SQL}, utilization_pct, configuration, total_write_requests, logical_bytes_written, physical_bytes_written,
       gc_bytes_copied, valid_blocks_migrated, cold_stream_writes, unpredicted_writes, round(waf, 9) AS waf, prediction_coverage,
       {", ".join(CHANGES)} FROM abl""")
def pc1(spark, folder):
    shown = _ablation(spark, folder).select(
        *RUN_KEY, "utilization_pct", "configuration", "total_write_requests", "logical_bytes_written",
        "physical_bytes_written", "gc_bytes_copied", "valid_blocks_migrated", "cold_stream_writes",
        "unpredicted_writes", r("waf", 9).alias("waf"), r("prediction_coverage").alias("prediction_coverage"), *CHANGES)
    return compare.sort_for_display(shown)


@query("win13_display_order", f"""WITH {ABLATION}
SELECT trace, utilization_pct, configuration, CASE configuration WHEN 'MIXED' THEN 0 WHEN 'RULE_BASED' THEN 1
  WHEN 'LSTM scratch' THEN 2 WHEN 'LSTM pretrained' THEN 3 WHEN 'LSTM pretrained+finetuned' THEN 4 ELSE 99 END AS place FROM abl""")
def win13(spark, folder):
    return _ablation(spark, folder).select(
        "trace", "utilization_pct", "configuration", compare.display_order(F.col("configuration")).alias("place"))


@query("pc2_waf_change", f"""WITH {CELLS}
SELECT {KEY_SQL}, round(mixed_waf, 9) AS mixed_waf, round(waf_change, 5) AS waf_change_vs_mixed_pct FROM chg""")
def pc2(spark, folder):
    changed = compare.waf_change(settle(runs(spark, folder), "runs"))
    return rounded(rounded(changed, 9, "mixed_waf"), 5, "waf_change_vs_mixed_pct").select(
        *RUN_KEY, "mixed_waf", "waf_change_vs_mixed_pct")


@query("pc3_policy_summary", f"""WITH {CELLS},
s AS (SELECT policy, avg(change_vs_mixed_pct) AS m, min(change_vs_mixed_pct) AS lo, max(change_vs_mixed_pct) AS hi FROM cells GROUP BY policy),
c AS (SELECT workload, utilization_pct, policy, avg(change_vs_mixed_pct) AS a FROM cells GROUP BY ALL),
w AS (SELECT workload, utilization_pct, arg_min(policy, (a, policy)) AS policy FROM c GROUP BY ALL),
n AS (SELECT policy, count(*) AS cells_won FROM w GROUP BY policy)
SELECT policy, round(m, 5) AS mean_change_pct, round(lo, 5) AS best_pct, round(hi, 5) AS worst_pct,
       coalesce(cells_won, 0) AS cells_won FROM s LEFT JOIN n USING (policy)""")
def pc3(spark, folder):
    return rounded(compare.policy_summary(_cells(spark, folder)), 5, "mean_change_pct", "best_pct", "worst_pct")


@query("pc4_waf_by_utilization", f"""WITH {ABLATION}
SELECT trace, configuration, round(arg_min(waf, total_segments) FILTER (utilization_pct = 70), 9) AS u70,
       round(arg_min(waf, total_segments) FILTER (utilization_pct = 75), 9) AS u75,
       round(arg_min(waf, total_segments) FILTER (utilization_pct = 80), 9) AS u80 FROM abl GROUP BY ALL""")
def pc4(spark, folder):
    wide = compare.metric_by_utilization(_ablation(spark, folder), "waf", [70.0, 75.0, 80.0])
    return wide.select("trace", "configuration", *[r(F.col(f"`{u}`"), 9).alias(f"u{int(u)}") for u in (70.0, 75.0, 80.0)])


@query("pc4_metric_grid", f"""WITH {ABLATION}
SELECT trace, utilization_pct, max(gc_bytes_copied) FILTER (configuration = 'MIXED') AS mixed,
       max(gc_bytes_copied) FILTER (configuration = 'RULE_BASED') AS rule_based,
       max(gc_bytes_copied) FILTER (configuration = 'LSTM scratch') AS scratch FROM abl GROUP BY ALL""")
def pc4_grid(spark, folder):
    wide = compare.metric_grid(_ablation(spark, folder), "gc_bytes_copied", ["MIXED", "RULE_BASED", "LSTM scratch"])
    return wide.select("trace", "utilization_pct", F.col("MIXED").alias("mixed"),
                       F.col("RULE_BASED").alias("rule_based"), F.col("`LSTM scratch`").alias("scratch"))


#: Baseline scores under the names of placement models, to join with run tables.
MODEL_OF = {"last_interval": "scratch", "mean_interval": "pretrained",
            "median_interval": "pretrained_finetuned", "ema_0.5": "linear_regression"}


def _model_scores(spark, folder):
    table_ = _comparison(spark, folder)
    name = F.col("model_type")
    renamed = F.when(name == "last_interval", "scratch").when(name == "mean_interval", "pretrained") \
        .when(name == "median_interval", "pretrained_finetuned").when(name == "ema_0.5", "linear_regression") \
        .otherwise(name)
    return table_.withColumn("model_type", renamed)


MODEL_SCORES = f"""{MULTI_SAMPLES}, {SCORED}, {REGRESSION}, {CONFUSION},
ms AS (SELECT trace_id AS workload, CASE predictor WHEN 'last_interval' THEN 'LSTM scratch' WHEN 'mean_interval' THEN 'LSTM pretrained'
         WHEN 'median_interval' THEN 'LSTM fine-tuned' WHEN 'ema_0.5' THEN 'Linear regression' END AS policy,
         mae_log1p, round(f1, 6) AS f1, mae_us FROM reg JOIN cls USING (trace_id, predictor))"""


@query("pc5_prediction_summary", f"""WITH {MODEL_SCORES}
SELECT policy, workload, mae_log1p, f1, mae_us FROM ms WHERE policy IS NOT NULL""")
def pc5(spark, folder):
    summary = compare.prediction_summary(_model_scores(spark, folder))
    return rounded(rounded(summary, 6, "mae_log1p", "f1"), 1, "mae_us").select(
        "policy", "workload", "mae_log1p", "f1", "mae_us")


@query("jn5_quality_by_placement", f"""WITH {MODEL_SCORES}, {CELLS},
p AS (SELECT CASE policy WHEN 'LSTM pretrained_finetuned' THEN 'LSTM fine-tuned' ELSE policy END AS policy, workload,
             avg(change_vs_mixed_pct) AS change_vs_mixed_pct FROM cells GROUP BY ALL)
SELECT policy, workload, f1, round(change_vs_mixed_pct, 5) AS change_vs_mixed_pct FROM ms JOIN p USING (policy, workload)""")
def jn5(spark, folder):
    cells = _cells(spark, folder).withColumn("policy", F.when(
        F.col("policy") == "LSTM pretrained_finetuned", "LSTM fine-tuned").otherwise(F.col("policy")))
    joined = compare.quality_by_placement(compare.prediction_summary(_model_scores(spark, folder)), cells)
    return rounded(rounded(joined, 6, "f1"), 5, "change_vs_mixed_pct").select(
        "policy", "workload", "f1", "change_vs_mixed_pct")


@query("ev13_quality_correlation", f"""WITH {MODEL_SCORES}, {CELLS},
p AS (SELECT CASE policy WHEN 'LSTM pretrained_finetuned' THEN 'LSTM fine-tuned' ELSE policy END AS policy, workload,
             avg(change_vs_mixed_pct) AS c FROM cells GROUP BY ALL),
j AS (SELECT workload, rank() OVER (PARTITION BY workload ORDER BY f1) + (count(*) OVER (PARTITION BY workload, f1) - 1) / 2 AS a,
             rank() OVER (PARTITION BY workload ORDER BY c) + (count(*) OVER (PARTITION BY workload, c) - 1) / 2 AS b
      FROM ms JOIN p USING (policy, workload))
SELECT workload, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rho, count(*) AS n FROM j GROUP BY workload""")
def ev13_quality(spark, folder):
    cells = _cells(spark, folder).withColumn("policy", F.when(
        F.col("policy") == "LSTM pretrained_finetuned", "LSTM fine-tuned").otherwise(F.col("policy")))
    joined = settle(compare.quality_by_placement(
        compare.prediction_summary(_model_scores(spark, folder)), cells), "joined")
    return rounded(evaluate.spearman(rounded(joined, 6, "f1"), ["workload"], "f1", "change_vs_mixed_pct"), 6, "rho")


@query("pc6_extreme_changes", f"""WITH {ABLATION}, o AS (SELECT * FROM abl WHERE policy <> 'MIXED' AND waf_vs_mixed_pct IS NOT NULL)
(SELECT 'largest_reduction' AS kind, trace, utilization_pct, configuration, waf_vs_mixed_pct FROM o
 ORDER BY waf_vs_mixed_pct, trace, utilization_pct, configuration LIMIT 1)
UNION ALL (SELECT 'largest_increase', trace, utilization_pct, configuration, waf_vs_mixed_pct FROM o
 ORDER BY waf_vs_mixed_pct DESC, trace, utilization_pct, configuration LIMIT 1)""")
def pc6(spark, folder):
    return compare.extreme_changes(_ablation(spark, folder))


@query("jn7_test_size_conflicts", f"""WITH {MULTI_SAMPLES},
t AS (SELECT trace_id AS target_trace, count(*) AS n FROM sp WHERE split = 'test' GROUP BY trace_id)
SELECT target_trace, 1 AS left_sizes, n AS left_min, n AS left_max, 1 AS right_sizes, n + 1 AS right_min, n + 1 AS right_max
FROM t WHERE target_trace = 't1'""")
def jn7(spark, folder):
    left = settle(_comparison(spark, folder), "comparison")
    right = left.withColumn("test_samples", F.col("test_samples") + F.when(F.col("target_trace") == "t1", 1).otherwise(0))
    return compare.test_size_conflicts(left, right)


@query("jn7_merge_scores", f"""WITH {MULTI_SAMPLES}, {SCORED}, {REGRESSION}
SELECT trace_id AS target_trace, predictor AS model_type, 'baseline' AS family, mae_log1p AS test_mae_log1p FROM reg WHERE trace_id <> 't2'
UNION ALL SELECT trace_id, predictor, 'classical_ml', mae_log1p FROM reg WHERE trace_id <> 't2' AND predictor = 'ema_0.5'""")
def jn7_merge(spark, folder):
    left = settle(_comparison(spark, folder), "comparison")
    right = left.filter((F.col("model_type") == "ema_0.5") & (F.col("target_trace") != "t2")) \
        .withColumn("family", F.lit("classical_ml"))
    merged = compare.merge_scores(left, right)
    return rounded(merged.select("target_trace", "model_type", "family", "test_mae_log1p"), 6, "test_mae_log1p")


@query("fn15_capacity", f"""WITH {RUNS}
SELECT DISTINCT trace, total_segments, policy, total_segments * 64 AS total_blocks,
       greatest(total_segments - (2 + CASE policy WHEN 'MIXED' THEN 1 ELSE 2 END + 1), 0) * 64 AS live_limit,
       round(greatest(total_segments - (2 + CASE policy WHEN 'MIXED' THEN 1 ELSE 2 END + 1), 0) / total_segments::DOUBLE, 6) AS max_utilization
FROM runs""")
def fn15(spark, folder):
    geometry = runs(spark, folder).select("trace", "total_segments", "policy", "blocks_per_segment").distinct()
    segments, blocks = F.col("total_segments"), F.col("blocks_per_segment")
    taken = F.when(F.col("policy") == "MIXED", capacity.unavailable_segments(2, True, 1)) \
        .otherwise(capacity.unavailable_segments(2, True))
    return geometry.select(
        "trace", "total_segments", "policy", capacity.capacity_blocks(segments, blocks).alias("total_blocks"),
        capacity.max_live_blocks(segments, blocks, taken).alias("live_limit"),
        r(capacity.max_utilization(segments, blocks, taken)).alias("max_utilization"))


@query("fn16_write_amplification", """SELECT l_suppkey,
       round(CASE WHEN sum(l_quantity) FILTER (l_returnflag = 'N') IS NULL THEN 1
                  ELSE sum(l_quantity) / sum(l_quantity) FILTER (l_returnflag = 'N') END, 6) AS waf
FROM lineitem GROUP BY l_suppkey""")
def fn16(spark, folder):
    line = table(spark, folder, "lineitem")
    new = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    sums = line.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("p"), F.sum(new).alias("l"))
    return sums.select("l_suppkey", r(capacity.write_amplification(F.col("p"), F.col("l"))).alias("waf"))


# -- audits -------------------------------------------------------------------

@query("au1_unequal_workloads", f"""WITH {RUNS}
SELECT trace, total_segments, count(DISTINCT total_write_requests) AS write_counts,
       count(DISTINCT logical_bytes_written) AS logical_sizes, count(DISTINCT seed) AS seeds,
       count(*) FILTER (policy = 'MIXED') AS mixed_runs FROM runs GROUP BY ALL
HAVING write_counts <> 1 OR logical_sizes <> 1 OR seeds <> 1 OR mixed_runs = 0""")
def au1(spark, folder):
    return audit.unequal_workloads(runs(spark, folder))


BROKEN = """brk AS (SELECT * REPLACE (
  CASE WHEN total_segments = 800 AND policy = 'MIXED' THEN physical_bytes_written + 4096 ELSE physical_bytes_written END AS physical_bytes_written,
  CASE WHEN total_segments = 900 AND policy = 'RULE_BASED' THEN waf + 0.01 ELSE waf END AS waf,
  CASE WHEN total_segments = 800 THEN CASE policy WHEN 'MIXED' THEN 5 ELSE 0 END ELSE cold_stream_writes END AS cold_stream_writes,
  CASE WHEN total_segments = 900 AND policy = 'PREDICTED' THEN total_write_requests - cold_stream_writes ELSE unpredicted_writes END AS unpredicted_writes)
  FROM runs)"""


def _broken(spark, folder):
    """Runs with errors put in, for the audits to find."""
    small, middle = F.col("total_segments") == 800, F.col("total_segments") == 900
    policy, cold = F.col("policy"), F.col("cold_stream_writes")
    return runs(spark, folder).withColumns({
        "physical_bytes_written": F.col("physical_bytes_written") + F.when(small & (policy == "MIXED"), 4096).otherwise(0),
        "waf": F.col("waf") + F.when(middle & (policy == "RULE_BASED"), 0.01).otherwise(0.0),
        "unpredicted_writes": F.when(middle & (policy == "PREDICTED"), F.col("total_write_requests") - cold)
        .otherwise(F.col("unpredicted_writes")),
        "cold_stream_writes": F.when(small, F.when(policy == "MIXED", 5).otherwise(0)).otherwise(cold)})


@query("au2_broken_accounting", f"""WITH {RUNS}, {BROKEN},
f AS (SELECT *, physical_bytes_written <> logical_bytes_written + gc_bytes_copied AS bytes_differ,
             abs(waf - physical_bytes_written / logical_bytes_written) > 1e-6 AS waf_differs FROM brk)
SELECT {KEY_SQL}, bytes_differ, waf_differs FROM f WHERE bytes_differ OR waf_differs""")
def au2(spark, folder):
    return audit.broken_accounting(_broken(spark, folder)).select(*RUN_KEY, "bytes_differ", "waf_differs")


@query("au3_misused_cold_log", f"""WITH {RUNS}, {BROKEN}
SELECT {KEY_SQL}, cold_stream_writes FROM brk
WHERE (policy = 'MIXED' AND cold_stream_writes <> 0) OR (policy <> 'MIXED' AND cold_stream_writes = 0)""")
def au3(spark, folder):
    return audit.misused_cold_log(_broken(spark, folder)).select(*RUN_KEY, "cold_stream_writes")


@query("au4_degenerate_labels", f"""WITH {RUNS}, {BROKEN},
h AS (SELECT *, (total_write_requests - unpredicted_writes - cold_stream_writes) / nullif(total_write_requests - unpredicted_writes, 0) AS hot
      FROM brk WHERE policy <> 'MIXED')
SELECT {KEY_SQL}, round(hot, 6) AS hot_share FROM h WHERE hot < 0.02 OR hot > 0.98""")
def au4(spark, folder):
    return rounded(audit.degenerate_labels(_broken(spark, folder)).select(*RUN_KEY, "hot_share"), 6, "hot_share")


@query("au5_unfair_comparison", f"""WITH {MULTI_SAMPLES},
t AS (SELECT trace_id, count(*) AS n FROM sp WHERE split = 'test' GROUP BY trace_id)
SELECT trace_id AS target_trace, CASE trace_id WHEN 't1' THEN 2 ELSE 1 END AS test_sizes, 1 AS lengths,
       5 AS family_baseline, CASE trace_id WHEN 't2' THEN 0 ELSE 1 END AS variant_last_interval, 0 AS other_families,
       CASE trace_id WHEN 't0' THEN 1 ELSE 0 END AS test_thresholds FROM t""")
def au5(spark, folder):
    """Each target gets one fault: a leaked threshold, a second test size, a missing variant."""
    target, model = F.col("target_trace"), F.col("model_type")
    faulty = _comparison(spark, folder).withColumns({
        "test_samples": F.col("test_samples") + F.when((target == "t1") & (model == "ema_0.5"), 1).otherwise(0),
        "hot_threshold_source": F.when((target == "t0") & (model == "ema_0.5"), "Test split")
        .otherwise(F.col("hot_threshold_source")),
        "model_type": F.when((target == "t2") & (model == "last_interval"), "other").otherwise(model)})
    return audit.unfair_comparison(faulty, ["baseline"], ["last_interval"])


ROLES = """roles AS (SELECT DISTINCT 't' || (user_id % 3) AS trace_id,
  CASE user_id % 3 WHEN 0 THEN 'pretrain' WHEN 1 THEN 'target' ELSE 'external' END AS role FROM events
  UNION SELECT 't2', 'pretrain')"""


@query("au6_role_leaks", f"""WITH {ROLES}
SELECT trace_id FROM roles WHERE role = 'pretrain' INTERSECT SELECT trace_id FROM roles WHERE role IN ('target', 'external')""")
def au6(spark, folder):
    place = F.col("user_id") % 3
    roles = table(spark, folder, "events").select(
        F.concat(F.lit("t"), place.cast("string")).alias("trace_id"),
        F.when(place == 0, "pretrain").when(place == 1, "target").otherwise("external").alias("role")).distinct()
    leaked = roles.unionByName(roles.filter(F.col("trace_id") == "t2").withColumn("role", F.lit("pretrain")))
    audit.require_targets(leaked)
    return audit.role_leaks(leaked)


def _misplaced(spark, folder):
    """Chronological splits where the last hundredth of the blocks is moved into training."""
    samples = split_samples(spark, folder, multi=True)
    return samples.withColumn("split", F.when(F.col("lba") % 100 == 99, "train").otherwise(F.col("split")))


MISPLACED = f"""{MULTI_SAMPLES}, mis AS (SELECT * REPLACE (CASE WHEN lba % 100 = 99 THEN 'train' ELSE split END AS split) FROM sp)"""


@query("au7_split_leaks", f"""WITH {MISPLACED},
e AS (SELECT trace_id, max(timestamp) FILTER (split = 'train') AS train_last, min(timestamp) FILTER (split = 'val') AS val_first,
             max(timestamp) FILTER (split = 'val') AS val_last, min(timestamp) FILTER (split = 'test') AS test_first FROM mis GROUP BY trace_id)
SELECT * FROM e WHERE train_last >= val_first OR val_last >= test_first OR train_last >= test_first""")
def au7(spark, folder):
    return audit.split_leaks(_misplaced(spark, folder))


@query("au7_samples_in_two_splits", """WITH x AS (SELECT l_returnflag AS trace_id, epoch_us(l_shipdate) AS timestamp,
  CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM lineitem)
SELECT trace_id, timestamp FROM x GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def au7_two(spark, folder):
    """A random split of tied times, which the audit must object to."""
    line = table(spark, folder, "lineitem")
    rows = line.select(F.col("l_returnflag").alias("trace_id"),
                       F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
                       F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test").alias("split"))
    return audit.samples_in_two_splits(rows)


@query("au7_windows_with_future", f"""WITH {MULTI_SAMPLES},
b AS (SELECT trace_id, lba, min(timestamp) AS first_write FROM writes GROUP BY ALL)
SELECT trace_id, lba, timestamp, position FROM sp JOIN b USING (trace_id, lba)
WHERE timestamp - (list_sum(inputs) + target + CASE WHEN position % 50 = 0 OR position = 5 THEN 1 ELSE 0 END) < first_write""")
def au7_future(spark, folder):
    """Some windows are one microsecond too long; those of the first samples leave the block's past."""
    trace = trace_multi(spark, folder)
    samples = split_samples(spark, folder, multi=True)
    late = (F.col("position") % 50 == 0) | (F.col("position") == 5)
    samples = samples.withColumn("inputs", F.when(late, F.transform(
        "inputs", lambda x, i: x + F.when(i == 0, 1.0).otherwise(0.0))).otherwise(F.col("inputs")))
    first = intervals.write_events(trace).groupBy("trace_id", "lba").agg(F.min("timestamp").alias("first_write"))
    return audit.windows_with_future(samples, first)


@query("au8_bad_model_records", f"""WITH {MULTI_SAMPLES},
p AS (SELECT unnest(['last_interval', 'mean_interval', 'median_interval', 'moving_average_3', 'ema_0.5']) AS model_type),
m AS (SELECT trace_id AS target_trace, model_type, CASE WHEN trace_id = 't0' AND model_type = 'ema_0.5' THEN NULL ELSE hot_threshold END AS hot_threshold,
             trace_id = 't1' AND model_type = 'ema_0.5' AS from_test, CASE WHEN trace_id = 't2' AND model_type = 'ema_0.5' THEN 6 ELSE 5 END AS len,
             trace_id = 't1' AND model_type = 'mean_interval' AS own FROM thr, p),
l AS (SELECT target_trace, count(DISTINCT len) AS lengths FROM m GROUP BY target_trace)
SELECT target_trace, model_type, coalesce(hot_threshold, 0) <= 0 AS no_threshold, from_test AS threshold_from_test, lengths > 1 AS mixed_lengths, own AS trained_on_target
FROM m JOIN l USING (target_trace) WHERE coalesce(hot_threshold, 0) <= 0 OR from_test OR lengths > 1 OR own""")
def au8(spark, folder):
    ema, target = F.col("model_type") == "ema_0.5", F.col("target_trace")
    records = _comparison(spark, folder).select(
        "target_trace", "model_type",
        F.when(ema & (target == "t0"), F.lit(None)).otherwise(F.col("hot_threshold_us")).alias("hot_threshold"),
        F.when(ema & (target == "t1"), "test split").otherwise("training split").alias("hot_threshold_source"),
        F.when(ema & (target == "t2"), 6).otherwise(F.col("sequence_length")).alias("sequence_length"),
        F.when((F.col("model_type") == "mean_interval") & (target != "t0"), F.array(F.lit("t0"), F.lit("t1")))
        .alias("pretrain_traces"))
    return audit.bad_model_records(records).select(
        "target_trace", "model_type", "no_threshold", "threshold_from_test", "mixed_lengths", "trained_on_target")


# -- selection ----------------------------------------------------------------

#: Thresholds at the size of the given tables; the library defaults are for real traces.
SCALED = selection.Criteria(min_write_blocks=500, min_rewrite_ratio=0.965, min_unique_written_lbas=15,
                            min_duration_seconds=2_574_000.0)
WORKLOADS = """wl AS (
  SELECT CASE WHEN user_id % 10 < 7 THEN 'msr_v' ELSE 'systor_lun' END || (user_id % 10) AS trace_id,
         CASE WHEN user_id % 10 < 7 THEN 'msr' ELSE 'systor' END AS dataset, user_id AS lba,
         epoch_us(ts) AS us, event_type <> 'view' AS w FROM events),
st AS (SELECT trace_id, dataset, count(*) FILTER (w) AS write_blocks, count(DISTINCT lba) FILTER (w) AS unique_written_lbas,
              (count(*) FILTER (w) - count(DISTINCT lba) FILTER (w)) / (count(*) FILTER (w))::DOUBLE AS rewrite_ratio,
              (max(us) - min(us)) / 1e6::DOUBLE AS duration_seconds FROM wl GROUP BY ALL),
el AS (SELECT *, concat_ws('; ',
         CASE WHEN write_blocks < 500 THEN 'write_blocks ' || format('{:,}', write_blocks) || ' < 500' END,
         CASE WHEN rewrite_ratio < 0.965 THEN 'rewrite_ratio ' || format('{:.3f}', rewrite_ratio) || ' < 0.965' END,
         CASE WHEN unique_written_lbas < 15 THEN 'unique_written_lbas ' || format('{:,}', unique_written_lbas) || ' < 15' END,
         CASE WHEN duration_seconds < 2574000 THEN 'duration_seconds ' || format('{:,}', round_even(duration_seconds, 0)::BIGINT) || ' < 2,574,000' END)
         AS ineligible_reasons FROM st),
ok AS (SELECT *, ineligible_reasons = '' AS eligible FROM el)"""


def _workloads(spark, folder):
    """Statistics of ten workloads made from the events, one per last digit of the user."""
    digit = F.col("user_id") % 10
    prefix = F.when(digit < 7, "msr_v").otherwise("systor_lun")
    events = table(spark, folder, "events").select(
        F.concat(prefix, digit.cast("string")).alias("trace_id"), F.col("user_id").alias("lba"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(F.col("event_type") == "view", "R").otherwise("W").alias("operation"))
    profile = settle(stats.lba_profile(events), "profile")
    span = profile.groupBy("trace_id").agg(
        ((F.max("last_ts") - F.min("first_ts")) / 1e6).alias("duration_seconds"), F.sum("writes").alias("write_blocks"))
    table_ = span.join(stats.rewrite_profile(profile), "trace_id", "left") \
        .withColumn("dataset", F.split_part("trace_id", F.lit("_"), F.lit(1)))
    return selection.with_eligibility(table_, SCALED)


@query("sel1_eligibility", f"WITH {WORKLOADS} SELECT trace_id, eligible, ineligible_reasons FROM ok")
def sel1(spark, folder):
    return _workloads(spark, folder).select("trace_id", "eligible", "ineligible_reasons")


@query("sel2_assign_roles", f"""WITH {WORKLOADS},
m AS (SELECT trace_id, row_number() OVER (ORDER BY trace_id) - 1 AS place, count(*) OVER () AS n FROM ok WHERE eligible AND dataset = 'msr'),
k AS (SELECT *, CASE WHEN n > 1 THEN least(2, greatest(1, n - 1)) ELSE 0 END AS cnt FROM m),
t AS (SELECT trace_id FROM k WHERE place >= greatest(0, (n - cnt) // 2) AND place < greatest(0, (n - cnt) // 2) + cnt)
SELECT trace_id, dataset, CASE WHEN NOT eligible THEN 'excluded' WHEN dataset <> 'msr' THEN 'external'
       WHEN trace_id IN (SELECT trace_id FROM t) THEN 'target' ELSE 'pretrain' END AS role, ineligible_reasons FROM ok""")
def sel2(spark, folder):
    return selection.assign_roles(_workloads(spark, folder), SCALED)


@query("sel3_inventory", f"""WITH {WORKLOADS}
SELECT trace_id, dataset, write_blocks, unique_written_lbas, round(rewrite_ratio, 6) AS rewrite_ratio,
       round(duration_seconds, 3) AS duration_seconds, eligible, ineligible_reasons FROM ok""")
def sel3(spark, folder):
    shown = selection.inventory(_workloads(spark, folder), [
        "dataset", "write_blocks", "unique_written_lbas", "rewrite_ratio", "duration_seconds"])
    return rounded(rounded(shown, 6, "rewrite_ratio"), 3, "duration_seconds")


@query("jn6_inventory_decisions", f"""WITH {WORKLOADS}
SELECT trace_id, write_blocks, eligible, CASE WHEN ineligible_reasons = '' THEN 0 ELSE len(string_split(ineligible_reasons, '; ')) END AS reasons FROM ok""")
def jn6(spark, folder):
    return _workloads(spark, folder).select("trace_id", "write_blocks", "eligible", F.size("reasons").alias("reasons"))
