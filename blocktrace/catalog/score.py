"""Queries that score predictors and fit models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blocktrace.catalog.common import (
    LABELLED,
    LENGTH,
    MULTI,
    MULTI_SAMPLES,
    PERCENTILE,
    REGRESSION,
    SAMPLES,
    SCORED,
    SCORES,
    AUC,
    CONFUSION,
    PREDICTIONS,
    query,
    rounded,
    split_samples,
    trace_events,
    trace_multi,
)
from blocktrace.functions.windows import median_interval, python_predictor
from blocktrace.operators import compare, evaluate, intervals, models, splits
from blocktrace.plans.storage import settle

RATES = ["accuracy", "precision", "recall", "f1", "actual_hot_fraction", "predicted_hot_fraction"]
ERRORS = ["mae_us", "rmse_us", "median_abs_error_us"]
COUNTS = ["true_positives", "false_positives", "true_negatives", "false_negatives"]
RATES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)
COUNTS_SQL = ", ".join(COUNTS)


def _labelled(spark, folder, multi=True):
    samples = settle(split_samples(spark, folder, multi), "samples")
    cut = splits.hot_threshold(samples, PERCENTILE)
    test = samples.filter(F.col("split") == "test")
    return settle(evaluate.label(evaluate.predict_all(test), cut), "labelled")


def _neat(scores):
    return rounded(rounded(scores, 1, *ERRORS), 6, "mae_log1p", "roc_auc", *RATES)


def scores(spark, folder, multi=True):
    return evaluate.score_predictors(split_samples(spark, folder, multi), PERCENTILE)


@query("ev1_regression_metrics", f"""WITH {MULTI_SAMPLES}, {SCORED}, {REGRESSION}
SELECT trace_id, predictor, test_samples AS n, mae_us, rmse_us, median_abs_error_us, mae_log1p FROM reg""")
def ev1(spark, folder):
    table = evaluate.regression_metrics(_labelled(spark, folder))
    return rounded(rounded(table, 1, *ERRORS), 6, "mae_log1p")


@query("ev2_classification_metrics", f"""WITH {MULTI_SAMPLES}, {SCORED}, {CONFUSION}
SELECT trace_id, predictor, n, {COUNTS_SQL}, {RATES_SQL} FROM cls""")
def ev2(spark, folder):
    return rounded(evaluate.classification_metrics(_labelled(spark, folder)), 6, *RATES)


@query("ev3_roc_auc", f"""WITH {MULTI_SAMPLES}, {SCORED}, {AUC}
SELECT trace_id, predictor, round(roc_auc, 6) AS roc_auc FROM auc""")
def ev3(spark, folder):
    return rounded(evaluate.roc_auc(_labelled(spark, folder)), 6, "roc_auc")


SCORE_COLUMNS = f"""trace_id, predictor, round(hot_threshold, 3) AS hot_threshold_us, test_samples,
       mae_us, rmse_us, median_abs_error_us, mae_log1p, {COUNTS_SQL}, {RATES_SQL}, round(roc_auc, 6) AS roc_auc"""
ALL_SCORES = "reg JOIN cls USING (trace_id, predictor) JOIN auc USING (trace_id, predictor) JOIN thr USING (trace_id)"


@query("ev4_score_predictors", f"WITH {MULTI_SAMPLES}, {SCORES} SELECT {SCORE_COLUMNS} FROM {ALL_SCORES}")
def ev4(spark, folder):
    return rounded(_neat(scores(spark, folder)), 3, "hot_threshold_us")


@query("flagship_score_baselines", f"WITH {SAMPLES}, {SCORES} SELECT {SCORE_COLUMNS} FROM {ALL_SCORES}")
def flagship(spark, folder):
    return rounded(_neat(scores(spark, folder, multi=False)), 3, "hot_threshold_us")


def _comparison(spark, folder):
    samples = settle(split_samples(spark, folder, multi=True), "samples")
    done = evaluate.score_predictors(samples, PERCENTILE)
    return evaluate.comparison_rows(done, splits.split_sizes(samples), family="baseline", length=LENGTH,
                                    source="target training split, p30", seed=42)


@query("ev5_comparison_table", f"""WITH {MULTI_SAMPLES}, {SCORES},
sizes AS (SELECT trace_id, count(*) FILTER (split = 'train') AS train_samples, count(*) FILTER (split = 'val') AS val_samples
          FROM sp GROUP BY trace_id),
best AS (SELECT trace_id, arg_min(predictor, (mae_log1p, predictor)) AS best_baseline, min(mae_log1p) AS best_mae FROM reg GROUP BY trace_id)
SELECT trace_id AS target_trace, split_part(trace_id, '_', 1) AS dataset, 'baseline' AS family, predictor AS model_type,
       {LENGTH} AS sequence_length, train_samples, val_samples, test_samples, mae_us AS test_mae_us, mae_log1p AS test_mae_log1p,
       'target training split, p30' AS hot_threshold_source, round(f1, 6) AS f1, best_baseline,
       round(mae_log1p - best_mae, 5) AS mae_log1p_delta, 42 AS seed
FROM reg JOIN cls USING (trace_id, predictor) JOIN sizes USING (trace_id) JOIN best USING (trace_id)""")
def ev5(spark, folder):
    table = rounded(rounded(_comparison(spark, folder), 1, "test_mae_us"), 6, "test_mae_log1p", "f1")
    neat = rounded(evaluate.best_baseline_deltas(table), 5, "mae_log1p_delta")
    return neat.select("target_trace", "dataset", "family", "model_type", "sequence_length", "train_samples",
                       "val_samples", "test_samples", "test_mae_us", "test_mae_log1p", "hot_threshold_source",
                       "f1", "best_baseline", "mae_log1p_delta", "seed")


def _model_query(name: str, model_type: str):
    @query(name)
    def run(spark, folder):
        samples = split_samples(spark, folder)
        return _neat(models.score_models(samples, [model_type]))
    return run


_model_query("ev6_linear_regression", "linear_regression")
_model_query("ev7_random_forest", "random_forest")
_model_query("ev8_boosted_trees", "boosted_trees")


def _middle(windows: pd.Series) -> pd.Series:
    """A predictor in Python: the median of each window, over a whole batch."""
    return pd.Series(np.median(np.vstack(windows), axis=1) if len(windows) else [], dtype="float64")


@query("udf_python_predictor", f"""WITH {SAMPLES}
SELECT trace_id, lba, timestamp, position, round(list_sort(inputs)[3], 3) AS predicted FROM smp""")
def udf(spark, folder):
    """A vectorised predictor of the user's own, beside the built-in ones."""
    samples = intervals.build_sequences(trace_events(spark, folder), LENGTH)
    predicted = python_predictor(_middle)(F.col("inputs"))
    return rounded(samples.select("trace_id", "lba", "timestamp", "position", predicted.alias("predicted")), 3, "predicted")


@query("ev9_model_predictions")
def ev9(spark, folder):
    samples = settle(split_samples(spark, folder), "samples")
    fitted = models.fit("linear_regression", samples)
    return models.predict(fitted, samples).select("trace_id", "lba", "timestamp", "predicted")


@query("ev10_export_predictions", f"""WITH {SAMPLES}, {PREDICTIONS}
SELECT trace_id, timestamp, lba, round_even(predicted_rewrite_interval, 3) AS predicted_rewrite_interval,
       predicted_class, 'median_interval' AS model_version FROM made""")
def ev10(spark, folder):
    samples = settle(split_samples(spark, folder), "samples")
    scored = evaluate.predict_all(samples, {"median_interval": median_interval})
    return models.export_predictions(scored, splits.hot_threshold(samples, PERCENTILE), "median_interval")


@query("ev10_export_summary", f"""WITH {SAMPLES}, {PREDICTIONS},
k AS (SELECT count(*) AS predicted_write_events,
             count(*) - count(DISTINCT (timestamp, lba)) AS duplicate_timestamp_lba_rows FROM made)
SELECT 'events' AS trace_id, (SELECT count(*) FROM writes) AS total_write_events, predicted_write_events,
       duplicate_timestamp_lba_rows,
       round(predicted_write_events / (SELECT count(*) FROM writes)::DOUBLE, 6) AS prediction_coverage FROM k""")
def ev10_summary(spark, folder):
    summary = models.export_summary(ev10(spark, folder), trace_events(spark, folder))
    return rounded(summary, 6, "prediction_coverage")


SOURCE_TEXT = "training split of the model's own training data"
QUALITY = f"""guess AS (SELECT trace_id, lba, timestamp, position, target, 'median_interval' AS predictor,
                             list_sort(inputs)[3]::DOUBLE AS predicted FROM sp),
{LABELLED}, {REGRESSION}, {CONFUSION}, {AUC}"""


@query("ev10_trace_quality", f"""WITH {MULTI_SAMPLES}, {QUALITY},
total AS (SELECT trace_id, count(*) AS total_write_events FROM writes GROUP BY trace_id),
keys AS (SELECT trace_id, count(*) - count(DISTINCT (timestamp, lba)) AS duplicate_timestamp_lba_rows FROM sp GROUP BY trace_id)
SELECT trace_id, total_write_events, test_samples AS predicted_write_events, duplicate_timestamp_lba_rows,
       round(test_samples / total_write_events::DOUBLE, 6) AS prediction_coverage, predictor AS model_version,
       round(hot_threshold, 3) AS hot_threshold_us, '{SOURCE_TEXT.replace("'", "''")}' AS hot_threshold_source,
       test_samples AS samples, mae_us, rmse_us, median_abs_error_us, mae_log1p, {COUNTS_SQL}, {RATES_SQL},
       round(roc_auc, 6) AS roc_auc
FROM {ALL_SCORES} JOIN total USING (trace_id) JOIN keys USING (trace_id)""")
def ev10_quality(spark, folder):
    """The summary of an exported table: coverage, and its metrics over whole traces."""
    samples = settle(split_samples(spark, folder, multi=True), "samples")
    cuts = settle(splits.hot_threshold(samples, PERCENTILE), "cuts")
    scored = evaluate.predict_all(samples, {"median_interval": median_interval})
    made = models.export_predictions(scored, cuts, "median_interval")
    quality = models.trace_quality(scored, cuts, "median_interval", SOURCE_TEXT)
    summary = models.export_summary(made, trace_multi(spark, folder), quality)
    return rounded(rounded(_neat(summary), 3, "hot_threshold_us"), 6, "prediction_coverage")


def _transfer_roles(samples):
    names = samples.select("trace_id").distinct()
    return names.withColumn("role", F.when(F.col("trace_id") == "t1", "target").otherwise("pretrain"))


@query("ev11_training_sets", f"""WITH {MULTI_SAMPLES},
own AS (SELECT target, row_number() OVER (ORDER BY timestamp, lba, position) AS nth, count(*) OVER () AS n
        FROM sp WHERE trace_id = 't1' AND split = 'train'),
sets AS (SELECT 'scratch' AS variant, target FROM own
  UNION ALL SELECT 'adapted', target FROM own WHERE nth <= round_even(0.2::DOUBLE * n, 0)
  UNION ALL SELECT 'pretrained', target FROM sp WHERE trace_id <> 't1' AND split = 'train')
SELECT 't1' AS target_trace, variant, round(quantile_cont(target, 0.3), 3) AS hot_threshold, count(*) AS threshold_samples
FROM sets GROUP BY variant""")
def ev11_sets(spark, folder):
    """What each variant of `ev11_transfer` takes its threshold from."""
    samples = settle(split_samples(spark, folder, multi=True), "samples")
    roles = _transfer_roles(samples)
    trained = settle(models.training_sets(samples, roles), "training")
    return rounded(models.training_thresholds(trained, roles, PERCENTILE), 3, "hot_threshold")


@query("ev11_transfer")
def ev11(spark, folder):
    samples = settle(split_samples(spark, folder, multi=True), "samples")
    return _neat(models.compare_transfer(samples, _transfer_roles(samples), "linear_regression"))


@query("ev12_grid_search")
def ev12(spark, folder):
    grid = models.grid_search(trace_multi(spark, folder), "random_forest", [10, 20],
                              {"numTrees": [50, 100]})
    return rounded(compare.rank_search(grid), 6, "val_mae_log1p")


@query("ev13_spearman", f"""WITH {MULTI_SAMPLES}, {SCORED},
x AS (SELECT trace_id, predictor, predicted AS a, target AS b FROM lab),
ranks AS (SELECT trace_id, predictor,
  rank() OVER (PARTITION BY trace_id, predictor ORDER BY a) + (count(*) OVER (PARTITION BY trace_id, predictor, a) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY trace_id, predictor ORDER BY b) + (count(*) OVER (PARTITION BY trace_id, predictor, b) - 1) / 2 AS rb FROM x)
SELECT trace_id, predictor, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS rho, count(*) AS n FROM ranks GROUP BY ALL""")
def ev13(spark, folder):
    table = _labelled(spark, folder).select("trace_id", "predictor", "predicted", "target")
    return rounded(evaluate.spearman(table, ["trace_id", "predictor"], "predicted", "target"), 6, "rho")


@query("ev14_class_balance", f"""WITH {MULTI_SAMPLES}, {SCORED}, {CONFUSION}
SELECT trace_id, round(max(actual_hot_fraction) * 100, 5) AS actual_hot_pct,
       round(avg(predicted_hot_fraction) * 100, 5) AS mean_predicted_hot_pct FROM cls GROUP BY trace_id""")
def ev14(spark, folder):
    table = evaluate.class_balance(evaluate.classification_metrics(_labelled(spark, folder)))
    return rounded(table, 5, "actual_hot_pct", "mean_predicted_hot_pct")


@query("ev15_best_predictors", f"""WITH {MULTI_SAMPLES}, {SCORED}, {REGRESSION}
SELECT trace_id, arg_min(predictor, (mae_log1p, predictor)) AS best_predictor, min(mae_log1p) AS best_mae_log1p
FROM reg GROUP BY trace_id""")
def ev15(spark, folder):
    table = evaluate.best_predictors(evaluate.regression_metrics(_labelled(spark, folder)))
    return rounded(table, 6, "best_mae_log1p")


@query("ev15_metric_grid", f"""WITH {MULTI_SAMPLES}, {SCORED}, {REGRESSION}
SELECT predictor, max(mae_log1p) FILTER (trace_id = 't0') AS t0, max(mae_log1p) FILTER (trace_id = 't1') AS t1,
       max(mae_log1p) FILTER (trace_id = 't2') AS t2 FROM reg GROUP BY predictor""")
def ev15_grid(spark, folder):
    table = evaluate.regression_metrics(_labelled(spark, folder))
    return rounded(evaluate.metric_grid(table, "mae_log1p", ["t0", "t1", "t2"]), 6, "t0", "t1", "t2")


@query("ev16_confusion_table", f"""WITH {MULTI_SAMPLES}, {SCORED}, {CONFUSION}
SELECT trace_id, predictor, n, {COUNTS_SQL}, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM cls""")
def ev16(spark, folder):
    table = evaluate.classification_metrics(_labelled(spark, folder))
    return rounded(table.select("trace_id", "predictor", "n", *COUNTS, "accuracy", "f1"), 6, "accuracy", "f1")


@query("win12_rank_search", f"""WITH {MULTI_SAMPLES}, {SCORED}, {REGRESSION},
g AS (SELECT trace_id, predictor, length(predictor)::DOUBLE AS model_size, {LENGTH} AS sequence_length, mae_us AS val_mae_us FROM reg)
SELECT trace_id, predictor, row_number() OVER (ORDER BY val_mae_us, model_size, sequence_length) AS rank,
       row_number() OVER (ORDER BY val_mae_us, model_size, sequence_length) = 1 AS selected FROM g""")
def win12(spark, folder):
    table = evaluate.regression_metrics(_labelled(spark, folder))
    grid = rounded(table, 1, "mae_us").select(
        "trace_id", "predictor", F.length("predictor").cast("double").alias("model_size"),
        F.lit(LENGTH).alias("sequence_length"), F.col("mae_us").alias("val_mae_us"))
    return compare.rank_search(grid).select("trace_id", "predictor", "rank", "selected")


@query("ev_window_length_sweep", f"""WITH {MULTI}, iv AS (
  SELECT trace_id, lba, row_number() OVER (PARTITION BY trace_id, lba ORDER BY timestamp, seq) - 2 AS position FROM writes),
l AS (SELECT unnest([3, 5, 10, 20]) AS sequence_length)
SELECT trace_id, sequence_length, count(*) AS samples FROM iv, l WHERE position >= sequence_length GROUP BY ALL""")
def length_sweep(spark, folder):
    """Samples each window length yields, from one pass over interval positions."""
    found = intervals.rewrite_intervals(trace_multi(spark, folder)).select("trace_id", "position")
    lengths = F.array(*[F.lit(n) for n in (3, 5, 10, 20)])
    fits = F.filter(lengths, lambda n: F.col("position") >= n)
    return found.withColumn("sequence_length", F.explode(fits)).groupBy("trace_id", "sequence_length").agg(
        F.count(F.lit(1)).alias("samples"))
