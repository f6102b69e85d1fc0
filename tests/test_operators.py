"""Hand-computed values for intervals, metrics, joins, placement and audits."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocktrace.functions import capacity, scaling, windows
from blocktrace.operators import (audit, clean, compare, evaluate, intervals, joins, models, placement, selection, splits,
                                  stats)
from blocktrace.sources.tables import check_predictions, typed_predictions

DEMO = [(0, 10), (5, 11), (5, 12), (9, 10, "R"), (12, 10), (20, 11), (31, 10)]


def test_worked_intervals(make_trace, layout):
    rows = intervals.rewrite_intervals(make_trace([(t, 100) for t in (10, 18, 24, 40)])).orderBy("position").collect()
    assert [(r["timestamp"], r["interval"], r["position"]) for r in rows] == [(18, 8, 0), (24, 6, 1), (40, 16, 2)]
    mixed = intervals.rewrite_intervals(make_trace([(0, 1), (1, 2), (10, 1), (21, 2), (30, 1)])).collect()
    assert sorted((r["lba"], r["interval"]) for r in mixed) == [(1, 10), (1, 20), (2, 20)]
    assert intervals.rewrite_intervals(make_trace([(0, 1), (1, 2), (2, 3)])).count() == 0
    zero = intervals.rewrite_intervals(make_trace([(100, 7), (100, 7), (105, 7)])).orderBy("position").collect()
    assert [r["interval"] for r in zero] == [0, 5]


def test_sequences(make_trace, layout):
    rows = intervals.build_sequences(make_trace([(t, 9) for t in (0, 1, 3, 6, 10, 15)]), 3).orderBy("position").collect()
    assert [(r["inputs"], r["target"], r["timestamp"]) for r in rows] == [([1, 2, 3], 4, 10), ([2, 3, 4], 5, 15)]
    two = intervals.build_sequences(make_trace([(t, lba) for lba in (1, 2) for t in range(6)]), 3)
    assert sorted(r["lba"] for r in two.collect()) == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        intervals.build_sequences(make_trace(DEMO), 0)


def test_split_sizes(spark):
    def sizes(times):
        table = spark.createDataFrame([("t", t) for t in times], "trace_id string, timestamp long")
        row = splits.split_sizes(splits.chronological_split(table)).first()
        return row["train"], row["val"], row["test"]

    assert sizes(range(100)) == (70, 15, 15)
    assert sizes([0] * 50 + [1] * 40 + [2] * 10) == (90, 0, 10)


def test_baselines(spark):
    row = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 10)]).alias("x")).select(
        windows.last_interval(F.col("x")), windows.mean_interval(F.col("x")), windows.median_interval(F.col("x")),
        windows.moving_average(3)(F.col("x")), windows.moving_average(10)(F.col("x")),
        windows.ema(0.5)(F.array(*[F.lit(7.0)] * 4))).first()
    assert list(row) == [10, 4, 2.5, 5, 4, 7]
    for wrong in (lambda: windows.moving_average(0), lambda: windows.ema(0.0)):
        with pytest.raises(ValueError):
            wrong()


def test_metrics(spark, layout):
    scored = spark.createDataFrame([("t", "p", 10.0, 12.0), ("t", "p", 20.0, 18.0), ("t", "p", 30.0, 33.0)],
                                   "trace_id string, predictor string, target double, predicted double")
    row = evaluate.regression_metrics(scored).first()
    assert (row["mae_us"], row["rmse_us"], row["median_abs_error_us"]) == \
        pytest.approx((7 / 3, math.sqrt(17 / 3), 2))
    labels = spark.createDataFrame(
        [("t", "p", bool(a), bool(b), float(-b)) for a, b in zip((1, 1, 0, 0, 1), (1, 0, 0, 1, 1))],
        "trace_id string, predictor string, actual_hot boolean, predicted_hot boolean, predicted double")
    row = evaluate.classification_metrics(labels).first()
    assert [row[c] for c in ("true_positives", "false_negatives", "false_positives", "true_negatives")] == [2, 1, 1, 1]
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 3 / 5))
    assert evaluate.roc_auc(labels).first()["roc_auc"] == pytest.approx((2 * 1 + 0.5 * 2 + 0.5 * 1) / 6)
    assert evaluate.roc_auc(labels.filter("actual_hot")).first()["roc_auc"] is None
    empty = evaluate.regression_metrics(scored.limit(0), expected=scored.select("trace_id", "predictor").limit(1)).first()
    assert math.isnan(empty["mae_us"]) and empty["n"] == 0


def test_scaler_and_threshold(spark):
    train = spark.createDataFrame([("t", [5.0, 5.0], 5.0)], "trace_id string, inputs array<double>, target double")
    fitted = scaling.fit_scaler(train, ["trace_id"]).first()
    assert (fitted["mean"], fitted["std"]) == pytest.approx((math.log1p(5), 1.0))
    with pytest.raises(ValueError):
        scaling.require_training(train.limit(0))
    back = spark.range(1).select(scaling.unscale(F.lit(-99.0), F.lit(0.0), F.lit(1.0)).alias("v")).first()["v"]
    assert back == 0.0
    targets = spark.createDataFrame([("t", "train", float(v)) for v in range(1, 101)],
                                    "trace_id string, split string, target double")
    assert splits.hot_threshold(targets, 30).first()["hot_threshold"] == pytest.approx(30.7)
    with pytest.raises(ValueError):
        splits.hot_threshold(targets.filter("split = 'test'"), 30)
    with pytest.raises(ValueError):
        splits.hot_threshold(targets, 100)


@pytest.mark.parametrize("value", [7.0, 1000.0, 12345.0])
def test_constant_intervals_have_unit_deviation(spark, value):
    train = spark.createDataFrame([("t", [value] * 20, value)] * 400 + [("t", [value] * 9, value)] * 30,
                                  "trace_id string, inputs array<double>, target double").repartition(5)
    assert scaling.fit_scaler(train, ["trace_id"]).first()["std"] == 1.0
    assert train.select(windows.window_features(F.col("inputs")).alias("f"), F.size("inputs").alias("n")) \
        .filter(F.col("f")[F.col("n") + 1] != 0.0).isEmpty()


def test_scaler_matches_a_plain_pool_of_unequal_windows(spark):
    rng = random.Random(3)
    made = [("t", [rng.uniform(0, 1e6) for _ in range(rng.choice([1, 4, 9]))], rng.uniform(0, 1e6)) for _ in range(200)]
    pool = np.log1p([x for _, inputs, target in made for x in [*inputs, target]])
    row = scaling.fit_scaler(spark.createDataFrame(
        made, "trace_id string, inputs array<double>, target double"), ["trace_id"]).first()
    assert (row["mean"], row["std"]) == pytest.approx((pool.mean(), pool.std()), rel=1e-12)


def test_a_trace_without_history_is_named(spark, make_trace):
    rows = make_trace([(n * 5, 1) for n in range(40)]).unionByName(make_trace([(0, 1), (9, 2)], "quiet"))
    with pytest.raises(ValueError, match="quiet"):
        splits.rule_threshold(rows, 2)
    scored = spark.createDataFrame([("quiet", "p", 1.0, 2.0)], "trace_id string, predictor string, target double, predicted double")
    cuts = spark.createDataFrame([("demo", 1.0)], "trace_id string, hot_threshold double")
    with pytest.raises(Exception, match="no threshold for trace quiet"):
        evaluate.label(scored, cuts).collect()


def test_each_trace_has_its_own_rule_threshold(spark, make_trace):
    rows = make_trace([(t, 1) for t in (0, 10, 20, 30)]).unionByName(make_trace([(t, 1) for t in (0, 10, 20, 30)], "b"))
    cuts = spark.createDataFrame([("demo", 15.0), ("b", 5.0)], "trace_id string, rule_threshold double")
    found = intervals.rule_temperature(rows, cuts, 2).filter("temperature <> 'UNKNOWN'").collect()
    assert {r["trace_id"]: r["temperature"] for r in found} == {"demo": "HOT", "b": "COLD"}


def test_audit_keeps_traces_with_rejects_only(spark, make_trace):
    checked = _predictions(spark, [(1, 10, "oops", "HOT")]).withColumn("trace_id", F.lit("other"))
    rows = {r["trace_id"]: r for r in joins.prediction_audit(make_trace([(1, 10)]), checked).collect()}
    assert (rows["other"]["rows_read"], rows["other"]["malformed_rows"], rows["other"]["lookups"]) == (1, 1, 0)
    assert rows["demo"]["lookup_misses"] == 1


def test_rule_classifier(make_trace, layout):
    rows = intervals.rule_temperature(make_trace([(t, 10) for t in (0, 10, 20, 30)]), 15.0, 2).orderBy("seq").collect()
    assert [r["temperature"] for r in rows] == ["UNKNOWN", "UNKNOWN", "UNKNOWN", "HOT"]
    cold = intervals.rule_temperature(make_trace([(t, 20) for t in (0, 100, 200, 300)]), 15.0, 2).orderBy("seq").collect()
    assert cold[-1]["temperature"] == "COLD"
    with pytest.raises(ValueError):
        intervals.rule_temperature(make_trace(DEMO), 1.0, 0)


def test_future_writes_do_not_move_the_rule_threshold(make_trace):
    rows = [(lba + 100 * n, lba) for n in range(30) for lba in range(40)]
    early = len(rows) * 7 // 10
    poisoned = rows[:early] + [(t * 1000, lba) for t, lba in rows[early:]]
    cuts = [splits.rule_threshold(make_trace(r), 2).first()["rule_threshold"] for r in (rows, poisoned)]
    assert cuts[0] == cuts[1] == 100


def _predictions(spark, rows):
    text = spark.createDataFrame(
        [(str(t), str(lba), str(v), c, "m1", "demo", i) for i, (t, lba, v, c) in enumerate(rows)],
        "timestamp string, lba string, predicted_rewrite_interval string, predicted_class string, "
        "model_version string, trace_id string, line_id long")
    return check_predictions(text)


def test_predictions_meet_writes(spark, make_trace, layout):
    checked = _predictions(spark, [(5, 11, 120.5, "HOT"), (5, 12, 9e5, "COLD"), (12, 10, 50.0, "HOT"), (31, 10, 7.5, "HOT")])
    lookups = [(0, 10), (5, 11), (5, 12), (5, 99), (12, 10), (20, 11), (31, 10)]
    audit = joins.prediction_audit(make_trace(lookups), checked).first()
    assert (audit["rows_read"], audit["rows_matched"], audit["lookups"], audit["lookup_misses"],
            audit["unmatched_predictions"]) == (4, 4, 7, 3, 0)
    assert not audit["out_of_order_input"]


def test_prediction_anomalies(spark, make_trace):
    checked = _predictions(spark, [(1, 10, 5.0, "HOT"), (2, 11, "oops", "HOT"), (3, 12, 5.0, "LUKEWARM"),
                                   (4, 13, 5.0, "0"), (4, 13, 6.0, "HOT"), (9, 14, 5.0, "HOT")])
    trace = make_trace([(1, 10), (2, 11), (3, 12), (4, 13), (4, 13)])
    met = joins.prediction_audit(trace, checked).first()
    assert [met[c] for c in ("malformed_rows", "unknown_class_rows", "duplicate_key_rows", "unmatched_predictions")] == [1] * 4
    given = joins.assign_predictions(trace, typed_predictions(checked), ["line_id"]).orderBy("seq").collect()
    assert [r["temperature"] for r in given] == ["HOT", "UNKNOWN", "UNKNOWN", "COLD", "UNKNOWN"]


def test_policies_see_one_workload(spark, make_trace, layout):
    made = typed_predictions(_predictions(spark, [(12, 10, 5.0, "HOT"), (20, 11, 9e5, "COLD"), (31, 10, 5.0, "HOT")]))
    routed = placement.route(placement.policy_temperatures(
        make_trace(DEMO), made, ["line_id"], rule_threshold=15.0, min_history=1))
    rows = {r["policy"]: r for r in placement.placement_counters(routed).collect()}
    assert {r["total_write_requests"] for r in rows.values()} == {6}
    assert (rows["MIXED"]["unpredicted_writes"], rows["MIXED"]["cold_stream_writes"]) == (6, 0)
    assert rows["PREDICTED"]["unpredicted_writes"] == 3 and rows["PREDICTED"]["cold_stream_writes"] == 1


def test_live_blocks_and_replay(make_trace):
    trace = make_trace(DEMO)
    assert [r["live_blocks"] for r in placement.live_blocks_at(trace, [0, 5, 40]).orderBy("instant").collect()] == [1, 3, 3]
    assert [r["live_blocks"] for r in placement.live_blocks_after(trace, [1, 2, 9]).orderBy("after_writes").collect()] == [1, 2, 3]
    met = placement.replayed_requests(trace, 3).first()
    assert (met["read_requests"], met["write_requests"]) == (0, 3)


def test_empty_defaults_keep_high_percentiles_absent(spark, make_trace):
    trace = make_trace([(0, 1), (1, 2)])
    summary = stats.interval_summary(trace, stats.lba_profile(trace))
    row = stats.with_empty_defaults(summary, trace).first()
    assert row["median_rewrite_interval_us"] == 0.0 and row["p90_rewrite_interval_us"] is None


def test_device_sizing(spark):
    sizes = spark.createDataFrame([(45870, 0.70), (10, 0.85)], "d long, u double")
    rows = sizes.select(capacity.device_segments(F.col("d"), F.col("u"), 64).alias("s")).collect()
    assert [r["s"] for r in rows] == [1024, 6]


def test_roles(spark):
    rows = [("msr", f"msr_{n}", 3_000_00, 0.5, 6000, 4000.0) for n in "abcdef"]
    rows += [("systor", "systor_1", 300000, 0.5, 6000, 4000.0), ("systor", "systor_2", 17088, 0.5, 6000, 82.0)]
    table = spark.createDataFrame(rows, "dataset string, trace_id string, write_blocks long, rewrite_ratio double, "
                                        "unique_written_lbas long, duration_seconds double")
    roles = {r["trace_id"]: r for r in selection.assign_roles(selection.with_eligibility(table)).collect()}
    assert [n for n, r in sorted(roles.items()) if r["role"] == "target"] == ["msr_c", "msr_d"]
    assert roles["systor_1"]["role"] == "external"
    assert roles["systor_2"]["ineligible_reasons"] == "write_blocks 17,088 < 200,000; duration_seconds 82 < 3,600"


def test_merge_guard(spark):
    left = spark.createDataFrame([("t", 10, "a")], "target_trace string, test_samples long, model_type string")
    right = spark.createDataFrame([("t", 11, "b")], left.schema)
    with pytest.raises(RuntimeError):
        compare.merge_scores(left, right)
    assert compare.merge_scores(left, left).count() == 2


def test_models_learn_a_toy_task(spark):
    rows = []
    for i in range(400):
        window = [float(10 + (i * 7 + j * 13) % 50) for j in range(4)]
        rows.append(("t", window, 3 * window[0], "train" if i < 280 else "val" if i < 340 else "test"))
    samples = spark.createDataFrame(rows, "trace_id string, inputs array<double>, target double, split string")
    table = models.score_models(samples, ["linear_regression"]).first()
    median = evaluate.score_predictors(samples, predictors={"median": windows.median_interval}).first()
    assert table["mae_log1p"] < median["mae_log1p"] / 2
    with pytest.raises(ValueError):
        models.fit("linear_regression", samples.filter("split = 'test'"))
    with pytest.raises(ValueError):
        models.make_estimator("unknown", 1)
    roles = spark.createDataFrame([("t", "target"), ("t", "pretrain")], "trace_id string, role string")
    with pytest.raises(ValueError):
        models.compare_transfer(samples, roles, "linear_regression")


def test_fits_run_on_all_cores(spark, monkeypatch):
    """Samples that come in one partition are dealt over all cores; kept node ids grow the same trees."""
    rows = [("t", [float(1 + (i * 7 + j * 13) % 50) for j in range(4)], float(1 + i * i % 97), "train" if i % 3 else "val")
            for i in range(3000)]
    samples = spark.createDataFrame(rows, "trace_id string, inputs array<double>, target double, split string").coalesce(1)
    made, real = [], models.make_estimator

    def estimator(*args, **kwargs):
        found = real(*args, **kwargs)
        grow = found.fit
        found.fit = lambda data: made.append([len(p) for p in data.rdd.glom().collect()]) or grow(data)
        return found

    monkeypatch.setattr(models, "make_estimator", estimator)
    small = {"numTrees": 5, "maxDepth": 6}
    kept = models.fit("random_forest", samples, **small)
    walked = models.fit("random_forest", samples, cacheNodeIds=False, maxMemoryInMB=256, **small)
    models.fit("boosted_trees", samples, patience=2, maxIter=2, maxDepth=2)
    cores = spark.sparkContext.defaultParallelism
    assert all(len(sizes) == cores and max(sizes) < 2 * 2000 / cores for sizes in made) and len(made) == 3
    assert kept.model.toDebugString.split("\n")[1:] == walked.model.toDebugString.split("\n")[1:]


def test_python_predictor(spark):
    double = windows.python_predictor(lambda values: values.map(lambda v: float(v[-1] * 2)))
    samples = spark.createDataFrame([("t", [1.0, 4.0], 2.0)], "trace_id string, inputs array<double>, target double")
    assert evaluate.predict_all(samples, {"double": double}).first()["predicted"] == 8.0


def test_device_map_is_bounded(spark):
    counts = spark.createDataFrame([("t", d, n) for d, n in (("a", 5), ("b", 9), ("c", 5), ("d", 1))] + [("u", "a", 2)],
                                   "trace_id string, device string, records long")
    rows = {r["trace_id"]: r for r in clean.device_record_map(counts, busiest=2).collect()}
    assert rows["t"]["device_record_counts"] == {"b": 9, "a": 5}
    assert (rows["t"]["other_devices"], rows["t"]["other_device_records"]) == (2, 6)
    assert (rows["u"]["other_devices"], rows["u"]["other_device_records"]) == (0, 0)


def test_model_trained_on_its_target(spark):
    models_ = spark.createDataFrame(
        [("t", "a", 5, 1.0, "training", ["u", "v"]), ("t", "b", 5, 1.0, "training", ["u", "t"]), ("t", "c", 5, 1.0, "training", None),
         (None, "d", 5, 1.0, "training", ["u"])],
        "target_trace string, model_type string, sequence_length int, hot_threshold double, hot_threshold_source string, "
        "pretrain_traces array<string>")
    bad = audit.bad_model_records(models_).collect()
    assert [(r["model_type"], r["trained_on_target"], r["mixed_lengths"]) for r in bad] == [("b", True, False)]
    assert audit.bad_model_records(models_.drop("pretrain_traces")).count() == 0


def test_name_of_the_predicting_policy(spark):
    runs = spark.createDataFrame([("t", 8, "MIXED", None, 0), ("t", 8, "OURS", "scratch", 0), ("t", 8, "PREDICTED", "scratch", 0)],
                                 "trace string, total_segments int, policy string, model_type string, cold_stream_writes int")
    label = compare.configuration(F.col("policy"), F.col("model_type"), "OURS")
    assert [r[0] for r in runs.select(label).collect()] == ["MIXED", "LSTM scratch", "PREDICTED"]
    assert [r["policy"] for r in audit.misused_cold_log(runs, "OURS").collect()] == ["OURS"]


def test_training_sets_of_a_transfer(spark):
    rows = [(trace, 10 * i, i, 0, [1.0], float(i), "train" if i < 10 else "test") for trace in ("p", "q", "t") for i in range(12)]
    samples = spark.createDataFrame(rows, "trace_id string, timestamp long, lba long, position long, inputs array<double>, "
                                          "target double, split string")
    roles = spark.createDataFrame([("t", "target"), ("q", "target"), ("p", "pretrain")], "trace_id string, role string")
    cuts = models.training_thresholds(models.training_sets(samples, roles, 0.3), roles, 50.0).collect()
    found = {(r["target_trace"], r["variant"]): (r["hot_threshold"], r["threshold_samples"]) for r in cuts}
    one = {"pretrained": (4.5, 10), "adapted": (1.0, 3), "scratch": (4.5, 10)}
    assert found == {(t, v): value for t in "qt" for v, value in one.items()}


def test_quality_of_an_exported_table(spark):
    scored = spark.createDataFrame([("t", 10.0, 10.0), ("t", 20.0, 40.0), ("t", 90.0, 10.0)],
                                   "trace_id string, target double, predicted double")
    cuts = spark.createDataFrame([("t", 25.0)], "trace_id string, hot_threshold double")
    row = models.trace_quality(scored, cuts, "m1").first()
    assert (row["model_version"], row["samples"], row["hot_threshold_us"], row["median_abs_error_us"]) == ("m1", 3, 25.0, 20.0)
    assert (row["true_positives"], row["false_negatives"], row["false_positives"]) == (1, 1, 1)
    assert abs(row["mae_us"] - 100 / 3) < 1e-9 and "training" in row["hot_threshold_source"]
