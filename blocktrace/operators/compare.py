"""Comparison of placement policies over run tables (one row per finished run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.operators.joins import union_tables
from blocktrace.plans.ordered import with_ordinal
from blocktrace.plans.storage import attach, settle
from blocktrace.schemas import PREDICTED_POLICY

# Display names and their order in tables.
LSTM_LABELS = {
    "scratch": "LSTM scratch",
    "pretrained": "LSTM pretrained",
    "pretrained_finetuned": "LSTM pretrained+finetuned",
}
POLICY_ORDER = ["MIXED", "RULE_BASED", "LSTM scratch", "LSTM pretrained", "LSTM pretrained+finetuned"]
UNKNOWN_ORDER = 99
#: Model types of the prediction summary and the policy name they appear under.
SUMMARY_POLICIES = {
    "scratch": "LSTM scratch",
    "pretrained": "LSTM pretrained",
    "pretrained_finetuned": "LSTM fine-tuned",
    "linear_regression": "Linear regression",
    "random_forest": "Random forest",
    "xgboost": "XGBoost",
}

RUN_ORDER = ["total_segments", "policy", "model_type"]


def configuration(policy: Column, model_type: Column, predicted_policy: str = PREDICTED_POLICY) -> Column:
    """Row label: the policy, or the model behind a run that follows predictions."""
    label = F.when(policy != predicted_policy, policy)
    for model, name in LSTM_LABELS.items():
        label = label.when(model_type == model, F.lit(name))
    return label.otherwise(F.concat(F.lit("LSTM "), model_type))


def display_order(label: Column) -> Column:
    place = F.lit(UNKNOWN_ORDER)
    for i, name in reversed(list(enumerate(POLICY_ORDER))):
        place = F.when(label == name, F.lit(i)).otherwise(place)
    return place


def sort_for_display(table: DataFrame) -> DataFrame:
    return table.orderBy("trace", "utilization_pct", display_order(F.col("configuration")), "configuration")


def utilization_pct(decimals: int) -> Column:
    return F.bround(F.col("target_utilization") * 100, decimals)


def mixed_baseline(runs: DataFrame, keys: list[str], order: list[str],
                   columns: list[str]) -> DataFrame:
    """First MIXED run of each group, its `columns` prefixed with ``mixed_``."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_b")
    base = runs.filter(F.col("policy") == "MIXED").groupBy(*keys).agg(picked)
    return base.select(*keys, *[F.col(f"_b.{c}").alias(f"mixed_{c}") for c in columns])


def _change(column: str) -> Column:
    base = F.col(f"mixed_{column}")
    return F.when(base != 0, (F.col(column) - base) / base * 100.0)


ABLATION_BASE = ["waf", "valid_blocks_migrated", "gc_bytes_copied"]


def with_mixed_baseline(runs: DataFrame, order: list[str] = RUN_ORDER,
                        predicted_policy: str = PREDICTED_POLICY) -> DataFrame:
    """Each run beside the MIXED run of its trace and utilization; others drop out."""
    labelled = runs.withColumns({
        "configuration": configuration(F.col("policy"), F.col("model_type"), predicted_policy),
        "utilization_pct": utilization_pct(1)})
    keys = ["trace", "utilization_pct"]
    return attach(labelled, mixed_baseline(labelled, keys, order, ABLATION_BASE), keys)


def groups_without_baseline(runs: DataFrame) -> DataFrame:
    """(trace, utilization) groups that have no MIXED run."""
    keyed = runs.withColumn("utilization_pct", utilization_pct(1))
    return keyed.groupBy("trace", "utilization_pct").agg(
        F.count_if(F.col("policy") == "MIXED").alias("_m"), F.count(F.lit(1)).alias("runs")) \
        .filter(F.col("_m") == 0).drop("_m")


def ablation(runs: DataFrame, order: list[str] = RUN_ORDER, predicted_policy: str = PREDICTED_POLICY) -> DataFrame:
    """Run metrics with percent changes against MIXED; null where MIXED is zero."""
    total = F.col("total_write_requests")
    return with_mixed_baseline(runs, order, predicted_policy).select(
        *runs.columns, "configuration", "utilization_pct",
        F.when(total == 0, 0.0).otherwise(1.0 - F.col("unpredicted_writes") / total)
        .alias("prediction_coverage"),
        _change("waf").alias("waf_vs_mixed_pct"),
        _change("valid_blocks_migrated").alias("migrations_vs_mixed_pct"),
        _change("gc_bytes_copied").alias("gc_bytes_vs_mixed_pct"))


def control_check(new: DataFrame, old: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """MIXED runs repeated with the same geometry but another result."""
    keys = ["trace", "total_segments"]
    before = old.filter(F.col("policy") == "MIXED").select(*keys, F.col("waf").alias("waf_existing"))
    return (new.filter(F.col("policy") == "MIXED").select(*keys, "waf").join(before, keys)
            .filter(F.abs(F.col("waf") - F.col("waf_existing")) > tolerance))


def require_same_control(new: DataFrame, old: DataFrame) -> None:
    wrong = control_check(new, old).limit(5).collect()
    if wrong:
        raise RuntimeError(f"MIXED control differs from the existing runs: {wrong}")


def combine_runs(existing: DataFrame, added: DataFrame, predicted_policy: str = PREDICTED_POLICY) -> DataFrame:
    """Existing runs and new model runs in one labelled table; new MIXED controls drop out."""
    old = existing.withColumn("configuration", F.when(
        F.col("policy") == predicted_policy, F.concat(F.lit("LSTM "), F.col("model_type")))
        .otherwise(F.col("policy")))
    new = added.filter(F.col("policy") != "MIXED").withColumn("configuration", F.col("model_type"))
    return union_tables(old, new)


def waf_change(runs: DataFrame, order: list[str] = RUN_ORDER) -> DataFrame:
    """WAF against the MIXED run of the same trace and segment count."""
    keys = ["trace", "total_segments"]
    base = mixed_baseline(runs, keys, order, ["waf"])
    return attach(runs, base, keys, "left").withColumn(
        "waf_change_vs_mixed_pct", (F.col("waf") / F.col("mixed_waf") - 1.0) * 100)


def waf_cells(changes: DataFrame) -> DataFrame:
    """policy x workload x utilization cells of the non-MIXED runs."""
    return changes.filter(F.col("policy") != "MIXED").select(
        F.col("configuration").alias("policy"), F.col("trace").alias("workload"),
        utilization_pct(0).cast("int").alias("utilization_pct"), "waf",
        F.col("waf_change_vs_mixed_pct").alias("change_vs_mixed_pct"))


def policy_summary(cells: DataFrame) -> DataFrame:
    """Mean, best and worst change per policy and the cells it wins."""
    cells = settle(cells, "cells")
    change = F.col("change_vs_mixed_pct")
    summary = cells.groupBy("policy").agg(
        F.avg(change).alias("mean_change_pct"), F.min(change).alias("best_pct"),
        F.max(change).alias("worst_pct"))
    per_cell = cells.groupBy("workload", "utilization_pct", "policy").agg(F.avg(change).alias("_c"))
    winners = per_cell.filter(F.col("_c").isNotNull()).groupBy("workload", "utilization_pct").agg(
        F.min_by("policy", F.struct("_c", "policy")).alias("policy"))
    wins = winners.groupBy("policy").agg(F.count(F.lit(1)).alias("cells_won"))
    return summary.join(wins, "policy", "left").fillna({"cells_won": 0})


def metric_by_utilization(table: DataFrame, metric: str, utilizations: list[float],
                          order: list[str] = RUN_ORDER) -> DataFrame:
    """One row per trace and configuration, one column per utilization."""
    wide = table.groupBy("trace", "configuration").pivot("utilization_pct", utilizations)
    return wide.agg(F.min_by(metric, F.struct(*order)))


def metric_grid(table: DataFrame, metric: str, configurations: list[str],
                order: list[str] = RUN_ORDER) -> DataFrame:
    """One row per trace and utilization, one column per configuration."""
    wide = table.groupBy("trace", "utilization_pct").pivot("configuration", configurations)
    return wide.agg(F.min_by(metric, F.struct(*order)))


def prediction_summary(scores: DataFrame) -> DataFrame:
    """Prediction quality per policy and workload, for the models that place writes."""
    name = F.lit(None).cast("string")
    for model, policy in SUMMARY_POLICIES.items():
        name = F.when(F.col("model_type") == model, F.lit(policy)).otherwise(name)
    return scores.select(
        name.alias("policy"), F.col("target_trace").alias("workload"),
        F.col("test_mae_log1p").alias("mae_log1p"), "f1", "roc_auc",
        F.col("test_mae_us").alias("mae_us"), F.col("test_rmse_us").alias("rmse_us")) \
        .filter(F.col("policy").isNotNull())


def quality_by_placement(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """Prediction quality beside the mean WAF change of the same policy and workload."""
    mean = cells.groupBy("policy", "workload").agg(
        F.avg("change_vs_mixed_pct").alias("change_vs_mixed_pct"))
    return predictions.join(mean, ["policy", "workload"])


def extreme_changes(table: DataFrame) -> DataFrame:
    """The largest WAF reduction and the largest increase over all non-MIXED runs."""
    row = F.struct("trace", "utilization_pct", "configuration", "waf_vs_mixed_pct")
    others = table.filter((F.col("policy") != "MIXED") & F.col("waf_vs_mixed_pct").isNotNull())
    tie = [F.col("trace"), F.col("utilization_pct"), F.col("configuration")]
    ends = others.agg(
        F.min_by(row, F.struct(F.col("waf_vs_mixed_pct"), *tie)).alias("low"),
        F.min_by(row, F.struct(-F.col("waf_vs_mixed_pct"), *tie)).alias("high"))
    both = F.array(F.struct(F.lit("largest_reduction").alias("kind"), F.col("low").alias("r")),
                   F.struct(F.lit("largest_increase").alias("kind"), F.col("high").alias("r")))
    return ends.select(F.explode(both).alias("_e")).select("_e.kind", "_e.r.*")


def rank_search(grid: DataFrame) -> DataFrame:
    """Search results by validation error, then the smaller model."""
    ranked = with_ordinal(grid.withColumn("_search", F.lit(1)), ["_search"],
                          ["val_mae_us", "model_size", "sequence_length"], "rank")
    return ranked.drop("_search").withColumn("rank", F.col("rank") + 1) \
        .withColumn("selected", F.col("rank") == 1)


def test_size_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Targets whose two result tables were scored on different test sizes."""
    def sizes(table: DataFrame, alias: str) -> DataFrame:
        return table.select("target_trace", "test_samples").distinct().groupBy("target_trace").agg(
            F.count(F.lit(1)).alias(f"{alias}_sizes"), F.min("test_samples").alias(f"{alias}_min"),
            F.max("test_samples").alias(f"{alias}_max"))

    # Two sets of sizes differ exactly when a size is in one of them only.
    only = (left.select("target_trace", "test_samples").distinct()
            .unionByName(right.select("target_trace", "test_samples").distinct())
            .groupBy("target_trace", "test_samples").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == 1).select("target_trace").distinct())
    both = sizes(left, "left").join(sizes(right, "right"), "target_trace")
    return both.join(only, "target_trace", "left_semi")


def merge_scores(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Existing rows of the added targets plus the added rows, same test sets only."""
    wrong = test_size_conflicts(existing, added).limit(5).collect()
    if wrong:
        raise RuntimeError(f"result tables use different test sets: {wrong}")
    kept = existing.join(added.select("target_trace").distinct(), "target_trace", "left_semi")
    return union_tables(kept, added)
