"""Exact regression, classification and ranking metrics, and score tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.functions.labels import is_hot
from blocktrace.functions.windows import BASELINES, Predictor
from blocktrace.operators.splits import hot_threshold
from blocktrace.plans.ordered import ordered_columns, percentiles
from blocktrace.plans.storage import attach, join_weighted, settle

SCORE_KEYS = ["trace_id", "predictor"]


def predict_all(samples: DataFrame, predictors: Mapping[str, Predictor] = BASELINES) -> DataFrame:
    """One row per sample and predictor, from a single scan of the samples."""
    guesses = F.array(*[
        F.struct(F.lit(name).alias("predictor"), f(F.col("inputs")).alias("predicted"))
        for name, f in predictors.items()])
    kept = [c for c in samples.columns if c != "inputs"]
    return (samples.select(*kept, F.explode(guesses).alias("_g"))
            .select(*kept, "_g.predictor", "_g.predicted"))


def with_threshold(rows: DataFrame, thresholds: DataFrame, column: str = "hot_threshold") -> DataFrame:
    """Add the threshold of each trace; a trace without one fails instead of losing its rows."""
    missing = F.raise_error(F.concat(F.lit("no threshold for trace "), F.col("trace_id"))).cast("double")
    return attach(rows, thresholds.select("trace_id", column), ["trace_id"], "left").withColumn(
        column, F.when(F.col(column).isNull(), missing).otherwise(F.col(column)))


def label(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Actual and predicted HOT flags from each trace's training threshold."""
    cut = F.col("hot_threshold")
    return with_threshold(scored, thresholds).withColumns({
        "actual_hot": is_hot(F.col("target"), cut),
        "predicted_hot": is_hot(F.col("predicted"), cut)})


def _log_gap() -> Column:
    zero = F.lit(0.0)
    return F.log1p(F.greatest("predicted", zero)) - F.log1p(F.greatest("target", zero))


def _exact_mean(value: Column) -> Column:
    """Mean of an exact sum, so that it depends on neither order nor partitions; doubles if a value has no decimal."""
    whole = value.try_cast("decimal(38,6)")
    return F.when(F.count(whole) == F.count(value), F.avg(whole).cast("double")).otherwise(F.avg(value))


def _regression() -> list[Column]:
    error = F.col("predicted") - F.col("target")
    return [_exact_mean(F.abs(error)).alias("mae_us"),
            F.sqrt(F.avg(error * error)).alias("rmse_us"),
            F.avg(F.abs(_log_gap())).alias("mae_log1p"),
            F.count(F.lit(1)).alias("n")]


def _confusion() -> list[Column]:
    actual, said = F.col("actual_hot"), F.col("predicted_hot")
    return [F.count_if(actual & said).alias("true_positives"),
            F.count_if(~actual & said).alias("false_positives"),
            F.count_if(~actual & ~said).alias("true_negatives"),
            F.count_if(actual & ~said).alias("false_negatives")]


def _rates(table: DataFrame) -> DataFrame:
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    n = tp + fp + tn + fn
    none = F.lit(0.0)
    table = table.withColumns({
        "accuracy": (tp + tn) / n,
        "precision": F.coalesce(F.try_divide(tp, tp + fp), none),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), none),
        "actual_hot_fraction": (tp + fn) / n,
        "predicted_hot_fraction": (tp + fp) / n})
    p, r = F.col("precision"), F.col("recall")
    return table.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), none))


def _median_error(scored: DataFrame, keys: list[str]) -> DataFrame:
    errors = scored.select(*keys, F.abs(F.col("predicted") - F.col("target")).alias("_e"))
    return percentiles(errors, keys, "_e", {"median_abs_error_us": 0.5})


def regression_metrics(scored: DataFrame, keys: list[str] = SCORE_KEYS,
                       expected: DataFrame | None = None) -> DataFrame:
    """MAE, RMSE, median error and log error; NaN for `expected` keys without rows."""
    table = scored.groupBy(*keys).agg(*_regression()).join(_median_error(scored, keys), keys)
    if expected is None:
        return table
    filled = expected.select(*keys).join(table, keys, "left")
    nan = F.lit(float("nan"))
    return filled.select(*keys, *[
        F.coalesce(c, F.lit(0) if c == "n" else nan).alias(c)
        for c in table.columns if c not in keys])


def classification_metrics(labelled: DataFrame, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """Confusion counts and rates with HOT as the positive class."""
    return _rates(labelled.groupBy(*keys).agg(*_confusion(), F.count(F.lit(1)).alias("n")))


def roc_auc(labelled: DataFrame, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, null for one class.

    A shorter predicted interval is a hotter score. Rows are first reduced to
    counts per distinct score, so ranking works on distinct scores only.
    """
    counts = labelled.groupBy(*keys, "predicted").agg(
        F.count_if("actual_hot").alias("_hot"), F.count_if(~F.col("actual_hot")).alias("_cold"))
    ranked = ordered_columns(counts, keys, ["predicted"], running={"_hotter": F.col("_hot")})
    # A cold row is ranked correctly against every hot row with a shorter prediction.
    won = F.col("_cold").cast("double") * (F.col("_hotter") + F.col("_hot") / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(won).alias("_won"), F.sum("_hot").alias("_p"),
                                     F.sum("_cold").alias("_q"))
    return sums.select(*keys, F.try_divide(
        F.col("_won"), F.col("_p").cast("double") * F.col("_q")).alias("roc_auc"))


def score(labelled: DataFrame, keys: list[str] = SCORE_KEYS) -> DataFrame:
    """All metrics of labelled predictions, one row per key."""
    table = _rates(labelled.groupBy(*keys).agg(
        F.max("hot_threshold").alias("hot_threshold_us"), *_regression(), *_confusion()))
    return (table.join(_median_error(labelled, keys), keys)
            .join(roc_auc(labelled, keys), keys)
            .withColumnRenamed("n", "test_samples"))


def score_predictors(split_samples: DataFrame, percentile: float = 30.0,
                     predictors: Mapping[str, Predictor] = BASELINES) -> DataFrame:
    """Every predictor on the identical test split, threshold from training."""
    split_samples = settle(split_samples, "samples")
    thresholds = hot_threshold(split_samples, percentile)
    test = split_samples.filter(F.col("split") == "test").select("trace_id", "inputs", "target")
    return score(label(predict_all(test, predictors), thresholds))


def comparison_rows(scores: DataFrame, sizes: DataFrame, *, family: str, length: int,
                    source: str, seed: int) -> DataFrame:
    """Score rows with the provenance columns of the comparison table."""
    return attach(scores, sizes.select("trace_id", "train", "val", "test"), ["trace_id"]).select(
        F.col("trace_id").alias("target_trace"),
        F.split_part("trace_id", F.lit("_"), F.lit(1)).alias("dataset"),
        F.lit(family).alias("family"), F.col("predictor").alias("model_type"),
        F.lit(length).alias("sequence_length"),
        F.col("train").alias("train_samples"), F.col("val").alias("val_samples"),
        F.col("test").alias("test_samples"),
        F.col("mae_us").alias("test_mae_us"), F.col("rmse_us").alias("test_rmse_us"),
        F.col("median_abs_error_us").alias("test_median_abs_error_us"),
        F.col("mae_log1p").alias("test_mae_log1p"), "hot_threshold_us",
        F.lit(source).alias("hot_threshold_source"),
        "accuracy", "precision", "recall", "f1", "roc_auc",
        "true_positives", "false_positives", "true_negatives", "false_negatives",
        "actual_hot_fraction", "predicted_hot_fraction", F.lit(seed).alias("seed"))


def best_baseline_deltas(comparison: DataFrame) -> DataFrame:
    """Each row's log error minus that of the best baseline of its trace."""
    best = comparison.filter(F.col("family") == "baseline").groupBy("target_trace").agg(
        F.min_by("model_type", F.struct("test_mae_log1p", "model_type")).alias("best_baseline"),
        F.min("test_mae_log1p").alias("best_mae_log1p"))
    return comparison.join(best, "target_trace").withColumn(
        "mae_log1p_delta", F.col("test_mae_log1p") - F.col("best_mae_log1p"))


def best_predictors(scores: DataFrame) -> DataFrame:
    """Predictor with the lowest log error per trace; ties go to the first name."""
    return scores.groupBy("trace_id").agg(
        F.min_by("predictor", F.struct("mae_log1p", "predictor")).alias("best_predictor"),
        F.min("mae_log1p").alias("best_mae_log1p"))


def metric_grid(scores: DataFrame, metric: str, traces: list[str]) -> DataFrame:
    """Predictor by trace table of one metric."""
    return scores.groupBy("predictor").pivot("trace_id", traces).agg(F.avg(metric))


def class_balance(scores: DataFrame) -> DataFrame:
    """Actual share of HOT and the mean predicted share, in percent."""
    return scores.groupBy("trace_id").agg(
        (F.max("actual_hot_fraction") * 100).alias("actual_hot_pct"),
        (F.avg("predicted_hot_fraction") * 100).alias("mean_predicted_hot_pct"))


def spearman(table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation within each key, tied values sharing their mean rank.

    Ranks come from a histogram per column, and each row looks its rank up by
    value. The rank of a value that many rows share is broadcast, so its rows
    stay where they are.
    """
    table = table.select(*keys, x, y)
    for column, alias in ((x, "_rx"), (y, "_ry")):
        counts = settle(table.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n")), "ranks")
        ranked = ordered_columns(counts, keys, [column], running={"_before": F.col("_n")})
        ranks = ranked.select(*keys, column, "_n", (F.col("_before") + (F.col("_n") + 1) / 2).alias(alias))
        table = join_weighted(table, ranks, [*keys, column], "_n").drop("_n")
    # Undefined, hence null, when either side is constant.
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    return table.groupBy(*keys).agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"))
