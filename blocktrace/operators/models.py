"""Spark ML predictors of the next interval, their export and their comparison."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktrace.functions.labels import temperature
from blocktrace.functions.scaling import from_log
from blocktrace.functions.windows import logged, summaries
from blocktrace.operators import forest
from blocktrace.operators.evaluate import label, regression_metrics, score, with_threshold
from blocktrace.operators.intervals import build_sequences, write_events
from blocktrace.operators.splits import chronological_prefix, chronological_split, hot_threshold
from blocktrace.plans.layout import task_rows
from blocktrace.plans.storage import settle, shared_folder
from blocktrace.schemas import SAMPLE_ORDER

MODEL_TYPES = ("linear_regression", "random_forest", "boosted_trees")
#: Spellings accepted for the boosted model.
ALIASES = {"xgboost": "boosted_trees"}
#: Rounds of boosting at most, and rounds without a lower validation error that end it.
MOST_ROUNDS, PATIENCE = 600, 30


@dataclass(frozen=True)
class FittedModel:
    model_type: str
    model: Model
    length: int
    train_samples: int
    #: Trees of a boosted model that validation kept.
    trees: int | None = None


def make_estimator(model_type: str, seed: int, **overrides):
    """Estimators with their fixed default parameters; boosting is Spark's own GBT.

    GBT draws its share of the features for each split of a tree, not once per
    tree, so boosted numbers differ from those of other libraries.
    """
    # The settings of the published comparison.
    model_type = ALIASES.get(model_type, model_type)
    if model_type == "linear_regression":
        settings = {"regParam": 0.0}
        return LinearRegression(**{**settings, **overrides})
    if model_type == "random_forest":
        # The last two don't shape trees: they keep the node of each row instead of shipping and walking the
        # grown trees for every group of nodes, and make fewer groups of them.
        settings = {"numTrees": 100, "maxDepth": 16, "minInstancesPerNode": 20,
                    "featureSubsetStrategy": "0.5", "seed": seed, "cacheNodeIds": True, "maxMemoryInMB": 512}
        return RandomForestRegressor(**{**settings, **overrides})
    if model_type == "boosted_trees":
        settings = {"maxIter": MOST_ROUNDS, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8,
                    "minInstancesPerNode": 5, "featureSubsetStrategy": "0.8", "seed": seed}
        return GBTRegressor(**{**settings, **overrides})
    raise ValueError(f"unknown model type {model_type!r}; expected one of {MODEL_TYPES}")


def best_round(errors: Iterable[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the lowest error before `patience` rounds in a row brought none lower; whether it came to that."""
    best, lowest, round_ = 0, float("inf"), 0
    for round_, error in enumerate(errors, 1):
        if error < lowest:
            best, lowest = round_, error
        elif round_ - best >= patience:
            return best, True
    return best, False


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The model after its first `count` rounds."""
    context = SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml.regression
    trees, weights = model._java_obj.trees(), model.treeWeights
    kept = context._gateway.new_array(ml.DecisionTreeRegressionModel, count)
    shares = context._gateway.new_array(context._jvm.double, count)
    for i in range(count):
        kept[i], shares[i] = trees[i], float(weights[i])
    return GBTRegressionModel(ml.GBTRegressionModel(model.uid, kept, shares))


def boost(data: DataFrame, seed: int, patience: int = PATIENCE, **overrides) -> GBTRegressionModel:
    """Boosted trees up to the round with the lowest validation error, under a patience.

    Trees are grown in whole batches of rounds, at first no more than it takes to
    use up the patience. Until it is, the number of rounds doubles; equal seeds
    give equal first trees, so the outcome is that of growing all rounds and
    looking back.
    """
    most = overrides.pop("maxIter", MOST_ROUNDS)
    train, val = data.filter(~F.col("is_val")), data.filter("is_val")
    rounds = min(most, patience + 1)
    while True:
        model = make_estimator("boosted_trees", seed, maxIter=rounds, **overrides).fit(train)
        best, stopped = best_round(model.evaluateEachIteration(val, "squared"), patience)
        if stopped or rounds >= most:
            return first_trees(model, best)
        rounds = min(most, 2 * rounds)


def with_window_features(samples: DataFrame) -> DataFrame:
    """Add ``features``. The logarithms are a column of their own, or each summary would compute them again."""
    return samples.withColumn("_logged", logged(F.col("inputs"))) \
        .withColumn("features", array_to_vector(summaries(F.col("_logged")))).drop("_logged")


def with_features(samples: DataFrame) -> DataFrame:
    return with_window_features(samples).withColumn("label", F.log1p(F.greatest(F.col("target"), F.lit(0.0))))


def spread(data: DataFrame, rows: int) -> DataFrame:
    """Rows dealt evenly over all cores.

    Each pass of a fit has as many tasks as its rows have partitions, and rows from
    a plan that one task may order come in a single one.
    """
    spark = data.sparkSession
    return data.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(rows / task_rows(spark))))


def fit(model_type: str, split_samples: DataFrame, seed: int = 42, **overrides) -> FittedModel:
    """Fit on the training split; validation is used for early stopping only."""
    return fit_features(model_type, settle(with_features(split_samples), "features"), seed, **overrides)


def fit_features(model_type: str, features: DataFrame, seed: int = 42, **overrides) -> FittedModel:
    """The same on a settled table of ``with_features``, which several fits may share."""
    model_type = ALIASES.get(model_type, model_type)
    parts = ["train", "val"] if model_type == "boosted_trees" else ["train"]
    data = features.filter(F.col("split").isin(parts)) \
        .select("features", "label", "inputs", (F.col("split") == "val").alias("is_val"))
    sizes = data.agg(F.count_if(~F.col("is_val")).alias("train"), F.count_if("is_val").alias("val"),
                     F.max(F.size("inputs")).alias("length")).first()
    if not sizes["train"]:
        raise ValueError("training split is empty")
    if model_type == "boosted_trees" and not sizes["val"]:
        raise ValueError("validation split is empty; early stopping needs it")
    data, rows = data.drop("inputs"), sizes["train"] + sizes["val"]
    estimator = None if model_type == "boosted_trees" else make_estimator(model_type, seed, **overrides)
    if model_type == "random_forest":
        width = data.first()["features"].size
        if forest.outgrows(estimator, rows, width):
            model = forest.fit_forest(data, estimator, rows, width)
            return FittedModel(model_type, model, sizes["length"], sizes["train"])
    data = spread(data, rows)
    # The lineage of boosted rounds and of node ids grows; Spark cuts it here every ten.
    spark = features.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if model_type == "boosted_trees":
        model = boost(data, seed, **overrides)
        return FittedModel(model_type, model, sizes["length"], sizes["train"], model.getNumTrees)
    return FittedModel(model_type, estimator.fit(data), sizes["length"], sizes["train"])


def predict(fitted: FittedModel, samples: DataFrame) -> DataFrame:
    """Add ``predicted``: microseconds, never negative. No rows in, no rows out."""
    scored = fitted.model.transform(with_window_features(samples))
    return scored.withColumn("predicted", from_log(F.col("prediction"))).drop("features", "prediction")


def export_predictions(scored: DataFrame, thresholds: DataFrame | None,
                       model_version: str) -> DataFrame:
    """Scored samples as the prediction contract; thresholds come from training."""
    if thresholds is None:
        raise ValueError("the hot threshold must come from training data")
    return with_threshold(scored, thresholds).select(
        "timestamp", "lba", F.bround("predicted", 3).alias("predicted_rewrite_interval"),
        temperature(F.col("predicted"), F.col("hot_threshold")).alias("predicted_class"),
        F.lit(model_version).alias("model_version"), "trace_id")


def trace_quality(scored: DataFrame, thresholds: DataFrame, model_version: str,
                  source: str = "training split of the model's own training data") -> DataFrame:
    """Metrics of predictions against the intervals that happened, over all samples of each trace.

    Training samples count as well, so this describes an exported table; how good
    a model is on new data is told by its test split. Actual classes come from
    the same threshold as the predicted ones; `source` says where it is from.
    """
    whole = scored.select("trace_id", "target", "predicted", F.lit(model_version).alias("predictor"))
    return score(label(whole, thresholds)).withColumn("hot_threshold_source", F.lit(source)) \
        .withColumnsRenamed({"predictor": "model_version", "test_samples": "samples"})


def export_summary(predictions: DataFrame, trace: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Coverage of a prediction table and how many of its keys repeat, beside its `trace_quality` if given."""
    keys = predictions.groupBy("trace_id", "timestamp", "lba").agg(F.count(F.lit(1)).alias("_n"))
    made = keys.groupBy("trace_id").agg(
        F.sum("_n").alias("predicted_write_events"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_timestamp_lba_rows"))
    total = write_events(trace).groupBy("trace_id").agg(F.count(F.lit(1)).alias("total_write_events"))
    joined = total.join(made, "trace_id", "left").fillna(
        0, ["predicted_write_events", "duplicate_timestamp_lba_rows"])
    covered = joined.withColumn("prediction_coverage",
                                F.col("predicted_write_events") / F.col("total_write_events"))
    return covered if quality is None else covered.join(quality, "trace_id", "left")


def score_models(split_samples: DataFrame, model_types: Iterable[str], seed: int = 42,
                 percentile: float = 30.0, overrides: Mapping[str, dict] | None = None) -> DataFrame:
    """Models fitted on each training split and scored on the identical test split."""
    split_samples = settle(split_samples, "samples")
    thresholds = hot_threshold(split_samples, percentile)
    test = split_samples.filter(F.col("split") == "test")
    scored = None
    for model_type in model_types:
        fitted = fit(model_type, split_samples, seed, **(overrides or {}).get(model_type, {}))
        part = predict(fitted, test).select(
            "trace_id", "target", "predicted", F.lit(fitted.model_type).alias("predictor"))
        scored = part if scored is None else scored.unionByName(part)
    # Scores read the predictions several times.
    return score(label(settle(scored, "predicted"), thresholds))


#: Variants of a target's model, by what they are trained on.
VARIANTS = ("pretrained", "adapted", "scratch")


def training_sets(samples: DataFrame, roles: DataFrame, early: float = 0.2) -> DataFrame:
    """The target's own training samples of each variant: the earliest share for `adapted`, all for `scratch`.

    The pool of the pretraining workloads is common to all targets and is not
    repeated for each.
    """
    targets = settle(roles.filter(F.col("role") == "target").select("trace_id").distinct(), "targets")
    own = samples.filter(F.col("split") == "train").join(targets, "trace_id", "left_semi")
    parts = {"adapted": chronological_prefix(own, early), "scratch": own}
    columns = [F.col("trace_id").alias("target_trace"), *SAMPLE_ORDER, "target", "split"]
    first, second = [part.select(*columns, F.lit(name).alias("variant")) for name, part in parts.items()]
    pool = samples.filter(F.col("split") == "train").join(
        settle(roles.filter(F.col("role") == "pretrain").select("trace_id"), "roles"), "trace_id", "left_semi")
    shared = pool.select(F.lit(None).cast("string").alias("target_trace"), *SAMPLE_ORDER, "target", "split",
                         F.lit("pretrained").alias("variant"))
    return first.unionByName(second).unionByName(shared)


def training_thresholds(trained: DataFrame, roles: DataFrame, percentile: float = 30.0) -> DataFrame:
    """Hot threshold and number of own training samples of each target and variant, from `training_sets`.

    A pretrained model takes both from its pool.
    """
    keyed = trained.withColumn("target_trace", F.coalesce("target_trace", F.lit("")))
    keys = ["target_trace", "variant"]
    cuts = hot_threshold(keyed, percentile, keys).join(
        keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("threshold_samples")), keys)
    pooled = F.col("variant") == "pretrained"
    targets = roles.filter(F.col("role") == "target").select(F.col("trace_id").alias("_target")).distinct() \
        .withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS)))) \
        .withColumn("target_trace", F.when(pooled, "").otherwise(F.col("_target")))
    return targets.join(cuts, keys).select(
        F.col("_target").alias("target_trace"), "variant", "hot_threshold", "threshold_samples")


def side_by_side(spark: SparkSession, work: Callable, items: list, width: int = 4) -> list:
    """`work` on each item, some at a time: independent fits leave no executor idle between their small jobs."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def compare_transfer(split_samples: DataFrame, roles: DataFrame, model_type: str,
                     seed: int = 42, percentile: float = 30.0, early: float = 0.2, **overrides) -> DataFrame:
    """Training on other workloads against training on the target alone.

    Three variants are scored on each target's test split: `pretrained` (other
    workloads), `adapted` (those and the earliest fraction `early` of the
    target's training split) and `scratch` (the target alone). The hot threshold
    comes from the training rows of the pool, of that fraction, and of the
    target. A target among the pretraining workloads is refused.
    """
    leaks = roles.filter(F.col("role") == "pretrain").select("trace_id").intersect(
        roles.filter(F.col("role") == "target").select("trace_id"))
    if not leaks.isEmpty():
        raise ValueError("a target is also a pretraining workload")
    samples = settle(split_samples, "samples")
    features = settle(with_features(samples), "features")
    names = [r["trace_id"] for r in roles.filter(F.col("role") == "target")
             .select("trace_id").distinct().orderBy("trace_id").collect()]
    trained = settle(training_sets(samples, roles, early), "training")
    cuts = {(r["target_trace"], r["variant"]): r["hot_threshold"]
            for r in training_thresholds(trained, roles, percentile).collect()}
    pool = features.join(settle(roles.filter(F.col("role") == "pretrain").select("trace_id"), "roles"),
                         "trace_id", "left_semi")

    def training(target: str, variant: str) -> DataFrame:
        own = features.filter(F.col("trace_id") == target)
        if variant == "scratch":
            return own
        # One row: the last early sample. The adapted model sees it and all before it.
        place = F.struct(*SAMPLE_ORDER)
        last = trained.filter((F.col("target_trace") == target) & (F.col("variant") == variant)) \
            .agg(F.max(place).alias("last")).first()["last"]
        early_rows = place <= F.struct(*[F.lit(last[c]).alias(c) for c in SAMPLE_ORDER])
        return pool.unionByName(own.filter((F.col("split") == "train") & early_rows))

    wanted = [(None, "pretrained"), *[(t, v) for t in names for v in ("adapted", "scratch")]]
    fits = dict(zip(wanted, side_by_side(
        samples.sparkSession, lambda w: fit_features(model_type, pool if w[0] is None else training(*w), seed, **overrides), wanted)))
    tables = []
    for target in names:
        test = samples.filter((F.col("trace_id") == target) & (F.col("split") == "test"))
        for name in VARIANTS:
            fitted = fits[None if name == "pretrained" else target, name]
            value = cuts[target, name]
            tables.append(predict(fitted, test).select(
                "trace_id", "target", "predicted", F.lit(name).alias("predictor"),
                F.lit(value).alias("hot_threshold"),
                (F.col("target") <= value).alias("actual_hot"),
                (F.col("predicted") <= value).alias("predicted_hot")))
    scored = tables[0]
    for table in tables[1:]:
        scored = scored.unionByName(table)
    # Scores read the predictions several times.
    return score(settle(scored, "predicted"))


def grid_search(trace: DataFrame, model_type: str, lengths: list[int],
                settings: Mapping[str, list], seed: int = 42, size: str | None = None) -> DataFrame:
    """Validation error for every window length and setting, best first.

    Samples and features are built once per length. Splits stay chronological,
    so the usual random cross-validation does not apply. `size` names the
    setting that orders models of equal error, by default the first one; a
    length without validation samples is refused.
    """
    size = size or next(iter(settings), None)
    tables = {}
    for length in lengths:
        samples = chronological_split(build_sequences(trace, length))
        tables[length] = settle(with_features(samples), "features")

    def cell(place: tuple) -> tuple:
        length, values = place
        chosen = dict(zip(settings, values))
        fitted = fit_features(model_type, tables[length], seed, **chosen)
        val = tables[length].filter(F.col("split") == "val").drop("features", "label")
        scored = predict(fitted, val).select("target", "predicted", F.lit(model_type).alias("predictor"))
        # Metrics read the predictions twice.
        scored = settle(scored, "predicted")
        pooled = regression_metrics(scored, ["predictor"]).first()
        if pooled is None:
            raise ValueError(f"no validation samples for windows of {length}")
        return (length, str(chosen), float(chosen.get(size, 0.0)),
                fitted.train_samples, pooled["mae_us"], pooled["rmse_us"], pooled["mae_log1p"])

    places = list(itertools.product(lengths, itertools.product(*settings.values())))
    rows = side_by_side(trace.sparkSession, cell, places)
    if not rows:
        raise ValueError("the search produced no result; check the input traces")
    schema = ("sequence_length int, setting string, model_size double, train_samples long, "
              "val_mae_us double, val_rmse_us double, val_mae_log1p double")
    return trace.sparkSession.createDataFrame(rows, schema)
