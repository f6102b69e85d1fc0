"""Forests over many rows: Spark's trees, grown in tasks that hold a bounded number of rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from blocktrace.operators import forest, models
from blocktrace.plans.layout import TASK_ROWS_CONF
from blocktrace.plans.storage import settle

ROWS = 3000


def table(spark, parts=3):
    draw = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double") for i in range(4)]
    rows = spark.range(ROWS, numPartitions=parts).select(*[c.alias(f"f{i}") for i, c in enumerate(draw)])
    # A feature with three values, and a label with some noise.
    kind, noise = F.pmod("f3", F.lit(3.0)), F.col("f2") / 7
    return rows.select(array_to_vector(F.array("f0", "f1", kind)).alias("features"),
                       (F.abs(F.col("f0") - 400) + F.when(kind == 1.0, F.col("f1")).otherwise(0.0) + noise).alias("label"))


@pytest.fixture(params=["whole", "cut"])
def task_rows(request, spark):
    """Subtrees from whole trees' rows, and from nodes that were split over all partitions first."""
    if request.param == "cut":
        spark.conf.set(TASK_ROWS_CONF, "400")
    yield request.param
    spark.conf.unset(TASK_ROWS_CONF)


def test_trees_are_those_of_spark(spark, task_rows):
    data = table(spark).cache()
    estimator = models.make_estimator("random_forest", 7, numTrees=1, maxDepth=7, bootstrap=False, featureSubsetStrategy="all")
    ours = forest.fit_forest(data, estimator, ROWS, 3).transform(data)
    theirs = estimator.fit(data).transform(data).withColumnRenamed("prediction", "expected")
    both = ours.join(theirs.select("features", "label", "expected"), ["features", "label"])
    assert both.count() >= ROWS
    assert both.filter(F.abs(F.col("prediction") - F.col("expected")) > 1e-9).count() == 0
    data.unpersist()


def test_forest_is_as_good_as_that_of_spark(spark, task_rows):
    data = table(spark).cache()
    estimator = models.make_estimator("random_forest", 7, numTrees=30, maxDepth=7)
    errors = [m.transform(data).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
              for m in (forest.fit_forest(data, estimator, ROWS, 3), estimator.fit(data))]
    assert abs(errors[0] / errors[1] - 1) < 0.05
    data.unpersist()


def test_a_level_beyond_one_pass_needs_no_pass_per_group(spark, monkeypatch):
    """Where a level of all trees doesn't fit into Spark's trainer, fits don't use it; first trees are those of fewer trees."""
    rows = [("t", [float(1 + (i * 7 + j * 13) % 50) for j in range(4)], float(1 + i * i % 97), "train" if i % 3 else "val")
            for i in range(3000)]
    samples = spark.createDataFrame(rows, "trace_id string, inputs array<double>, target double, split string")
    real = models.make_estimator

    def refusing(*args, **kwargs):
        found = real(*args, **kwargs)
        found.fit = lambda data: pytest.fail("went over all rows for each group of nodes")
        return found

    monkeypatch.setattr(models, "make_estimator", refusing)
    features = settle(models.with_features(samples), "features")
    few, more = [models.fit_features("random_forest", features, numTrees=n, maxMemoryInMB=1) for n in (5, 8)]
    assert few.train_samples == 2000 and few.model.getNumTrees == 5
    trees = [[t.value for t in m.model._held.value[2]] for m in (few, more)]
    assert all(np.array_equal(a, b) for a, b in zip(*trees))
    predicted = models.predict(more, samples).collect()
    assert len(predicted) == 3000 and all(r["predicted"] >= 0 for r in predicted)


def test_tasks_hold_a_bounded_number_of_rows(spark):
    """Nodes with more drawn rows than a task may hold are split over all partitions; the others share tasks up to it."""
    estimator = models.make_estimator("random_forest", 7, numTrees=6, maxDepth=9)
    chosen = forest.Settings.of(estimator, 3)
    blocks = forest.stored_blocks(table(spark), ROWS, [np.arange(100.0, 1000.0, 100.0)] * 2 + [np.array([0.5, 1.5])], 0.0)
    tops = forest.grow_tops(chosen, blocks, ROWS, range(6), 400)
    jobs = [forest.Job(t, n, *held) for t, top in tops.items() for n, held in top.open.items()]
    assert len(jobs) > 6 * ROWS / 400 and all(40 <= j.rows <= 400 for j in jobs)
    held = {}
    for job, task in zip(jobs, forest.packed(jobs, 400, 2)):
        held.setdefault(task, []).append(job.rows)
    assert sorted(held) == list(range(len(held))) and all(sum(rows) <= 400 for rows in held.values())
    # Every drawn row is in a job or in a leaf above.
    assert all(sum(rows for _, rows in top.open.values()) <= 1.1 * ROWS for top in tops.values())
