"""Boosting stops under a patience without growing more rounds than that takes."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from blocktrace.operators import models


@pytest.fixture()
def grown(monkeypatch):
    """Rounds of each batch that is grown."""
    rounds, make = [], models.make_estimator

    def seen(model_type, seed, **settings):
        rounds.append(settings["maxIter"])
        return make(model_type, seed, **settings)

    monkeypatch.setattr(models, "make_estimator", seen)
    return rounds


def rows(spark, label, count=240):
    return (spark.range(count, numPartitions=2)
            .select(array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") * 7 % 5).cast("double"))).alias("features"),
                    F.expr(label).cast("double").alias("label"), (F.col("id") % 4 == 3).alias("is_val")))


def looked_back(data, patience, **settings):
    """All rounds grown at once, cut at the best one."""
    model = models.make_estimator("boosted_trees", 7, **settings).fit(data.filter("NOT is_val"))
    best, _ = models.best_round(model.evaluateEachIteration(data.filter("is_val"), "squared"), patience)
    return models.first_trees(model, best)


# Noise that no round can learn, and a slope that takes many.
@pytest.mark.parametrize("label", ["xxhash64(id) % 1000", "id * 3 + xxhash64(id) % 20"])
def test_outcome_is_that_of_all_rounds(spark, grown, label):
    data = rows(spark, label).cache()
    found = models.boost(data, 7, patience=3, maxIter=14, maxDepth=2)
    whole = looked_back(data, 3, maxIter=14, maxDepth=2)
    assert found.getNumTrees == whole.getNumTrees
    assert found.toDebugString.split("\n", 1)[1] == whole.toDebugString.split("\n", 1)[1]
    data.unpersist()


def test_first_batch_is_no_longer_than_the_patience_needs(spark, grown):
    # Validation labels lie on the other side: each round after the first is worse.
    data = rows(spark, "CASE WHEN id % 4 = 3 THEN -id ELSE id END").cache()
    found = models.boost(data, 7, patience=3, maxIter=14, maxDepth=2)
    assert found.getNumTrees == 1
    assert grown == [4]
    data.unpersist()
