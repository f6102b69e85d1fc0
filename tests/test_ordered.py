"""The ordered primitives against plain loops, with a hot key and heavy ties."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocktrace.operators.splits import chronological_split
from blocktrace.plans.layout import CHUNK, TASK_ROWS_CONF, chunk_count, heavy_key, with_chunk
from blocktrace.plans.ordered import SLOTS, _slots, ordered_columns, ordered_prefix, percentiles, with_ordinal
from blocktrace.plans.storage import settle


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = []
    for i in range(240):
        key = "hot" if rng.random() < 0.5 else rng.choice("abcdefgh")
        made.append((key, 50 if rng.random() < 0.4 else rng.randrange(100), i, rng.randrange(1, 9)))
    return made


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, i long, w long")


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_ordered_columns(spark, layout, rows):
    table = frame(spark, rows)
    got = ordered_columns(table, ["k"], ["t", "i"], running={"before": F.col("w")},
                          past={"last": ("w", 3)}, first={"head": "w"}, following={"next": "w"}).collect()
    want = {}
    for group in by_key(rows).values():
        weights = [r[3] for r in group]
        for n, row in enumerate(group):
            want[row[2]] = (sum(weights[:n]), weights[max(0, n - 3):n], weights[0],
                            weights[n + 1] if n + 1 < len(group) else None)
    assert {r["i"]: (r["before"], r["last"], r["head"], r["next"]) for r in got} == want


@pytest.fixture()
def small_tasks(spark):
    spark.conf.set(TASK_ROWS_CONF, "20")
    yield 20
    spark.conf.unset(TASK_ROWS_CONF)


def test_neighbouring_instants_past_double_precision(spark, small_tasks):
    """Two tied instants that are one apart and equal as doubles, beside a row at time 0."""
    instant = 12_816_637_200_306_164
    made = [("a", 0, 0)] + [("a", instant + (i > 400), i) for i in range(1, 801)]
    got = with_ordinal(spark.createDataFrame(made, "k string, t long, i long").repartition(7),
                       ["k"], ["t", "i"], "place").collect()
    assert len(got) == 801 and all(r["place"] == r["i"] for r in got)


def test_no_chunk_exceeds_the_limit_on_uneven_ties(spark, small_tasks):
    """Half of the rows share one instant, beside 500 lighter ties."""
    table = spark.range(8000).select(
        F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 1001).alias("t"),
        F.col("id").alias("i"))
    sizes = with_chunk(settle(table), ["k"], ["t", "i"], chunk_count(spark, 8000)).groupBy(CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= small_tasks


def test_null_values_are_neither_skipped_nor_taken_for_missing(spark, layout):
    made = [("a", i, None if i % 3 == 0 else i) for i in range(60)]
    got = ordered_columns(spark.createDataFrame(made, "k string, t long, v long"), ["k"], ["t"],
                          first={"head": "v"}, following={"next": "v"}).collect()
    assert all(r["head"] is None for r in got)
    assert {r["t"]: r["next"] for r in got} == {i: made[i + 1][2] if i < 59 else None for i in range(60)}


@pytest.mark.parametrize("n, fraction", [(7, None), (None, 0.3)])
def test_ordered_prefix(spark, layout, rows, n, fraction):
    got = ordered_prefix(frame(spark, rows), ["k"], ["t", "i"], n=n, fraction=fraction)
    want = set()
    for group in by_key(rows).values():
        want |= {r[2] for r in group[:n if n is not None else round(fraction * len(group))]}
    assert {r["i"] for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 3, 4, 5, 99, 100, 1000])
def test_prefix_ends_at_slot_edges_and_beyond(spark, small_tasks, n):
    """Rows 0 to 99 in files of splits of four lines; and the same rows by their number."""
    table = spark.range(100).select(F.lit("a").alias("k"), F.expr("id div 40").cast("int").alias("f"),
                                    F.expr("id div 4").alias("b"), F.col("id").alias("i")).repartition(5)
    for order, coarse in ((["f", "b", "i"], 2), (["i"], 0)):
        got = ordered_prefix(table, ["k"], order, n=n, coarse=coarse).collect()
        assert sorted(r["i"] for r in got) == list(range(min(n, 100)))


def test_edges_are_completed_over_whole_chunks(spark, small_tasks):
    """One key over many chunks between two that share theirs with it; the summary stays small."""
    made = [("a", i, i) for i in range(5)] + [("b", i, 1) for i in range(900)] + [("c", i, i) for i in range(7)]
    got = ordered_columns(spark.createDataFrame(made, "k string, t long, w long").repartition(9), ["k"], ["t"],
                          running={"before": F.col("w")}, past={"last": ("t", 4)}, first={"head": "t"}, following={"next": "t"})
    for r in got.collect():
        group = [m for m in made if m[0] == r["k"]]
        assert r["before"] == sum(m[2] for m in group[:r["t"]]) and r["head"] == 0
        assert r["last"] == list(range(max(0, r["t"] - 4), r["t"]))
        assert r["next"] == (r["t"] + 1 if r["t"] + 1 < len(group) else None)


def test_percentiles(spark, layout, rows):
    got = percentiles(frame(spark, rows), ["k"], "t", {"p30": 0.3, "p99": 0.99}).collect()
    for row in got:
        values = [r[1] for r in rows if r[0] == row["k"]]
        assert row["p30"] == pytest.approx(np.percentile(values, 30))
        assert row["p99"] == pytest.approx(np.percentile(values, 99))


def loop_split(times, train, val):
    n = len(times)

    def past_ties(i):
        while 0 < i < n and times[i] == times[i - 1]:
            i += 1
        return i

    first = past_ties(round(train * n))
    return first, past_ties(max(first, round((train + val) * n)))


def test_split_matches_index_walk_on_tied_arrays(spark, layout):
    rng = random.Random(11)
    made, want = [], {}
    for number in range(12):
        times = sorted(rng.randrange(rng.choice([3, 10, 200])) for _ in range(rng.randrange(1, 90)))
        name = f"t{number}"
        made += [(name, t) for t in times]
        first, second = loop_split(times, 0.6, 0.2)
        want[name] = (first, second - first, len(times) - second)
    table = spark.createDataFrame(made, "trace_id string, timestamp long")
    sizes = chronological_split(table, 0.6, 0.2).groupBy("trace_id").pivot(
        "split", ["train", "val", "test"]).count().fillna(0).collect()
    assert {r["trace_id"]: (r["train"], r["val"], r["test"]) for r in sizes} == want


def test_split_shares_are_checked(spark):
    table = spark.createDataFrame([("t", 1)], "trace_id string, timestamp long")
    for shares in ((0.0, 0.2), (0.5, 1.0), (0.8, 0.2)):
        with pytest.raises(ValueError):
            chronological_split(table, *shares)


def test_slots_are_found_without_a_look_at_every_bound(spark):
    """Each row's slot is the number of bounds below its value; nulls come first; no list is gone through."""
    rows = [("a", float(i * i % 997)) for i in range(2000)] + [("b", 5.0), ("b", None), ("c", None)]
    table = settle(spark.createDataFrame(rows, "k string, v double"))
    placed = _slots(table, ["k"], "v")
    assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
    shares = [i / SLOTS for i in range(1, SLOTS)]
    cuts = {r["k"]: r["c"] or [] for r in table.groupBy("k").agg(F.percentile_approx("v", shares).alias("c")).collect()}
    got = [(r["k"], r["v"], r["_slot"]) for r in placed.collect()]
    assert len(got) == len(rows)
    assert all(slot == (0 if v is None else sum(cut < v for cut in cuts[k])) for k, v, slot in got)


def test_whole_keys_are_dealt_where_none_is_heavy(spark):
    """300 rows over 100 keys, of which a task may order 40: no chunk is cut or written."""
    spark.conf.set(TASK_ROWS_CONF, "40")
    try:
        table = settle(spark.range(300).select((F.col("id") % 100).alias("k"), F.col("id").alias("i")))
        assert not heavy_key(table, ["k"]) and heavy_key(table.withColumn("k", F.lit(1)), ["k"])
        got = ordered_columns(table, ["k"], ["i"], running={"n": F.lit(1).cast("long")}, past={"before": ("i", 1)},
                              first={"head": "i"}, following={"next": "i"})
        assert CHUNK not in got._jdf.queryExecution().analyzed().toString()
        assert sorted(tuple(r) for r in got.collect()) == [
            (i % 100, i, i // 100, [i - 100] if i >= 100 else [], i % 100, i + 100 if i < 200 else None)
            for i in sorted(range(300), key=lambda i: (i % 100, i))]
    finally:
        spark.conf.unset(TASK_ROWS_CONF)
