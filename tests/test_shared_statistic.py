"""The rule's statistic is computed once for its threshold and its temperatures."""

from __future__ import annotations

from blocktrace.catalog import QUERIES
from blocktrace.operators import intervals, placement, splits
from blocktrace.plans.storage import settle


def trace_of(make_trace):
    # Three blocks with tied instants, and a second trace.
    rows = [(t // 2 * 3 + t % 5, t % 3, "R" if t % 7 == 3 else "W") for t in range(60)]
    rows.sort()
    return make_trace(rows, "a").unionByName(make_trace([(t * t, t % 2) for t in range(30)], "b"))


def values(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def test_threshold_from_known_statistic(layout, make_trace):
    trace = trace_of(make_trace)
    known = settle(intervals.rule_statistic(trace, 2), "known")
    columns = ("trace_id", "rule_threshold")
    wanted = values(splits.rule_threshold(trace, 2), *columns)
    assert len(wanted) == 2
    assert values(splits.rule_threshold(trace, 2, known=known), *columns) == wanted


def test_temperatures_from_known_statistic(layout, make_trace):
    trace = trace_of(make_trace)
    made = trace.filter("lba = 1").selectExpr(
        "trace_id", "timestamp", "lba", "1.0D AS predicted_rewrite_interval", "'HOT' AS predicted_class", "seq AS occ")
    known = settle(intervals.rule_statistic(trace, 2), "known")
    columns = ("policy", "trace_id", "timestamp", "lba", "seq", "temperature")
    cuts = splits.rule_threshold(trace, 2)

    def placed(**given):
        return values(placement.policy_temperatures(trace, made, ["occ"], rule_threshold=cuts, min_history=2, **given), *columns)

    wanted = placed()
    assert {row[-1] for row in wanted} == {"HOT", "COLD", "UNKNOWN"}
    assert placed(known=known) == wanted


def test_query_computes_it_once(spark, monkeypatch):
    calls, plain = [], intervals.rule_statistic

    def seen(*args, **settings):
        calls.append(settings)
        return plain(*args, **settings)

    for module in (intervals, splits, placement):
        if hasattr(module, "rule_statistic"):
            monkeypatch.setattr(module, "rule_statistic", seen)
    assert not QUERIES["pl1_policy_temperatures"](spark, "/root/testdata/sf0.001").isEmpty()
    assert len(calls) == 1
