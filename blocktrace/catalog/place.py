"""Queries that join predictions and place writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from blocktrace.catalog.common import (
    MIN_HISTORY,
    MULTI,
    PREDICTIONS,
    SAMPLES,
    TRACE,
    predictions,
    query,
    rounded,
    split_samples,
    trace_events,
    trace_multi,
)
from blocktrace.catalog.trace import ALL_WRITES, EARLY, MULTI_SAMPLES, RULE
from blocktrace.operators import intervals, joins, placement, splits
from blocktrace.plans.storage import settle

KEY = "trace_id, timestamp, lba"

ASSIGNED = f"""firstp AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY occ) = 1),
w1 AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS nth FROM writes),
assigned AS (
  SELECT w1.trace_id, w1.timestamp, w1.lba, w1.seq, p.predicted_rewrite_interval,
         coalesce(p.predicted_class, 'UNKNOWN') AS temperature
  FROM w1 LEFT JOIN firstp p ON w1.nth = 1 AND w1.trace_id = p.trace_id
       AND w1.timestamp = p.timestamp AND w1.lba = p.lba)"""


@query("jn1_assign_predictions", f"""WITH {SAMPLES}, {PREDICTIONS}, {ASSIGNED}
SELECT trace_id, timestamp, lba, seq, round(predicted_rewrite_interval, 3) AS predicted_rewrite_interval, temperature
FROM assigned""")
def jn1(spark, folder):
    writes = intervals.write_events(trace_events(spark, folder)).select("trace_id", "timestamp", "lba", "seq")
    return rounded(joins.assign_predictions(writes, predictions(spark, folder), ["occ"]), 3,
                   "predicted_rewrite_interval")


#: Both sides coarsened to days and 20 blocks, so that keys repeat on both sides.
COARSE = f"""{SAMPLES}, {PREDICTIONS},
cw AS (SELECT trace_id, timestamp // 86400000000 AS timestamp, lba % 20 AS lba, seq FROM writes),
cp AS (SELECT trace_id, timestamp // 86400000000 AS timestamp, lba % 20 AS lba, predicted_class,
              timestamp AS made_at, lba AS block, occ FROM pred WHERE timestamp // 86400000000 % 3 <> 0 OR lba % 2 = 0)"""


def _coarse(table):
    return table.withColumn("timestamp", F.expr("timestamp div 86400000000")).withColumn("lba", F.col("lba") % 20)


def _coarse_sides(spark, folder):
    writes = _coarse(intervals.write_events(trace_events(spark, folder))).select("trace_id", "timestamp", "lba", "seq")
    made = predictions(spark, folder).withColumns({"made_at": F.col("timestamp"), "block": F.col("lba")})
    kept = made.filter((F.expr("timestamp div 86400000000") % 3 != 0) | (F.col("lba") % 2 == 0))
    return writes, _coarse(kept)


@query("jn1_repeated_keys", f"""WITH {COARSE},
f AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY occ, made_at, block) = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS nth FROM cw)
SELECT w.trace_id, w.timestamp, w.lba, w.seq, coalesce(f.predicted_class, 'UNKNOWN') AS temperature
FROM w LEFT JOIN f ON w.nth = 1 AND w.trace_id = f.trace_id AND w.timestamp = f.timestamp AND w.lba = f.lba""")
def jn1_repeated(spark, folder):
    writes, made = _coarse_sides(spark, folder)
    return joins.assign_predictions(writes, made, ["occ", "made_at", "block"]).drop("predicted_rewrite_interval")


@query("jn2_prediction_audit", f"""WITH {COARSE},
bad AS (SELECT *, CASE WHEN block % 17 = 3 THEN 'malformed' WHEN block % 17 = 5 THEN 'unknown_class' END AS reason FROM cp),
ok AS (SELECT trace_id, timestamp, lba, count(*) AS p FROM bad WHERE reason IS NULL GROUP BY ALL),
w AS (SELECT trace_id, timestamp, lba, count(*) AS n FROM cw GROUP BY ALL),
m AS (SELECT count(*) AS matched FROM ok JOIN w USING ({KEY})),
d AS (SELECT coalesce(sum(p - 1), 0) AS dup FROM ok WHERE (trace_id, timestamp) IN (SELECT trace_id, timestamp FROM cw)),
t AS (SELECT (SELECT count(*) FROM bad) AS rows_read, (SELECT count(*) FROM cw) AS lookups,
             (SELECT count(*) FROM bad WHERE reason IS NULL) AS valid,
             (SELECT count(*) FROM bad WHERE reason = 'malformed') AS malformed_rows,
             (SELECT count(*) FROM bad WHERE reason = 'unknown_class') AS unknown_class_rows)
SELECT 'events' AS trace_id, rows_read, matched AS rows_matched, lookups, lookups - matched AS lookup_misses,
       (valid - matched - dup)::BIGINT AS unmatched_predictions, dup::BIGINT AS duplicate_key_rows, malformed_rows, unknown_class_rows,
       FALSE AS out_of_order_input FROM t, m, d""")
def jn2(spark, folder):
    writes, made = _coarse_sides(spark, folder)
    part = F.col("block") % 17
    checked = made.withColumn("reject_reason", F.when(part == 3, "malformed").when(part == 5, "unknown_class"))
    return joins.prediction_audit(writes, checked)


@query("set2_keys_without_write", f"""WITH {SAMPLES}, {PREDICTIONS}
SELECT DISTINCT trace_id, timestamp + lba % 2 AS timestamp, lba FROM pred p WHERE NOT EXISTS (
  SELECT 1 FROM writes w WHERE w.trace_id = p.trace_id AND w.timestamp = p.timestamp + p.lba % 2 AND w.lba = p.lba)""")
def set2(spark, folder):
    """Predictions of odd blocks are moved by a microsecond, so they lose their write."""
    moved = predictions(spark, folder).withColumn("timestamp", F.col("timestamp") + F.col("lba") % 2)
    return joins.keys_without_write(moved, intervals.write_events(trace_events(spark, folder)))


@query("set3_split_overlap", f"""WITH {MULTI_SAMPLES}
SELECT timestamp // 86400000000 AS day, trace_id FROM sp WHERE split = 'train'
INTERSECT SELECT timestamp // 86400000000, trace_id FROM sp WHERE split <> 'train'""")
def set3(spark, folder):
    days = split_samples(spark, folder, multi=True).withColumn("day", F.expr("timestamp div 86400000000"))
    return joins.overlap(days.filter(F.col("split") == "train"), days.filter(F.col("split") != "train"),
                         ["day", "trace_id"])


# -- placement ----------------------------------------------------------------

#: The rule's cut-off of each trace, from its early writes.
RULE_CUTS = f"""{EARLY.replace("pre AS", "early AS")}, {RULE.replace("ruled AS", "known AS").replace("FROM pre", "FROM early")},
cuts AS (SELECT trace_id, quantile_cont(mean_interval, 0.3) AS rule_threshold FROM known
         WHERE mean_interval IS NOT NULL GROUP BY trace_id)"""

POLICIES = f"""{MULTI_SAMPLES}, {PREDICTIONS}, {ASSIGNED}, {RULE_CUTS}, {ALL_WRITES}, {RULE},
placed AS (
  SELECT 'MIXED' AS policy, trace_id, timestamp, lba, seq, 'UNKNOWN' AS temperature FROM writes
  UNION ALL SELECT 'RULE_BASED', trace_id, timestamp, lba, seq, CASE WHEN mean_interval IS NULL THEN 'UNKNOWN'
       WHEN mean_interval <= rule_threshold THEN 'HOT' ELSE 'COLD' END FROM ruled JOIN cuts USING (trace_id)
  UNION ALL SELECT 'PREDICTED', trace_id, timestamp, lba, seq, temperature FROM assigned),
routed AS (SELECT *, CASE WHEN policy <> 'MIXED' AND temperature = 'COLD' THEN 'COLD' ELSE 'MAIN' END AS stream FROM placed)"""


def _placed(spark, folder):
    """Three traces, each with its own predictions and its own rule threshold."""
    trace = settle(trace_multi(spark, folder), "trace")
    known = settle(intervals.rule_statistic(trace, MIN_HISTORY), "known")
    return placement.policy_temperatures(trace, predictions(spark, folder, trace=trace), ["occ"],
                                         rule_threshold=splits.rule_threshold(trace, MIN_HISTORY, known=known),
                                         min_history=MIN_HISTORY, known=known)


def _routed(spark, folder):
    return placement.route(_placed(spark, folder))


@query("pl1_policy_temperatures", f"WITH {POLICIES} SELECT * FROM placed")
def pl1(spark, folder):
    return _placed(spark, folder)


@query("pl2_route_streams", f"WITH {POLICIES} SELECT trace_id, policy, seq, temperature, stream FROM routed")
def pl2(spark, folder):
    return _routed(spark, folder).select("trace_id", "policy", "seq", "temperature", "stream")


COUNTERS = """cnt AS (
  SELECT trace_id, policy, count(*) AS total_write_requests, count(*) FILTER (stream = 'MAIN') AS main_stream_writes,
         count(*) FILTER (stream = 'COLD') AS cold_stream_writes, count(*) FILTER (temperature = 'HOT') AS hot_placements,
         count(*) FILTER (temperature = 'COLD') AS cold_placements, count(*) FILTER (temperature = 'UNKNOWN') AS unpredicted_writes,
         count(*) * 4096 AS logical_bytes_written FROM routed GROUP BY ALL)"""


@query("pl3_placement_counters", f"WITH {POLICIES}, {COUNTERS} SELECT * FROM cnt")
def pl3(spark, folder):
    return placement.placement_counters(_routed(spark, folder))


@query("pl4_replayed_requests", f"""WITH {MULTI},
w AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, seq) AS nth FROM writes),
stop AS (SELECT trace_id, seq AS last FROM w WHERE nth = 800)
SELECT trace_id, count(*) FILTER (operation = 'R') AS read_requests, count(*) FILTER (operation = 'D') AS discard_requests,
       count(*) FILTER (operation = 'W') AS write_requests
FROM trace LEFT JOIN stop USING (trace_id) WHERE last IS NULL OR seq <= last GROUP BY trace_id""")
def pl4(spark, folder):
    return placement.replayed_requests(trace_multi(spark, folder), 800)


@query("pl5_prediction_coverage", f"""WITH {POLICIES}, {COUNTERS}
SELECT trace_id, policy, round(1 - unpredicted_writes / total_write_requests, 6) AS prediction_coverage FROM cnt""")
def pl5(spark, folder):
    table = placement.prediction_coverage(placement.placement_counters(_routed(spark, folder)))
    return rounded(table.select("trace_id", "policy", "prediction_coverage"), 6, "prediction_coverage")


@query("pl6_block_versions", f"""WITH {MULTI}
SELECT trace_id, lba, seq, timestamp AS valid_from, lead(timestamp) OVER w AS valid_to, lead(seq) OVER w AS next_seq
FROM writes WINDOW w AS (PARTITION BY trace_id, lba ORDER BY timestamp, seq)""")
def pl6(spark, folder):
    writes = intervals.write_events(trace_multi(spark, folder)).select("trace_id", "lba", "timestamp", "seq")
    return placement.block_versions(writes)


#: Instants (days of the trace) and write counts at which live blocks are counted.
DAYS = [86_400_000_000 * day for day in (1, 2, 5, 10, 20, 30)]
AFTER = [10, 100, 1000, 2500]


@query("pl7_live_blocks_at", f"""WITH {MULTI},
born AS (SELECT trace_id, lba, min(timestamp) AS born FROM writes GROUP BY ALL),
t AS (SELECT unnest([{", ".join(map(str, DAYS))}]) AS instant)
SELECT trace_id, instant, count(*) FILTER (born <= instant) AS live_blocks FROM born, t GROUP BY ALL""")
def pl7(spark, folder):
    return placement.live_blocks_at(trace_multi(spark, folder), DAYS)


@query("pl7_live_blocks_after", f"""WITH {MULTI},
w AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY timestamp, seq) - 1 AS nth FROM writes),
born AS (SELECT trace_id, lba, min(nth) AS born FROM w GROUP BY ALL),
t AS (SELECT unnest([{", ".join(map(str, AFTER))}]) AS after_writes)
SELECT trace_id, after_writes, count(*) FILTER (born < after_writes) AS live_blocks FROM born, t GROUP BY ALL""")
def pl7_after(spark, folder):
    return placement.live_blocks_after(trace_multi(spark, folder), AFTER)


@query("e3_predictions_to_placement", f"""WITH {POLICIES}, {COUNTERS},
sp0 AS (SELECT trace_id, count(DISTINCT lba) AS distinct_lbas FROM writes GROUP BY trace_id)
SELECT trace_id, policy, total_write_requests, cold_stream_writes, unpredicted_writes, distinct_lbas,
       greatest(1, ceil(distinct_lbas / (0.70::DOUBLE * 64)), ceil(distinct_lbas / 64::DOUBLE) + 5)::BIGINT AS segments
FROM cnt JOIN sp0 USING (trace_id)""")
def e3(spark, folder):
    from blocktrace.functions.capacity import device_segments
    from blocktrace.operators.stats import replay_footprint
    counters = placement.placement_counters(_routed(spark, folder))
    size = replay_footprint(trace_multi(spark, folder), None).select("trace_id", "distinct_lbas")
    return counters.join(size, "trace_id").select(
        "trace_id", "policy", "total_write_requests", "cold_stream_writes", "unpredicted_writes", "distinct_lbas",
        device_segments(F.col("distinct_lbas"), F.lit(0.70), 64).alias("segments"))
