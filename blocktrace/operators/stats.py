"""Per-trace statistics, skew profiles and the tables behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocktrace.operators.intervals import rewrite_intervals, write_events, write_prefix
from blocktrace.plans.ordered import ordered_columns, percentiles
from blocktrace.plans.storage import attach, settle
from blocktrace.schemas import KEY


def lba_profile(trace: DataFrame) -> DataFrame:
    """One row per block: access counts and the first and last write times.

    The basis of every trace statistic: the map side already reduces a hot
    block to one row per input partition.
    """
    written = F.col("operation") == "W"
    return trace.groupBy("trace_id", "lba").agg(
        F.count(F.lit(1)).alias("accesses"),
        F.count_if(written).alias("writes"),
        F.count_if(F.col("operation") == "R").alias("reads"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.min(F.when(written, F.col("timestamp"))).alias("first_write"),
        F.max(F.when(written, F.col("timestamp"))).alias("last_write"))


def access_mix(trace: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return trace.groupBy("trace_id").agg(
        n.alias("block_requests"),
        F.count_if(F.col("operation") == "W").alias("write_blocks"),
        F.count_if(F.col("operation") == "R").alias("read_blocks"),
        (F.count_if(F.col("operation") == "W") * 100.0 / n).alias("write_percentage"))


def footprint(profile: DataFrame) -> DataFrame:
    return profile.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("unique_lbas"), F.min("lba").alias("lba_min"),
        F.max("lba").alias("lba_max"), (F.max("lba") - F.min("lba") + 1).alias("lba_span"))


def approximate_footprint(trace: DataFrame, error: float = 0.02) -> DataFrame:
    """Sketch of the distinct block count, for when an estimate is enough."""
    return trace.groupBy("trace_id").agg(
        F.approx_count_distinct("lba", error).alias("approx_unique_lbas"))


def duration_and_size(trace: DataFrame, audit: DataFrame) -> DataFrame:
    """Seconds from first to last row, and mean request size from the parse audit."""
    span = trace.groupBy("trace_id").agg(
        ((F.max("timestamp") - F.min("timestamp")) / 1e6).alias("duration_seconds"))
    sizes = audit.select("trace_id", (
        F.col("total_bytes") / F.greatest("records_accepted", F.lit(1))).alias("mean_request_size_bytes"))
    return span.join(sizes, "trace_id", "left")


def rewrite_profile(profile: DataFrame) -> DataFrame:
    written = profile.filter(F.col("writes") > 0)
    distinct, total = F.count(F.lit(1)), F.sum("writes")
    again = F.count_if(F.col("writes") > 1)
    return written.groupBy("trace_id").agg(
        distinct.alias("unique_written_lbas"),
        (total - distinct).alias("rewrite_events"),
        ((total - distinct) / total).alias("rewrite_ratio"),
        again.alias("lbas_written_more_than_once"),
        (again / distinct).alias("repeated_write_lba_fraction"),
        F.max("writes").alias("max_writes_to_single_lba"))


def write_count_ranges(profile: DataFrame) -> DataFrame:
    """Blocks ranked by write count, hottest first, as one row per distinct count.

    Blocks with equal counts form one rank range, so a trace of N writes has at
    most sqrt(2 N) rows here and no block-level ranking is needed.
    """
    counts = profile.filter(F.col("writes") > 0).groupBy("trace_id", "writes").agg(
        F.count(F.lit(1)).alias("lbas"))
    hottest_first = counts.withColumn("_order", -F.col("writes"))
    ranked = ordered_columns(hottest_first, KEY, ["_order"], running={
        "_lbas_before": F.col("lbas"), "_writes_before": F.col("lbas") * F.col("writes")})
    return ranked.drop("_order")


def lba_popularity(profile: DataFrame) -> DataFrame:
    """Writes per block by rank: each row covers ranks first_rank to last_rank."""
    return write_count_ranges(profile).select(
        "trace_id", "writes", (F.col("_lbas_before") + 1).alias("first_rank"),
        (F.col("_lbas_before") + F.col("lbas")).alias("last_rank"))


def lorenz_curve(profile: DataFrame) -> DataFrame:
    """Cumulative share of writes against share of blocks, hottest first.

    One point at the end of each rank range; the curve is straight in between.
    """
    ranges = settle(write_count_ranges(profile), "ranges")
    totals = ranges.groupBy("trace_id").agg(
        F.sum("lbas").alias("_n"), F.sum(F.col("lbas") * F.col("writes")).alias("_w"))
    return attach(ranges, totals, KEY).select(
        "trace_id", "writes",
        ((F.col("_lbas_before") + F.col("lbas")) * 100.0 / F.col("_n")).alias("lba_share_pct"),
        ((F.col("_writes_before") + F.col("lbas") * F.col("writes")) * 100.0 / F.col("_w"))
        .alias("write_share_pct"))


def top_share(profile: DataFrame, share: float = 0.01) -> DataFrame:
    """Share of writes that hit the busiest `share` of written blocks."""
    ranges = settle(write_count_ranges(profile), "ranges")
    totals = ranges.groupBy("trace_id").agg(
        F.sum("lbas").alias("_n"), F.sum(F.col("lbas") * F.col("writes")).alias("_w"))
    top = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("_n"))).cast("long")
    taken = F.greatest(F.least(top - F.col("_lbas_before"), F.col("lbas")), F.lit(0))
    return attach(ranges, totals, KEY).groupBy("trace_id").agg(
        (F.sum(taken * F.col("writes")) / F.max("_w")).alias("top1pct_lba_write_share"))


def interval_mean(profile: DataFrame) -> DataFrame:
    """Mean rewrite interval: a block's intervals add up to its write span.

    Spans of years over 50,000 blocks add up to more than a long holds, so they are summed as decimals.
    """
    again = profile.filter(F.col("writes") > 1)
    span = (F.col("last_write") - F.col("first_write")).cast("decimal(19,0)")
    return again.groupBy("trace_id").agg(
        (F.sum(span) / F.sum(F.col("writes") - 1)).cast("double").alias("mean_rewrite_interval_us"))


def interval_summary(trace: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean, median, p90 and p99; traces without a rewrite have no row."""
    ranks = percentiles(rewrite_intervals(trace).select("trace_id", "interval"), KEY, "interval", {
        "median_rewrite_interval_us": 0.5, "p90_rewrite_interval_us": 0.9,
        "p99_rewrite_interval_us": 0.99})
    return interval_mean(profile).join(ranks, "trace_id")


#: Measures that stay unknown where there is nothing to measure.
UNDEFINED = ["p90_rewrite_interval_us", "p99_rewrite_interval_us"]


def with_empty_defaults(statistics: DataFrame, traces: DataFrame) -> DataFrame:
    """A row for every listed trace; what was not measured is zero, except `UNDEFINED`.

    A measure is any column of numbers: counts, shares, sizes and times all
    start at zero.
    """
    full = traces.select("trace_id").distinct().join(statistics, "trace_id", "left")
    return full.fillna(0, [field.name for field in full.schema
                           if isinstance(field.dataType, T.NumericType) and field.name not in UNDEFINED])


def trace_statistics(trace: DataFrame, audit: DataFrame) -> DataFrame:
    """Every measure of the trace inventory, one row per audited trace."""
    profile = settle(lba_profile(trace), "lba_profile")
    per_trace = profile.groupBy("trace_id").agg(
        F.sum("accesses").alias("block_requests"),
        (F.sum("writes") * 100.0 / F.sum("accesses")).alias("write_percentage"),
        F.count(F.lit(1)).alias("unique_lbas"), F.min("lba").alias("lba_min"),
        F.max("lba").alias("lba_max"), (F.max("lba") - F.min("lba") + 1).alias("lba_span"),
        ((F.max("last_ts") - F.min("first_ts")) / 1e6).alias("duration_seconds"))
    for part in (rewrite_profile(profile), top_share(profile), interval_summary(trace, profile)):
        per_trace = per_trace.join(part, "trace_id", "left")
    joined = audit.join(per_trace, "trace_id", "left").withColumn(
        "mean_request_size_bytes",
        F.when(F.col("block_requests").isNotNull(),
               F.col("total_bytes") / F.greatest("records_accepted", F.lit(1))))
    return with_empty_defaults(joined, audit)


def replay_footprint(trace: DataFrame, max_writes: int | None) -> DataFrame:
    """Distinct written blocks and writes over the replayed prefix."""
    per_lba = write_prefix(trace, max_writes).groupBy("trace_id", "lba").agg(
        F.count(F.lit(1)).alias("_n"))
    return per_lba.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("distinct_lbas"), F.sum("_n").alias("writes"))


def write_rate(trace: DataFrame, bins: int = 119) -> DataFrame:
    """Writes per second in equal time bins; the last bin includes its right edge.

    Bin numbers use whole microseconds. Empty bins are present.
    """
    writes = write_events(trace).select("trace_id", "timestamp")
    span = writes.groupBy("trace_id").agg(
        F.min("timestamp").alias("_low"), (F.max("timestamp") - F.min("timestamp")).alias("_span"))
    span = settle(span.filter(F.col("_span") > 0), "span")
    place = F.least(F.lit(bins - 1), F.expr(f"((timestamp - _low) * {bins}) div _span"))
    counts = attach(writes, span, KEY).groupBy("trace_id", place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("writes"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.col("_span") / F.lit(bins * 1e6)
    return grid.join(counts, ["trace_id", "bin"], "left").select(
        "trace_id", "bin",
        ((F.col("_low") / 1e6 + F.col("bin") * width) / 3600.0).alias("start_hours"),
        F.coalesce("writes", F.lit(0)).alias("writes"),
        (F.coalesce("writes", F.lit(0)) / F.greatest(width, F.lit(1e-9))).alias("writes_per_second"))


def interval_ecdf(intervals: DataFrame, points: int = 4000, at_least: int = 100) -> DataFrame:
    """Empirical distribution of positive intervals, thinned to about `points` per trace.

    Works on distinct values with their counts; a value is repeated only for
    the few plotted positions that fall on it.
    """
    counts = settle(intervals.filter(F.col("interval") > 0).groupBy("trace_id", "interval").agg(
        F.count(F.lit(1)).alias("_n")), "histogram")
    ranked = ordered_columns(counts, KEY, ["interval"], running={"_start": F.col("_n")})
    totals = counts.groupBy("trace_id").agg(F.sum("_n").alias("_total")) \
        .filter(F.col("_total") >= at_least) \
        .withColumn("_step", F.greatest(F.lit(1), F.expr(f"_total div {points}")))
    placed = attach(ranked, totals, KEY).withColumn(
        "_at", F.expr("((_start + _step - 1) div _step) * _step"))
    hit = placed.filter(F.col("_at") < F.col("_start") + F.col("_n"))
    spots = F.sequence(F.col("_at"), F.col("_start") + F.col("_n") - 1, F.col("_step"))
    return hit.withColumn("index", F.explode(spots)).select(
        "trace_id", "index", "interval", ((F.col("index") + 1) / F.col("_total")).alias("ecdf"))


def composition(statistics: DataFrame) -> DataFrame:
    """Writes and reads in millions, traces ranked by write share."""
    return statistics.select(
        "trace_id", (F.col("write_blocks") / 1e6).alias("writes_millions"),
        (F.col("read_blocks") / 1e6).alias("reads_millions"), "write_percentage") \
        .orderBy(F.col("write_percentage").desc(), "trace_id")
