"""From raw requests to one row per touched block, with a full audit.

A request table has the columns of ``schemas.REQUEST``. `order` names the
columns that give the order of the source files within a trace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blocktrace.plans.ordered import ordered_columns, ordered_prefix
from blocktrace.plans.storage import attach, settle
from blocktrace.schemas import KEY, OPERATIONS, RAW_ORDER


class MultipleDevicesError(ValueError):
    """A trace must describe one device; pooled addresses would invent rewrites."""


@dataclass(frozen=True)
class Limits:
    """Sanity limits on a request."""

    block_bytes: int = 4096
    max_blocks: int = 2048
    max_offset: int = 1 << 50

    def __post_init__(self) -> None:
        if self.block_bytes <= 0:
            raise ValueError("block_bytes must be > 0")


#: Reject reasons in the order they are tested; the first that applies counts.
REASONS = ["extra_columns", "other_device", "malformed", "unknown_operation",
           "bad_offset", "bad_size", "oversized"]


def device_counts(requests: DataFrame, order: list[str] = RAW_ORDER) -> DataFrame:
    """Records per device of each trace, counted before any validation."""
    return requests.filter(F.col("device").isNotNull()).groupBy("trace_id", "device").agg(
        F.count(F.lit(1)).alias("records"), F.min(F.struct(*order)).alias("first_seen"))


def device_record_map(counts: DataFrame, busiest: int = 1000) -> DataFrame:
    """The same counts as one map per trace, of the `busiest` devices; the others are summed up.

    The device is text from the input, so a damaged file can have any number of
    them. Ties in records go to the first name.
    """
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("records").desc(), "device"))
    # The limit on the place is applied before the shuffle, too.
    kept = settle(counts.select("trace_id", "device", "records").withColumn("_place", place)
                  .filter(F.col("_place") <= busiest).drop("_place"), "devices")
    mapped = kept.groupBy("trace_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("device", "records")))).alias("device_record_counts"),
        F.count(F.lit(1)).alias("_kept"), F.sum("records").alias("_held"))
    whole = counts.groupBy("trace_id").agg(F.count(F.lit(1)).alias("_devices"), F.sum("records").alias("_records"))
    return whole.join(mapped, "trace_id").select(
        "trace_id", "device_record_counts", (F.col("_devices") - F.col("_kept")).alias("other_devices"),
        (F.col("_records") - F.col("_held")).alias("other_device_records"))


def dominant_devices(counts: DataFrame) -> DataFrame:
    """Busiest device per trace; the one seen first wins a tie."""
    return counts.groupBy("trace_id").agg(
        F.min_by("device", F.struct(-F.col("records"), F.col("first_seen"))).alias("device_selected"))


def select_device(requests: DataFrame, policy: str = "auto",
                  order: list[str] = RAW_ORDER) -> DataFrame:
    """Add ``device_selected`` under the policy auto, dominant or an explicit device."""
    if policy not in ("auto", "dominant"):
        return requests.withColumn("device_selected", F.lit(policy))
    counts = settle(device_counts(requests, order), "devices")
    if policy == "auto":
        mixed = counts.groupBy("trace_id").agg(F.count(F.lit(1)).alias("devices")) \
            .filter(F.col("devices") > 1).orderBy("trace_id").first()
        if mixed:
            raise MultipleDevicesError(
                f"trace {mixed['trace_id']} mixes {mixed['devices']} devices; "
                "choose 'dominant' or name one")
    return attach(requests, dominant_devices(counts), KEY, "left")


def computed_once(requests: DataFrame) -> DataFrame:
    """Keep the optimiser from copying parsing expressions into later filters.

    A filter on ``reject_reason`` is otherwise pushed below the projection that
    parses the line, and every reference to a field parses it again.
    """
    return requests.select(F.inline(F.array(F.struct(*requests.columns))))


def check_requests(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add the block range and the first reason to reject each request, if any."""
    requests = computed_once(requests)
    ok_numbers = (F.col("raw_ts").isNotNull() & F.col("offset_bytes").isNotNull()
                  & F.col("size_bytes").isNotNull())
    sane = ok_numbers & F.col("offset_bytes").between(0, limits.max_offset) & (F.col("size_bytes") > 0)
    in_range = requests.withColumns({
        "first_block": F.when(sane, F.expr(f"offset_bytes div {limits.block_bytes}")),
        "last_block": F.when(sane, F.expr(f"try_add(offset_bytes, size_bytes - 1) div {limits.block_bytes}"))})
    blocks = in_range.withColumn("n_blocks", F.col("last_block") - F.col("first_block") + 1)
    other = F.lit(False)
    if "device_selected" in requests.columns:
        other = F.col("device_selected").isNotNull() \
            & ~F.coalesce(F.col("device") == F.col("device_selected"), F.lit(False))
    extra = F.coalesce(F.col("extra_columns"), F.lit(False)) \
        if "extra_columns" in requests.columns else F.lit(False)
    reason = (F.when(extra, "extra_columns")
              .when(other, "other_device")
              .when(~ok_numbers | F.col("operation").isNull(), "malformed")
              .when(~F.col("operation").isin(OPERATIONS), "unknown_operation")
              .when(~F.col("offset_bytes").between(0, limits.max_offset), "bad_offset")
              .when(F.col("size_bytes") <= 0, "bad_size")
              .when(F.coalesce(F.col("n_blocks") > limits.max_blocks, F.lit(True)), "oversized"))
    return blocks.withColumn("reject_reason", reason)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def reject_counts(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull()).groupBy("trace_id", "reject_reason") \
        .agg(F.count(F.lit(1)).alias("records"))


def _counters(limits: Limits) -> dict[str, Column]:
    reason = F.col("reject_reason")
    kept = reason.isNull()
    # Traffic counters also cover requests that only the size cap rejects.
    seen = kept | (reason == "oversized")

    def when_seen(condition: Column) -> Column:
        return F.count_if(seen & condition)

    counters: dict[str, Column] = {
        "raw_records_read": F.count_if(kept | (reason != "extra_columns")),
        "records_accepted": F.count_if(kept),
        "blocks_emitted": F.coalesce(F.sum(F.when(kept, F.col("n_blocks"))), F.lit(0)),
        "write_blocks": F.coalesce(F.sum(F.when(kept & (F.col("operation") == "W"), F.col("n_blocks"))), F.lit(0)),
        "read_blocks": F.coalesce(F.sum(F.when(kept & (F.col("operation") == "R"), F.col("n_blocks"))), F.lit(0)),
    }
    for name in REASONS[1:]:
        column = "dropped_oversized_request" if name == "oversized" else f"dropped_{name}"
        counters[column] = F.count_if(reason == name)
    counters["dropped_total"] = F.count_if(reason.isNotNull() & (reason != "extra_columns"))
    counters["skipped_extra_columns"] = F.count_if(reason == "extra_columns")
    counters["total_bytes"] = F.coalesce(F.sum(F.when(seen, F.col("size_bytes"))), F.lit(0))
    counters["write_records"] = when_seen(F.col("operation") == "W")
    counters["read_records"] = when_seen(F.col("operation") == "R")
    counters["discard_records"] = when_seen(F.col("operation") == "D")
    counters["unaligned_requests"] = when_seen(F.col("offset_bytes") % limits.block_bytes != 0)
    counters["multi_block_requests"] = when_seen(F.col("n_blocks") > 1)
    counters["first_raw_timestamp"] = F.min(F.when(kept, F.col("raw_ts")))
    counters["last_raw_timestamp"] = F.max(F.when(kept, F.col("raw_ts")))
    return counters


def parse_counters(checked: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All record counters of the audit in one aggregation, before expansion."""
    return checked.groupBy("trace_id").agg(*[c.alias(n) for n, c in _counters(limits).items()])


def disorder_counts(checked: DataFrame, order: list[str] = RAW_ORDER) -> DataFrame:
    """Adjacent block rows that go back in time or repeat a timestamp, in file order.

    Counted on requests: a request of k blocks holds k - 1 repeats, and only
    neighbouring requests need comparing.
    """
    narrow = accepted(checked).select("trace_id", *order, "raw_ts", "n_blocks")
    near = ordered_columns(narrow, KEY, order, past={"_before": ("raw_ts", 1)})
    previous = F.try_element_at("_before", F.lit(1))
    return near.groupBy("trace_id").agg(
        F.count_if(F.col("raw_ts") < previous).alias("out_of_order_records"),
        (F.sum(F.col("n_blocks") - 1) + F.count_if(F.col("raw_ts") == previous))
        .alias("duplicate_timestamps"))


def unknown_operation_examples(checked: DataFrame, order: list[str] = RAW_ORDER,
                               limit: int = 5) -> DataFrame:
    """The first few unknown spellings of each trace, by first appearance."""
    spellings = (checked.filter(F.col("reject_reason") == "unknown_operation")
                 .groupBy("trace_id", "operation").agg(F.min(F.struct(*order)).alias("first_seen")))
    place = Window.partitionBy("trace_id").orderBy("first_seen")
    return (spellings.withColumn("rank", F.row_number().over(place))
            .filter(F.col("rank") <= limit).select("trace_id", "rank", "operation"))


def parse_audit(checked: DataFrame, limits: Limits = Limits(),
                order: list[str] = RAW_ORDER) -> DataFrame:
    """One audit row per trace: counters, disorder, devices, odd spellings."""
    checked = settle(checked, "checked")
    examples = unknown_operation_examples(checked, order).groupBy("trace_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "operation"))),
                    lambda item: item["operation"]).alias("unknown_operation_examples"))
    audit = parse_counters(checked, limits)
    for part in (disorder_counts(checked, order), examples,
                 device_record_map(settle(device_counts(checked, order), "devices"))):
        audit = audit.join(part, "trace_id", "left")
    zero = F.lit(0).cast("long")
    return audit.withColumns({
        "out_of_order_records": F.coalesce("out_of_order_records", zero),
        "duplicate_timestamps": F.coalesce("duplicate_timestamps", zero),
        "other_devices": F.coalesce("other_devices", zero),
        "other_device_records": F.coalesce("other_device_records", zero),
        "unknown_operation_examples": F.coalesce("unknown_operation_examples", F.array().cast("array<string>")),
        "first_raw_timestamp": F.coalesce("first_raw_timestamp", zero),
        "last_raw_timestamp": F.coalesce("last_raw_timestamp", zero),
        "duration_microseconds": F.coalesce(F.col("last_raw_timestamp") - F.col("first_raw_timestamp"), zero)})


def expand_blocks(requests: DataFrame) -> DataFrame:
    """One row per block a request touches, partial first and last blocks included."""
    return requests.withColumn(
        "block_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))) \
        .withColumn("lba", F.col("first_block") + F.col("block_index"))


def rebase(requests: DataFrame, time: str = "raw_ts") -> DataFrame:
    """Add ``timestamp``: microseconds since the first kept request of the trace."""
    start = requests.groupBy("trace_id").agg(F.min(time).alias("_start"))
    return attach(requests, start, KEY).withColumn(
        "timestamp", F.col(time) - F.col("_start")).drop("_start")


def normalize(checked: DataFrame, order: list[str] = RAW_ORDER) -> DataFrame:
    """Accepted requests as normalized block rows.

    ``seq`` is the dense place of a row in its trace: by time, then source order,
    then block. It is computed on requests (block counts summed over earlier
    requests), so the expanded rows are never sorted.
    """
    kept = rebase(accepted(checked)).select(
        "trace_id", "timestamp", *order, "first_block", "n_blocks", "operation")
    placed = ordered_columns(kept, KEY, ["timestamp", *order], running={"_start": F.col("n_blocks")})
    return expand_blocks(placed).select(
        "timestamp", "lba", F.lit(1).alias("size"), "operation",
        (F.col("_start") + F.col("block_index")).alias("seq"), "trace_id")


def request_prefix(requests: DataFrame, max_records: int, order: list[str] = RAW_ORDER) -> DataFrame:
    """The first `max_records` raw records of each trace, in file order."""
    # Lines of one split of a file are counted together; other sources have a number in front.
    return ordered_prefix(requests, KEY, order, n=max_records, coarse=2 if order == RAW_ORDER else 0)


def structural_check(requests: DataFrame, limits: Limits = Limits(),
                     order: list[str] = RAW_ORDER, records: int = 2000) -> DataFrame:
    """Parse a prefix; a trace passes if most of it survives validation."""
    prefix = settle(request_prefix(requests, records, order), "prefix")
    checked = check_requests(select_device(prefix, "dominant", order), limits)
    table = parse_counters(checked, limits).select(
        "trace_id", "raw_records_read", "blocks_emitted", "dropped_total")
    verdict = (F.when(F.col("raw_records_read") == 0, "no records could be read")
               .when(F.col("blocks_emitted") == 0, "no record survived validation")
               .when(F.col("dropped_total") / F.col("raw_records_read") > 0.5,
                     "more than half of the records rejected")
               .otherwise("ok"))
    return table.withColumn("verdict", verdict).withColumn("passed", F.col("verdict") == "ok")

