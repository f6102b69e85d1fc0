"""Device geometry arithmetic and write amplification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unavailable_segments(reserved: int, separate_gc: bool, user_streams: int = 2) -> int:
    return reserved + user_streams + (1 if separate_gc else 0)


def device_segments(distinct_lbas: Column, utilization: Column, blocks_per_segment: int,
                    reserved: int = 2, separate_gc: bool = True) -> Column:
    """Segments for live data to fill `utilization` and still leave room to clean."""
    held = F.ceil(distinct_lbas / (utilization * F.lit(blocks_per_segment)))
    fits = F.ceil(distinct_lbas / F.lit(blocks_per_segment)) + F.lit(unavailable_segments(reserved, separate_gc))
    return F.greatest(F.lit(1), held, fits).cast("long")


def capacity_blocks(segments: Column, blocks_per_segment: Column) -> Column:
    return segments * blocks_per_segment


def max_live_blocks(segments: Column, blocks_per_segment: Column, unavailable: Column) -> Column:
    return F.greatest(segments - unavailable, F.lit(0)) * blocks_per_segment


def max_utilization(segments: Column, blocks_per_segment: Column, unavailable: Column) -> Column:
    total = capacity_blocks(segments, blocks_per_segment)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        max_live_blocks(segments, blocks_per_segment, unavailable) / total)


def write_amplification(physical: Column, logical: Column) -> Column:
    return F.when(logical == 0, F.lit(1.0)).otherwise(physical / logical)
