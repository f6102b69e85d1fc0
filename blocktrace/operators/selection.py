"""Workload eligibility and roles, decided before any model is trained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criteria:
    """Thresholds every candidate workload must reach."""

    min_write_blocks: int = 200_000
    min_rewrite_ratio: float = 0.30
    min_unique_written_lbas: int = 5_000
    min_duration_seconds: float = 3_600.0
    num_targets: int = 2


def with_eligibility(statistics: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """Add ``eligible`` and the reasons against, in fixed order."""
    writes = F.coalesce("write_blocks", F.lit(0)).cast("long")
    ratio = F.coalesce("rewrite_ratio", F.lit(0.0))
    lbas = F.coalesce("unique_written_lbas", F.lit(0)).cast("long")
    seconds = F.coalesce("duration_seconds", F.lit(0.0))

    def reason(condition, text, *values):
        return F.when(condition, F.concat_ws("", F.lit(text), *values))

    reasons = F.array(
        reason(writes < criteria.min_write_blocks, "write_blocks ", F.format_number(writes, 0),
               F.lit(f" < {criteria.min_write_blocks:,}")),
        reason(ratio < criteria.min_rewrite_ratio, "rewrite_ratio ",
               F.format_string("%.3f", ratio), F.lit(f" < {criteria.min_rewrite_ratio}")),
        reason(lbas < criteria.min_unique_written_lbas, "unique_written_lbas ",
               F.format_number(lbas, 0), F.lit(f" < {criteria.min_unique_written_lbas:,}")),
        reason(seconds < criteria.min_duration_seconds, "duration_seconds ",
               F.format_number(seconds, 0), F.lit(f" < {criteria.min_duration_seconds:,.0f}")))
    return statistics.withColumn("reasons", F.array_compact(reasons)) \
        .withColumn("eligible", F.size("reasons") == 0) \
        .withColumn("ineligible_reasons", F.array_join("reasons", "; "))


def assign_roles(checked: DataFrame, criteria: Criteria = Criteria()) -> DataFrame:
    """pretrain / target / external / excluded for each workload.

    Targets are the middle of the eligible MSR workloads in name order. The
    table has one row per workload, so a window over it stays small.
    """
    candidate = F.col("eligible") & (F.col("dataset") == "msr")
    group = Window.partitionBy(candidate)
    n = F.count(F.lit(1)).over(group)
    place = F.row_number().over(group.orderBy("trace_id")) - 1
    count = F.when(n > 1, F.least(F.lit(criteria.num_targets), F.greatest(F.lit(1), n - 1))).otherwise(0)
    start = F.greatest(F.lit(0), F.floor((n - count) / 2))
    chosen = (place >= start) & (place < start + count)
    role = (F.when(~F.col("eligible"), "excluded")
            .when(F.col("dataset") != "msr", "external")
            .when(chosen, "target").otherwise("pretrain"))
    return checked.select("trace_id", "dataset", role.alias("role"), "ineligible_reasons")


def inventory(checked: DataFrame, columns: list[str]) -> DataFrame:
    """The measured statistics with the decision attached, sorted by workload."""
    return checked.select("trace_id", *columns, "eligible", "ineligible_reasons").orderBy("trace_id")
