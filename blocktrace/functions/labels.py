"""Operation codes, hot/cold labels and write routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings each format uses for reads, writes and discards.
MSR_OPERATIONS = {"WRITE": "W", "READ": "R", "W": "W", "R": "R"}
FIU_OPERATIONS = {"W": "W", "R": "R", "WS": "W", "RS": "R", "WRITE": "W", "READ": "R", "D": "D"}
SYSTOR_OPERATIONS = {"W": "W", "R": "R", "WRITE": "W", "READ": "R"}


def map_operation(raw: Column, spellings: dict[str, str]) -> Column:
    """Known spellings become codes; other text is kept; blank becomes BLANK."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    result = F.when(text == "", F.lit("BLANK"))
    for spelling, code in spellings.items():
        if spelling != code:
            result = result.when(text == spelling, F.lit(code))
    return result.otherwise(text)


def is_hot(interval: Column, threshold: Column) -> Column:
    """HOT means rewritten within the threshold, the threshold included."""
    return interval <= threshold


def temperature(interval: Column, threshold: Column) -> Column:
    return F.when(is_hot(interval, threshold), "HOT").otherwise("COLD")


def write_stream(policy: Column, temp: Column) -> Column:
    """MIXED keeps one log; other policies move only COLD writes aside."""
    return F.when((policy != "MIXED") & (temp == "COLD"), "COLD").otherwise("MAIN")
