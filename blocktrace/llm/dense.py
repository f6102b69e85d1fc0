"""Vectors as matrices: which rows are sound, blocks of a column, sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str, below: float = float("inf")) -> Column:
    """Vectors that are there, have entries, and hold finite ones only, of less than `below`; never null."""
    sound = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < below, F.lit(False)))
    return F.coalesce(sound & (F.size(column) > 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], column: str, entries: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches of vectors of one length, cut to about `entries` numbers, each with its matrix."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, entries // max(1, len(batch.column(column)[0])))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, matrix(part.column(column))


def array_sums(parts: DataFrame) -> DataFrame:
    """Add up arrays (`key` long, `part` array<double>, all of one length) by key; one row per key.

    Rows of a key meet in one task and are added as they come, so a task holds
    one array per key. Each row stands for a whole task or batch.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, values in zip(batch.column("key").to_pylist(), matrix(batch.column("part"))):
                if key in sums:
                    sums[key] += values
                else:
                    sums[key] = values.copy()
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                              names=["key", "part"])

    return parts.repartition("key").mapInArrow(add, "key long, part array<double>")


def collected(parts: DataFrame, size: int) -> np.ndarray:
    """The rows of ``array_sums`` in order of their keys: a matrix of `size` columns, of fixed size."""
    found = array_sums(parts).toArrow().sort_by("key").to_pydict()["part"]
    return np.array(found, dtype=np.float64).reshape(-1, size)
