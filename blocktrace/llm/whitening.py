"""Whitening of vectors by blockwise QR, bidiagonal reduction and dqds.

The covariance is never formed. Tasks centre their rows and keep the triangular
factor of what they have seen; factors are stacked and reduced in a tree, a
few at a time, to one triangle R with R'R equal to the centred rows' square.
``bidiagonal.py`` turns R into singular values and right vectors: the vectors
are the principal directions, the squared values over the count their variances.

Counts, sums and squared deviations are whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.bidiagonal import right_vectors
from blocktrace.llm.common import settle
from blocktrace.llm.dense import blocks, collected, finite

#: Whole numbers of the grid: floor(scale * c) + offset. Entries from LIMIT on have no exact place on it.
SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0 ** 45
#: Bytes of the triangles that one task of the tree stacks.
STACK_BYTES = 1 << 26


def grid(rows: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * rows).astype(np.int64) + OFFSET


class Centre:
    """Exact number of rows and sum of each dimension, and what follows for a block of rows."""

    def __init__(self, count: int, sums: list[int]):
        self.count = count
        self.whole = np.array([s // count for s in sums], dtype=np.int64)
        self.rest = np.array([s % count for s in sums], dtype=np.int64)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``x - S / n`` as doubles."""
        return (grid(rows) - self.whole).astype(np.float64) - self.rest / self.count

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n x - S) ** 2``; None where no long can hold it."""
        away = grid(rows) - self.whole
        largest = int(np.abs(away).max(initial=0)) + 1
        if rows.shape[1] * (self.count * largest) ** 2 < 2 ** 63:
            scaled = away * self.count - self.rest
            return (scaled * scaled).sum(axis=1).tolist()
        scaled = away.astype(object) * self.count - self.rest.astype(object)
        return [v if v < 2 ** 63 else None for v in (scaled * scaled).sum(axis=1)]


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Count and sums over all rows. A sum travels in two halves, so nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for _, rows in blocks(batches, "embedding"):
            # A block has at most 2 ** 20 rows and a number less than 2 ** 52.
            part = grid(rows)
            halves = np.stack([part >> 26, part & ((1 << 26) - 1)]).sum(axis=1).astype(object)
            count += len(rows)
            total = halves if total is None else total + halves
        if count:
            whole = [(int(h) << 26) + int(low) for h, low in zip(*total)]
            yield pa.record_batch([pa.array(range(-1, len(whole)), pa.int64()),
                                   pa.array([str(v) for v in (count, *whole)])], names=["place", "total"])

    rows = (vectors.select("embedding").mapInArrow(run, "place long, total string").groupBy("place")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect())
    totals = [int(r["total"]) for r in rows]
    return (totals[0], totals[1:]) if totals else (0, [])


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, as a square."""
    size = rows.shape[1]
    out = np.linalg.qr(rows, mode="r")
    return out if len(out) == size else np.vstack([out, np.zeros((size - len(out), size))])


def _factor(vectors: DataFrame, centre: Centre, size: int) -> np.ndarray:
    """The triangle of all centred rows."""

    def pack(part: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int64()), pa.array([held.tobytes()], pa.binary())],
                               names=["part", "triangle"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((size, size))
        for _, rows in blocks(batches, "embedding"):
            held = triangle(np.vstack([held, centre.centred(rows)]))
        yield pack(TaskContext.get().partitionId(), held)

    def stack(table: pa.Table) -> pa.Table:
        squares = [np.frombuffer(t, dtype=np.float64).reshape(size, size) for t in table.column("triangle").to_pylist()]
        return pa.Table.from_batches([pack(table.column("part")[0].as_py(), triangle(np.vstack(squares)))])

    schema = "part long, triangle binary"
    width = max(2, min(64, STACK_BYTES // (8 * size * size)))
    parts = settle(vectors.select("embedding").mapInArrow(run, schema), "triangles")
    highest = parts.agg(F.max("part")).first()[0]
    while highest:
        parts = settle(parts.select(F.floor(F.col("part") / width).alias("part"), "triangle")
                       .groupBy("part").applyInArrow(stack, schema), "triangles")
        highest //= width
    return np.frombuffer(parts.first()["triangle"], dtype=np.float64).reshape(size, size)


def whitened(vectors: DataFrame, *, components: int = 32) -> DataFrame:
    """Whitened coordinates of every row on the leading principal directions.

    Entries become whole numbers x = floor(64 c) + 1000000; all rows are the
    fit list. Returns one row per row and component (from 1, by falling
    variance): `vec_id`, `component`, `n` (rows fitted), `deviation` (exact sum
    of ``(n x - S) ** 2``; null beyond a long), `whitened`, `explained` (share
    of the variance) and `identity_error` (largest entry of the covariance of
    all whitened coordinates minus the identity, over all rows).

    Left out are vectors that are null, empty, or hold null or non-finite
    entries or any of 2^45 or more, and those of another length than the most
    frequent one (of equally frequent ones the longest counts). Repeated rows
    count each, and a null id is kept. Directions without variance are no
    components: equal rows, one row, or an empty table give no rows.
    """
    sound = vectors.filter(finite("embedding", LIMIT)).select("vec_id", "embedding")
    common = (sound.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.desc("size")).first())
    size = common["size"] if common else 1
    sound = sound.filter(F.size("embedding") == size)
    count, sums = _sums(sound)
    centre = Centre(max(count, 1), sums or [0] * size)
    factor = _factor(sound, centre, size) if common else np.zeros((size, size))
    values, axes = right_vectors(factor, components)
    kept = len(values)
    # To unit variance: a coordinate's variance is the squared singular value over the count.
    turn = axes * (np.sqrt(centre.count) / values) if kept else axes

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for _, rows in blocks(batches, "embedding"):
            coordinates = centre.centred(rows) @ turn
            total[:kept] += coordinates.T @ coordinates
            total[kept] += coordinates.sum(axis=0)
        yield pa.record_batch([pa.array(range(kept + 1), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                              names=["key", "part"])

    error, shares = 0.0, []
    if kept:
        found = collected(sound.select("embedding").mapInArrow(products, "key long, part array<double>"), kept) / centre.count
        error = float(np.abs(found[:kept] - np.outer(found[kept], found[kept]) - np.eye(kept)).max())
        shares = [float(v) for v in values * values / np.square(factor).sum()]

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in blocks(batches, "embedding"):
            yield pa.record_batch(
                [part.column("vec_id"), pa.array(centre.deviations(rows), pa.int64()),
                 pa.array(list(centre.centred(rows) @ turn), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "coordinates"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    told = sound.mapInArrow(coordinates, f"vec_id {kind}, deviation long, coordinates array<double>")
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("component")) if shares else F.lit(0.0)
    return (told.select("vec_id", "deviation", F.posexplode("coordinates"))
            .withColumn("component", (F.col("pos") + 1).cast("int"))
            .select("vec_id", "component", F.lit(count).cast("long").alias("n"), "deviation",
                    F.col("col").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error")))

