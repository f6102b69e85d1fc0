"""Near copies among vectors by tiled comparison in the order of principal components.

Equal vectors are one class from the start. The classes are rotated to their
principal axes, so the first coordinates hold most of every dot product. Rows
of a label are cut into tiles along the first axis, and

* two tiles meet only if their boxes on the leading axes come close enough;
  along the first axis the partners of a tile are a run of its neighbours;
* inside a pair of tiles the leading coordinates are multiplied first. The rest
  of a product is at most the product of the suffix norms (Cauchy-Schwarz), so
  a pair stops as soon as its cosine cannot reach the threshold;
* what is left at the end is compared in full; cosines that are too close to
  the threshold for the rotation's rounding are computed from the vectors as given.

No link is missed. A task sends back one row per class with its number of links
and one link to a component inside the pair of tiles, not all pairs, so a large
group of near copies stays linear in its size and number of tiles.

The work is quadratic in the size of a label where vectors have no structure:
the tiles of a label all meet, and the early stop saves a constant factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from blocktrace.llm.common import join_uneven, settle
from blocktrace.llm.dense import blocks, collected, finite
from blocktrace.llm.graph import components

#: Most rows of a tile, and the fewest that a small table is cut into.
TILE_ROWS, LEAST_ROWS = 4096, 1024
#: Axes that the boxes of tiles cover.
LEAD = 8
#: Bound on the rounding of a cosine between rotated unit vectors.
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows or vanishes."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def suffix_norms(rows: np.ndarray, marks: list[int]) -> list[np.ndarray]:
    """Length of what is left of each row from every mark on."""
    squares = rows * rows
    return [np.sqrt(squares[:, mark:].sum(axis=1)) for mark in marks]


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool,
                block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and cosines of the pairs of unit rows whose cosine reaches `threshold` less ``SLACK``.

    Leading coordinates come first; a pair ends when its partial product and
    the suffix norms cannot reach the threshold. If `same`, `b` is `a` and each
    pair comes once.
    """
    size, bound = a.shape[1], threshold - SLACK
    marks = sorted({max(1, size // 4), max(1, size // 2), size})
    rest_a, rest_b = suffix_norms(a, marks), suffix_norms(b, marks)
    for start in range(0, len(a), block):
        skip = start if same else 0
        x, y = a[start:start + block], b[skip:]
        part = x[:, :marks[0]] @ y[:, :marks[0]].T
        alive = part + rest_a[0][start:start + block, None] * rest_b[0][None, skip:] >= bound
        if same:
            alive &= np.arange(len(y))[None, :] > np.arange(len(x))[:, None]
        i, j = np.nonzero(alive)
        value = part[i, j]
        for k in range(1, len(marks)):
            low, high = marks[k - 1], marks[k]
            for at in range(0, len(i), 1 << 16):
                here = slice(at, at + (1 << 16))
                value[here] += np.einsum("ij,ij->i", x[i[here], low:high], y[j[here], low:high])
            kept = value + rest_a[k][start + i] * rest_b[k][skip + j] >= bound
            i, j, value = i[kept], j[kept], value[kept]
        if len(i):
            yield i + start, j + skip, value


def join_groups(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place of each group after the links `i` - `j`; `label` holds those before."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def compare_tiles(first: dict, second: dict | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Links between two tiles, or inside one: nodes with links, how many rows they link to, one node of their group."""
    one = _Tile(first, axes)
    two = one if second is None else _Tile(second, axes)
    shift = 0 if second is None else len(one.nodes)
    nodes = one.nodes if second is None else np.concatenate([one.nodes, two.nodes])
    links, label = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    for i, j, value in close_pairs(one.turned, two.turned, threshold, second is None):
        unsure = np.flatnonzero(np.abs(value - threshold) <= SLACK)
        if len(unsure):
            x, y = one.unit[i[unsure]], two.unit[j[unsure]]
            sure = np.ones(len(i), dtype=bool)
            sure[unsure] = np.einsum("ij,ij->i", x, y) >= threshold
            i, j = i[sure], j[sure]
        j = j + shift
        links += np.bincount(i, two.copies[j - shift], len(nodes)).astype(np.int64)
        links += np.bincount(j, one.copies[i], len(nodes)).astype(np.int64)
        label = join_groups(label, i, j)
    linked = np.flatnonzero(links)
    return nodes[linked], links[linked], nodes[label[linked]]


class _Tile:
    def __init__(self, row: dict, axes: np.ndarray):
        self.nodes = np.frombuffer(row["nodes"], dtype=np.int64)
        self.copies = np.frombuffer(row["copies"], dtype=np.int64)
        values = np.frombuffer(row["vectors"], dtype=np.float64 if row["wide"] else np.float32)
        self.unit = unit(values.reshape(len(self.nodes), -1).astype(np.float64))
        self.turned = self.unit @ axes if len(axes) else self.unit


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """Axes of the unit vectors of one length, by falling energy, as columns.

    The second moments are summed over all classes; `size` squared numbers reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, rows in blocks(batches, "embedding"):
            rows = unit(rows)
            total += rows.T @ rows
        yield pa.record_batch([pa.array(range(size), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                              names=["key", "part"])

    parts = classes.filter(F.col("size") == size).select("embedding").mapInArrow(moments, "key long, part array<double>")
    _, axes = np.linalg.eigh(collected(parts, size))
    return np.ascontiguousarray(axes[:, ::-1])


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray], rows: int, count: int) -> DataFrame:
    """Tiles of at most `rows` classes of one label and length, in ranges along the first axis."""
    wide = classes.schema["embedding"].dataType.elementType.typeName() == "double"
    kind = np.float64 if wide else np.float32
    label = classes.schema["label"].dataType.simpleString()
    place = "label " + label + ", size int, node long, copies long, vector binary, lead double"
    tile = ("label " + label + ", size int, tile long, nodes binary, copies binary, vectors binary, wide boolean, "
            "low array<double>, high array<double>")
    none = np.zeros((0, 0))

    def turned(values: np.ndarray) -> np.ndarray:
        turn = axes.get(values.shape[1], none)
        return unit(values) @ turn if len(turn) else unit(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for held, values in blocks(iter([part]), "embedding"):
                    vectors = [v.tobytes() for v in values.astype(kind)]
                    yield pa.record_batch(
                        [*(held.column(c) for c in ("label", "size", "node", "copies")), pa.array(vectors, pa.binary()),
                         pa.array(turned(values)[:, 0])], names=["label", "size", "node", "copies", "vector", "lead"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            nodes, copies = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
            vectors = b"".join(h[2] for h in held)
            values = np.frombuffer(vectors, dtype=kind).reshape(len(held), -1).astype(np.float64)
            lead = turned(values)[:, :LEAD]
            return pa.RecordBatch.from_pylist([{
                "label": key[0], "size": key[1], "tile": int(nodes[0]), "nodes": nodes.tobytes(),
                "copies": copies.tobytes(), "vectors": vectors, "wide": wide, "low": lead.min(axis=0).tolist(),
                "high": lead.max(axis=0).tolist()}], schema=arrow)

        types = [batch_label, pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(),
                 pa.list_(pa.float64()), pa.list_(pa.float64())]
        arrow = pa.schema(list(zip(("label", "size", "tile", "nodes", "copies", "vectors", "wide", "low", "high"), types)))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "size", "node", "copies", "vector")]
            for name, size, *row in zip(*columns):
                if held and ((name, size) != key or len(held) >= max(64, min(rows, (1 << 21) // size))):
                    yield out()
                    held = []
                key = (name, size)
                held.append(row)
        if held:
            yield out()

    batch_label = to_arrow_type(classes.schema["label"].dataType)
    order = ["label", "size", "lead", "node"]
    placed = settle(classes.select("label", "size", "node", "copies", "embedding").mapInArrow(project, place), "placed")
    return settle(placed.repartitionByRange(count, *order).sortWithinPartitions(*order).mapInArrow(cut, tile), "tiles")


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles (`tile_a`, `tile_b`) of a label that may hold a link; a tile meets itself too.

    Tiles are numbered along the first axis; the partners of one are the run of
    numbers up to the last tile that begins within reach of its end.
    """
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    key = ["label", "size"]
    boxes = tiles.select(*key, "tile", "low", "high")
    along = Window.partitionBy(*key).orderBy(F.col("low")[0], "tile")
    numbered = settle(boxes.withColumn("number", F.row_number().over(along)), "boxes")
    starts = numbered.select(*key, F.col("low")[0].alias("at"), F.lit(1).alias("begins"), F.lit(None).cast("int").alias("number"))
    ends = numbered.select(*key, (F.col("high")[0] + reach).alias("at"), F.lit(0).alias("begins"), "number")
    up_to = Window.partitionBy(*key).orderBy(F.col("at"), F.col("begins").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = (starts.union(ends).withColumn("last", F.sum("begins").over(up_to)).filter("number IS NOT NULL")
            .select(*key, "number", "last"))
    runs = numbered.join(last, [*key, "number"]).select(
        *key, F.col("tile").alias("tile_a"), F.col("low").alias("_low"), F.col("high").alias("_high"),
        F.explode(F.sequence(F.col("number"), F.greatest("number", F.col("last").cast("int")))).alias("number"))
    over, under = (F.zip_with(x, y, lambda p, q: p - q) for x, y in (("low", "_high"), ("_low", "high")))
    gap = F.zip_with(over, under, lambda p, q: F.pow(F.greatest(p, q, F.lit(0.0)), F.lit(2.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x)
    return (runs.join(numbered, [*key, "number"]).filter(apart <= reach * reach)
            .select(*key, "tile_a", F.col("tile").alias("tile_b")))


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, tile_rows: int = TILE_ROWS,
                 least_rows: int = LEAST_ROWS) -> DataFrame:
    """Groups of vectors of one label linked by a cosine of at least `threshold`.

    Returns one row per row of `vectors`: `vec_id`, `n_links` (other rows
    linked directly), `component_id` (smallest id reachable over links) and
    `kept` (true for that one). A vector that is null, empty or zero or holds
    a null or non-finite entry links with nothing, nor does a row with a null
    label or id; vectors of different lengths don't either. Repeated rows are
    rows of their own, linked with each other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    sound = finite("embedding") & F.coalesce(F.exists("embedding", lambda c: c != 0), F.lit(False)) \
        & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keys = [F.xxhash64(F.lit(i), "label", "embedding").alias(f"k{i}") for i in (1, 2)]
    key = ["label", "k1", "k2"]
    good = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", *keys)
    classes = settle(good.groupBy(*key).agg(
        F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .withColumns({"size": F.size("embedding"), "node": F.monotonically_increasing_id()}), "classes")
    # Axes for the most frequent length; others are compared in the order of their entries.
    common = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    axes = {common["size"]: principal_axes(classes, common["size"])} if common else {}
    total = classes.count()
    rows = min(tile_rows, max(least_rows, ceil(total / (4 * spark.sparkContext.defaultParallelism))))
    tiles = _tiles(classes, axes, rows, max(1, ceil(total / rows)))
    pairs = settle(_tile_pairs(tiles, threshold), "tile-pairs")
    none = np.zeros((0, 0))

    def compare(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["tile"] != r["tile_a"])
        turn = axes.get(held[0]["size"], none)
        found = compare_tiles(held[0], held[1] if len(held) > 1 else None, turn, threshold)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["node", "links", "root"])

    both = (tiles.join(pairs.withColumn("tile", F.explode(F.array_distinct(F.array("tile_a", "tile_b")))),
                       [*key[:1], "size", "tile"])
            .select("tile_a", "tile_b", "tile", "size", "nodes", "copies", "vectors", "wide"))
    tasks = max(spark.sparkContext.defaultParallelism, ceil(pairs.count() / 4))
    found = settle(both.repartition(tasks, "tile_a", "tile_b").groupBy("tile_a", "tile_b")
                   .applyInArrow(compare, "node long, links long, root long"), "found")

    groups = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.join(groups, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    lowest = named.groupBy("_group").agg(F.min("low_id").alias("component_id"))
    linked = found.groupBy("node").agg(F.sum("links").alias("_links"))
    told = named.drop("component").join(lowest, "_group").join(linked, "node", "left").select(
        *key, "copies", "component_id", (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))
    result = join_uneven(good.drop("embedding"), told, key, "copies").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = vectors.filter(~sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return result.union(alone)


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
scaled AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM sound),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM scaled a JOIN scaled b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach(x, y) AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(r.low, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) n ON n.x = e.vec_id
LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON r.x = e.vec_id
"""
