"""Random forests over more rows than Spark's own trainer passes over at once.

Spark's trainer sends a histogram of every node from every partition and goes
over all rows again for each group of nodes that fits its memory, so its cost
grows with the number of nodes. Here a node that holds too many rows for one
task is split from histograms of all partitions. Any other node goes to one
task together with its rows, and the task grows the whole subtree below it.

Bins, bootstrap, feature subsets, gain and stopping rules are those of Spark's
regression trees; the random draws are others. They depend on the seed, the stored
block of rows, the tree and the node alone, so lost tasks change nothing and equal
seeds give equal first trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocktrace.plans.layout import task_rows
from blocktrace.plans.storage import settle

#: Rows in a stored block of binned rows, and rows whose histograms are added up at a time.
BLOCK_ROWS, PIECE_ROWS = 4096, 16_384
#: Bytes of rows that one task grows a subtree from, and that are shuffled at a time for all trees.
TASK_BYTES, SHUFFLED_BYTES = 48 << 20, 2 << 30
#: Variance that a split must take away; less is rounding.
LEAST_GAIN = 1e-12
#: Bin numbers are bytes, and a leaf is a node whose rows all stay: no bin is above this one.
STAY = 255
#: Bytes of a batch on its way to Python, and rows of blocks a reader holds.
BATCH_BYTES, READ_ROWS = 4 << 20, 512


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    least: int
    #: Features drawn for each node, and features in all.
    drawn: int
    width: int
    bins: int
    rate: float
    bootstrap: bool
    seed: int

    @classmethod
    def of(cls, estimator: RandomForestRegressor, width: int) -> Settings:
        return cls(trees=estimator.getNumTrees(), depth=estimator.getMaxDepth(), least=estimator.getMinInstancesPerNode(),
                   drawn=features_drawn(estimator.getFeatureSubsetStrategy(), estimator.getNumTrees(), width), width=width,
                   bins=estimator.getMaxBins(), rate=estimator.getSubsamplingRate(), bootstrap=estimator.getBootstrap(),
                   seed=estimator.getSeed() % 2 ** 64)


def features_drawn(strategy: str, trees: int, width: int) -> int:
    """Features a node chooses from, by the names Spark has for regression."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {"all": width, "onethird": math.ceil(width / 3), "sqrt": math.ceil(math.sqrt(width)),
             "log2": max(1, math.ceil(math.log2(width)))}
    if strategy in named:
        return named[strategy]
    if strategy.isdigit():
        return min(int(strategy), width)
    return math.ceil(float(strategy) * width)


def outgrows(estimator: RandomForestRegressor, rows: int, width: int) -> bool:
    """True if the histograms of one level of all trees may need more than one pass of Spark's trainer.

    Settings that only Spark's trainer knows leave it the work.
    """
    plain = (estimator.getMinInfoGain() == 0.0 and estimator.getMinWeightFractionPerNode() == 0.0
             and not estimator.isDefined(estimator.weightCol) and estimator.getMaxBins() <= STAY)
    chosen = Settings.of(estimator, width)
    nodes = chosen.trees * min(2 ** (chosen.depth - 1), math.ceil(rows / chosen.least))
    return plain and nodes * chosen.drawn * chosen.bins * 32 > estimator.getMaxMemoryInMB() << 20


# -- bins --------------------------------------------------------------------

def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of one feature: all midpoints of a few values, else about equal numbers of rows between two."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) < bins:
        return middles
    stride = len(values) / bins
    kept, seen, target = [], int(counts[0]), stride
    for i in range(1, len(found)):
        before, seen = seen, seen + int(counts[i])
        if abs(before - target) < abs(seen - target):
            kept.append(middles[i - 1])
            target += stride
    return np.array(kept)


def to_bins(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    bins = np.empty(rows.shape, np.uint8)
    for f, points in enumerate(cuts):
        bins[:, f] = np.searchsorted(points, rows[:, f], side="left")
    return bins


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bounded(spark: SparkSession) -> None:
    """Rows with blocks reach Python in batches of bounded bytes; a smaller setting stays."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
                       ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if int(spark.conf.get(name, None) or 2 ** 31 - 1) > most:
            spark.conf.set(name, str(most))


def stored_blocks(data: DataFrame, rows: int, cuts: list[np.ndarray], middle: float) -> DataFrame:
    """Binned rows as stored blocks, whose numbers seed the bootstrap; labels are told from `middle`."""
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                bins = to_bins(matrix(part.column("features"), len(cuts)), cuts)
                labels = part.column("label").to_numpy(zero_copy_only=False) - middle
                yield pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "labels": [labels.tobytes()]})

    # As many partitions as cores: later passes have a task for each file.
    spread = data.repartition(max(data.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / task_rows(data.sparkSession))))
    made = spread.select(vector_to_array("features").alias("features"), "label") \
        .mapInArrow(blocks, "bins binary, labels binary")
    return settle(made.withColumn("block", F.monotonically_increasing_id()), "binned")


# -- trees ---------------------------------------------------------------------

@dataclass
class Nodes:
    """A tree in arrays. Rows of node `i` go on to `left[i]`, or to the next node if their bin is above `cut[i]`."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def leaves(cls, values: Iterable[float], first: int = 0) -> Nodes:
        value = np.array(values, np.float64)
        return cls(np.zeros(len(value), np.uint16), np.full(len(value), STAY, np.uint8),
                   np.arange(first, first + len(value), dtype=np.int32), value)

    @classmethod
    def joined(cls, parts: list[Nodes]) -> Nodes:
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("feature", "cut", "left", "value")])

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> None:
        self.feature[at], self.cut[at], self.left[at] = feature, cut, left

    def graft(self, at: int, below: Nodes) -> Nodes:
        """This tree with another one in the place of the leaf `at`; the nodes under its root come last."""
        moved = below.left + np.int32(len(self.value) - 1)
        self.feature[at], self.cut[at], self.value[at] = below.feature[0], below.cut[0], below.value[0]
        if len(below.value) > 1:
            self.left[at] = moved[0]
        rest = Nodes(below.feature[1:], below.cut[1:], moved[1:], below.value[1:])
        return Nodes.joined([self, rest])

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node in which each row ends after `depth` steps at most."""
        flat, starts = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        at = np.zeros(len(bins), np.int32)
        for _ in range(depth if len(self.value) > 1 else 0):
            after = self.left[at] + (flat[starts + self.feature[at]] > self.cut[at])
            if np.array_equal(after, at):
                break
            at = after.astype(np.int32)
        return at


def draw_counts(chosen: Settings, block: int, tree: int, rows: int) -> np.ndarray:
    """How often a tree's sample has each row of a block."""
    if not chosen.bootstrap and chosen.rate >= 1.0:
        return np.ones(rows, np.uint8)
    draws = np.random.default_rng([chosen.seed, block, tree])
    if chosen.bootstrap:
        return draws.poisson(chosen.rate, rows).astype(np.uint8)
    return (draws.random(rows) < chosen.rate).astype(np.uint8)


def draw_features(chosen: Settings, draws: np.random.Generator, nodes: int) -> np.ndarray:
    if chosen.drawn == chosen.width:
        return np.tile(np.arange(chosen.width), (nodes, 1))
    return np.argpartition(draws.random((nodes, chosen.width)), chosen.drawn, axis=1)[:, :chosen.drawn]


def histogram(bins: np.ndarray, labels: np.ndarray, counts: np.ndarray, node: np.ndarray, features: np.ndarray,
              most: int) -> np.ndarray:
    """Drawn rows and their label sums for each node, drawn feature and bin."""
    nodes, drawn = features.shape
    sums = np.zeros((2, nodes, drawn, most))
    if nodes == 1 and most * most <= PIECE_ROWS:
        return node_histogram(bins, labels, counts, features[0], most)
    flat, width, slots = bins.ravel(), bins.shape[1], np.ascontiguousarray(features.T)
    # Pieces and slots one by one: a core's cache holds all of a piece.
    for start in range(0, len(bins), PIECE_ROWS):
        part = slice(start, start + PIECE_ROWS)
        own = node[part]
        rows, first = np.arange(start, start + len(own)) * width, own * most
        weight = counts[part].astype(np.float64)
        weighted = weight * labels[part]
        for slot in range(drawn):
            index = flat.take(rows + slots[slot].take(own)) + first
            sums[0, :, slot] += np.bincount(index, weight, nodes * most).reshape(nodes, most)
            sums[1, :, slot] += np.bincount(index, weighted, nodes * most).reshape(nodes, most)
    return sums


def node_histogram(bins: np.ndarray, labels: np.ndarray, counts: np.ndarray, features: np.ndarray, most: int) -> np.ndarray:
    """The same for rows of one node: two features at a time, as pairs of bins."""
    pairs = [features[i:i + 2] for i in range(0, len(features), 2)]
    joint = np.zeros((2, len(pairs), most * most))
    for start in range(0, len(bins), PIECE_ROWS):
        part = slice(start, start + PIECE_ROWS)
        weight = counts[part].astype(np.float64)
        weighted = weight * labels[part]
        for i, pair in enumerate(pairs):
            index = bins[part, pair[0]].astype(np.int64) * most
            if len(pair) == 2:
                index += bins[part, pair[1]]
            joint[0, i] += np.bincount(index, weight, most * most)
            joint[1, i] += np.bincount(index, weighted, most * most)
    joint = joint.reshape(2, len(pairs), most, most)
    both = np.stack([joint.sum(axis=3), joint.sum(axis=2)], axis=2)
    return both.reshape(2, 1, 2 * len(pairs), most)[:, :, :len(features)]


@dataclass
class Splits:
    """The best split of each node of a histogram; `gain` is 0 where there is none."""
    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    #: Drawn rows and mean label of both sides, and mean label of the node.
    rows: np.ndarray
    means: np.ndarray
    value: np.ndarray


def best_splits(sums: np.ndarray, features: np.ndarray, least: int) -> Splits:
    """The split that takes away most variance and leaves `least` drawn rows on both sides."""
    nodes, drawn, most = sums.shape[1:]
    below, low = np.cumsum(sums, axis=3)
    whole, total = below[:, :1, -1:], low[:, :1, -1:]
    below, low = below[:, :, :-1], low[:, :, :-1]
    above, high = whole - below, total - low
    with np.errstate(divide="ignore", invalid="ignore"):
        score = low * low / below + high * high / above
    score[(below < least) | (above < least)] = -np.inf
    score = score.reshape(nodes, -1)
    found = np.argmax(score, axis=1)
    whole, total = whole.reshape(nodes), total.reshape(nodes)
    every = np.arange(nodes)
    gain = (score[every, found] - total * total / whole) / whole
    rows = np.stack([below.reshape(nodes, -1)[every, found], above.reshape(nodes, -1)[every, found]])
    labels = np.stack([low.reshape(nodes, -1)[every, found], high.reshape(nodes, -1)[every, found]])
    slot, cut = found // (most - 1), found % (most - 1)
    return Splits(np.where(gain > LEAST_GAIN, gain, 0.0), features[every, slot], cut, rows,
                  labels / np.maximum(rows, 1), total / whole)


def grow(chosen: Settings, bins: np.ndarray, labels: np.ndarray, counts: np.ndarray, depth: int,
         draws: np.random.Generator) -> Nodes:
    """The subtree of a node at `depth` from all rows of the node.

    Rows stay in the order of the nodes of a level: left children first, then right ones.
    """
    weight = counts.astype(np.float64)
    root = Nodes.leaves([float((weight * labels).sum() / weight.sum())])
    parts, made = [root], 1
    # Nodes of the level by number and by the part that holds them, and how many rows each has.
    numbers, sizes = np.zeros(1, np.int64), np.array([len(bins)])
    while len(numbers) and depth < chosen.depth and len(bins):
        features = draw_features(chosen, draws, len(numbers))
        ends = np.cumsum(sizes)
        found, first = [], 0
        while first < len(numbers):
            start = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + PIECE_ROWS, side="right")))
            rows = slice(start, ends[last - 1])
            node = np.repeat(np.arange(last - first), sizes[first:last])
            found.append(best_splits(
                histogram(bins[rows], labels[rows], counts[rows], node, features[first:last], chosen.bins),
                features[first:last], chosen.least))
            first = last
        best = Splits(*[np.concatenate([getattr(s, name) for s in found], axis=-1)
                        for name in ("gain", "feature", "cut", "rows", "means", "value")])
        split = np.flatnonzero(best.gain)
        lefts = made + 2 * np.arange(len(split))
        level = parts[-1]
        level.split(numbers[split] - (made - len(level.value)), best.feature[split], best.cut[split], lefts)
        parts.append(Nodes.leaves(best.means[:, split].T.ravel(), made))
        made += 2 * len(split)
        # Children that can be split again go on, with their rows.
        goes_on = best.rows[:, split] >= 2 * chosen.least
        place = np.full(len(numbers), -1)
        place[split] = np.arange(len(split))
        # Pieces of rows, since whole columns of numbers would take more memory than the rows.
        ends = np.cumsum(sizes)
        sides, held = ([], []), np.zeros((2, len(split)), np.int64)
        for start in range(0, len(bins), PIECE_ROWS):
            piece = bins[start:start + PIECE_ROWS]
            node = np.searchsorted(ends, np.arange(start, start + len(piece)), side="right")
            right = piece.ravel().take(np.arange(len(piece)) * chosen.width + best.feature[node]) > best.cut[node]
            child = place[node]
            for side, rows in ((0, np.flatnonzero(~right & (child >= 0))), (1, np.flatnonzero(right & (child >= 0)))):
                rows = rows[goes_on[side, child[rows]]]
                held[side] += np.bincount(child[rows], minlength=len(split))
                sides[side].append((rows + start).astype(np.int32))
        order = np.concatenate([*sides[0], *sides[1]])
        alive = goes_on.ravel()
        numbers, sizes = np.concatenate([lefts, lefts + 1])[alive], held.ravel()[alive]
        bins = bins.take(order, axis=0)
        labels, counts = labels.take(order), counts.take(order)
        depth += 1
    return Nodes.joined(parts)


def in_order(parts: tuple[list, ...], width: int) -> tuple[np.ndarray, ...]:
    """Bins, labels and counts by number of block, whatever order the shuffle brings; the parts are used up."""
    order = np.argsort(parts[0])
    rows = []
    for column, kind in zip(parts[1:], (np.uint8, np.float64, np.uint8)):
        rows.append(np.frombuffer(b"".join(column[i] for i in order), kind))
        column.clear()
    return rows[0].reshape(-1, width), rows[1], rows[2]


# -- a forest over stored blocks --------------------------------------------------

@dataclass
class Top:
    """The upper nodes of a tree, which rows of all partitions decide; `open` ones have a subtree to come."""
    nodes: Nodes
    #: Depth and drawn rows of each open node.
    open: dict[int, tuple[int, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Job:
    """An open node whose subtree one task grows."""
    tree: int
    node: int
    depth: int
    rows: float


def rows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, bins, labels in zip(batch.column("block"), batch.column("bins"), batch.column("labels")):
        yield (block.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width),
               np.frombuffer(labels.as_buffer(), np.float64))


def split_heavy(chosen: Settings, blocks: DataFrame, tops: dict[int, Top], heavy: list[tuple[int, int]]) -> Splits:
    """The best split of each heavy node, from the histograms of all partitions."""
    features = {(t, n): draw_features(chosen, np.random.default_rng([chosen.seed, t, n, 0]), 1)[0] for t, n in heavy}
    own: dict[int, list[int]] = {}
    for t, n in heavy:
        own.setdefault(t, []).append(n)
    places = {key: i for i, key in enumerate(heavy)}
    steps = max(depth for t, n in heavy for depth, _ in [tops[t].open[n]])
    above = {t: tops[t].nodes for t in own}

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bins, labels in rows_of(batch, chosen.width):
                for t, numbers in own.items():
                    counts = draw_counts(chosen, block, t, len(bins))
                    which = np.full(len(above[t].value), -1)
                    which[numbers] = np.arange(len(numbers))
                    node = which[above[t].places(bins, steps)]
                    rows = np.flatnonzero((node >= 0) & (counts > 0))
                    added = histogram(bins[rows], labels[rows], counts[rows], node[rows],
                                      np.stack([features[t, n] for n in numbers]), chosen.bins)
                    sums[t] = sums[t] + added if t in sums else added
        for t, added in sums.items():
            yield pa.RecordBatch.from_pydict({"node": pa.array([places[t, n] for n in own[t]], pa.int32()),
                                              "sums": [added[:, i].tobytes() for i in range(len(own[t]))]})

    def decide(group: pa.Table) -> pa.Table:
        n = group.column("node")[0].as_py()
        # In one order, whatever order the partitions come in.
        parts = np.sort([np.frombuffer(s.as_buffer()) for s in group.column("sums")], axis=0)
        best = best_splits(parts.sum(axis=0).reshape(2, 1, chosen.drawn, chosen.bins), features[heavy[n]][None], chosen.least)
        return pa.table({"node": pa.array([n], pa.int32()), "gain": best.gain, "feature": best.feature.astype(np.int32),
                         "cut": best.cut.astype(np.int32), "rows": [best.rows[:, 0]], "means": [best.means[:, 0]],
                         "value": best.value})

    found = blocks.mapInArrow(partial, "node int, sums binary").groupBy("node").applyInArrow(
        decide, "node int, gain double, feature int, cut int, rows array<double>, means array<double>, value double") \
        .orderBy("node").collect()
    if len(found) != len(heavy):
        raise RuntimeError("a node of the forest has no rows")
    columns = [np.array([r[name] for r in found]) for name in ("gain", "feature", "cut", "rows", "means", "value")]
    return Splits(columns[0], columns[1], columns[2], columns[3].T, columns[4].T, columns[5])


def grow_tops(chosen: Settings, blocks: DataFrame, rows: int, trees: range, most: int) -> dict[int, Top]:
    """Trees split level by level until no open node has more than `most` drawn rows."""
    drawn = rows * chosen.rate if chosen.bootstrap or chosen.rate < 1.0 else rows
    tops = {t: Top(Nodes.leaves([0.0]), {0: (0, drawn)}) for t in trees}
    while heavy := [(t, n) for t, top in tops.items() for n, (depth, held) in top.open.items()
                    if held > most and depth < chosen.depth]:
        best = split_heavy(chosen, blocks, tops, heavy)
        for i, (t, n) in enumerate(heavy):
            top = tops[t]
            depth, _ = top.open.pop(n)
            top.nodes.value[n] = best.value[i]
            if not best.gain[i]:
                continue
            left = len(top.nodes.value)
            top.nodes.split(np.array([n]), best.feature[i], best.cut[i], left)
            top.nodes = Nodes.joined([top.nodes, Nodes.leaves(best.means[:, i], left)])
            for side in (0, 1):
                if depth + 1 < chosen.depth and best.rows[side, i] >= 2 * chosen.least:
                    top.open[left + side] = (depth + 1, float(best.rows[side, i]))
    return tops


def packed(jobs: list[Job], most: int, cores: int) -> list[int]:
    """A task for each job, the largest jobs first; a task takes `most` drawn rows, or less to keep cores busy, or one job."""
    most = min(most, math.ceil(sum(j.rows for j in jobs) / (4 * cores)))
    tasks, task, held = [0] * len(jobs), -1, math.inf
    for i in sorted(range(len(jobs)), key=lambda i: -jobs[i].rows):
        if held + jobs[i].rows > most:
            task, held = task + 1, 0.0
        tasks[i], held = task, held + jobs[i].rows
    return tasks


def finish(chosen: Settings, blocks: DataFrame, tops: dict[int, Top], most: int) -> dict[int, Nodes]:
    """The whole trees: each open node's rows are brought to one task, which grows what is below."""
    jobs = [Job(t, n, *held) for t, top in tops.items() for n, held in top.open.items()]
    tasks = packed(jobs, most, blocks.sparkSession.sparkContext.defaultParallelism)
    above = {t: top.nodes for t, top in tops.items()}
    steps = max((j.depth for j in jobs), default=0)
    places: dict[int, np.ndarray] = {}
    for i, job in enumerate(jobs):
        places.setdefault(job.tree, np.full(len(above[job.tree].value), -1))[job.node] = i

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for block, bins, labels in rows_of(batch, chosen.width):
                for t, of_node in places.items():
                    for job, part, counts in drawn_parts(block, t, of_node, bins):
                        rows.append((tasks[job], job, block, bins.take(part, axis=0).tobytes(),
                                     labels.take(part).tobytes(), counts.take(part).tobytes()))
                        held += len(part) * (chosen.width + 9)
                    if held > BATCH_BYTES:
                        yield from_rows(rows)
                        rows, held = [], 0
        if rows:
            yield from_rows(rows)

    def drawn_parts(block: int, t: int, of_node: np.ndarray, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        counts = draw_counts(chosen, block, t, len(bins))
        if len(of_node) == 1:
            yield int(of_node[0]), np.flatnonzero(counts), counts
            return
        job = of_node[above[t].places(bins, steps)]
        rows = np.flatnonzero((job >= 0) & (counts > 0))
        rows = rows[np.argsort(job[rows], kind="stable")]
        found, starts = np.unique(job[rows], return_index=True)
        for j, part in zip(found.tolist(), np.split(rows, starts[1:])):
            yield j, part, counts

    def from_rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)],
                                          ["task", "job", "block", "bins", "labels", "counts"])

    def grown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, ...]] = {}
        for batch in batches:
            for row in zip(*[batch.column(name).to_pylist() for name in ("job", "block", "bins", "labels", "counts")]):
                for column, value in zip(held.setdefault(row[0], ([], [], [], [])), row[1:]):
                    column.append(value)
            del batch
        for j in sorted(held):
            job = jobs[j]
            tree = grow(chosen, *in_order(held.pop(j), chosen.width), job.depth,
                        np.random.default_rng([chosen.seed, job.tree, job.node, 1]))
            yield pa.RecordBatch.from_pydict({
                "job": pa.array([j], pa.int32()), "feature": [tree.feature.tobytes()], "cut": [tree.cut.tobytes()],
                "left": [tree.left.tobytes()], "value": [tree.value.tobytes()]})

    trees = dict(above)
    if jobs:
        dealt = blocks.mapInArrow(deal, "task int, job int, block long, bins binary, labels binary, counts binary")
        subtrees = settle(dealt.repartitionById(max(tasks) + 1, "task").mapInArrow(
            grown, "job int, feature binary, cut binary, left binary, value binary"), "subtrees")
        for row in subtrees.orderBy("job").collect():
            job = jobs[row["job"]]
            below = Nodes(*[np.frombuffer(row[name], kind) for name, kind in (
                ("feature", np.uint16), ("cut", np.uint8), ("left", np.int32), ("value", np.float64))])
            trees[job.tree] = trees[job.tree].graft(job.node, below)
    return trees


def fit_forest(data: DataFrame, estimator: RandomForestRegressor, rows: int, width: int) -> ForestModel:
    """A forest with the estimator's settings on the stored columns `features` and `label`."""
    spark = data.sparkSession
    chosen = Settings.of(estimator, width)
    bounded(spark)
    wanted = min(1.0, max(chosen.bins ** 2, 10_000) / rows)
    seen = data if wanted == 1.0 else data.sample(wanted, seed=estimator.getSeed())
    sample = seen.select(vector_to_array("features").alias("features"), "label").toArrow()
    values = matrix(sample.column("features").combine_chunks(), width)
    cuts = [cut_points(values[:, f], min(chosen.bins, rows)) for f in range(width)]
    middle = float(np.mean(sample.column("label").to_numpy()))
    blocks = stored_blocks(data, rows, cuts, middle)
    # Distinct rows of a tree's sample, and bytes of one of them.
    share = 1.0 - math.exp(-chosen.rate) if chosen.bootstrap else min(1.0, chosen.rate)
    size = width + 9
    most = min(task_rows(spark), int(TASK_BYTES / size / share * chosen.rate))
    at_once = max(1, int(SHUFFLED_BYTES / size / share / rows))
    trees: dict[int, Nodes] = {}
    # Rounds of about equal numbers of trees.
    at_once = math.ceil(chosen.trees / math.ceil(chosen.trees / at_once))
    for first in range(0, chosen.trees, at_once):
        some = range(first, min(first + at_once, chosen.trees))
        trees |= finish(chosen, blocks, grow_tops(chosen, blocks, rows, some, most), most)
    return ForestModel(spark, cuts, middle, [trees[t] for t in range(chosen.trees)], chosen.depth)


class ForestModel(Model):
    """Mean of the trees; bins of a row are found once for all of them."""

    def __init__(self, spark: SparkSession, cuts: list[np.ndarray], middle: float, trees: list[Nodes], depth: int):
        super().__init__()
        self.getNumTrees, self.totalNumNodes = len(trees), sum(len(t.value) for t in trees)
        self._held = spark.sparkContext.broadcast((cuts, middle, trees, depth))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = self._held

        @F.arrow_udf("double")
        def predicted(features: pa.Array) -> pa.Array:
            cuts, middle, trees, depth = held.value
            bins = to_bins(matrix(features, len(cuts)), cuts)
            total = np.zeros(len(bins))
            for tree in trees:
                total += tree.value[tree.places(bins, depth)]
            return pa.array(total / len(trees) + middle)

        return dataset.withColumn("prediction", predicted(vector_to_array("features")))
