"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets a label, good or bad. A line's score uses its own
features and those of the lines before and after it; transition weights tie
neighbouring labels. Forward-backward gives the marginal of `good` for each
line, the marginals weighted by line length give one number per document, and a
logistic curve fitted on the same sample turns it into a probability.

Only documents are labelled, so training alternates: at first all lines of a bad
document are bad; then its lines that the field takes for good become good,
but for the worst one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import bounded, remainder, slices, texts

#: Labelled documents that the field is fitted on, chosen by a hash of their id.
TRAINING_DOCUMENTS = 2500
#: Rounds of relabelling, and gradient steps in each.
ROUNDS, STEPS = 3, 40
SYMBOLS = frozenset("#*$%&|<>@^~_=+{}[]\\/")
RATES = 6
WIDTH = 1 + 3 * RATES + 6


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line with a word, and the line's length in characters."""
    rows, lengths, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        count, length = len(words), len(line)
        rates = (sum(map(line.count, SYMBOLS)) / length,
                 sum(map(str.isupper, words)) / count,
                 sum(map(line.count, "0123456789")) / length,
                 sum(map(eq, words, words[1:])) / count,
                 line.count("|") / count,
                 line.count("!") / count)
        row = [1.0]
        for rate in rates:
            row += [min(rate, 1.0), float(rate > 0.02), float(rate > 0.2)]
        letters = sum(map(len, words))
        row += [float(count < 4), min(np.log1p(count) / 6, 1.5), min(letters / count / 10, 2.0),
                len(set(words)) / count, float(line.rstrip()[-1:] in ".!?"), float(line in seen)]
        seen.add(line)
        rows.append(row)
        lengths.append(length)
    return np.array(rows, dtype=np.float64).reshape(-1, WIDTH), np.array(lengths, dtype=np.float64)


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and of the line after (zeros at the ends)."""
    edge = np.zeros((1, rows.shape[1]))
    return np.hstack([rows, np.vstack([edge, rows[:-1]]), np.vstack([rows[1:], edge])])


@dataclass
class Chains:
    """Lines of several documents, one after the other."""

    rows: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, np.ndarray]]) -> Chains:
        sizes = np.array([len(rows) for rows, _ in found], dtype=np.int64)
        blocks = [with_neighbours(rows) for rows, _ in found if len(rows)]
        return cls(np.vstack(blocks) if blocks else np.zeros((0, 3 * WIDTH)),
                   np.concatenate([lengths for _, lengths in found] or [np.zeros(0)]), sizes)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def marginals(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of `good` for every line, and the expected number of each transition.

    `scores` are the log odds of good by the features; all chains step together.
    """
    total = len(scores)
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    clipped = np.clip(scores, -50, 50)
    good = 1 / (1 + np.exp(-clipped))
    emit = np.stack([1 - good, good], axis=1) + 1e-30
    step = np.exp(transitions)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
    forward, backward = np.empty((total, 2)), np.ones((total, 2))
    at = first[:active[0]]
    forward[at] = emit[at] / emit[at].sum(axis=1, keepdims=True)
    for t in range(1, len(active)):
        at = first[:active[t]] + t
        value = (forward[at - 1] @ step) * emit[at]
        forward[at] = value / value.sum(axis=1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = first[:active[t + 1]] + t
        value = (backward[at + 1] * emit[at + 1]) @ step.T
        backward[at] = value / value.sum(axis=1, keepdims=True)
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    last = np.zeros(total, dtype=bool)
    last[(np.cumsum(sizes) - 1)[sizes > 0]] = True
    here = np.flatnonzero(~last)
    pairs = forward[here][:, :, None] * step[None] * (emit * backward)[here + 1][:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pairs.sum(axis=0)


@dataclass
class Field:
    """Weights of the chain, and of the curve over the weighted marginal."""

    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    offset: float

    def weighted(self, chains: Chains) -> np.ndarray:
        """Length-weighted marginal of `good` of each document, 0 without lines."""
        good, _ = marginals(chains.rows @ self.weights, chains.sizes, self.transitions)
        owner, count = chains.owner, len(chains.sizes)
        whole = np.bincount(owner, chains.lengths, count)
        part = np.bincount(owner, chains.lengths * good, count)
        return np.divide(part, whole, out=np.zeros(count), where=whole > 0)

    def score(self, chains: Chains) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.weighted(chains) + self.offset, -500, 500)))


def fit(chains: Chains, labels: np.ndarray) -> Field:
    """Fit the field on documents with labels 0 and 1. Without documents of both kinds the score is their label."""
    field = Field(np.zeros(3 * WIDTH), np.zeros((2, 2)), 0.0, 0.0)
    if not len(labels) or labels.min() == labels.max():
        kind = labels[0] if len(labels) else 1
        field.offset = 20.0 * (2 * kind - 1)
        return field
    owner = chains.owner
    target = labels[owner].astype(np.float64)
    for _ in range(ROUNDS):
        _ascend(field, chains, target)
        good, _ = marginals(chains.rows @ field.weights, chains.sizes, field.transitions)
        worst = np.full(len(labels), np.inf)
        np.minimum.at(worst, owner, good)
        target = np.where(labels[owner] == 1, 1.0, ((good > 0.5) & (good > worst[owner])).astype(float))
    _calibrate(field, field.weighted(chains), labels)
    return field


def _ascend(field: Field, chains: Chains, target: np.ndarray) -> None:
    """Gradient steps with momentum and scaling on the penalised likelihood."""
    inside = np.flatnonzero(np.diff(chains.owner) == 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[inside].astype(int), target[inside + 1].astype(int)), 1)
    total = len(target)
    parts = [field.weights, field.transitions]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for step in range(1, STEPS + 1):
        good, pairs = marginals(chains.rows @ field.weights, chains.sizes, field.transitions)
        slopes = [chains.rows.T @ (target - good) / total - 1e-4 * field.weights,
                  (seen - pairs) / total - 1e-4 * field.transitions]
        for value, slope, (mean, square) in zip(parts, slopes, moments):
            mean += 0.1 * (slope - mean)
            square += 0.001 * (slope * slope - square)
            value += 0.15 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)


def _calibrate(field: Field, values: np.ndarray, labels: np.ndarray) -> None:
    """Logistic curve by Newton steps, with a small penalty."""
    design = np.stack([values, np.ones_like(values)], axis=1)
    answer = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ answer, -30, 30)))
        slope = design.T @ (labels - p) - 1e-2 * answer
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        answer = answer + np.clip(np.linalg.solve(curve, slope), -5, 5)
    field.slope, field.offset = map(float, answer)


def training_sample(docs: DataFrame, labels: DataFrame, documents: int = TRAINING_DOCUMENTS) -> tuple[Chains, np.ndarray]:
    """Line features of at most `documents` labelled documents outside the held-out fifth."""
    chosen = (labels.select("doc_id", "quality").dropna()
              .filter(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [line_features(text) for text in texts(part)]
            yield pa.record_batch(
                [part.column("doc_id"), part.column("quality"), pa.array([r.ravel() for r, _ in found], pa.list_(pa.float64())),
                 pa.array([n for _, n in found], pa.list_(pa.float64()))],
                names=["doc_id", "quality", "rows", "lengths"])

    # Bounded by `documents`, so it may be sent to every executor.
    read = bounded(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.col("doc_id").cast("long"), F.col("quality").cast("long"), "text")
    sample = read.mapInArrow(run, "doc_id long, quality long, rows array<double>, lengths array<double>") \
        .toArrow().sort_by("doc_id").to_pydict()
    found = [(np.array(rows).reshape(-1, WIDTH), np.array(lengths)) for rows, lengths
             in zip(sample["rows"], sample["lengths"])]
    return Chains.of(found), (np.array(sample["quality"], dtype=np.int64) > 0).astype(np.int64)


def score_quality(docs: DataFrame, labels: DataFrame, *, documents: int = TRAINING_DOCUMENTS,
                  threshold: float = 0.3) -> DataFrame:
    """Quality of every document.

    Returns one row per row of `docs`: `doc_id`, `held_out` (crc32 of the id
    modulo 5 is 0, null ids are not), `score` (0 to 1, higher is better),
    `predicted` (1 from `threshold` on), `good_share` (length-weighted marginal)
    and `n_lines` (lines with a word). Null and wordless texts have a share of
    0. Unlabelled and repeated rows are scored like all others; of several
    labels for an id the higher one counts. An empty table gives no rows.
    """
    field = fit(*training_sample(docs, labels, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            chains = Chains.of([line_features(text) for text in texts(part)])
            score = field.score(chains)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("held_out"), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32)), pa.array(field.weighted(chains)),
                 pa.array(chains.sizes)],
                names=["doc_id", "held_out", "score", "predicted", "good_share", "n_lines"])

    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return bounded(docs).select("doc_id", held_out, "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, "
             "good_share double, n_lines long")


def good_documents(docs: DataFrame, labels: DataFrame, *, documents: int = TRAINING_DOCUMENTS,
                   threshold: float = 0.3) -> DataFrame:
    """Rows of `docs` that the field doesn't reject, each judged by its own text; nothing is shuffled."""
    field = fit(*training_sample(docs, labels, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = field.score(Chains.of([line_features(text) for text in texts(part)]))
            yield part.filter(pa.array(score >= threshold))

    return bounded(docs).mapInArrow(run, docs.schema)
