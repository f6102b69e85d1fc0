"""Near copies by an inverted join of MinHash signature coordinates.

A signature has `coordinates` values; two documents of similarity J agree at
each with probability J. Documents are posted under their (coordinate, value)
pairs, and a pair of documents is a candidate if it collides `matches` times.

* Prefix: two signatures with `matches` common pairs of K share one among the
  rarest `K - matches + 1` pairs of each. Only those are joined, so values that
  a common passage brings into many signatures are skipped.
* Skip: pairs that nobody else has are dropped first, and a document that keeps
  fewer than `matches` shared pairs leaves at once. The long lists outside the
  prefix are never merged: a candidate's collisions are counted by comparing
  the two signatures.
* Confirmation is exact, on full shingle sets.

Components only need enough links to be connected. Each posting list is first
linked to two hubs, the member whose values are the most common ones and a
random one, which is linear in its length and joins most members of a group of
copies. After that, only members of different components are compared with
each other. Lists of up to ``SHORT_LIST`` members give their pairs, which stays
in proportion to the postings. The members of longer lists meet by the same
prefix rule on their shingle sets: two sets with an overlap of `t` share one
among the rarest `n - t + 1` shingles of each, so a copy with many edits of its
own meets nobody. Equal sets are one class from the start.

With the default 64 coordinates and 36 matches, a pair at exactly 0.8 is missed
with a probability of about 1e-6 (binomial tail), a closer one more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import bounded, hashed_words, mix64, settle, slices, without
from blocktrace.llm.graph import components

#: Members of a posting list whose pairs are compared one by one.
SHORT_LIST = 40
#: Longest text in characters whose shingles a task remembers for its next pairs.
REMEMBERED = 50_000
SKETCH = "doc_id long, n_shingles long, set_key binary, signature array<long>"


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased.

    A text with fewer words is one shingle; without words there is none.
    """
    hashes = hashed_words(text.encode().lower())
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    count = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        joined = np.full(count, width, dtype=np.uint64)
        for j in range(width):
            joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + count]
    return np.unique(mix64(joined))


@lru_cache(maxsize=4)
def _multipliers(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:coordinates] | np.uint64(1), seeds[coordinates:]


def signature(values: np.ndarray, coordinates: int) -> np.ndarray:
    """One 64-bit number for each (coordinate, smallest value) pair."""
    factors, shifts = _multipliers(coordinates)
    low = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(values), 4096):
            part = values[start:start + 4096]
            low = np.minimum(low, (part[:, None] * factors[None, :] + shifts[None, :]).min(axis=0))
        return mix64(low ^ (factors * np.uint64(0x2545F4914F6CDD1D))).view(np.int64)


def sketch(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """Set size, set key and signature of every row; the last two are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches):
            sizes, keys, signatures = [], [], []
            for text in part.column("text").to_pylist():
                values = shingles(text or "", words)
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                signatures.append(signature(values, coordinates) if len(values) else None)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signatures, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "signature"])

    return bounded(docs).select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SKETCH)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Texts of the rows whose id is among `nodes`, which hold each `node` once."""
    # As a table of its own the side has a known size: small, it is broadcast, and no text moves.
    return settle(docs.select(docs["doc_id"].cast("long").alias("node"), "text")
                  .join(settle(nodes, "nodes"), "node"), "texts")


def _confirmed(pairs: DataFrame, signed: DataFrame, docs: DataFrame, words: int, percent: int,
               matches: int) -> DataFrame:
    """The pairs (`a`, `b`) that collide often enough and whose full sets are similar enough.

    Only texts of pairs that collide often enough are read.
    """
    def side(name: str) -> DataFrame:
        return signed.select(F.col("node").alias(name), F.col("n_shingles").alias(f"_n_{name}"),
                             F.col("set_key").alias(f"key_{name}"), F.col("signature").alias(f"_s_{name}"))

    alike = (pairs.join(side("a"), "a").join(side("b"), "b")
             .filter(100 * F.least("_n_a", "_n_b") >= percent * F.greatest("_n_a", "_n_b"))
             .filter(F.size(F.array_intersect("_s_a", "_s_b")) >= matches).select("a", "b", "key_a", "key_b"))
    alike = settle(alike, "candidates")
    read = _texts(docs, alike.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    first, second = (read.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}")) for name in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        short = lru_cache(maxsize=64)(lambda text: shingles(text, words))

        def values(text: str) -> np.ndarray:
            # Remembered for hubs, but not beyond a bounded size.
            return short(text) if len(text) <= REMEMBERED else shingles(text, words)

        for part in slices(batches, "text_a", "text_b"):
            kept = []
            columns = [part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b", "key_a", "key_b")]
            for a, b, text_a, text_b, key_a, key_b in zip(*columns):
                x, y = values(text_a or ""), values(text_b or "")
                # Of rows that share an id only the one with the sketched set speaks.
                if xxhash.xxh3_128_digest(x.tobytes()) != key_a or xxhash.xxh3_128_digest(y.tobytes()) != key_b:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append((a, b))
            yield pa.record_batch([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return bounded(alike.join(first, "a").join(second, "b")).mapInArrow(run, "a long, b long")


def _rarest(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rarest shingles of each node, as many as any partner could need.

    Takes `node`, `_group` and `set_key`. Returns `node`, `_group`, `n` (set
    size), `shingle` and its `place` (from 1) in the order of rising frequency
    among all `nodes`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches):
            columns = [part.column(c).to_pylist() for c in ("node", "_group", "set_key", "text")]
            for node, group, key, text in zip(*columns):
                values = shingles(text or "", words)
                # Of rows that share an id only the one with the sketched set speaks.
                if xxhash.xxh3_128_digest(values.tobytes()) != key:
                    continue
                yield pa.record_batch([pa.array(np.full(len(values), node)), pa.array(np.full(len(values), group)),
                                       pa.array(values.view(np.int64))], names=["node", "_group", "shingle"])

    sets = settle(_texts(docs, nodes).mapInArrow(run, "node long, _group long, shingle long").distinct(), "sets")
    counts = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("_held"))
    ordered = (sets.join(counts, "shingle").groupBy("node", "_group")
               .agg(F.array_sort(F.collect_list(F.struct("_held", "shingle"))).alias("_all"))
               .withColumn("n", F.size("_all")))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return (ordered.select("node", "_group", "n", F.posexplode(F.slice("_all", F.lit(1), most.cast("int"))))
            .filter("col._held > 1")
            .select("node", "_group", "n", (F.col("pos") + 1).alias("place"), F.col("col.shingle").alias("shingle")))


def _crossing(ranks: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different groups that share a shingle early enough in both orders."""
    other = ranks.toDF("_node", "_other", "_size", "_place", "shingle")
    overlap = F.ceil(percent * (F.col("n") + F.col("_size")) / (100 + percent))
    return (ranks.join(other, "shingle")
            .filter((F.col("node") < F.col("_node")) & (F.col("_group") != F.col("_other"))
                    & (F.col("place") <= F.col("n") - overlap + 1)
                    & (F.col("_place") <= F.col("_size") - overlap + 1))
            .select(F.col("node").alias("a"), F.col("_node").alias("b")))


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, coordinates: int = 64,
                    matches: int = 36) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word shingles of at least `percent`.

    Returns one row per row of `docs`: `doc_id`, `n_shingles` (size of its
    set), `component_id` (smallest id reachable over links) and `kept` (true
    for that one). Texts without words have no links and are kept. Rows with a
    null id have a null component and are kept. Rows that repeat an id belong
    to its component; if their texts differ, the one with the smallest set key
    speaks for the id. An empty table gives no rows.
    """
    sketched = settle(sketch(docs, words, coordinates), "sketches")
    classes = (sketched.filter("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key")
               .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                    F.first("signature").alias("signature")))
    classes = settle(classes, "classes")
    postings = classes.select("node", F.explode("signature").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("_held")).filter("_held > 1")
    ranked = (postings.join(shared, "key").groupBy("node")
              .agg(F.array_sort(F.collect_list(F.struct("_held", "key"))).alias("_keys"),
                   F.sum("_held").alias("_common"))
              .filter(F.size("_keys") >= matches))
    ranked = settle(ranked.select("node", "_common", F.slice(
        "_keys.key", F.lit(1), F.size("_keys") - matches + 1).alias("_rare")), "prefixes")
    prefix = ranked.select("node", "_common", F.explode("_rare").alias("key"))
    # From here on only documents with enough shared pairs matter: their signatures are read once.
    signed = (classes.join(ranked.select("node"), "node").groupBy("node")
              .agg(F.min(F.struct("set_key", "n_shingles", "signature")).alias("_")).select("node", "_.*"))
    signed = settle(signed, "signatures")

    chance = F.xxhash64("node")
    orders = [F.max(F.struct("_common", chance, "node"))["node"], F.min(F.struct(chance, "node"))["node"]]
    hubs = prefix.groupBy("key").agg(F.array_distinct(F.array(*orders)).alias("_hubs"),
                                     F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    spokes = (prefix.join(hubs, "key").select("node", F.explode("_hubs").alias("_hub")).filter("node <> _hub")
              .select(*_ordered(F.col("node"), F.col("_hub"))).distinct())
    links = settle(_confirmed(spokes, signed, docs, words, percent, matches), "links")
    joined = components(links)

    # What the hubs didn't connect: pairs of different components under one key.
    member = F.coalesce("component", prefix["node"]).alias("_group")
    grouped = prefix.join(joined, prefix["node"] == joined["node"], "left").select(prefix["node"], "key", member)
    mixed = (grouped.groupBy("key").agg(F.min("_group").alias("_low"), F.max("_group").alias("_high"),
                                        F.count(F.lit(1)).alias("_n"))
             .filter("_low < _high").select("key", (F.col("_n") > SHORT_LIST).alias("_long")))
    rest = settle(grouped.join(mixed, "key"), "unconnected")
    short = rest.filter(~F.col("_long")).select("key", "node", "_group")
    long = rest.filter("_long").select("node", "_group").distinct().join(signed.select("node", "set_key"), "node")
    ranks = settle(_rarest(long, docs, words, percent), "rarest")
    crossing = (short.join(short.toDF("key", "_node", "_other"), "key")
                .filter((F.col("node") < F.col("_node")) & (F.col("_group") != F.col("_other")))
                .select(F.col("node").alias("a"), F.col("_node").alias("b"))
                .union(_crossing(ranks, percent)).distinct())
    late = _confirmed(crossing, signed, docs, words, percent, matches)
    final = components(links.union(settle(late, "late-links")))

    found = (classes.join(final, "node", "left")
             .select("set_key", F.coalesce("component", "node").alias("_component")))
    return sketched.join(found, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("_component", "doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs` that ``near_duplicates`` keeps; all rows with a null id stay."""
    return without(docs, near_duplicates(docs, **options).filter("NOT kept").select("doc_id"))
