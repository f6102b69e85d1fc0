"""Shared prefixes of conversations in z-fast tries.

A node of the prefix tree is a distinct sequence of first turns, named by its
depth and a 128-bit prefix hash: the sum of 64-bit hashes of (turn, place), so
running sums give the hashes of all prefixes of a conversation.

Every task inserts the conversations of its partition, a batch at a time, into
a compacted trie. A compacted node covers the depths ``(top, end]`` of one edge
and stands in a hash table under its handle, the prefix at the two-fattest
depth of that interval (the one divisible by the largest power of two). A fat
binary search over handles finds the node at which a conversation leaves the
trie in a logarithmic number of probes; there the edge is split or a leaf hung
on. Full tries are written out and begun anew: edges are expanded into one row
per depth with the members below, and rows of equal nodes are added up. So a
prefix that a third of all conversations share is one row per trie when rows
are shuffled.

Sums over subtrees need no climbing. If conversation `c` is the smallest
member of a node, it is the smallest of all nodes further down its path, so the
nodes that `c` names are one chain at the end of its path. Suffix sums along
chains give the part inside a chain; a chain's total is added to the nodes of
the path above it, which are no more rows than the turns read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import join_uneven, settle
from blocktrace.llm.mixing import word_count
from blocktrace.plans.ordered import ordered_columns, with_ordinal

#: Turns of one conversation in a row; longer ones go on in another row under their prefix.
SEGMENT = 1024
#: Turns that a trie stores before it is written out.
TRIE_TURNS = 400_000
#: Ids in one piece of a list of members.
PIECE = 2000
KEY = ["depth", "k1", "k2"]
NODE = "depth long, k1 long, k2 long, p1 long, p2 long, words long, n_convs long, conv_id long"
ARROW_NODE = pa.schema([pa.field(part.split()[0], pa.int64()) for part in NODE.split(", ")])

Key = tuple[int, int]


def two_fattest(low: int, high: int) -> int:
    """The number in ``(low, high]`` that the largest power of two divides."""
    bit = (low ^ high).bit_length() - 1
    return (high >> bit) << bit


class ZFastTrie:
    """Compacted trie over sequences of prefix keys; several roots may stand side by side.

    A sequence is its prefix keys at the depths ``base + 1, base + 2, ...``
    below the root key at depth `base`.
    """

    def __init__(self) -> None:
        self.handles: dict[Key, int] = {}
        self.first: dict[Key, int] = {}     # node by the key one below its parent's end
        self.roots: dict[tuple[int, Key], int] = {}
        self.top: list[int] = []
        self.end: list[int] = []
        self.base: list[int] = []
        self.keys: list[list[Key]] = []     # of a sequence that runs through the node
        self.words: list[list[int]] = []
        self.parent: list[int] = []
        self.count: list[int] = []          # members whose sequence ends here
        self.least: list[int] = []
        self.root_key: list[Key] = []
        self.stored = 0

    def _add(self, top: int, end: int, base: int, keys: list[Key], words: list[int], parent: int, root: Key) -> int:
        node = len(self.top)
        for column, value in ((self.top, top), (self.end, end), (self.base, base), (self.keys, keys), (self.words, words),
                              (self.parent, parent), (self.count, 0), (self.least, None), (self.root_key, root)):
            column.append(value)
        if end > top:
            self._name(node)
            self.first[keys[top - base]] = node
        return node

    def _name(self, node: int) -> None:
        """Enter a node under its handle."""
        handle = two_fattest(self.top[node], self.end[node])
        self.handles[self.keys[node][handle - self.base[node] - 1]] = node

    def locate(self, base: int, root: Key, keys: list[Key]) -> int:
        """The node whose edge the sequence leaves or ends in, by fat binary search."""
        node = self.roots.get((base, root))
        if node is None:
            node = self.roots[base, root] = self._add(base, base, base, [], [], -1, root)
        low, high = base, base + len(keys)
        total = high
        while low < high:
            fat = two_fattest(low, high)
            found = self.handles.get(keys[fat - base - 1])
            if found is None:
                high = fat - 1
                continue
            end = self.end[found]
            if end > total or self.keys[found][end - self.base[found] - 1] != keys[end - base - 1]:
                return found
            node, low = found, end
        if low < total:
            return self.first.get(keys[low - base], node)
        return node

    def insert(self, base: int, root: Key, keys: list[Key], words: list[int], count: int, least: int) -> None:
        node = self.locate(base, root, keys)
        total = base + len(keys)
        low, high = self.top[node], min(self.end[node], total)
        held, offset = self.keys[node], self.base[node]
        while low < high:
            middle = (low + high + 1) // 2
            if held[middle - offset - 1] == keys[middle - base - 1]:
                low = middle
            else:
                high = middle - 1
        if low < self.end[node]:
            node = self._split(node, low)
        if low < total:
            node = self._add(low, total, base, keys, words, node, root)
            self.stored += len(keys)
        self.count[node] += count
        self.least[node] = least if self.least[node] is None else min(self.least[node], least)

    def _split(self, node: int, depth: int) -> int:
        """Cut an edge at a depth; returns the new upper node."""
        top, keys, base = self.top[node], self.keys[node], self.base[node]
        del self.handles[keys[two_fattest(top, self.end[node]) - base - 1]]
        upper = self._add(top, depth, base, keys, self.words[node], self.parent[node], self.root_key[node])
        self.top[node], self.parent[node] = depth, upper
        self._name(node)
        self.first[keys[depth - base]] = node
        return upper

    def expand(self) -> pa.RecordBatch:
        """One row per depth of every edge, with the members below it."""
        order = sorted(range(len(self.top)), key=self.end.__getitem__, reverse=True)
        for node in order:
            above = self.parent[node]
            if above >= 0:
                self.count[above] += self.count[node]
                if self.least[above] is None or self.least[node] < self.least[above]:
                    self.least[above] = self.least[node]
        depth, own, over, words, count, least = [], [], [], [], [], []
        for node in order:
            top, end, base = self.top[node], self.end[node], self.base[node]
            if top == end:
                continue
            keys = self.keys[node][top - base:end - base]
            depth.extend(range(top + 1, end + 1))
            own.extend(keys)
            over.append(self.keys[node][top - base - 1] if top > base else self.root_key[node])
            over.extend(keys[:-1])
            words.extend(self.words[node][top - base:end - base])
            count.extend([self.count[node]] * (end - top))
            least.extend([self.least[node]] * (end - top))
        columns = [depth, [k[0] for k in own], [k[1] for k in own], [k[0] for k in over], [k[1] for k in over],
                   words, count, least]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=ARROW_NODE)


def _tries(batches: Iterator[pa.RecordBatch], trie_turns: int) -> Iterator[pa.RecordBatch]:
    """Segments of conversations into tries, tries into rows of nodes."""
    trie = ZFastTrie()
    for batch in batches:
        lists = batch.column("path")
        edges, turns = lists.offsets.to_numpy().tolist(), lists.values
        depth, k1, k2, p1, p2, words = (turns.field(n).to_numpy() for n in ("depth", "k1", "k2", "p1", "p2", "words"))
        # Equal segments of a batch are inserted once.
        fresh: dict[tuple, list] = {}
        for conv_id, start, stop in zip(batch.column("conv_id").to_pylist(), edges, edges[1:]):
            same = tuple(int(x) for x in (depth[start], p1[start], p2[start], stop - start, k1[stop - 1], k2[stop - 1]))
            held = fresh.setdefault(same, [0, conv_id, start])
            held[0] += 1
            held[1] = min(held[1], conv_id)
        for (first, *root, size, _, _), (count, least, start) in fresh.items():
            part = slice(start, start + size)
            trie.insert(first - 1, tuple(root), list(zip(k1[part].tolist(), k2[part].tolist())), words[part].tolist(),
                        count, least)
            if trie.stored > trie_turns:
                yield trie.expand()
                trie = ZFastTrie()
    yield trie.expand()


def _key(total: Column) -> Column:
    """A sum of 64-bit hashes modulo 2^64 as a long."""
    span, half = (F.lit(str(2 ** bits)).cast("decimal(38,0)") for bits in (64, 63))
    return (F.pmod(total, span) - half).cast("long")


def _root() -> list[Column]:
    return [_key(F.lit(0).cast("decimal(38,0)")).alias(k) for k in ("k1", "k2")]


def rebuilt_turns(conversations: DataFrame, every: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (`conv_id`, `place` from 0, `digest`, `words`), and all ids."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"),
        word_count(text).alias("words"), F.monotonically_increasing_id().alias("_row"))
    own = settle(with_ordinal(turns, ["conv_id"], ["turn", "digest", "_row"], "place")
                 .select("conv_id", "place", "digest", "words"), "turns")
    base = F.col("conv_id") - F.col("conv_id") % every
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (shared + 1)
    ids = settle(own.filter("place = 0").select("conv_id", base.alias("base"), head.alias("head")), "conversations")
    heads = own.filter((F.col("conv_id") % every == 0) & (F.col("place") < shared)).withColumnRenamed("conv_id", "base")
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("_held"))
    given = (ids.join(heads, "base").filter("place < head").select("conv_id", "place", "digest", "words"))
    taken = F.least("head", F.coalesce("_held", F.lit(0)))
    kept = (own.withColumns({"base": base, "head": head}).filter("place >= head").join(sizes, "base", "left")
            .select("conv_id", (F.col("place") - F.col("head") + taken).alias("place"), "digest", "words"))
    return given.union(kept), ids.select("conv_id")


def _paths(turns: DataFrame) -> DataFrame:
    """Prefix keys: `conv_id`, `depth`, key (`k1`, `k2`), key of the prefix one shorter (`p1`, `p2`), `words`."""
    hashes = {f"_h{i}": F.xxhash64(F.lit(i), "digest", "place").cast("decimal(38,0)") for i in (1, 2)}
    summed = ordered_columns(turns.withColumns(hashes), ["conv_id"], ["place"],
                             running={f"_s{i}": F.col(f"_h{i}") for i in (1, 2)})
    return settle(summed.select(
        "conv_id", (F.col("place") + 1).alias("depth"),
        *[_key(F.col(f"_s{i}") + F.col(f"_h{i}")).alias(f"k{i}") for i in (1, 2)],
        *[_key(F.col(f"_s{i}").cast("decimal(38,0)")).alias(f"p{i}") for i in (1, 2)], "words"), "paths")


def _members(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids (`conv_id`) under each key, joined by commas.

    Ids are joined in pieces of a range partitioning; the pieces of a key then
    pass through one hash in their order, one after the other.
    """
    from pyspark.sql import types as T

    names = [*KEY, "first", "text"]
    piece = T.StructType([*[T.StructField(n, T.LongType()) for n in names[:-1]], T.StructField("text", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            key, held = None, []
            for *now, conv_id in zip(*(batch.column(c).to_pylist() for c in [*KEY, "conv_id"])):
                if now != key or len(held) == PIECE:
                    if held:
                        rows.append([*key, held[0], ",".join(map(str, held))])
                    key, held = now, []
                held.append(conv_id)
            if held:
                rows.append([*key, held[0], ",".join(map(str, held))])
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())],
                                  names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            rows = []
            for *now, text in zip(*(batch.column(c).to_pylist() for c in [*KEY, "text"])):
                if now == key:
                    running.update(b"," + text.encode())
                    continue
                if key is not None:
                    rows.append([*key, running.hexdigest()])
                key, running = now, hashlib.sha256(text.encode())
            yield out(rows)
        if key is not None:
            yield out([[*key, running.hexdigest()]])

    def out(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                               names=[*KEY, "ends_sha256"])

    pieces = (ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
              .mapInArrow(join, piece))
    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_tree(conversations: DataFrame, *, every: int = 20, shared: int = 3, segment: int = SEGMENT,
                trie_turns: int = TRIE_TURNS) -> DataFrame:
    """All shared and single prefixes of the rebuilt conversations, one row per node.

    Conversation `c` begins with the first ``crc32(c) % (shared + 1)`` turns of
    conversation ``c - c % every`` and goes on with its own. Returns `conv_id`
    (smallest member), `depth`, `parent_conv_id` (null at the root),
    `n_convs`, `n_children`, `n_leaves`, `saved_tokens` and `ends_sha256`.

    Turns are ordered by `turn`, null first; equal turn numbers by the hash of
    role and text, and every repeated row is a turn. Null role and text are
    empty. Rows with a null id belong to no conversation. An empty table gives
    no rows, not even a root. `segment` and `trie_turns` bound rows and tries.
    """
    turns, ids = rebuilt_turns(conversations, every, shared)
    paths = _paths(turns)
    path = F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "p1", "p2", "words"))).alias("path")
    parts = (paths.groupBy("conv_id", F.floor((F.col("depth") - 1) / segment).alias("_part")).agg(path)
             .select("conv_id", "path").mapInArrow(partial(_tries, trie_turns=trie_turns), NODE))
    found = settle(parts.groupBy(*KEY).agg(
        F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")), "nodes")

    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(found.join(children, KEY, "left").select(
        *found.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("_leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("_saved")), "nodes")

    chains = settle(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("_top"), F.sum("_leaf").alias("_leaves"), F.sum("_saved").alias("_total")), "chains")
    inside = ordered_columns(nodes, ["conv_id"], ["depth"], running={"_before": F.col("_saved")})
    above = (paths.select("conv_id", *KEY).join(chains, "conv_id").filter("depth < _top").groupBy(*KEY)
             .agg(F.sum("_leaves").alias("_more_leaves"), F.sum("_total").alias("_more_saved")))
    summed = inside.join(chains, "conv_id").join(above, KEY, "left").select(
        *KEY, "p1", "p2", "conv_id", "n_convs", "n_children", (F.col("depth") == F.col("_top")).alias("_is_top"),
        (F.col("_leaves") + F.coalesce("_more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("_total") - F.col("_before") + F.coalesce("_more_saved", F.lit(0))).alias("saved_tokens"))
    tree = settle(summed, "tree")

    # Inside a chain the parent has the same smallest member; above its top another one.
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("_parent"), F.col("n_children").alias("_n"))
    tops = join_uneven(tree.filter("_is_top AND depth > 1"), parents, ["depth", "p1", "p2"], "_n")
    below = tree.filter("NOT _is_top").withColumn("_parent", F.col("conv_id"))
    size, smallest = ids.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    highest = tree.filter("_is_top AND depth = 1").withColumn("_parent", F.lit(smallest).cast("long"))
    columns = [*KEY, "conv_id", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
               "saved_tokens"]
    inner = tops.select(*columns).union(below.select(*columns)).union(highest.select(*columns))
    leaves, saved = chains.agg(F.sum("_leaves"), F.sum("_total")).first()
    whole = (0, smallest, None, size, tree.filter("depth = 1").count(), leaves or 1, saved or 0)
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = ids.limit(1).select(*[F.lit(v).cast("long").alias(n) for v, n in zip(whole, names)], *_root())

    last = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("_end"))
    ends = ids.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("_end.depth", F.lit(0)).cast("long").alias("depth"),
        *[F.coalesce(f"_end.{k}", root_key).alias(k) for k, root_key in zip(("k1", "k2"), _root())])
    empty = hashlib.sha256(b"").hexdigest()
    return inner.unionByName(root).join(_members(ends), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
         md5(concat(md5(coalesce(role, '')), md5(coalesce(text, '')))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place
  FROM turns),
heads AS (
  SELECT conv_id, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
           lambda crc, byte: list_reduce(
             [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS head
  FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT h.conv_id, o.place, o.digest, o.words
  FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.place < h.head
  UNION ALL
  SELECT h.conv_id, 4 + o.place, o.digest, o.words
  FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.place >= h.head),
paths AS (
  SELECT h.conv_id, coalesce(list(r.digest ORDER BY r.place) FILTER (r.digest IS NOT NULL), []) AS digests,
         coalesce(list(r.words ORDER BY r.place) FILTER (r.digest IS NOT NULL), []) AS words
  FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
prefixes AS (
  SELECT conv_id, depth, len(digests) AS size, md5(array_to_string(digests[1:depth], ',')) AS prefix,
         md5(array_to_string(digests[1:depth - 1], ',')) AS above,
         CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words
  FROM (SELECT *, unnest(range(0, len(digests) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs,
         any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                                             FILTER (depth = size), '') AS ends
  FROM prefixes GROUP BY depth, prefix),
children AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
weighed AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, (n.n_convs - 1) * n.words AS saved
  FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.prefix = c.prefix),
sums AS (
  SELECT p.depth, p.prefix, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM weighed w JOIN prefixes p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY ALL)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM weighed w JOIN sums s ON s.depth = w.depth AND s.prefix = w.prefix
LEFT JOIN nodes u ON u.depth = w.depth - 1 AND u.prefix = w.above AND w.depth > 0
"""
