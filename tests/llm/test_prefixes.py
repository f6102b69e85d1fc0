"""Prefix trees of conversations against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from blocktrace.llm import prefixes
from blocktrace.llm.prefixes import ZFastTrie, two_fattest

SCHEMA = "conv_id long, turn long, role string, text string, depth string, place int"


def plain_tree(rows):
    """{path: row} by walking every rebuilt conversation."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            both = (hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()
            own[conv_id].append(((turn is not None, turn or 0), hashlib.md5(both).hexdigest(), (role, text)))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, held in members.items():
        words = len(path[-1][1].split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * words
    return sorted((min(held), len(path), min(members[path[:-1]]) if path else -1, len(held), children[path], leaves[path],
                   saved[path], hashlib.sha256(",".join(str(c) for c in sorted(held) if len(rebuilt[c]) == len(path))
                                               .encode()).hexdigest()) for path, held in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"segment": 2, "trie_turns": 5}])
def test_tree_matches_plain_python(spark, options):
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 90), 1001, 4000, 4003]:
        size = draw.choice([1, 2, 2, 3, 5, 9]) if c != 7 else 60
        rows += [(c, t, draw.choice(["user", "tool"]), draw.choice(["a b", "a b c", " "])) for t in range(size)]
    # One conversation under many ids, repeated rows, nulls, tied turns, no id.
    rows += [(c, t, "user", f"w {t}") for c in range(200, 260) for t in range(4)]
    rows += [(300, None, None, None), (300, 0, "user", None), (300, 0, None, "x"), (300, 0, None, "x"),
             (None, 0, "user", "nobody"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert rows_of(prefixes.prefix_tree(table, **options)) == plain_tree(rows)


def test_empty_and_turnless(spark):
    empty = prefixes.prefix_tree(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and len(empty.columns) == 8
    # Each has one turn of its own, all of it replaced by the head of an absent conversation.
    ids = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:2]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = rows_of(prefixes.prefix_tree(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)))
    joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == [(ids[0], 0, -1, 2, 0, 1, 0, joined)] == plain_tree(rows)


def test_trie_counts_every_prefix():
    assert [two_fattest(a, b) for a, b in ((0, 1), (0, 7), (4, 7), (5, 6), (3, 9))] == [1, 4, 6, 6, 8]
    draw = random.Random(8)
    trie, want, least = ZFastTrie(), Counter(), {}
    for c in range(600):
        turns = [draw.randrange(2) for _ in range(draw.choice([1, 2, 5, 9, 30]))]
        keys, words = [], []
        for d in range(1, len(turns) + 1):
            digest = hashlib.md5(str(turns[:d]).encode()).digest()
            keys.append((int.from_bytes(digest[:7], "big"), int.from_bytes(digest[7:14], "big")))
            words.append(turns[d - 1])
            want[d, keys[-1]] += 1
            least.setdefault((d, keys[-1]), c)
        trie.insert(0, (0, 0), keys, words, 1, c)
        # Every compacted node is found under its handle.
        assert all(trie.top[n] < two_fattest(trie.top[n], trie.end[n]) <= trie.end[n] for n in trie.handles.values())
    found = trie.expand().to_pylist()
    assert {(r["depth"], (r["k1"], r["k2"])): (r["n_convs"], r["conv_id"]) for r in found} == {
        k: (n, least[k]) for k, n in want.items()}
    assert len(found) == len(want)


def test_uneven_join_keeps_all_rows(spark):
    from blocktrace.llm.common import join_uneven

    rows = spark.createDataFrame([(0, i) for i in range(3000)] + [(i, i) for i in range(1, 4000)], "k long, v long")
    side = spark.createDataFrame([(0, 3000, "hot")] + [(i, 1, "cold") for i in range(1, 3990)], "k long, n long, kind string")
    joined = join_uneven(rows, side, ["k"], "n")
    assert joined.columns == ["k", "v", "kind"] and joined.count() == 3000 + 3989
    assert joined.filter("kind = 'hot'").count() == 3000
