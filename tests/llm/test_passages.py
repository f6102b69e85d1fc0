"""Sparse suffixes against plain Python: matches on one side only, repeated ids, chunk edges."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from blocktrace.llm import passages


def prose(draw, n):
    return ["".join(draw.choices("abcdefgh", k=4)) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def covered(rows, passage):
    """Covered words of each (id, text), and the smallest id for each of its passages."""
    holders, first = defaultdict(set), {}
    for i, text in set(rows):
        w = text.split()
        for s in range(len(w) - passage + 1):
            key = tuple(w[s:s + passage])
            holders[key].add(text)
            first[key] = min(first.get(key, i), i)
    words = defaultdict(set)
    for i, text in set(rows):
        w = text.split()
        for s in range(len(w) - passage + 1):
            if len(holders[tuple(w[s:s + passage])]) > 1:
                words[i].update((text, s + k) for k in range(passage))
    return words, first


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_matches(spark, seed):
    """Short alphabets of parts: each text matches different texts to the left and to the right of one gram."""
    draw = random.Random(seed)
    parts = [prose(draw, draw.choice((7, 10, 26, 40))) for _ in range(9)]
    rows = [(i, " ".join(w for _ in range(6) for w in draw.choice(parts))) for i in range(30)]
    rows += [(30, "z " * 400), (31, "z " * 300 + "y"), (32, f"{'w' * 5000} {rows[0][1]}"), (33, f"{'w' * 5000} {rows[0][1]}x")]
    want, first = covered(rows, 50)
    unique = len({t for _, t in rows}) == len(rows)
    assert unique
    got = defaultdict(set)
    for r in passages.repeated_passages(table(spark, rows)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == {i: {k for _, k in places} for i, places in want.items()}
    left = {r.doc_id: r.text.split() for r in passages.without_repeats(table(spark, rows)).collect()}
    for i, text in rows:
        w = text.split()
        cut = {s + k for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < i for k in range(50)}
        assert left.get(i, []) == [x for k, x in enumerate(w) if k not in cut]


def test_match_away_from_the_neighbour(spark):
    """The longest common prefix is with a text that differs to the left; the match has a shorter one."""
    draw = random.Random(4)
    gram, mid, right, other = prose(draw, 20), prose(draw, 15), prose(draw, 60), prose(draw, 60)
    left = prose(draw, 15)
    rows = [(1, " ".join(prose(draw, 40) + left + gram + mid + right)),
            (2, " ".join(prose(draw, 40) + prose(draw, 15) + gram + mid + right)),
            (3, " ".join(prose(draw, 40) + left + gram + mid + other))]
    got = {r.doc_id: (r.start_word, r.end_word, r.first_id) for r in passages.repeated_passages(table(spark, rows)).collect()}
    assert got == {1: (40, 150, 1), 2: (55, 150, 1), 3: (40, 90, 1)}


def test_repeated_ids_are_told_apart(spark):
    draw = random.Random(6)
    a, b = prose(draw, 60), prose(draw, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, "x " + " ".join(b)), (2, " ".join(a)), (2, " ".join(a)), (None, " ".join(a))]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.first_id) for r in passages.repeated_passages(table(spark, rows)).collect())
    # The first text is in four rows and the second in two, each once with a word before it.
    assert got == [(1, 0, 60, 1), (1, 0, 60, 1), (2, 0, 60, 1), (2, 0, 60, 1), (2, 1, 61, 1)]
    left = sorted((r.doc_id or 0, r.text) for r in passages.without_repeats(table(spark, rows)).collect())
    assert left == sorted([(0, " ".join(a)), (1, " ".join(a)), (1, " ".join(b)), (2, "x ")])
    alone = passages.repeated_passages(table(spark, [(1, " ".join(a)), (1, " ".join(b)), (2, "x " + " ".join(b))])).collect()
    assert sorted((r.doc_id, r.start_word) for r in alone) == [(1, 0), (2, 1)]


def test_a_text_that_repeats_itself(spark):
    """A line repeated in a text is a few suffixes, not one for each time; what is covered stays exact."""
    draw = random.Random(8)
    line, other, tail = prose(draw, 7), prose(draw, 90), prose(draw, 55)
    rows = [(1, " ".join(line * 400 + tail)), (2, " ".join(other + line * 300)),
            (3, " ".join(prose(draw, 30) + line * 20 + other[:60] + line * 20)), (4, " ".join(prose(draw, 20) + tail))]
    want, first = covered(rows, 50)
    docs = table(spark, rows)
    made, real = {}, passages.settle
    try:
        passages.settle = lambda df, label: made.setdefault(label, real(df, label))
        passages.matched_starts(docs, 50, 20)
    finally:
        passages.settle = real
    assert made["suffixes"].count() < 80
    got = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        places = set(range(r.start_word, r.end_word))
        assert not got[r.doc_id] & places
        got[r.doc_id] |= places
    assert got == {i: {k for _, k in places} for i, places in want.items()}
    left = {r.doc_id: r.text.split() for r in passages.without_repeats(docs).collect()}
    for i, text in rows:
        w = text.split()
        cut = {s + k for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < i for k in range(50)}
        assert left.get(i, []) == [x for k, x in enumerate(w) if k not in cut]


def test_common_words():
    assert passages.common_words(b"a b ", b"a b c ") == 2 and passages.common_words(b"ab ", b"a ") == 0
