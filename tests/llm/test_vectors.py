"""Whitening and near copies of vectors against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from blocktrace.llm import vectors, whitening
from blocktrace.llm.bidiagonal import right_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n double"
NAN, INF = float("nan"), float("inf")


def planted():
    draw = np.random.default_rng(5)
    rows = []
    for label in (0, 1, 2, None):
        base = draw.standard_normal((60, 16)).astype(np.float32)
        near = base[:20] + 0.3 * draw.standard_normal((20, 16)).astype(np.float32)
        group = base[0] + 0.25 * draw.standard_normal((80, 16)).astype(np.float32)
        rows += [(v.tolist(), label) for v in [*base, *near, *group, base[3], base[3], 2 * base[4]]]
    rows += [(rows[0][0], 7)] * 150
    rows += [([1.0] * 8, 1), ([1.0] * 8, 1), ([0.0] * 16, 1), ([], 1), (None, 1), ([NAN] + [1.0] * 15, 1),
             ([INF] * 16, 1), ([None] * 16, 1), ([3e38] * 16, 1), ([1e-40] * 16, 1)]
    draw.shuffle(order := np.arange(len(rows)))
    table = [(int(i) * 3, *rows[k]) for i, k in enumerate(order)]
    return table + [(None, rows[0][0], 0)]


def plain_links(table, threshold=0.93):
    sound = [(i, v, label) for i, v, label in table if i is not None and v and label is not None
             and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = []
    for _, v, _ in sound:
        v = np.array(v, dtype=np.float32).astype(np.float64)
        v = v / np.abs(v).max()
        unit.append(v / np.sqrt(v @ v))
    links = {i: set() for i, *_ in table if i is not None}
    for a, (i, v, x) in enumerate(sound):
        for b in range(a):
            j, w, y = sound[b]
            if x == y and len(v) == len(w) and unit[a] @ unit[b] >= threshold:
                links[i].add(j)
                links[j].add(i)
    root = {i: i for i in links}
    for i in sorted(links):
        if root[i] == i:
            todo = [i]
            while todo:
                k = todo.pop()
                for other in links[k]:
                    if root[other] > i:
                        root[other] = i
                        todo.append(other)
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("options", [{}, {"tile_rows": 16, "least_rows": 16}])
def test_near_vectors_match_brute_force(spark, options):
    table = planted()
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in table], SCHEMA)
    rows = vectors.near_vectors(df, **options).collect()
    want = plain_links(table)
    assert sum(n for n, *_ in want.values()) > 10_000
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is not None} == want
    assert len(rows) == len(table) and [(r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is None] == [(0, None, True)]
    assert vectors.near_vectors(df.limit(0), **options).collect() == []


def test_early_stop_misses_no_pair():
    draw = np.random.default_rng(2)
    a = vectors.unit(draw.standard_normal((300, 24)) + 2.5 * np.eye(24)[0])
    b = vectors.unit(np.vstack([a[:40] + 0.05 * draw.standard_normal((40, 24)), draw.standard_normal((200, 24))]))
    for threshold in (0.2, 0.93):
        found = [np.stack(p[:2]) for p in vectors.close_pairs(a, b, threshold, False, block=64)]
        assert set(map(tuple, np.hstack(found).T)) == set(zip(*np.nonzero(a @ b.T >= threshold)))
    found = np.hstack([np.stack(p[:2]) for p in vectors.close_pairs(a, a, 0.5, True, block=64)])
    assert set(map(tuple, found.T)) == set(zip(*np.nonzero(np.triu(a @ a.T >= 0.5, 1))))


def test_wide_entries_and_repeated_ids(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (9, [1.0, 0.1], 1), (3, [0.1, 1.0], 1), (4, [1e200, 1e200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [(3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False), (5, 1, 5, True), (9, 1, 5, False)]


def plain_whitening(rows, components):
    x = np.floor(64 * np.array(rows, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    value, axes = np.linalg.eigh(centred.T @ centred / n)
    value, axes = value[::-1], axes[:, ::-1]
    kept = min(components, int((value > 1e-12 * value[0]).sum()))
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, total)) for row in x.tolist()]
    return deviation, centred @ axes[:, :kept] / np.sqrt(value[:kept]), value[:kept] / value.sum()


@pytest.mark.parametrize("rank", [40, 6])
def test_whitening_matches_eigenvectors(spark, rank):
    draw = np.random.default_rng(rank)
    rows = draw.standard_normal((500, rank)) * np.linspace(3, 0.2, rank)
    rows = (rows if rank == 40 else np.hstack([rows, rows[:, :1], np.ones((500, 3))])).astype(np.float32)
    table = [(i, v.tolist(), 1, "clash", 0.1) for i, v in enumerate(rows)]
    odd = [(1000, None, 1, "", 0.0), (1001, [NAN] * len(rows[0]), 1, "", 0.0), (1002, [None] * len(rows[0]), 1, "", 0.0),
           (1003, [], 1, "", 0.0), (1004, [1.0], 1, "", 0.0), (1005, [INF] * len(rows[0]), 1, "", 0.0)]
    found = whitening.whitened(spark.createDataFrame(table + odd, SCHEMA).repartition(7)).collect()
    deviation, want, share = plain_whitening(rows, 32)
    assert len(found) == want.size and {r.vec_id for r in found} == set(range(500))
    got = np.zeros_like(want)
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == 500 and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-7


def test_whitening_of_little(spark):
    def run(rows):
        return whitening.whitened(spark.createDataFrame([(i, v, 1, "", 0.0) for i, v in rows], SCHEMA)).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(i, [1.0, 2.0]) for i in range(9)]) == []
    # Two different rows have one direction; a repeated row and a null id count.
    found = run([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 1.0]), (2, [1.0, 1.0])])
    assert {(r.component, round(abs(r.whitened), 9), r.n, r.deviation) for r in found} == {(1, 1.0, 4, 2 * 128 ** 2)}
    assert len(found) == 4
    # (n x - S) ** 2 beyond a long.
    far = run([(1, [0.0, 2.0 ** 40]), (2, [0.0, 0.0]), (3, [1.0, 0.0])])
    assert {r.deviation for r in far} == {None} and {r.component for r in far} <= {1, 2}


def test_solver_on_hard_matrices():
    draw = np.random.default_rng(1)
    p, q = (np.linalg.qr(draw.standard_normal((40, 40)))[0] for _ in range(2))
    spread = {"graded": 10.0 ** -np.linspace(0, 8, 40), "equal": np.repeat([3.0, 2.0, 1.0, 1.0], 10),
              "close": 1 + 1e-9 * np.arange(40), "deficient": np.array([5.0] + [1.0] * 38 + [0.0]),
              "one": np.eye(40)[0], "none": np.zeros(40)}
    for name, sizes in spread.items():
        whole = p @ np.diag(sizes) @ q
        values, axes = right_vectors(whole, 40)
        assert len(values) == (sizes > 1e-13).sum(), name
        assert np.allclose(values, np.sort(sizes)[::-1][:len(values)], rtol=1e-6), name
        assert np.abs(axes.T @ axes - np.eye(len(values))).max(initial=0) < 1e-8, name
        assert np.abs(whole.T @ (whole @ axes) - axes * values ** 2).max(initial=0) < 1e-8, name
    # High relative accuracy of a bidiagonal matrix whose values span many orders.
    diagonal, above = 10.0 ** -np.arange(0, 12, 1.0), 10.0 ** -np.arange(0.5, 11, 1.0)
    from blocktrace.llm.bidiagonal import singular_values
    product = np.prod(singular_values(diagonal.copy(), above.copy()))
    assert abs(product / np.prod(diagonal) - 1) < 1e-12
