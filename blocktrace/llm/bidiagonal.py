"""Singular values and right vectors of a small square matrix.

Householder reflections make the matrix bidiagonal, dqds with Newton's shifts
finds the singular values with high relative accuracy, and twisted
factorisations of the tridiagonal square give the vectors. Everything here is
of the size of one vector squared and runs once, on the driver.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny
#: Inverse iterations for a vector of a group of close values.
ATTEMPTS = 10


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor `V` with ``matrix = U B V'``."""
    work = np.array(matrix, dtype=np.float64)
    size = work.shape[1]
    right = np.eye(size)
    for k in range(size):
        reflect = _reflector(work[k:, k])
        if reflect is not None:
            work[k:, k:] -= 2 * np.outer(reflect, reflect @ work[k:, k:])
        if k < size - 2:
            reflect = _reflector(work[k, k + 1:])
            if reflect is not None:
                work[k:, k + 1:] -= 2 * np.outer(work[k:, k + 1:] @ reflect, reflect)
                right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ reflect, reflect)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _reflector(column: np.ndarray) -> np.ndarray | None:
    """Unit vector whose reflection maps `column` to a multiple of the first axis."""
    scale = np.abs(column).max(initial=0.0)
    if scale == 0.0 or not column[1:].any():
        return None
    out = column / scale
    out[0] += np.copysign(np.sqrt(out @ out), out[0])
    return out / np.sqrt(out @ out)


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix without zeros, largest first, by dqds."""
    q, e = diagonal * diagonal, above * above
    found, low, high = [], 0, len(q)
    stack = [(low, high, 0.0)]
    while stack:
        low, high, shift = stack.pop()
        while high > low:
            cuts = [k for k in range(low, high - 1) if e[k] <= EPS * EPS * (q[k] + q[k + 1] + shift)]
            if cuts:
                stack.append((low, cuts[-1] + 1, shift))
                low = cuts[-1] + 1
                if high == low + 1:
                    found.append(q[low] + shift)
                    break
                continue
            if high == low + 1:
                found.append(q[low] + shift)
                break
            step = _newton(q[low:high], e[low:high - 1])
            # A shift that rounding has carried past the smallest value is taken back.
            while True:
                done = _dqds(q[low:high], e[low:high - 1], step)
                if done is not None:
                    break
                step = step / 2 if step > EPS * shift else 0.0
            q[low:high], e[low:high - 1] = done
            shift += step
    return np.sqrt(np.sort(np.array(found))[::-1])


def _newton(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the smallest eigenvalue: one over the trace of the inverse.

    The pivots of the unshifted transform are the inverse's diagonal, inverted.
    """
    pivot = q[0]
    pivots = [pivot]
    for k in range(len(e)):
        pivot = pivot * (q[k + 1] / (pivot + e[k])) if pivot > 0 else 0.0
        pivots.append(pivot)
    if min(pivots) <= 0.0:
        return 0.0
    return float(1.0 / np.sum(1.0 / np.array(pivots)))


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential quotient-difference step; None if the shift was too large."""
    out_q, out_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        total = d + e[k]
        out_q[k] = max(total, TINY)
        ratio = q[k + 1] / out_q[k]
        out_e[k] = e[k] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    out_q[-1] = d
    return out_q, out_e


def twisted_vector(pivots: np.ndarray, below: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of ``L D L'`` for an eigenvalue, from the twist with the smallest residual.

    `pivots` is D, `below` the subdiagonal of the unit lower L.
    """
    size = len(pivots)
    forward, multiplier = np.empty(size), np.empty(max(size - 1, 0))
    backward, upper = np.empty(size), np.empty(max(size - 1, 0))
    s = -value
    for k in range(size - 1):
        forward[k] = s
        pivot = _safe(s + pivots[k], value)
        multiplier[k] = pivots[k] * below[k] / pivot
        s = multiplier[k] * below[k] * s - value
    forward[-1] = s
    p = pivots[-1] - value
    backward[-1] = p
    for k in range(size - 2, -1, -1):
        pivot = _safe(pivots[k] * below[k] * below[k] + p, value)
        ratio = pivots[k] / pivot
        upper[k] = below[k] * ratio
        p = p * ratio - value
        backward[k] = p
    twist = int(np.argmin(np.abs(forward + backward + value)))
    out = np.zeros(size)
    out[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        out[k] = -multiplier[k] * out[k + 1]
    for k in range(twist, size - 1):
        out[k + 1] = -upper[k] * out[k]
    return out / np.sqrt(out @ out)


def _safe(pivot: float, scale: float) -> float:
    least = EPS * EPS * abs(scale) + TINY
    return pivot if abs(pivot) > least else (least if pivot >= 0 else -least)


def _solve(pivots: np.ndarray, below: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Nearly solve ``(L D L' - value) x = right`` by the stationary factorisation."""
    size, x = len(pivots), right.copy()
    diagonal, multiplier = np.empty(size), np.empty(max(size - 1, 0))
    s = -value
    for k in range(size):
        diagonal[k] = _safe(s + pivots[k], pivots.max())
        if k < size - 1:
            multiplier[k] = pivots[k] * below[k] / diagonal[k]
            s = multiplier[k] * below[k] * s - value
    for k in range(1, size):
        x[k] -= multiplier[k - 1] * x[k - 1]
    x /= diagonal
    for k in range(size - 2, -1, -1):
        x[k] -= multiplier[k] * x[k + 1]
    return x


def right_vectors(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values, at most `most`, and their right vectors as columns.

    Values of no more than the size times the rounding of the largest one are
    zero and left out. Vectors of close values are made orthogonal.
    """
    diagonal, above, right = bidiagonalise(matrix)
    size = len(diagonal)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(0), np.zeros((size, 0))
    # Zeros become a fraction of the rounding.
    floor = EPS * EPS * scale
    diagonal = np.where(np.abs(diagonal) < floor, floor, diagonal)
    above = np.where(np.abs(above) <= EPS * (np.abs(diagonal[:-1]) + np.abs(diagonal[1:])) / 8, 0.0, above)
    edges = [0, *(np.flatnonzero(above == 0.0) + 1), size]
    pieces = []
    for low, high in zip(edges, edges[1:]):
        a, b = diagonal[low:high], above[low:high - 1]
        values = singular_values(a, b)
        pieces += [(value, low, high) for value in values]
    pieces.sort(reverse=True)
    pieces = [p for p in pieces[:most] if p[0] > size * EPS * scale]
    columns, values = np.zeros((size, len(pieces))), np.array([p[0] for p in pieces])
    draw = np.random.default_rng(0)
    for k, (value, low, high) in enumerate(pieces):
        a, b = diagonal[low:high], above[low:high - 1]
        pivots, below = a * a, b / a[:-1]
        column = twisted_vector(pivots, below, value * value)
        near = [j for j in range(k) if values[j] - value <= 1e-3 * values[j] and pieces[j][1] == low]
        held = columns[low:high, near]
        for attempt in range(ATTEMPTS if near else 0):
            # The inverse pulls towards the whole group of close values; what is left of it after
            # the vectors found so far is the next one, if it is not rounding alone.
            rest = column - held @ (held.T @ column)
            length = np.sqrt(rest @ rest)
            if length < 1e-6:
                rest = draw.standard_normal(high - low)
            rest -= held @ (held.T @ rest)
            column = rest / np.sqrt(rest @ rest)
            if attempt > 1 and length > 0.1 or attempt == ATTEMPTS - 1:
                break
            column = _solve(pivots, below, value * value * (1 + 2 * EPS * attempt), column)
            column = column / np.sqrt(column @ column)
        columns[low:high, k] = column
    return values, right @ columns
