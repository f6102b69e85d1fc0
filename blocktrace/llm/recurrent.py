"""Bidirectional gated recurrent network over bytes, in numpy.

Both directions read the bytes of a window; a gate decides at every byte how
much of the state is kept and how much is renewed. Each position gets label
probabilities from the two states there, and a text's probabilities are the mean
log probabilities of all its positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear gate: cheap, and close to the logistic one."""
    return np.clip(0.25 * x + 0.5, 0, 1)


@dataclass
class ByteNetwork:
    """Weights, one row per unit, so that a step works on whole rows of windows.

    `table` holds, per direction, the input part of both gates and of the
    candidate for each byte; the candidate is x / (1 + |x|).
    """

    table: np.ndarray      # (2, 3 * hidden, 256)
    state: np.ndarray      # (2, 3 * hidden, hidden)
    output: np.ndarray     # (labels, 2 * hidden)
    bias: np.ndarray       # (labels, 1)

    @classmethod
    def new(cls, hidden: int, labels: int, seed: int) -> ByteNetwork:
        draw = np.random.default_rng(seed).standard_normal
        return cls(*(a.astype(np.float32) for a in (
            0.5 * draw((2, 3 * hidden, 256)), draw((2, 3 * hidden, hidden)) / np.sqrt(hidden),
            draw((labels, 2 * hidden)) / np.sqrt(2 * hidden), np.zeros((labels, 1)))))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.table, self.state, self.output, self.bias]

    def states(self, data: np.ndarray, remember: list | None = None) -> np.ndarray:
        """States of both directions, (2 * hidden, positions, windows); `data` is (windows, positions)."""
        windows, positions = data.shape
        hidden = self.state.shape[2]
        columns = np.ascontiguousarray(data.T)
        out = np.empty((2 * hidden, positions, windows), dtype=np.float32)
        for way in (0, 1):
            table, gates, renewed = self.table[way], self.state[way, :2 * hidden], self.state[way, 2 * hidden:]
            h = np.zeros((hidden, windows), dtype=np.float32)
            for t in range(positions) if way == 0 else range(positions - 1, -1, -1):
                x = np.take(table, columns[t], axis=1)
                zr = gate(x[:2 * hidden] + gates @ h)
                z, r = zr[:hidden], zr[hidden:]
                c = x[2 * hidden:] + renewed @ (r * h)
                c /= 1 + np.abs(c)
                if remember is not None:
                    remember.append((way, t, h, z, r, c))
                h = h + z * (c - h)
                out[way * hidden:(way + 1) * hidden, t] = h
        return out

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(labels, positions, windows)."""
        states = self.states(data)
        scores = (self.output @ states.reshape(len(states), -1) + self.bias).reshape(-1, *states.shape[1:])
        scores -= scores.max(axis=0)
        return scores - np.log(np.exp(scores).sum(axis=0))

    def gradients(self, data: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean loss over the masked positions, by backpropagation through time."""
        remember: list = []
        states = self.states(data, remember)
        flat = states.reshape(len(states), -1)
        scores = self.output @ flat + self.bias
        p = np.exp(scores - scores.max(axis=0))
        p /= p.sum(axis=0)
        d = p.reshape(-1, *states.shape[1:])
        for label in range(len(self.bias)):
            d[label][:, labels == label] -= 1
        d *= (mask.T / max(mask.sum(), 1)).astype(np.float32)
        d = d.reshape(len(self.bias), -1)
        grads = [np.zeros_like(self.table), np.zeros_like(self.state), d @ flat.T, d.sum(axis=1, keepdims=True)]
        back = (self.output.T @ d).reshape(states.shape)
        hidden = self.state.shape[2]
        carried = [np.zeros((hidden, len(labels)), dtype=np.float32) for _ in (0, 1)]
        for way, t, h, z, r, c in reversed(remember):
            gates, renewed = self.state[way, :2 * hidden], self.state[way, 2 * hidden:]
            dh = back[way * hidden:(way + 1) * hidden, t] + carried[way]
            dc = dh * z * (1 - np.abs(c)) ** 2
            drh = renewed.T @ dc
            zr, dzr = np.vstack([z, r]), np.vstack([dh * (c - h), drh * h])
            dzr = 0.25 * dzr * ((zr > 0) & (zr < 1))
            carried[way] = dh * (1 - z) + drh * r + gates.T @ dzr
            grads[1][way, :2 * hidden] += dzr @ h.T
            grads[1][way, 2 * hidden:] += dc @ (r * h).T
            np.add.at(grads[0][way].T, data[:, t], np.vstack([dzr, dc]).T)
        return grads


def train(parts: list[np.ndarray], gradients, steps: int, rate: float) -> None:
    """Adam over `parts`; `gradients(step)` gives the gradient of each."""
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in parts]
    for step in range(1, steps + 1):
        found = gradients(step)
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        shrink = min(1.0, 1.0 / (norm + 1e-9))
        for value, slope, (mean, square) in zip(parts, found, moments):
            slope = slope * shrink
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            value -= (rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)).astype(value.dtype)
