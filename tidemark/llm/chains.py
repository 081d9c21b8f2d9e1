"""Forward and backward recursions over many chains at once, for the hidden Markov model and the random fields.

The chains of a batch are laid out step by step: all first elements, longest chain first, then all second
elements of the chains that have one, and so on. Each step of a recursion is then one product of a matrix of chains
by states with the transitions, over rows that lie side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Layout:
    """Where the elements of chains with the given (positive) lengths stand in the step-by-step order."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max()) if len(lengths) else 0
        self.alive = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
        self.start = np.concatenate(([0], np.cumsum(self.alive)))
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        self.chain = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(self.chain)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: Place of each element, the elements counted chain by chain.
        self.place = self.start[step] + rank[self.chain]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values given chain by chain, in the step-by-step order."""
        out = np.empty_like(values)
        out[self.place] = values
        return out

    def before(self) -> np.ndarray:
        """For each element after the first step, in order: the place of the element before it in its chain."""
        return np.arange(self.start[1], self.start[-1]) - np.repeat(self.alive[:-1], self.alive[1:])


def forward(layout: Layout, emit: np.ndarray, initial: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and the scale of each element; the log of a chain's total weight is the sum of logs of its scales."""
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    ones = np.ones(emit.shape[1])
    for t, (a, n) in enumerate(zip(layout.start.tolist(), layout.alive.tolist(), strict=False)):
        now = np.multiply(alpha[a - layout.alive[t - 1] : a - layout.alive[t - 1] + n] @ move if t else initial, emit[a : a + n], out=alpha[a : a + n])
        z = np.dot(now, ones, out=scale[a : a + n])
        now /= z[:, None]
    return alpha, scale


def backward(layout: Layout, emit: np.ndarray, scale: np.ndarray, move: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Scaled backward variables: alpha * beta are the posteriors of the states. last: those of the last element of a single chain that goes on."""
    beta = np.ones_like(emit)
    if last is not None:
        beta[-1] = last
    weighed = emit / scale[:, None]
    back = np.ascontiguousarray(move.T)
    for t in range(len(layout.alive) - 2, -1, -1):
        a, b, n = layout.start[t], layout.start[t + 1], layout.alive[t + 1]
        np.dot(weighed[b : b + n] * beta[b : b + n], back, out=beta[a : a + n])
    return beta


def totals(layout: Layout, scale: np.ndarray) -> np.ndarray:
    """Log of each chain's total weight."""
    return np.bincount(layout.chain, weights=np.log(scale)[layout.place], minlength=len(layout.lengths))


def pair_counts(layout: Layout, alpha: np.ndarray, beta: np.ndarray, emit: np.ndarray, scale: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected number of each transition, over all chains."""
    if len(layout.alive) < 2:
        return np.zeros_like(move)
    a = layout.start[1]
    return move * (alpha[layout.before()].T @ (emit[a:] * beta[a:] / scale[a:, None]))


def packs(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of chains in groups of about `most` elements, like lengths together, so that few steps have few chains."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    sizes = np.cumsum(lengths[order])
    for _, part in _runs(sizes // max(1, most), order):
        yield part


def _runs(group: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(group)) + 1
    for part, g in zip(np.split(values, cuts), np.split(group, cuts), strict=True):
        if len(part):
            yield int(g[0]), part
