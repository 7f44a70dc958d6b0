"""A linear-chain conditional random field over many sequences at once, in numpy.

Emissions are sums of the weights of active features; transitions are one matrix. Marginals come from the exact
forward-backward recursion, with each step taken for all sequences at once, and the weights from the
gradient of the log-likelihood (what was observed less what the marginals expect) with per-weight step sizes.
"""

from __future__ import annotations

import numpy as np


PIECE = 128


def _live(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places by falling size; for t = 0, 1, ...: how many of them have a t-th element."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    longest = int(falling[0]) if len(falling) else 0
    return order, (len(falling) - np.searchsorted(falling[::-1], np.arange(1, longest + 1))).tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    """Columns scaled to a sum of 1; x is labels x sequences."""
    x /= x.sum(0)
    return x


def marginals(
    emissions: np.ndarray,
    kinds: np.ndarray,
    offsets: np.ndarray,
    transitions: np.ndarray,
    first: np.ndarray,
    moves: bool = False,
    real=np.float32
) -> tuple[np.ndarray, np.ndarray | None]:
    """P(label) of each element and, with moves, the expected number of each transition over all sequences.

    emissions: kinds of elements x labels, logarithms; kinds: the kind of each element. offsets: n + 1 ends of the
    sequences. transitions: from x to. Sequences are cut into pieces of PIECE elements. A piece's product of
    transition and emission matrices carries what enters it to its end, so the recursion first runs from piece to
    piece, then inside all pieces at once: the result is that of the plain recursion, in far fewer steps. Elements
    are laid out by step, so that each step works on one stretch of memory.
    """
    n, labels = len(kinds), emissions.shape[1]
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    heats = np.exp(emissions - emissions.max(1, keepdims=True)).astype(real)
    move, begin = np.exp(transitions - transitions.max()).astype(real), np.exp(first - first.max()).astype(real)
    sizes = np.diff(offsets)
    parts = -(-sizes // PIECE)
    inside = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(offsets[:-1], parts) + inside * PIECE
    lengths = np.minimum(PIECE, np.repeat(offsets[1:], parts) - starts)
    order, live = _live(lengths)
    starts, inside = starts[order], inside[order]
    begins = np.concatenate([[0], np.cumsum(live)])
    at = np.concatenate([starts[:m] + t for t, m in enumerate(live)])
    heat = np.ascontiguousarray(heats[kinds[at]].T)
    into = np.ascontiguousarray(move.T)
    enter = np.tile(begin[:, None], (1, len(starts)))
    leave = np.full((labels, len(starts)), 1.0 / labels, real)
    if (parts > 1).any():
        product = np.where((inside == 0)[None, None, :], np.eye(labels, dtype=real)[:, :, None], move[:, :, None])
        for t, m in enumerate(live):
            now = product[:, :, :m]
            if t:
                now = np.matmul(into, now)
            now = now * heat[None, :, begins[t] : begins[t] + m]
            now /= now.sum((0, 1))
            product[:, :, :m] = now
        place = np.empty(len(starts), np.int64)
        place[order] = np.arange(len(starts))
        falling, turns = _live(parts)
        top = (np.cumsum(parts) - parts)[falling]
        for k in range(1, len(turns)):
            old, new = place[top[: turns[k]] + k - 1], place[top[: turns[k]] + k]
            enter[:, new] = _unit(np.einsum("in,ijn->jn", enter[:, old], product[:, :, old]))
        for k in range(len(turns) - 1, 0, -1):
            old, new = place[top[: turns[k]] + k - 1], place[top[: turns[k]] + k]
            leave[:, old] = _unit(np.einsum("ijn,jn->in", product[:, :, new], leave[:, new]))
        del product
    forward = np.empty_like(heat)
    alpha = np.where(inside == 0, enter, into @ enter)
    for t, m in enumerate(live):
        cut = slice(begins[t], begins[t] + m)
        alpha = _unit((into @ alpha[:, :m] if t else alpha) * heat[:, cut])
        forward[:, cut] = alpha
    backward = np.empty_like(heat)
    after = 0
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        if after:
            leave[:, :after] = _unit(move @ (leave[:, :after] * heat[:, begins[t + 1] : begins[t + 1] + after]))
        backward[:, begins[t] : begins[t] + m] = leave[:, :m]
        after = m
    out = np.empty((n, labels), real)
    out[at] = _unit(forward * backward).T
    if not moves:
        return out, None
    ahead, behind = np.empty((n, labels)), np.empty((n, labels))
    ahead[at], behind[at] = forward.T, (heat * backward).T
    inner = np.ones(n, bool)
    inner[offsets[1:][sizes > 0] - 1] = False
    left = np.flatnonzero(inner)
    right = behind[left + 1]
    norm = ((ahead[left] @ move) * right).sum(1)
    return out, move * ((ahead[left] / norm[:, None]).T @ right)


class Features:
    """The active features of kinds of elements, in columns of (ids, owners).

    Owners rise; in a column marked single none comes twice, in the others they come in runs.
    """

    def __init__(self, n: int, columns: list[tuple[np.ndarray, np.ndarray, bool]]) -> None:
        self.n, self.columns = n, [c for c in columns if len(c[0])]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), weights.dtype)
        for ids, owners, single in self.columns:
            if single:
                out[owners] += weights[ids]
            else:
                heads = np.flatnonzero(np.diff(owners, prepend=-1))
                out[owners[heads]] += np.add.reduceat(weights[ids], heads, axis=0)
        return out

    def spread(self, values: np.ndarray, n_weights: int) -> np.ndarray:
        out = np.zeros((n_weights, values.shape[1]))
        for ids, owners, _ in self.columns:
            for j in range(values.shape[1]):
                out[:, j] += np.bincount(ids, values[owners, j], n_weights)
        return out


def fit(
    features: Features, kinds: np.ndarray, offsets: np.ndarray, targets: np.ndarray, n_weights: int, rounds: int, rate: float, decay: float
):
    """Weights (features x labels), transitions and first-label weights.

    kinds[i] is the kind of element i (elements that share all features are one kind). targets: elements x labels,
    each row a distribution (soft labels are allowed).
    """
    labels = targets.shape[1]
    weights = np.zeros((n_weights, labels))
    transitions, first = np.eye(labels), np.zeros(labels)
    sums = [np.full_like(x, 1e-8) for x in (weights, transitions, first)]
    starts = offsets[:-1][np.diff(offsets) > 0]
    inner = np.ones(len(targets), bool)
    inner[starts] = False
    right = np.flatnonzero(inner)
    seen = targets[right - 1].T @ targets[right]
    seen_first = targets[starts].sum(0)
    n = max(1, len(targets))
    for _ in range(rounds):
        chance, moved = marginals(features.sums(weights), kinds, offsets, transitions, first, True, np.float64)
        slack = targets - chance
        by_kind = np.stack([np.bincount(kinds, slack[:, j], features.n) for j in range(labels)], 1)
        steps = [
            features.spread(by_kind, n_weights) / n - decay * weights,
            (seen - moved) / n - decay * transitions,
            (seen_first - chance[starts].sum(0)) / n - decay * first,
        ]
        for x, g, s in zip((weights, transitions, first), steps, sums, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    return weights, transitions, first
