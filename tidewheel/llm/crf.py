"""A linear-chain conditional random field over categorical features, in numpy.

A sequence is an integer matrix (positions x features) of feature ids, -1 for none, and the class of the move into each position (all 0 by default):
moves of different classes have weights of their own. Training maximises
the penalised log-likelihood by Adam over the whole table; decoding is Viterbi's recursion over batches
of sequences of about the same length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    emit: np.ndarray  # features + 1 (the last one is none) x labels
    move: np.ndarray  # class x label before x label
    first: np.ndarray
    last: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(self.emit[features[..., f]] for f in range(features.shape[-1]))


def _padded(seqs: Sequence[np.ndarray], fill: float) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), n.max(), *seqs[0].shape[1:]), fill, seqs[0].dtype)
    for row, s in zip(out, seqs, strict=True):
        row[: len(s)] = s
    return out, n


def _by_length(seqs: Sequence[np.ndarray]) -> list[list[int]]:
    """Indices of sequences of about the same length: in each group the longest is less than twice as long as the shortest."""
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(seqs):
        if len(x):
            groups.setdefault(int(len(x)).bit_length(), []).append(i)
    return [groups[k] for k in sorted(groups)]


def _expected(model: Model, x: np.ndarray, n: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels at each position (0 beyond a sequence's end), and expected numbers of moves, by forward and backward sums."""
    b, t, _ = x.shape
    k = len(model.first)
    mask = np.arange(t)[None, :] < n[:, None]
    # probabilities are scaled at each position; what is beyond a sequence's end passes its state on
    e = model.scores(x)
    e = np.where(mask[:, :, None], np.exp(e - e.max(axis=2, keepdims=True)), 1.0)
    moves_by = np.exp(model.move)
    classes = len(moves_by)

    def moved(p: np.ndarray, i: int, back: bool = False) -> np.ndarray:
        ways = [p @ (m.T if back else m) for m in moves_by]
        return ways[0] if classes == 1 else np.choose(by[:, i, None], ways)

    fwd, back = np.zeros((b, t, k)), np.zeros((b, t, k))
    here = np.exp(model.first) * e[:, 0]
    fwd[:, 0] = here / here.sum(1, keepdims=True)
    for i in range(1, t):
        here = moved(fwd[:, i - 1], i) * e[:, i]
        fwd[:, i] = np.where(mask[:, i, None], here / here.sum(1, keepdims=True), fwd[:, i - 1])
    ends = np.exp(model.last) / np.exp(model.last).sum()
    back[:, t - 1] = ends
    for i in range(t - 2, -1, -1):
        here = moved(e[:, i + 1] * back[:, i + 1], i + 1, back=True)
        back[:, i] = np.where(mask[:, i + 1, None], here / here.sum(1, keepdims=True), ends)
    p = fwd * back
    p = p / p.sum(2, keepdims=True) * mask[:, :, None]
    moves = np.zeros((classes, k, k))
    if t > 1:
        after = e[:, 1:] * back[:, 1:]
        for c in range(classes):
            z = np.einsum("btj,btj->bt", fwd[:, :-1] @ moves_by[c], after)
            weighted = fwd[:, :-1] * (mask[:, 1:] & (by[:, 1:] == c))[:, :, None] / z[:, :, None]
            moves[c] = moves_by[c] * (weighted.reshape(-1, k).T @ after.reshape(-1, k))
    return p, moves


def train(seqs: Sequence[np.ndarray], labels: Sequence[np.ndarray], n_features: int, n_labels: int, l2: float = 0.02, steps: int = 80, rate: float = 0.2, moves_by: Sequence[np.ndarray] | None = None, n_classes: int = 1) -> Model:
    """Full-batch Adam on the mean negative log-likelihood per sequence plus l2/2 times the squared weights over sequences."""
    total = sum(1 for x in seqs if len(x))
    by = [np.zeros(len(x), np.int8) for x in seqs] if moves_by is None else moves_by
    size = [(n_features + 1) * n_labels, n_classes * n_labels * n_labels, n_labels, n_labels]
    bounds = np.cumsum([0, *size])
    parts = []
    for group in _by_length(seqs):
        x, n = _padded([seqs[i] for i in group], -1)
        y, _ = _padded([labels[i] for i in group], 0)
        c, _ = _padded([by[i] for i in group], 0)
        mask = np.arange(x.shape[1])[None, :] < n[:, None]
        x = np.where(x < 0, n_features, x)
        # where each feature stands: positions in the order of features
        ids = x[mask].ravel()
        order = np.argsort(ids, kind="stable")
        order = order[: np.searchsorted(ids[order], n_features)]
        which, begins = np.unique(ids[order], return_index=True)
        parts.append((x, n, mask, (which, begins, np.flatnonzero(mask)[order // x.shape[2]]), c, np.eye(n_labels)[y] * mask[:, :, None]))

    def counts(p: np.ndarray, moves: np.ndarray, part: tuple) -> np.ndarray:
        _, n, _, (which, begins, at), _, _ = part
        out = np.zeros((n_features + 1, n_labels))
        if len(which):
            out[which] = np.add.reduceat(p.reshape(-1, n_labels)[at], begins, axis=0)
        return np.concatenate([out.ravel(), moves.ravel(), p[:, 0].sum(0), p[np.arange(len(n)), n - 1].sum(0)])

    def model(w: np.ndarray) -> Model:
        emit, move, first, last = (w[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True))
        return Model(emit.reshape(n_features + 1, n_labels), move.reshape(n_classes, n_labels, n_labels), first, last)

    def given(part: tuple) -> np.ndarray:
        _, _, mask, _, c, hot = part
        return np.stack([np.einsum("bti,btj,bt->ij", hot[:, :-1], hot[:, 1:], (mask & (c == k))[:, 1:].astype(float)) for k in range(n_classes)])

    gold = sum(counts(part[-1], given(part), part) for part in parts)
    w, m, v = np.zeros(bounds[-1]), np.zeros(bounds[-1]), np.zeros(bounds[-1])
    for step in range(1, steps + 1):
        seen = sum(counts(*_expected(model(w), part[0], part[1], part[4]), part) for part in parts)
        g = (seen - gold + l2 * w) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model(w)


def marginals(seqs: Sequence[np.ndarray], model: Model) -> list[np.ndarray]:
    """Probabilities of the labels at each position of all sequences."""
    out: list[np.ndarray] = [np.zeros((0, len(model.first)))] * len(seqs)
    for group in _by_length(seqs):
        x, n = _padded([seqs[i] for i in group], -1)
        for i, p, k in zip(group, _expected(model, x, n, np.zeros(x.shape[:2], np.int8))[0], n, strict=True):
            out[i] = p[:k]
    return out


def viterbi(scores: np.ndarray, n: np.ndarray, model: Model, by: np.ndarray | None = None) -> np.ndarray:
    """Best labels of padded score matrices (sequences x positions x labels); of equal paths the one with the lower labels at the end."""
    b, t, k = scores.shape
    best = model.first + scores[:, 0]
    back = np.zeros((b, t, k), np.int8)
    ended = np.where((n == 1)[:, None], best, -np.inf)
    for i in range(1, t):
        paths = best[:, :, None] + (model.move[:1] if by is None else model.move[by[:, i]])
        back[:, i] = paths.argmax(1)
        best = paths.max(1) + scores[:, i]
        ended = np.where((n - 1 == i)[:, None], best, ended)
    out = np.zeros((b, t), np.int8)
    at = (ended + model.last).argmax(1).astype(np.int8)
    rows = np.arange(b)
    for i in range(t - 1, -1, -1):
        here = i < n
        out[here, i] = at[here]
        if i:
            at = np.where(here, back[rows, i, at], at)
    return out


def decode(seqs: Sequence[np.ndarray], model: Model, cells: int = 1 << 18) -> list[np.ndarray]:
    """Labels of all sequences; batches hold up to about so many cells."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(seqs)
    order = [i for i in sorted(range(len(seqs)), key=lambda i: len(seqs[i])) if len(seqs[i])]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and len(seqs[order[hi]]) * (hi - lo + 1) <= cells:
            hi += 1
        part = order[lo:hi]
        x, n = _padded([seqs[i] for i in part], -1)
        for i, row, k in zip(part, viterbi(model.scores(x), n, model), n, strict=True):
            out[i] = row[:k]
        lo = hi
    return out
