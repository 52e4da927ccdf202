"""A linear-chain conditional random field in numpy: many chains side by side, one step of all of them at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _order(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each chain, longest first; how many chains have a position t, for each t)."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest), "right")
    return offsets[:-1][order], active


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(unary: np.ndarray, step: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward: (state marginals of each position, sum of log Z, expected transitions)."""
    begin, active = _order(offsets)
    alpha, beta = unary.copy(), np.zeros_like(unary)
    for t in range(1, len(active)):
        at = begin[: active[t]] + t
        alpha[at] += _log_sum(alpha[at - 1][:, :, None] + step[None], 1)
    pairs = np.zeros_like(step)
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        beta[at - 1] = _log_sum(step[None] + (unary[at] + beta[at])[:, None, :], 2)
    both = alpha + beta
    z = _log_sum(both, 1)
    inner = np.ones(len(unary), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    if len(at):
        pairs = np.exp(alpha[at - 1][:, :, None] + step[None] + (unary[at] + beta[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    return np.exp(both - z[:, None]), float(z[firsts].sum()), pairs


def viterbi(unary: np.ndarray, step: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The likeliest state of each position, chain by chain; ties go to the lower state."""
    begin, active = _order(offsets)
    n, states = unary.shape
    best, back = unary.copy(), np.zeros((n, states), np.int8)
    for t in range(1, len(active)):
        at = begin[: active[t]] + t
        before = best[at - 1]
        for s in range(states):
            x = before + step[:, s]
            k = x.argmax(axis=1)
            back[at, s] = k
            best[at, s] += x[np.arange(len(at)), k]
    out = best.argmax(axis=1).astype(np.int8)
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        out[at - 1] = back[at, out[at]]
    return out


@dataclass
class Chain:
    weights: np.ndarray  # features x states
    step: np.ndarray  # states x states
    mean: np.ndarray
    scale: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def fit(features: np.ndarray, states: np.ndarray, offsets: np.ndarray, count: int, l2: float = 1e-3, rounds: int = 150, rate: float = 0.1) -> Chain:
    """Maximum penalised likelihood by Adam over the whole sample; the same sample gives the same chain."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    constant = scale < 1e-9
    mean[constant], scale[constant] = 0, 1
    x = (features - mean) / scale
    n = max(len(x), 1)
    gold = np.eye(count)[states]
    inner = np.ones(len(x), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    gold_pairs = np.zeros((count, count))
    np.add.at(gold_pairs, (states[at - 1], states[at]), 1)
    params = [np.zeros((x.shape[1], count)), np.zeros((count, count))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        got, _, pairs = marginals(x @ params[0], params[1], offsets)
        slopes = [x.T @ (gold - got) / n - l2 * params[0], (gold_pairs - pairs) / n - l2 * params[1]]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return Chain(params[0], params[1], mean, scale)
