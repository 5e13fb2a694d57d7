"""Linear-chain conditional random fields in numpy, on batches of padded sequences."""
from __future__ import annotations

import numpy as np


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals [sequence, position, label], log partition functions, and expected transitions summed over all sequences.

    Each position's forward and backward values are scaled to sum to 1, so no step needs a logarithm of a sum.
    """
    n, wide, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    lift, step, first = np.exp(emit - top), np.exp(trans - trans.max()), np.exp(start - start.max())
    real = np.arange(wide) < lengths[:, None]
    alpha, beta, scale = np.empty_like(lift), np.ones_like(lift), np.ones((n, wide))
    for t in range(wide):
        now = (alpha[:, t - 1] @ step if t else first) * lift[:, t]
        scale[:, t] = now.sum(axis=1)
        np.divide(now, scale[:, t, None], out=alpha[:, t])
    for t in range(wide - 2, -1, -1):
        near = (lift[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]) @ step.T
        beta[:, t] = np.where(real[:, t + 1, None], near, 1)
    marginals = np.where(real[..., None], alpha * beta, 0)
    total = start.max() + (lengths - 1) * trans.max() + np.where(real, np.log(scale) + top[..., 0], 0).sum(axis=1)
    onward = (lift * beta * (real / scale)[..., None])[:, 1:]
    pairs = alpha[:, :-1].reshape(-1, k).T @ onward.reshape(-1, k)
    return marginals, total, pairs * step


def viterbi(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels [sequence, position]; the lower label on ties, -1 beyond the ends."""
    n, wide, _ = emit.shape
    best = start + emit[:, 0]
    back = np.zeros(emit.shape, np.int8)
    for t in range(1, wide):
        step = best[:, :, None] + trans
        back[:, t] = step.argmax(axis=1)
        best = np.where((t < lengths)[:, None], step.max(axis=1) + emit[:, t], best)
    path = np.full((n, wide), -1, np.int8)
    now = best.argmax(axis=1)
    for t in range(wide - 1, -1, -1):
        on = t < lengths
        path[on, t] = now[on]
        now = np.where(on, np.take_along_axis(back[:, t], now[:, None], 1)[:, 0], now)
    return path


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, rounds: int = 50, l2: float = 1e-3, rate: float = 0.3):
    """Weights [feature, label], transitions and starts that maximise the labels' likelihood, by Adam over all sequences, in steps
    that shrink to 0.

    features [sequence, position, slot] holds feature numbers; number 0 is none and keeps weight 0. labels [sequence, position].
    """
    n, wide, slots = features.shape
    real = np.arange(wide) < lengths[:, None]
    flat = features[real].ravel()
    truth = np.zeros((n, wide, n_labels))
    np.put_along_axis(truth, np.where(real, labels, 0)[..., None], 1.0, 2)
    truth[~real] = 0
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (labels[:, :-1][real[:, 1:]], labels[:, 1:][real[:, 1:]]), 1)
    tokens = real.sum()
    params = [np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        w, trans, start = params
        emit = w[features].sum(axis=2)
        marginals, _, pairs = forward_backward(emit, lengths, trans, start)
        diff = (marginals - truth)[real]
        gw = np.stack([np.bincount(flat, np.repeat(diff[:, k], slots), n_features) for k in range(n_labels)], axis=1)
        gw[0] = 0
        grads = [gw / tokens + l2 * w / 10, (pairs - seen) / tokens, (marginals[:, 0] - truth[:, 0]).sum(axis=0) / tokens]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (1 - (step - 1) / rounds) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    return params


def padded(sequences: list[list], fill=0) -> tuple[np.ndarray, np.ndarray]:
    """Lists of equal-width items as one array [sequence, position, ...], and the lengths."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    shape = np.shape(sequences[0][0]) if len(sequences) and len(sequences[0]) else ()
    out = np.full((len(sequences), int(lengths.max(initial=1)), *shape), fill, np.int64)
    for row, s in zip(out, sequences):
        row[: len(s)] = s
    return out, lengths
