"""Linear-chain conditional random fields on padded batches of sequences."""

from __future__ import annotations

import numpy as np


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """Posteriors of the labels of each position, and log Z of each sequence.

    scores: (T, B, L) emission scores, rows past a sequence's length ignored;
    trans: (L, L) transition scores. Probabilities are rescaled at each step.
    """
    steps, batch, n = scores.shape
    top = scores.max(2, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(trans)
    alpha = np.empty_like(e)
    log_z = np.zeros(batch)
    now = np.full((batch, n), 1.0)
    live = (np.arange(steps)[:, None] < lengths[None, :])
    for t in range(steps):
        now = (now @ a if t else now) * e[t]
        z = now.sum(1, keepdims=True)
        now = now / z
        alpha[t] = now
        log_z += np.where(live[t], np.log(z[:, 0]) + top[t, :, 0], 0)
    beta = np.ones((batch, n))
    post = np.empty_like(e)
    at = a.T.copy()
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            new = (e[t + 1] * beta) @ at
            new /= new.sum(1, keepdims=True)
            beta = np.where(live[t + 1][:, None], new, 1.0)
        g = alpha[t] * beta
        post[t] = g / g.sum(1, keepdims=True)
    return post, log_z, alpha, e, live


def pair_counts(scores, lengths, trans):
    """Posteriors, and expected transitions summed over the batch (L, L)."""
    post, log_z, alpha, e, live = forward_backward(scores, lengths, trans)
    a = np.exp(trans)
    expected = np.zeros_like(trans)
    beta = np.ones(scores.shape[1:])
    for t in range(scores.shape[0] - 1, 0, -1):
        right = e[t] * beta
        joint = alpha[t - 1][:, :, None] * a[None] * right[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        expected += (joint * live[t][:, None, None]).sum(0)
        new = right @ a.T
        beta = np.where(live[t][:, None], new / new.sum(1, keepdims=True), 1.0)
    return post, log_z, expected, live


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of one sequence; scores (T, L). Ties go to the lower label."""
    steps, n = scores.shape
    back = np.zeros((steps, n), np.int32)
    best = scores[0]
    for t in range(1, steps):
        total = best[:, None] + trans
        back[t] = total.argmax(0)
        best = total.max(0) + scores[t]
    out = np.empty(steps, np.int64)
    out[-1] = best.argmax()
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def viterbi_batch(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels (T, B) of padded sequences; scores (T, B, L)."""
    steps, batch, n = scores.shape
    back = np.zeros((steps, batch, n), np.int8)
    best = scores[0].copy()
    for t in range(1, steps):
        total = best[:, :, None] + trans[None]
        back[t] = total.argmax(1)
        new = total.max(1) + scores[t]
        stop = t >= lengths
        back[t, stop] = np.arange(n)
        best = np.where(stop[:, None], best, new)
    out = np.empty((steps, batch), np.int64)
    out[-1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, rows, out[t]]
    return out


def train(features: list[np.ndarray], owners: list[np.ndarray], labels: list[np.ndarray], n_features: int, n_labels: int, steps: int = 240, batch: int = 32, rate: float = 0.3, l2: float = 1e-4, seed: int = 7):
    """Weights (n_features, n_labels) and transitions by AdaGrad on the
    conditional log-likelihood.

    Sequence i has positions len(labels[i]); features[i] are feature ids and
    owners[i] the position that each belongs to.
    """
    rng = np.random.default_rng(seed)
    w, t = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(steps):
        pick = rng.integers(0, len(labels), min(batch, len(labels)))
        lengths = np.array([len(labels[i]) for i in pick])
        longest, many = int(lengths.max()), len(pick)
        ids = np.concatenate([features[i] for i in pick])
        cell = np.concatenate([owners[i] * many + b for b, i in enumerate(pick)])
        scores = np.stack([np.bincount(cell, w[ids, k], longest * many) for k in range(n_labels)], 1).reshape(longest, many, n_labels)
        post, _, expected, live = pair_counts(scores, lengths, t)
        truth = np.zeros_like(post)
        observed = np.zeros_like(t)
        for b, i in enumerate(pick):
            truth[np.arange(lengths[b]), b, labels[i]] = 1
            np.add.at(observed, (labels[i][:-1], labels[i][1:]), 1)
        miss = ((truth - post) * live[:, :, None]).reshape(-1, n_labels)
        total = lengths.sum()
        grad = np.stack([np.bincount(ids, miss[cell, k], n_features) for k in range(n_labels)], 1) / total - l2 * w
        gw += grad**2
        w += rate * grad / np.sqrt(gw)
        grad = (observed - expected) / total - l2 * t
        gt += grad**2
        t += rate * grad / np.sqrt(gt)
    return w, t
