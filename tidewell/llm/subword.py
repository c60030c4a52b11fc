"""Subword-bag linear softmax in numpy, shared by two classifiers.

A piece of text is a bag of hashed byte n-grams that stay inside one word (with
its edges as marks).  Their embeddings are averaged and go through a linear
softmax; embeddings and softmax are trained jointly by stochastic gradient
descent.  For scoring, embeddings times softmax is folded into one table of
class weights per bucket, so scoring is a gather and a sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textbuf import TextBlock, word_hashes

ORDERS = (3, 4, 5)
BITS = 17


def buckets(block: TextBlock, orders=ORDERS, bits: int = BITS):
    """For each order: (bucket of the n-gram that begins at each byte, whether it counts)."""
    b = block.buf.astype(np.uint64)
    inside = block.buf != 0
    n = len(b)
    gram = b.copy()
    ok = np.ones(n, bool)
    for order in range(2, max(orders) + 1):
        gram = (gram[: n - order + 1] << np.uint64(8)) | b[order - 1 :]
        if order > 2:
            ok = ok[: n - order + 1] & inside[order - 2 : n - 1]
        else:
            ok = ok[: n - 1]
        if order in orders:
            h = (gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield order, (h >> np.uint64(64 - bits)).astype(np.int64), ok


@dataclass
class Model:
    """Folded weights: logit of a bag = mean of table rows + bias."""

    classes: list
    table: np.ndarray
    bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    floor: float = 0.0
    prior: float = 0.1  # share of label 1 among the training labels of a two-class model
    known: np.ndarray | None = None  # buckets that were seen often enough to say something


def windows(block: TextBlock, size: int, step: int):
    """Runs of `size` words every `step` words, over all words: (row, byte start, byte stop)."""
    count = np.diff(block.first_word)
    per = np.where(count > 0, np.maximum(1, -(-(count - size) // step) + 1), 0)
    row = np.repeat(np.arange(len(per)), per)
    k = np.arange(len(row)) - np.concatenate(([0], np.cumsum(per)))[row]
    a = block.first_word[row] + k * step
    z = np.minimum(a + size, block.first_word[row + 1])
    return row, block.word_start[a] - 1, block.word_end[z - 1] + 1


def bags(block: TextBlock, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat buckets of some byte ranges, and the offset of each range."""
    parts, owner = [], []
    for order, bucket, ok in buckets(block):
        length = np.maximum(stop - start - order + 1, 0)
        own = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(own)) - np.concatenate(([0], np.cumsum(length)))[own] + start[own]
        keep = ok[at]
        parts.append(bucket[at[keep]].astype(np.int32))
        owner.append(own[keep].astype(np.int32))
    flat, own = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return flat[order], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(start)))))


def train(flat: np.ndarray, offset: np.ndarray, label: np.ndarray, classes: list, *, weight: np.ndarray | None = None, dim: int = 8, epochs: int = 4, rate: float = 0.5, batch: int = 64, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax; Adagrad steps on small batches."""
    rng = np.random.default_rng(seed)
    k, rows = len(classes), 1 << BITS
    emb = rng.uniform(-0.5 / dim, 0.5 / dim, (rows, dim)).astype(np.float32)
    emb_sq = np.full(rows, 1e-4, np.float32)
    out = rng.uniform(-0.5, 0.5, (dim, k)).astype(np.float32)
    out_sq = np.full((dim, k), 1e-2, np.float32)
    bias, bias_sq = np.zeros(k, np.float32), np.full(k, 1e-2, np.float32)
    size = np.diff(offset)
    usable = np.flatnonzero(size > 0)
    weight = np.ones(len(label), np.float32) if weight is None else weight.astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(usable)
        lr = rate * (1 - epoch / epochs) + 0.05
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            n = size[pick]
            own = np.repeat(np.arange(len(pick)), n)
            idx = flat[np.arange(int(n.sum())) - np.concatenate(([0], np.cumsum(n)))[own] + offset[pick][own]]
            mean = np.add.reduceat(emb[idx], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
            logit = mean @ out + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            p *= weight[pick][:, None]
            g_out, g_bias, g_mean = mean.T @ p, p.sum(0), (p @ out.T) / np.sqrt(n)[:, None]
            out_sq += g_out**2
            out -= lr * 0.2 * g_out / np.sqrt(out_sq)
            bias_sq += g_bias**2
            bias -= lr * 0.2 * g_bias / np.sqrt(bias_sq)
            touched, inv = np.unique(idx, return_inverse=True)
            g = np.empty((len(touched), dim), np.float32)
            for d in range(dim):
                g[:, d] = np.bincount(inv, g_mean[own, d], len(touched))
            emb_sq[touched] += (g**2).mean(1)
            emb[touched] -= lr * g / np.sqrt(emb_sq[touched])[:, None]
    return Model(classes, emb @ out, bias)


def echoes(block: TextBlock, reach: int) -> np.ndarray:
    """Marks the bytes where n-grams of words begin that stand among the `reach` words before, too."""
    words = word_hashes(block)
    row = np.repeat(np.arange(len(block.start)), np.diff(block.first_word))
    again = np.zeros(len(words), bool)
    for k in range(1, min(reach, len(words) - 1) + 1):
        again[k:] |= (words[k:] == words[:-k]) & (row[k:] == row[:-k])
    edge = np.zeros(len(block.buf) + 1, np.int8)
    edge[block.word_start[again] - 1] += 1
    edge[block.word_end[again]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def range_logits(model: Model, block: TextBlock, start: np.ndarray, stop: np.ndarray, reach: int = 0) -> np.ndarray:
    """Logits of byte ranges for a two-class model: class 1 against class 0, scored by prefix sums.

    With `reach`, a word that was said within that many words before adds its
    length to the mean but no evidence, so a run of one word is not many proofs.
    """
    silent = echoes(block, reach) if reach else None
    known = model.known if model.known is not None else np.ones(len(model.table), bool)
    weight = (model.table[:, 1] - model.table[:, 0]).astype(np.float32)
    n = len(block.buf)
    total, count = np.zeros(len(start)), np.zeros(len(start))
    for order, bucket, ok in buckets(block):
        value = weight[bucket]
        ok = ok & known[bucket]
        value[~ok] = 0
        if silent is not None:
            value[silent[: len(value)]] = 0
        sums = np.zeros(n + 1)
        np.cumsum(value, dtype=np.float64, out=sums[1 : len(value) + 1])
        many = np.zeros(n + 1, np.int64)
        np.cumsum(ok, out=many[1 : len(ok) + 1])
        last = np.clip(stop - order + 1, start, len(value))
        total += sums[last] - sums[start]
        count += many[last] - many[start]
    return total / np.maximum(count, 1) + float(model.bias[1] - model.bias[0])


def row_logits(model: Model, block: TextBlock) -> np.ndarray:
    """Logits of whole rows, one column a class."""
    k = len(model.classes)
    total = np.zeros((len(block.start), k))
    count = np.zeros(len(block.start))
    table = model.table.astype(np.float32)
    for order, bucket, ok in buckets(block):
        at = np.flatnonzero(ok)
        bound = np.searchsorted(at, np.stack((block.start - 1, np.maximum(block.end + 2 - order, block.start - 1))))
        value = table[bucket[at]]
        value = np.concatenate((value, np.zeros((1, k), np.float32)))
        if len(block.start):
            # reduceat over [start, stop) pairs; empty ranges are set to zero below
            edges = bound.T.reshape(-1)
            total += np.where((bound[1] > bound[0])[:, None], np.add.reduceat(value, edges, axis=0, dtype=np.float64)[::2], 0)
        count += bound[1] - bound[0]
    return total / np.maximum(count, 1)[:, None] + model.bias


def softmax(logit: np.ndarray) -> np.ndarray:
    p = np.exp(logit - logit.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit_line(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Platt scaling: a, b that make sigmoid(a x + b) fit y, by damped Newton steps with a small ridge."""
    mean, sd = float(np.average(x, weights=w)), float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)) + 1e-9)
    z = (x - mean) / sd
    theta = np.zeros(2)
    target = np.where(y > 0, 0.995, 0.005)
    basis = np.stack((z, np.ones_like(z)), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(basis @ theta, -30, 30)))
        grad = basis.T @ (w * (p - target)) + 1e-2 * theta
        hess = (basis * (w * p * (1 - p))[:, None]).T @ basis + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
    return theta[0] / sd, theta[1] - theta[0] * mean / sd
