"""Logistic regression on sparse rows, fitted with Adam on the driver, and calibration of its scores."""

from __future__ import annotations

import numpy as np

#: Features that are worked on at a time.
CHUNK = 1 << 18


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Rows:
    """Sparse rows: for each row a run of (bucket, value) pairs."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int):
        self.buckets, self.values, self.owner, self.n = buckets.astype(np.int32), values.astype(np.float32), owner.astype(np.uint16 if n <= 1 << 16 else np.int32), n

    @staticmethod
    def counted(buckets: np.ndarray, owner: np.ndarray, n: int, dims: int, scale: float, smooth: float = 0.0) -> Rows:
        """Counts of each bucket of a row, divided by ``smooth`` plus the row's number of features and multiplied by ``scale``."""
        key, count = np.unique(owner.astype(np.int64) * dims + buckets, return_counts=True)
        who = key // dims
        total = np.bincount(owner, minlength=n)
        return Rows(key % dims, count * scale / (total[who] + smooth), who, n)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("buckets", "values", "owner")), parts[0].n)

    def shifted(self, first: int, n: int) -> Rows:
        """The same rows as rows ``first``, ``first + 1``, ... of ``n``."""
        return Rows(self.buckets, self.values, self.owner.astype(np.int64) + first, n)

    def some(self, rows: np.ndarray) -> Rows:
        at = np.full(self.n, -1)
        at[rows] = np.arange(len(rows))
        mine = at[self.owner] >= 0
        return Rows(self.buckets[mine], self.values[mine], at[self.owner[mine]], len(rows))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]))
        for k in range(w.shape[1]):
            column = np.ascontiguousarray(w[:, k], np.float32)
            for at in range(0, len(self.owner), CHUNK):
                s = slice(at, at + CHUNK)
                out[:, k] += np.bincount(self.owner[s], self.values[s] * column[self.buckets[s]], self.n)
        return out

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        out = np.zeros((dims, g.shape[1]))
        for k in range(g.shape[1]):
            column = np.ascontiguousarray(g[:, k], np.float32)
            for at in range(0, len(self.owner), CHUNK):
                s = slice(at, at + CHUNK)
                out[:, k] += np.bincount(self.buckets[s], self.values[s] * column[self.owner[s]], dims)
        return out


class Blocks:
    """Rows whose features lie in several blocks of about ``BLOCK``, so that they are never copied all at once."""

    BLOCK = 1 << 20

    def __init__(self, n: int):
        self.n, self.blocks, self.open = n, [], []

    def add(self, part: Rows) -> None:
        self.open.append(part)
        if sum(len(p.owner) for p in self.open) >= self.BLOCK:
            self.close()

    def close(self) -> Blocks:
        if self.open:
            self.blocks.append(Rows.joined(self.open))
            self.open = []
        return self

    def dot(self, w: np.ndarray) -> np.ndarray:
        return sum((b.dot(w) for b in self.blocks), np.zeros((self.n, w.shape[1])))

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return sum((b.back(g, dims) for b in self.blocks), np.zeros((dims, g.shape[1])))


def _fit_binary(rows: Rows | Blocks, label: np.ndarray, dims: int, steps: int, rate: float, l2: float, weight: np.ndarray) -> tuple[np.ndarray, float]:
    w, b, m, v, mb, vb = np.zeros(dims), 0.0, np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(2 * (rows.dot(w[:, None])[:, 0] + b), -60, 60)))
        error = (p - label) * (weight / weight.sum())
        g, gb = rows.back(error[:, None], dims)[:, 0] + l2 * w, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def fit(rows: Rows | Blocks, label: np.ndarray, classes: int, dims: int, steps: int = 80, rate: float = 0.05, l2: float = 1e-6, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights (dims, classes), bias). Multinomial; of two classes the difference of columns is the usual binary model. A row of weight
    0 plays no part."""
    if classes == 2:  # the columns are each other's negative: one is enough
        w, b = _fit_binary(rows, label, dims, steps, rate, l2, np.ones(len(label)) if weight is None else weight)
        return np.stack([-w, w], axis=1), np.array([-b, b])
    w, b = np.zeros((dims, classes)), np.zeros(classes)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    weight = np.ones(len(label)) if weight is None else weight
    target = np.eye(classes)[label]
    for t in range(1, steps + 1):
        error = (_softmax(rows.dot(w) + b) - target) * (weight / weight.sum())[:, None]
        g, gb = rows.back(error, dims) + l2 * w, error.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, c) so that 1 / (1 + exp(-(a * score + c))) is the probability of label 1. Newton steps on smoothed targets."""
    if not len(score) or label.min() == label.max():
        return 1.0, 0.0
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, c = 1.0, 0.0
    x = np.stack([score, np.ones_like(score)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + c, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * np.array([a - 1, c])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(c)


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-out rows."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
