"""Hashed character n-grams and a logistic regression on sparse rows, in NumPy."""

from __future__ import annotations

import numpy as np

_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def codes_of(text: str) -> np.ndarray:
    """Code points of ``text`` with runs of white space as one space and a space at either end."""
    return np.frombuffer(f" {' '.join(text.split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(codes: np.ndarray, sizes: range, bits: int):
    """For each n of ``sizes``, the buckets (below 2**bits) of all n-grams of ``codes``, in order."""
    with np.errstate(over="ignore"):
        h = codes * _MIX
        for n in range(2, sizes.stop):
            if len(codes) < n:
                return
            h = h[:-1] * _STEP + codes[n - 1 :]
            h ^= h >> np.uint32(15)
            if n in sizes:
                yield (h * _MIX + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)


class Rows:
    """Sparse rows: row i has the columns ``rows[i]``, with the values of ``vals[i]``, or ones without ``vals``; ``scale`` multiplies columns. Indices are kept in 32 bits."""

    def __init__(self, rows: list[np.ndarray], width: int, vals: list[np.ndarray] | None = None, scale: np.ndarray | None = None):
        self.width, self.scale = width, scale
        self.n = len(rows)
        self.cols = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.vals = np.concatenate(vals) if vals else None
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        w = w if self.scale is None else w * self.scale
        found = w[self.cols]
        if self.vals is not None:
            found *= self.vals
        return np.bincount(self.row, weights=found, minlength=self.n)

    def sum(self, g: np.ndarray) -> np.ndarray:
        found = g[self.row]
        if self.vals is not None:
            found *= self.vals
        out = np.bincount(self.cols, weights=found, minlength=self.width)
        return out if self.scale is None else out * self.scale


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, dtype=float)))


def logistic(rows: Rows, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the regularised logistic regression, by L-BFGS; the intercept is free."""
    weight = np.ones(len(y)) if weight is None else weight
    m = rows.width

    def value(p):
        z = rows.times(p[:m]) + p[m]
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * (p[:m] ** 2).sum()
        g = weight * (sigmoid(z) - y)
        return loss, np.append(rows.sum(g) + l2 * p[:m], g.sum())

    p = np.zeros(m + 1)
    rate = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
    p[m] = np.log(rate / (1 - rate))
    loss, g = value(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, coeff = g.copy(), []
        for s, t, r in reversed(past):
            coeff.append(a := r * s.dot(d))
            d -= a * t
        if past:
            d *= past[-1][0].dot(past[-1][1]) / max(past[-1][1].dot(past[-1][1]), 1e-12)
        else:
            d /= max(1.0, np.abs(g).sum())
        for (s, t, r), a in zip(past, reversed(coeff)):
            d += (a - r * t.dot(d)) * s
        slope, rate = g.dot(d), 1.0
        if slope <= 1e-10:
            break
        while rate > 1e-8:
            new_loss, new_g = value(p - rate * d)
            if new_loss <= loss - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, t = -rate * d, new_g - g
        if s.dot(t) > 1e-12:
            past = [*past[-9:], (s, t, 1 / s.dot(t))]
        done = loss - new_loss < 1e-6 * max(1.0, abs(loss))
        p, loss, g = p + s, new_loss, new_g
        if done:
            break
    return p[:m], float(p[m])
