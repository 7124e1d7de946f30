"""Singular values and right singular vectors of a small triangular matrix: Householder, dqds, twisted factorisations.

The squared entries of an upper bidiagonal B are its qd array: ``q`` (diagonal) and ``e`` (superdiagonal). dqds finds the
squares of the singular values from it by transformations without subtractions but of the shift, each to high relative
accuracy. A vector comes from the twisted factorisation of B^T B - lambda, taken where its twist element is least.
"""

from __future__ import annotations

import math

import numpy as np

from tracekit.llm.common import ship

ship(__name__)

EPS = float(np.finfo(np.float64).eps)


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and b such that (1 - b v v^T) x has only its first entry."""
    v, top = x.copy(), float(np.abs(x).max(initial=0))
    if top == 0 or not np.any(x[1:]):
        return v, 0.0
    v /= top
    v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
    return v, 2 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal a, superdiagonal b, V) of B = U^T r V for a square r; a and b are not negative."""
    m, n = r.astype(np.float64, copy=True), r.shape[1]
    turned = np.eye(n)
    for j in range(n):
        v, c = _reflector(m[j:, j])
        if c:
            m[j:, j:] -= np.outer(c * v, v @ m[j:, j:])
        if j < n - 2:
            v, c = _reflector(m[j, j + 1:])
            if c:
                m[j:, j + 1:] -= np.outer(m[j:, j + 1:] @ v, c * v)
                turned[:, j + 1:] -= np.outer(turned[:, j + 1:] @ v, c * v)
    a, b = np.diagonal(m).copy(), np.diagonal(m, 1).copy()
    signs = np.cumprod(np.concatenate([[1.0], np.where(a[:-1] * b < 0, -1.0, 1.0)])) if n else np.ones(0)
    return np.abs(a), np.abs(b), turned * signs


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transformation, or None where the shift is above the least value."""
    d = least = q[0] - shift
    to_q, to_e = [], []
    for i in range(len(e)):
        if d < 0:
            return None
        x = d + e[i]
        if x == 0:
            return None
        t = q[i + 1] / x
        to_q.append(x)
        to_e.append(e[i] * t)
        d = d * t - shift
        least = min(least, d)
    if not least >= 0:
        return None
    to_q.append(d)
    return to_q, to_e, least


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared singular values of the bidiagonal (a, b), falling."""
    out: list[float] = []
    top = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if top == 0:
        return np.zeros(len(a))
    parts = [([float(x) for x in (a / top) ** 2], [float(x) for x in (b / top) ** 2], 0.0)]
    while parts:
        q, e, moved = parts.pop()
        sweeps = 0
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (q[i] + q[i + 1] + moved) or e[i] < 1e-300), None)
            if cut is not None:  # a negligible coupling: two problems
                parts.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if len(q) == 1:
                out.append(moved + q[0])
                break
            if q[-1] > 1.5 * q[0]:
                q, e = q[::-1], e[::-1]
            # the lesser value of the last two rows, a little lowered, is mostly below the least of all
            s, p = q[-1] + q[-2] + e[-1], q[-1] * q[-2]
            guess = 2 * p / (s + math.sqrt(max(0.0, s * s - 4 * p))) if s else 0.0
            for shift in (guess * (1 - 1e-8) - e[-1] * 1e-2, guess * 0.5, guess * 0.05, 0.0):
                if shift >= 0 and (done := _sweep(q, e, shift)):
                    q, e, _ = done
                    moved += shift
                    break
            else:  # a zero on the diagonal whose coupling is zero as well
                e = [x if x > 1e-290 else 0.0 for x in e]
            sweeps += 1
            if sweeps > 200 * (len(a) + 1):
                raise ArithmeticError("dqds has not converged")
    return np.sort(np.array(out))[::-1] * top * top


def _solve(x: np.ndarray, pivots: list[float], factors: list[float]) -> np.ndarray:
    """(B^T B - lambda) y = x by its stationary factors."""
    y = x.tolist()
    for i in range(1, len(y)):
        y[i] -= factors[i - 1] * y[i - 1]
    y = [v / p for v, p in zip(y, pivots)]
    for i in range(len(y) - 2, -1, -1):
        y[i] -= factors[i] * y[i + 1]
    y = np.array(y)
    return y / np.abs(y).max()


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B^T B (columns) for the given squared singular values, orthogonal to each other."""
    n = len(a)
    q, e, t = (a * a).tolist(), (b * b).tolist(), (a[:-1] * b).tolist()
    tiny = EPS * EPS * max(float(np.max(values, initial=0)), 1e-280)
    kept = np.empty((n, 0))
    rng = np.random.default_rng(0)
    for value in map(float, values):
        s, p = [-value], [0.0] * n
        down, up, low = [], [0.0] * max(n - 1, 0), [0.0] * max(n - 1, 0)
        for i in range(n):
            x = s[i] + q[i]
            down.append(x if abs(x) > tiny else tiny)
            if i < n - 1:
                low[i] = t[i] / down[i]
                s.append(e[i] * s[i] / down[i] - value)
        p[-1] = q[-1] - value
        for i in range(n - 2, -1, -1):
            x = e[i] + p[i + 1]
            x = x if abs(x) > tiny else tiny
            up[i] = t[i] / x
            p[i] = p[i + 1] * q[i] / x - value
        twist = int(np.argmin(np.abs(np.array(s) + np.array(p) + value)))
        z = [0.0] * n
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -low[i] * z[i + 1]
        for i in range(twist, n - 1):
            z[i + 1] = -up[i] * z[i]
        z = np.array(z)
        z /= np.linalg.norm(z)
        rest = z - kept @ (kept.T @ z)
        if np.linalg.norm(rest) < 0.9:  # one of a cluster: iterate beside those found
            rest = rng.standard_normal(n)
            for _ in range(6):
                rest -= kept @ (kept.T @ rest)
                rest = _solve(rest / np.linalg.norm(rest), down, low)
        for _ in range(2):
            rest -= kept @ (kept.T @ rest)
            rest /= np.linalg.norm(rest)
        kept = np.column_stack([kept, rest])
    return kept


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as rows) of the k greatest of a triangular r."""
    n = r.shape[1]
    square = np.zeros((n, n))
    square[:len(r)] = r
    a, b, turned = bidiagonal(square)
    values = squared_values(a, b)[:k]
    found = (turned @ vectors(a, b, values)).T
    at = np.abs(found).argmax(axis=1)
    return values, found * np.sign(found[np.arange(len(found)), at])[:, None]
