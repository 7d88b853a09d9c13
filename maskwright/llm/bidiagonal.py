"""Singular values and right singular vectors of a small square matrix.

Householder reflections make it bidiagonal; differential quotient-difference
steps with shifts give its singular values to high relative accuracy, also the
small ones; each vector follows from the two factorisations, from the top and
from the bottom, of the shifted product, joined at the row where they fit best.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Vectors whose values are this close, relative to the largest, are made orthogonal to each other.
NEAR = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal ``a``, superdiagonal ``b`` and ``w``, so that matrix @ w has the bidiagonal's singular values and vectors."""
    m = np.array(matrix, np.float64)
    n = m.shape[1]
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """The unit vector whose reflection takes ``x`` to its first axis."""
        size = np.abs(x).max(initial=0.0)
        if not size or not np.abs(x[1:]).max(initial=0.0):
            return None
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(m[k:, k])
        if v is not None:
            m[k:, k:] -= np.outer(2 * v, v @ m[k:, k:])
        if k < n - 2:
            v = reflector(m[k, k + 1 :])
            if v is not None:
                m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ v, 2 * v)
                w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, 2 * v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential step: the squares of the next bidiagonal, and what was left before each row's ``e``."""
    d = q[0] - shift
    new_q, new_e, left = [], [], [d]
    for k in range(len(e)):
        whole = d + e[k]
        ratio = q[k + 1] / whole if whole else 0.0
        new_q.append(whole)
        new_e.append(e[k] * ratio)
        d = (d * ratio if whole else q[k + 1]) - shift
        left.append(d)
    return [*new_q, d], new_e, left


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling.

    A step without a shift leaves, row by row, the inverses of the diagonal of
    the product's inverse; their sum bounds the smallest value from below, so
    it is a safe shift. Where rounding makes it too large, it is halved.
    """
    q, e = [float(x) ** 2 for x in a], [float(x) ** 2 for x in b]
    out, taken = [], 0.0
    budget = 200 * len(q) + 200
    while q:
        if len(q) == 1 or e[-1] <= EPS * EPS * (taken + q[-1]):
            out.append(q.pop() + taken)
            if e:
                e.pop()
            continue
        budget -= 1
        if budget < 0:
            raise ArithmeticError("singular values did not converge")
        q, e, left = _step(q, e, 0.0)
        least = min(left)
        shift = (1 - 8 * EPS) / sum(1 / x for x in left) if least > 0 else 0.0
        while shift > EPS * EPS * taken:
            next_q, next_e, rest = _step(q, e, shift)
            if min(rest) >= 0:
                q, e, taken = next_q, next_e, taken + shift
                break
            shift /= 2
    return np.sort(np.array(out))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from the top and from the bottom, and the misfit of joining them at each row."""
    n = len(a)
    tiny = EPS * EPS * max(value, float(np.max(a * a, initial=0)), 1e-300)
    q, low = a * a, np.divide(b, a[:-1])
    plus, minus = np.zeros(n - 1), np.zeros(n - 1)
    s = np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        d = s[k] + q[k]
        d = d if abs(d) > tiny else -tiny
        plus[k] = q[k] * low[k] / d
        s[k + 1] = plus[k] * low[k] * s[k] - value
    p = q[n - 1] - value
    misfit = np.empty(n)
    misfit[n - 1] = s[n - 1] + q[n - 1]
    for k in range(n - 2, -1, -1):
        d = q[k] * low[k] * low[k] + p
        d = d if abs(d) > tiny else -tiny
        t = q[k] / d
        minus[k] = low[k] * t
        p = p * t - value
        misfit[k] = s[k] + p + value
    return plus, minus, misfit


def _vector(plus: np.ndarray, minus: np.ndarray, at: int) -> np.ndarray:
    n = len(plus) + 1
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -minus[k] * z[k]
    size = np.abs(z).max()
    z = z / size
    return z / np.linalg.norm(z)


def _without_zeros(a: np.ndarray, b: np.ndarray, zero: float) -> None:
    """Empty the rows whose diagonal is zero, by rotations of rows, which leave right singular vectors as they are."""
    for k in range(len(b)):
        if abs(a[k]) > zero:
            continue
        a[k], moved, b[k] = 0.0, b[k], 0.0
        for j in range(k + 1, len(a)):
            size = np.hypot(a[j], moved)
            if not size:
                break
            cosine, sine = a[j] / size, moved / size
            a[j] = size
            if j < len(b):
                moved, b[j] = -sine * b[j], cosine * b[j]


def _vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Right singular vectors of a bidiagonal without zeros, but for its last entry, for its largest ``values``."""
    if len(a) == 1:
        return [np.ones(1)][: len(values)]
    out: list[np.ndarray] = []
    for k, value in enumerate(values):
        plus, minus, misfit = _twisted(a, b, float(value))
        beside = [out[j] for j in range(k) if values[j] - value <= NEAR * values[0]]
        best, kept = None, 0.0
        for at in np.argsort(np.abs(misfit), kind="stable"):
            z = _vector(plus, minus, int(at))
            for _ in range(2):
                for other in beside:
                    z = z - (other @ z) * other
            size = float(np.linalg.norm(z))
            if size > kept:
                best, kept = z / size, size
            if size > 0.1:
                break
        for other in beside:
            best = best - (other @ best) * other
        out.append(best / np.linalg.norm(best))
    return out


def largest(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values, falling, and the right singular vectors as columns.

    Values below the rounding of the largest are left out. A vector's largest entry is above 0.
    """
    n = matrix.shape[1]
    size = np.abs(matrix).max(initial=0.0)
    if not size or not n:
        return np.zeros(0), np.zeros((n, 0))
    a, b, w = bidiagonal(matrix / size)
    whole = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    _without_zeros(a, b, EPS * whole / n)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * whole / n) + 1), n]
    found = []  # value, columns of the block, vector
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        values = squares(a[lo:hi], b[lo : hi - 1])[:k]
        for value, z in zip(values, _vectors(a[lo:hi], b[lo : hi - 1], values), strict=True):
            found.append((float(value), lo, z))
    found.sort(key=lambda x: (-x[0], x[1]))
    found = [x for x in found[:k] if x[0] > (4 * n * EPS) ** 2 * found[0][0]]
    values, vectors = np.array([x[0] for x in found]), np.zeros((n, len(found)))
    for j, (_, lo, z) in enumerate(found):
        v = w[:, lo : lo + len(z)] @ z
        v /= np.linalg.norm(v)
        vectors[:, j] = v if v[np.argmax(np.abs(v))] > 0 else -v
    return values * size * size, vectors
