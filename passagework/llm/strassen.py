"""Products of whole-number matrices by Strassen's seven products of halves."""

from __future__ import annotations

import numpy as np

#: A side of at most this many is multiplied directly.
LEAF = 32
#: Whole numbers below this are exact in a double.
EXACT = 2 ** 53


def direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in int64; by way of doubles where no sum can leave the whole numbers that doubles hold exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return x if x.shape == (rows, columns) else np.pad(x, ((0, rows - x.shape[0]), (0, columns - x.shape[1])))


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices. Sides are padded with zeros to even length before they are halved.

    Sums and differences of halves may wrap around; the product is right as long as its own entries fit.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return direct(a, b)
    m, k, n = (-(-side // 2) for side in (rows, inner, columns))
    a, b = _padded(a, 2 * m, 2 * k), _padded(b, 2 * k, 2 * n)
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:rows, :columns]
