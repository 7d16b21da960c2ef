"""Small numeric helpers for arrays that Spark has already reduced: least squares and tail probabilities."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_tail(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction (modified Lentz), elementwise."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    zs = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zs) + q * np.log1p(-zs)) / p
    floor = 1e-300
    c, d = np.ones_like(zs), 1 - (p + q) * zs / (p + 1)
    d = 1 / np.where(np.abs(d) < floor, floor, d)
    fraction = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * zs / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * zs / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / np.where(np.abs(d) < floor, floor, d)
            c = np.where(np.abs(c) < floor, floor, c)
            fraction = fraction * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(inside, front * fraction, np.where(z <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def f_pvalue(f, df1, df2) -> np.ndarray:
    """P(F > f)."""
    f, df1, df2 = np.asarray(f, float), np.asarray(df1, float), np.asarray(df2, float)
    return beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_pvalue(t, df) -> np.ndarray:
    """P(|T| > |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def solve_normal(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, inverse and rank for stacked normal equations; directions without data get zero.

    The system is scaled to a unit diagonal before the pseudo-inverse, so that its cut-off does not depend on units.
    """
    scale = np.sqrt(np.einsum("bii->bi", xx))
    scale = np.where(scale > 0, scale, 1.0)
    unit = xx / scale[:, :, None] / scale[:, None, :]
    inverse = np.linalg.pinv(unit, rcond=1e-11, hermitian=True)
    rank = np.rint(np.einsum("bij,bji->b", unit, inverse))
    inverse = inverse / scale[:, :, None] / scale[:, None, :]
    return np.einsum("bij,bj->bi", inverse, xy), inverse, rank


def condition_number(xx: np.ndarray) -> np.ndarray:
    """Condition number of the design matrix behind each Gram matrix; NaN where the design is singular to rounding."""
    values = np.linalg.eigvalsh(xx)
    least, most = values[:, 0], values[:, -1]
    regular = least > most * xx.shape[-1] * np.finfo(float).eps
    return np.sqrt(np.where(regular, most / np.where(regular, least, 1.0), np.nan))
