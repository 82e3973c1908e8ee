"""Tail probabilities and small linear inference, on the driver: results have a handful of numbers."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _series(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail: the lower incomplete gamma series, or a continued fraction where it converges faster."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    if y < a + 1:
        return 1 - _series(a, y)
    b, c = y + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-y + a * math.log(y) - math.lgamma(a))


def beta_ratio(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by numerical integration of a smooth substitution (Gauss-Legendre)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(1 - x, b, a)
    # t = x u**(1/a) removes the singularity at 0 for any a > 0.
    nodes, weights = np.polynomial.legendre.leggauss(200)
    u = (nodes + 1) / 2
    values = (1 - x * u ** (1 / a)) ** (b - 1)
    total = float((weights / 2 * values).sum()) * x**a / a
    return total * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def f_tail(x: float, d1: int, d2: int) -> float:
    return 1.0 if x <= 0 else beta_ratio(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def wald(estimates, covariance) -> tuple[float, int, float]:
    """(statistic, rank, p) of all estimates being 0, by the pseudo-inverse."""
    b, v = np.asarray(estimates, float), np.atleast_2d(np.asarray(covariance, float))
    rank = int(np.linalg.matrix_rank(v))
    value = float(b @ np.linalg.pinv(v) @ b)
    return value, rank, chi2_tail(value, rank) if rank else float("nan")


def hotelling(rows) -> tuple[float, float]:
    """(T squared, p) of a zero mean vector, by its exact F distribution; NaN where rows are too few."""
    x = np.asarray(rows, float)
    n, k = x.shape
    if n <= k:
        return float("nan"), float("nan")
    mean = x.mean(axis=0)
    t2 = float(n * mean @ np.linalg.pinv(np.atleast_2d(np.cov(x, rowvar=False))) @ mean)
    return t2, f_tail(t2 * (n - k) / (k * (n - 1)), k, n - k)


def clustered_ols(x, y, cluster) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their cluster-robust (CR1) covariance."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    e = y - x @ b
    names, index = np.unique(cluster, return_inverse=True)
    sums = np.zeros((len(names), x.shape[1]))
    np.add.at(sums, index, x * e[:, None])
    g, n, k = len(names), len(y), x.shape[1]
    scale = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    return b, scale * inverse @ (sums.T @ sums) @ inverse


def consistency_ratio(matrix) -> float:
    """Consistency ratio of a 3 x 3 pairwise comparison matrix."""
    return float((np.linalg.eigvals(np.asarray(matrix, float)).real.max() - 3) / 2 / 0.58)


def checked_weights(weights, total: float = 1.0) -> list[float]:
    w = [float(x) for x in weights]
    if any(x < 0 or not math.isfinite(x) for x in w) or abs(sum(w) - total) > 1e-6:
        raise ValueError(f"weights must be non-negative and sum to {total}: {w}")
    return w
