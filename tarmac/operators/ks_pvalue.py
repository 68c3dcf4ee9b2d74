"""P-values of the two-sample Kolmogorov-Smirnov statistic for finite samples.

Samples of at most 10,000 rows a side: the exact share of lattice paths from (0, 0) to (n, m)
that leave the band of the statistic, by a recursion over diagonals that only keeps the cells
inside the band.  Larger samples: the distribution of the one-sample statistic at the effective
size n m / (n + m), itself exact (powers of Durbin's matrix) up to 10,000 and by the Pelz-Good
expansion, whose error falls with the square of the size, above.

All functions take one number each; ``p_value`` is the column form for one row a feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The largest sample of the exact two-sample form.
EXACT_ROWS = 10_000


def lattice_tail(n: int, m: int, d: float) -> float:
    """P(D >= d) for samples of n and m rows without ties: paths that leave the band.

    ``d`` is a difference of multiples of 1/n and 1/m; rounding errors in it do not matter.
    The share that left is followed, not the share that stayed, so small values are exact too.
    """
    small, large = sorted((n, m))
    common = math.gcd(n, m)
    a, b = small // common, large // common
    edge = round(d * a * b * common)  # d in units of 1 / lcm
    if edge <= 0:
        return 1.0
    left, low = np.ones(0), 0  # shares of the last diagonal's cells inside the band, and the first of them
    for s in range(small + large + 1):
        # Of diagonal s the cells (i, s - i) with |i b - (s - i) a| < edge.
        first = max(0, s - large, (s * a - edge) // (a + b) + 1)
        last = min(small, s, -((-s * a - edge) // (a + b)) - 1)
        if last < first:
            return 1.0
        if s == 0:
            left, low = np.zeros(1), 0
            continue
        # A cell's neighbours are (i - 1, j) and (i, j - 1); outside the band all paths have left.
        wide = np.ones(last - first + 2)
        at, end = low - (first - 1), low - (first - 1) + len(left)
        wide[max(0, at):min(end, len(wide))] = left[max(0, -at):len(left) - max(0, end - len(wide))]
        i = np.arange(first, last + 1)
        left, low = (wide[:-1] * i + wide[1:] * (s - i)) / s, first
    return float(left[small - low])


def durbin_tail(n: int, d: float) -> float:
    """P(D_n >= d) of the one-sample statistic, by the power of Durbin's matrix."""
    k = math.ceil(n * d)
    h = k - n * d
    size = 2 * k - 1
    matrix = (np.arange(size)[:, None] - np.arange(size)[None] + 1 >= 0).astype(float)
    powers = h ** np.arange(1, size + 1)
    matrix[:, 0] -= powers
    matrix[-1] -= powers[::-1]
    matrix[-1, 0] += max(0.0, 2 * h - 1) ** size
    steps = np.arange(size)[:, None] - np.arange(size)[None] + 1
    log_factorial = np.array([math.lgamma(x + 1) for x in range(size + 1)])
    matrix = np.where(steps >= 0, matrix * np.exp(-log_factorial[np.maximum(steps, 0)]), 0)
    # The power with a running exponent; n! / n^n is spread over its steps.
    result, exponent, base, base_exponent, left = np.eye(size), 0.0, matrix, 0.0, n
    while left:
        if left & 1:
            result, exponent = result @ base, exponent + base_exponent
            scale = result.max()
            result, exponent = result / scale, exponent + math.log(scale)
        left >>= 1
        if left:
            base, base_exponent = base @ base, 2 * base_exponent
            scale = base.max()
            base, base_exponent = base / scale, base_exponent + math.log(scale)
    inside = result[k - 1, k - 1]
    if inside <= 0:
        return 1.0
    return 1.0 - math.exp(math.log(inside) + exponent + math.lgamma(n + 1) - n * math.log(n))


def one_sided_tail(n: int, d: float) -> float:
    """P(D+ >= d) of the one-sample statistic: a finite sum, terms by logarithms."""
    j = np.arange(0, math.floor(n * (1 - d)) + 1)
    j = j[n * (1 - d) - j > 0]
    log_choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in j.tolist()])
    return float(d * np.exp(log_choose + (j - 1) * np.log(d + j / n) + (n - j) * np.log1p(-d - j / n)).sum())


def pelz_good_tail(n: float, d: float) -> float:
    """P(D_n >= d) by the expansion in powers of 1 / sqrt(n), to the third."""
    z = d * math.sqrt(n)
    p2, z2 = math.pi ** 2, z * z
    odd = [(k + 0.5) ** 2 * p2 for k in range(100)]
    whole = [k * k * p2 for k in range(1, 100)]
    w = [math.exp(-x / (2 * z2)) for x in odd]
    v = [math.exp(-x / (2 * z2)) for x in whole]
    k0 = sum(w) / z
    k1 = sum((x - z2) * e for x, e in zip(odd, w)) / (6 * z ** 4)
    k2 = (sum((6 * z ** 6 + 2 * z ** 4 + (2 * z ** 4 - 5 * z2) * x + (1 - 2 * z2) * x * x) * e for x, e in zip(odd, w)) / (72 * z ** 7)
          - sum(x * e for x, e in zip(whole, v)) / (36 * z ** 3))
    k3 = (sum((-30 * z ** 6 - 90 * z ** 8 + (135 * z ** 4 - 96 * z ** 6) * x + (-60 * z2 + 212 * z ** 4) * x * x
               + (5 - 30 * z2) * x ** 3) * e for x, e in zip(odd, w)) / (6480 * z ** 10)
          + sum((3 * x * z2 - x * x) * e for x, e in zip(whole, v)) / (216 * z ** 6))
    inside = math.sqrt(2 * math.pi) * (k0 + k1 / math.sqrt(n) + k2 / n + k3 / n ** 1.5)
    return min(1.0, max(0.0, 1.0 - inside))


def one_sample_tail(n: int, d: float) -> float:
    """P(D_n >= d) of the one-sample statistic of n rows."""
    t = n * d * d
    if n * d <= 0.5:
        return 1.0
    if d >= 1 or t > 350:
        return 0.0
    if n <= EXACT_ROWS:
        # Both sides at once is rarer than 1e-15 of one side there.
        return min(1.0, 2 * one_sided_tail(n, d)) if t > 4 or d >= 0.5 else max(0.0, durbin_tail(n, d))
    # Beyond t = 18 (below 1e-15) the expansion's rounding errors are larger than its value.
    return 2 * math.exp(-2 * (d + 1 / (6 * n)) ** 2 * n) if t > 18 else pelz_good_tail(n, d)


def two_sample_tail(n: int, m: int, d: float) -> float:
    """The p-value of a two-sided two-sample statistic ``d`` of n and m rows."""
    if max(n, m) <= EXACT_ROWS:
        return lattice_tail(n, m, d)
    return one_sample_tail(round(n * m / (n + m)), d)


def _p_values(n: pd.Series, m: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([two_sample_tail(int(a), int(b), c) if a and b and c == c else None for a, b, c in zip(n, m, d)], dtype="float64")


def p_value(n, m, d):
    """Column form: sizes of the samples and the statistic; for tables of one row a test."""
    return F.pandas_udf(_p_values, "double")(n, m, d)
