"""Distribution tails without a statistics library."""

from __future__ import annotations

import math
from statistics import NormalDist


def chi2_1_sf(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def normal_upper_z(p: float) -> float:
    """The z that a normal variable exceeds with probability p."""
    return NormalDist().inv_cdf(1 - p)


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _tail(logs) -> float:
    """Sum of exp of logs."""
    logs = list(logs)
    if not logs:
        return 0.0
    top = max(logs)
    return 0.0 if top == -math.inf else min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    if p <= 0 or k >= n:
        return 0.0
    if p >= 1 or k < 0:
        return 1.0
    return _tail(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1, n + 1))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    if p <= 0 or k >= n:
        return 1.0 if k >= 0 else 0.0
    if p >= 1 or k < 0:
        return 0.0
    return _tail(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))


def hypergeometric_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X > k) of marked ones among `drawn` from `total`."""
    base = _log_choose(total, drawn)
    return _tail(_log_choose(marked, i) + _log_choose(total - marked, drawn - i) - base for i in range(max(k + 1, drawn - (total - marked), 0), min(marked, drawn) + 1))


def hypergeometric_cdf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X <= k)."""
    base = _log_choose(total, drawn)
    return _tail(_log_choose(marked, i) + _log_choose(total - marked, drawn - i) - base for i in range(max(drawn - (total - marked), 0), min(k, marked, drawn) + 1))


def poisson_sf(k: int, rate: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if rate <= 0:
        return 0.0
    logs, i = [], k
    while i < k + 1000:
        logs.append(i * math.log(rate) - rate - math.lgamma(i + 1))
        if i > rate and logs[-1] < logs[0] - 40:
            break
        i += 1
    return _tail(logs)
