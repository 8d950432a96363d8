"""Stationary bootstrap and search-adjusted Sharpe ratios."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, erf, exp, isfinite, log10, pi, sqrt
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
EULER = 0.5772156649015329


def block_length(x: np.ndarray) -> float:
    """Automatic mean block length of the stationary bootstrap: flat-top spectral rule with its published correction.

    The bandwidth is twice the first lag that begins a run of small autocorrelations, or the largest lag where there is none.
    """
    x = np.asarray(x, float)
    n = len(x)
    if not np.isfinite(x).all():
        raise ValueError("values must be finite")
    if n < 10:
        raise ValueError("at least 10 values are required")
    d = x - x.mean()
    if not d.any():
        return 1.0
    run = max(5, int(sqrt(log10(n))))
    most = min(ceil(sqrt(n) + run), n - 1)
    acov = np.array([d[k:] @ d[: n - k] / n for k in range(most + 1)])
    small = np.abs(acov / acov[0]) < 2 * sqrt(log10(n) / n)
    first = next((k for k in range(1, most - run + 2) if small[k : k + run].all()), most)
    m = min(2 * first, most)
    lag = np.arange(1, m + 1)
    top = np.minimum(1, 2 * (1 - lag / m))
    g, spectrum = 2 * (top * lag * acov[1 : m + 1]).sum(), acov[0] + 2 * (top * acov[1 : m + 1]).sum()
    if spectrum == 0:
        return 1.0
    return float(np.clip((g * g / spectrum**2 * n) ** (1 / 3), 1, ceil(min(3 * sqrt(n), n / 3))))


_MASK, _FACTOR = np.uint64(0xFFFFFFFF), np.uint64(0x45D9F3B)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixer of 32-bit numbers (in 64-bit ones): two rounds of shift, exclusive or and product, and a last shift."""
    x = np.asarray(x, np.uint64)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * _FACTOR & _MASK
    return (x >> np.uint64(16)) ^ x


def paths(n: int, length: float, seed: int, stream: int, draws: np.ndarray) -> np.ndarray:
    """Resampled index paths, a row a draw: each step starts anew with probability 1 / length, else goes on in a circle.

    Every number is a function of (seed, stream, draw, step), so any part of the draws can be made anywhere.
    """
    key = mixed(mixed(mixed(seed) ^ np.uint64(stream)) ^ np.asarray(draws, np.uint64))[:, None]
    t = np.arange(n, dtype=np.uint64)
    anew = mixed(key ^ (2 * t)) < 2**32 / length
    anew[:, 0] = True
    steps = np.arange(n)
    at = np.maximum.accumulate(np.where(anew, steps, 0), axis=1)
    starts = (mixed(key ^ (2 * t + np.uint64(1))) % np.uint64(n)).astype(np.int64)
    return (np.take_along_axis(starts, at, axis=1) + steps - at) % n


def sharpe(x: np.ndarray, periods: int = 252) -> np.ndarray:
    """Of the last axis; 0 for a series that doesn't move."""
    sd = x.std(axis=-1, ddof=1)
    return np.where(sd > 0, x.mean(axis=-1) / np.where(sd > 0, sd, 1), 0) * sqrt(periods)


def drawn(series: np.ndarray, signs: np.ndarray, length: float, seed: int, stream: int, draws: np.ndarray, stat=sharpe) -> np.ndarray:
    """The signed sum of a statistic over series (S, n) for each draw; all series share its path."""
    at = paths(series.shape[1], length, seed, stream, draws)
    return sum(s * stat(x[at]) for s, x in zip(signs, series))


def difference_interval(series: list[np.ndarray], signs: list[int], stat=sharpe, draws: int = 2000, level: float = 0.95, seed: int = 0, stream: int = 0, length: float | None = None) -> dict:
    """Point, interval and block length of a signed sum of a statistic over series that share every resampled path."""
    x, signs = np.stack(series), np.array(signs)
    if draws < 1 or not 0 < level < 1 or (length is not None and not 1 <= length < np.inf):
        raise ValueError("draws must be at least 1, the level within (0, 1), the block length finite and at least 1")
    if not np.isfinite(x).all():
        raise ValueError("values must be finite")
    length = length or block_length(signs @ x)
    low, high = np.quantile(drawn(x, signs, length, seed, stream, np.arange(draws), stat), [(1 - level) / 2, (1 + level) / 2])
    return {"point": float(signs @ stat(x)), "low": float(low), "high": float(high), "block_length": float(length)}


@lru_cache
def order_moments(k: int) -> tuple[float, float]:
    """Mean and standard deviation of the largest of k standard normals, by Gauss-Legendre quadrature."""
    nodes, w = np.polynomial.legendre.leggauss(400)
    z, w = 12 * nodes, 12 * w
    cdf = 0.5 * (1 + np.array([erf(v / sqrt(2)) for v in z]))
    dens = k * np.exp(-z * z / 2) / sqrt(2 * pi) * cdf ** (k - 1)
    mean = (w * z * dens).sum()
    return float(mean), float(sqrt((w * (z - mean) ** 2 * dens).sum()))


def gumbel_cdf(x: float) -> float:
    """Standardised to mean 0 and variance 1."""
    return exp(-exp(-(x * pi / sqrt(6) + EULER)))


def deflated(sharpe_: float, variance: float, trials: int, n: int, skew: float, kurt: float) -> float:
    """Probability that a per-period Sharpe ratio exceeds the expected largest of ``trials`` unskilled ones."""
    best = 0.0
    if trials > 1:
        best = sqrt(variance) * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * exp(1))))
    return NORMAL.cdf((sharpe_ - best) * sqrt(n - 1) / sqrt(1 - skew * sharpe_ + (kurt - 1) / 4 * sharpe_**2))


def location_scale(sharpe_: float, variance: float, trials: int, n: int, skew: float, kurt: float) -> tuple[float, float]:
    """The same idea with the largest order statistic's mean and spread: (normal, Gumbel) probabilities."""
    if trials < 1:
        raise ValueError("at least one trial is required")
    if variance is None or not isfinite(variance) or variance <= 0:
        raise ValueError("the variance across trials must be finite and positive")
    mean, sd = order_moments(trials)
    noise = (1 - skew * sharpe_ + (kurt - 1) / 4 * sharpe_**2) / (n - 1)
    z = (sharpe_ - sqrt(variance) * mean) / sqrt(variance * sd * sd + noise)
    return NORMAL.cdf(z), gumbel_cdf(z)
