"""Multivariate Student-t predictive densities with one pooled or several regime components."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log, pi

import numpy as np

RIDGE, FLOOR = 1e-6, 1e-300
NU_GRID = [2.5 + 0.5 * k for k in range(15)] + [10.0 + 2 * k for k in range(11)]


def weighted_moments(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = w / w.sum()
    mean = w @ x
    return mean, ((x - mean) * w[:, None]).T @ (x - mean)


def unit_loglik(z: np.ndarray, nu: float, w: np.ndarray | None = None) -> float:
    z = np.asarray(z, float)
    ok = np.isfinite(z)
    z = z[ok]
    each = lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * log(nu * pi) - (nu + 1) / 2 * np.log1p(z * z / nu)
    return float(each.sum() if w is None else (np.asarray(w)[ok] * each).sum())


def fit_nu(z: np.ndarray, grid: list[float] = NU_GRID, w: np.ndarray | None = None) -> float:
    """The first of the best candidates."""
    scores = [unit_loglik(z, v, w) for v in grid]
    return grid[int(np.argmax(scores))]


def log_t(x: np.ndarray, nu: float, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    n = len(mean)
    low = np.linalg.cholesky(scale)
    z = np.linalg.solve(low, (np.atleast_2d(x) - mean).T)
    q = (z * z).sum(axis=0)
    return lgamma((nu + n) / 2) - lgamma(nu / 2) - n / 2 * log(nu * pi) - np.log(np.diag(low)).sum() - (nu + n) / 2 * np.log1p(q / nu)


@dataclass
class Pooled:
    nu: float
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, nu: float) -> "Pooled":
        cov = np.cov(x.T) + RIDGE * np.eye(x.shape[1])
        return cls(nu, x.mean(axis=0), cov * (nu - 2) / nu)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return log_t(x, self.nu, self.mean, self.scale)


@dataclass
class Mixture:
    nus: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, probs: np.ndarray, nus: float | np.ndarray) -> "Mixture":
        nus = np.broadcast_to(np.asarray(nus, float), (probs.shape[1],)).copy()
        means, covs = zip(*(weighted_moments(x, p) for p in probs.T))
        eye = RIDGE * np.eye(x.shape[1])
        return cls(nus, np.stack(means), np.stack([(c + eye) * (v - 2) / v for c, v in zip(covs, nus)]))

    def covariances(self) -> np.ndarray:
        return self.scales * (self.nus / (self.nus - 2))[:, None, None]

    def log_density(self, x: np.ndarray, probs: np.ndarray) -> np.ndarray:
        dens = np.exp(np.stack([log_t(x, v, m, s) for v, m, s in zip(self.nus, self.means, self.scales)], axis=1))
        return np.log(np.maximum((np.atleast_2d(probs) * dens).sum(axis=1), FLOOR))
