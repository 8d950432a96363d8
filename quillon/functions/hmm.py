"""Gaussian hidden Markov regimes: filtering, EM, information criteria and state alignment."""

from __future__ import annotations

from dataclasses import dataclass
from math import sumprod
from operator import mul

import numpy as np

#: Floors and ridges of the model's definition.
DENSITY_FLOOR, EMISSION_RIDGE, COVARIANCE_RIDGE, DISTANCE_RIDGE = 1e-300, 1e-8, 1e-6, 1e-8


@dataclass
class Regimes:
    """start (K), step (K, K), means (K, F), covs (K, F, F); loglik is that of the last E-step before the last M-step."""

    start: np.ndarray
    step: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = float("nan")
    steps: int = 0

    def permuted(self, p: np.ndarray) -> "Regimes":
        return Regimes(self.start[p], self.step[np.ix_(p, p)], self.means[p], self.covs[p], self.loglik, self.steps)


def gaussian(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    low = np.linalg.cholesky(cov)
    z = np.linalg.solve(low, (x - mean).T)
    return np.exp(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * len(mean) * np.log(2 * np.pi))


def emissions(m: Regimes, x: np.ndarray) -> np.ndarray:
    ridge = EMISSION_RIDGE * np.eye(x.shape[1])
    return np.maximum(np.stack([gaussian(x, mu, c + ridge) for mu, c in zip(m.means, m.covs)], axis=1), DENSITY_FLOOR)


def filtered(m: Regimes, dens: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(P(state | past and present), scale of each day); ``prior`` continues an earlier run."""
    alpha, scale = [], []
    now = (m.start if prior is None else prior @ m.step).tolist()
    into = m.step.T.tolist()
    for b in dens.tolist():
        a = list(map(mul, now, b))
        total = sum(a)
        a = [v / total for v in a]
        alpha.append(a)
        scale.append(total)
        now = [sumprod(a, c) for c in into]
    return np.array(alpha).reshape(dens.shape), np.array(scale)


def smoothed(m: Regimes, dens: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(state | all), expected transitions, log-likelihood)."""
    alpha, scale = filtered(m, dens)
    out_of, z, later = m.step.tolist(), [1.0] * len(m.start), []
    for b in (dens[:0:-1] / scale[:0:-1, None]).tolist():
        later.append(z)
        v = list(map(mul, b, z))
        z = [sumprod(v, r) for r in out_of]
    beta = np.array([z, *reversed(later)])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    ahead = dens[1:] * beta[1:] / scale[1:, None]
    return gamma, m.step * (alpha[:-1].T @ ahead), float(np.log(scale).sum())


def fit(x: np.ndarray, states: int, seed: int = 0, rounds: int = 200, tolerance: float = 1e-4, begin: Regimes | None = None) -> Regimes:
    """EM from random rows as means and the global covariance, or from ``begin``."""
    t, f = x.shape
    ridge = COVARIANCE_RIDGE * np.eye(f)
    if begin is None:
        rows = np.random.default_rng(seed).choice(t, size=states, replace=False)
        cov = np.cov(x.T).reshape(f, f) + ridge
        m = Regimes(np.full(states, 1 / states), np.full((states, states), 1 / states), x[rows].copy(), np.repeat(cov[None], states, axis=0))
    else:
        m = Regimes(begin.start.copy(), begin.step.copy(), begin.means.copy(), begin.covs.copy())
    last = -np.inf
    for k in range(rounds):
        gamma, moves, ll = smoothed(m, emissions(m, x))
        mass = gamma.sum(axis=0)
        means = gamma.T @ x / mass[:, None]
        covs = np.stack([((x - mu) * g[:, None]).T @ (x - mu) / w + ridge for mu, g, w in zip(means, gamma.T, mass)])
        m = Regimes(gamma[0], moves / moves.sum(axis=1, keepdims=True), means, covs, ll, k + 1)
        if abs(ll - last) < tolerance:
            break
        last = ll
    return m


def bic(m: Regimes, n: int) -> float:
    k, f = m.means.shape
    free = k * f + k * f * (f + 1) / 2 + k * (k - 1) + (k - 1)
    return -2 * m.loglik + free * np.log(n)


def bhattacharyya(mean_a, cov_a, mean_b, cov_b) -> float:
    eye = DISTANCE_RIDGE * np.eye(len(mean_a))
    a, b = cov_a + eye, cov_b + eye
    mid = (a + b) / 2
    (sa, la), (sb, lb), (sm, lm) = (np.linalg.slogdet(c) for c in (a, b, mid))
    if min(sa, sb, sm) <= 0:
        return float("inf")
    d = np.asarray(mean_a) - np.asarray(mean_b)
    return float(d @ np.linalg.solve(mid, d) / 8 + 0.5 * (lm - 0.5 * (la + lb)))


def aligned(m: Regimes, reference: Regimes) -> Regimes:
    """States in the order that is closest to the reference's: an assignment of least total distance, by subsets of states."""
    k = len(m.start)
    cost = np.array([[bhattacharyya(m.means[i], m.covs[i], reference.means[j], reference.covs[j]) for j in range(k)] for i in range(k)])
    found = {0: (0.0, ())}  # by the states that are taken: the least cost of the reference's first states, and the order
    for j in range(k):
        ahead: dict[int, tuple] = {}
        for taken, (total, order) in found.items():
            for i in range(k):
                if not taken >> i & 1:
                    new = (total + cost[i, j], (*order, i))
                    ahead[taken | 1 << i] = min(ahead.get(taken | 1 << i, new), new)
        found = ahead
    return m.permuted(np.array(found[(1 << k) - 1][1]))
