"""Risk budgets, hierarchical risk parity, constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def shrink(cov: np.ndarray, share: float = 0.10) -> np.ndarray:
    n = len(cov)
    return (1 - share) * cov + share * np.trace(cov) / n * np.eye(n)


def risk_shares(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    part = w * (cov @ w)
    return part / part.sum()


def risk_budget(cov: np.ndarray, budgets: np.ndarray, tolerance: float = 1e-10, rounds: int = 200) -> np.ndarray:
    """Weights whose risk shares are the budgets: minimises y'Cy/2 - b'log y by damped Newton steps, then normalises."""
    b = np.asarray(budgets, float)
    if (b <= 0).any():
        raise ValueError("budgets must be positive")
    b = b / b.sum()
    scale = np.sqrt(np.diag(cov))
    c = cov / np.outer(scale, scale)
    y = np.sqrt(b)
    value = lambda v: 0.5 * v @ c @ v - b @ np.log(v)
    for _ in range(rounds):
        grad = c @ y - b / y
        if np.abs(y * grad).max() < tolerance:
            w = y / scale
            return w / w.sum()
        step = np.linalg.solve(c + np.diag(b / y**2), -grad)
        t, now = 1.0, value(y)
        while (y + t * step <= 0).any() or value(y + t * step) > now + 1e-4 * t * (grad @ step) + 1e-15:
            t /= 2
            if t < 1e-12:
                break
        y = y + t * step
    raise RuntimeError("the risk budget solver did not converge")


def risk_budget_gradient(cov: np.ndarray, budgets: np.ndarray, w: np.ndarray) -> np.ndarray:
    """d weights / d budgets (n, n) from the optimality conditions of the barrier problem."""
    y = w * np.sqrt(1 / (w @ cov @ w))
    dy = np.linalg.solve(cov + np.diag(budgets / y**2), np.diag(1 / y))
    s = y.sum()
    return dy / s - np.outer(y, dy.sum(axis=0)) / s**2


def squared_error(w: np.ndarray, cov: np.ndarray, budgets: np.ndarray) -> float:
    """What the squared solver minimises: squared differences of risk shares and budgets."""
    return float(((risk_shares(w, cov) - budgets) ** 2).sum())


def _share_jacobian(w: np.ndarray, cov: np.ndarray) -> np.ndarray:
    m = cov @ w
    v = w @ m
    return (np.diag(m) + w[:, None] * cov) / v - np.outer(w * m / v, 2 * m / v)


def bounded_step(h: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(d, price of the sum, prices of the bounds): least d'Hd/2 + g'd with d summing to 0 within [low, high], which hold 0.

    Active sets: solve on the free entries, stop at the first bound in the way, and free the entry whose bound has the worst price.
    """
    n = len(g)
    d, side = np.zeros(n), np.where(low > -1e-15, -1, np.where(high < 1e-15, 1, 0))
    for _ in range(100 * n):
        free = np.flatnonzero(side == 0)
        slope = g + h @ d
        if len(free):
            k = len(free)
            kkt = np.block([[h[np.ix_(free, free)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
            found = np.linalg.lstsq(kkt, np.concatenate([-slope[free], [0]]), rcond=None)[0]
            p, price = found[:k], float(found[k])
        else:
            p, price = np.zeros(0), float(-np.median(slope))
        if np.abs(p).max(initial=0) > 1e-13:
            room = np.where(p > 0, high[free] - d[free], np.where(p < 0, low[free] - d[free], np.inf)) / np.where(p == 0, 1, p)
            at = int(np.argmin(room))
            t = min(1.0, max(room[at], 0.0))
            d[free] += t * p
            if t < 1:
                side[free[at]] = 1 if p[at] > 0 else -1
                d[free[at]] = high[free[at]] if p[at] > 0 else low[free[at]]
            continue
        prices = (slope + price) * -side  # at least 0 where the bound holds the entry back
        held = np.flatnonzero(side)
        if not len(held) or prices[held].min() >= -1e-12:
            return d, price, np.where(side != 0, slope + price, 0)
        side[held[np.argmin(prices[held])]] = 0
    return d, price, np.where(side != 0, slope + price, 0)


def risk_budget_squared(cov: np.ndarray, budgets: np.ndarray, bounds: tuple[float, float] = (0.0, 0.60), rounds: int = 500) -> np.ndarray:
    """Weights within ``bounds`` whose risk shares are nearest to the budgets: sequential quadratic steps from equal weights.

    The problem isn't convex, so equal weights may lead to a local optimum; where its error is above that of the exact solution
    put into the bounds, the steps start there instead. The result is never worse than that point.
    """
    n = len(cov)
    b = np.asarray(budgets, float) / np.sum(budgets)
    lim = Limits(bounds[0], bounds[1], 2.0)
    starts = [np.full(n, 1 / n)]
    if (b > 0).all():
        starts.append(project(risk_budget(cov, b), starts[0], lim))
    best = None
    for start in starts:
        if best is not None and squared_error(best, cov, b) <= squared_error(start, cov, b) + 1e-15:
            continue
        w = start
        for _ in range(rounds):
            now, j = squared_error(w, cov, b), _share_jacobian(w, cov)
            g = 2 * j.T @ (risk_shares(w, cov) - b)
            d, _, _ = bounded_step(2 * j.T @ j + 1e-9 * np.eye(n), g, bounds[0] - w, bounds[1] - w)
            t = 1.0
            while t > 1e-12 and squared_error(w + t * d, cov, b) > now + 1e-4 * t * (g @ d):
                t /= 2
            if t <= 1e-12 or np.abs(d).max() < 1e-12:
                break
            w = np.clip(w + t * d, *bounds)
            w = w / w.sum()
        if best is None or squared_error(w, cov, b) < squared_error(best, cov, b):
            best = w
    return best


#: By name: how budgets become weights.
SOLVERS = {"exact": risk_budget, "squared": risk_budget_squared}


def equal_risk(cov: np.ndarray, share: float = 0.10) -> np.ndarray:
    return risk_budget(shrink(cov, share), np.full(len(cov), 1 / len(cov)))


def leaf_order(distance: np.ndarray) -> list[int]:
    """Single-linkage order of the leaves; of two joined clusters that with the smaller number stands left."""
    n = len(distance)
    clusters = {i: [i] for i in range(n)}
    d = {(i, j): distance[i, j] for i in range(n) for j in range(i + 1, n)}
    nxt = n
    while len(clusters) > 1:
        (i, j), _ = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        merged = clusters.pop(i) + clusters.pop(j)
        for k in clusters:
            a, b = d.pop((min(i, k), max(i, k))), d.pop((min(j, k), max(j, k)))
            d[(k, nxt)] = min(a, b)
        del d[(i, j)]
        clusters[nxt] = merged
        nxt += 1
    return clusters[nxt - 1]


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Recursive bisection of the single-linkage order by inverse-variance cluster risk; the left half has floor(n / 2)."""
    sd = np.sqrt(np.diag(cov))
    dist = np.sqrt(np.maximum(0.5 * (1 - cov / np.outer(sd, sd)), 0))
    np.fill_diagonal(dist, 0)

    def risk(items: list[int]) -> float:
        sub = cov[np.ix_(items, items)]
        w = 1 / np.diag(sub)
        w /= w.sum()
        return float(w @ sub @ w)

    out, todo = np.ones(len(cov)), [leaf_order(dist)]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        a, b = risk(left), risk(right)
        out[left] *= 1 - a / (a + b)
        out[right] *= a / (a + b)
        todo += [left, right]
    return out / out.sum()


@dataclass(frozen=True)
class Limits:
    lower: float = 0.0
    upper: float = 0.30
    turnover: float = 0.50


class Infeasible(ValueError):
    pass


def _clipped(raw: np.ndarray, before: np.ndarray, price: np.ndarray, mu: np.ndarray, lim: Limits) -> np.ndarray:
    """Weights for prices of budget and turnover; the last axis has the assets."""
    d = raw - price[..., None] - before
    return np.clip(before + np.sign(d) * np.maximum(np.abs(d) - mu[..., None], 0), lim.lower, lim.upper)


def _balanced(raw: np.ndarray, before: np.ndarray, mu: np.ndarray, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(price, weights summing to 1) of each row for its price of turnover.

    The sum falls piecewise linearly with the price of the budget, so it is evaluated at all its kinks and interpolated.
    """
    m = mu[:, None]
    kinks = np.sort(np.concatenate([raw - before - m, raw - before + m, *(raw - edge + side * m for edge in (lim.lower, lim.upper) for side in (-1, 1))], axis=1), axis=1)
    sums = _clipped(raw[:, None], before[:, None], kinks, np.broadcast_to(m, kinks.shape), lim).sum(axis=2)
    at = np.maximum((sums >= 1).sum(axis=1) - 1, 0)
    after = np.minimum(at + 1, kinks.shape[1] - 1)
    rows = np.arange(len(raw))
    fall, width = sums[rows, at] - sums[rows, after], kinks[rows, after] - kinks[rows, at]
    part = np.clip(np.where(fall > 0, (sums[rows, at] - 1) / np.where(fall > 0, fall, 1), 0), 0, 1)
    price = kinks[rows, at] + part * width
    return price, _clipped(raw, before, price, mu, lim)


def project_many(raw: np.ndarray, before: np.ndarray, lim: Limits = Limits()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, price of the budget, price of turnover, feasible) of the weights nearest to ``raw`` that sum to 1, keep the box and trade
    at most ``turnover`` (gross) from ``before``, for all rows at once.

    Rows bisect the price of turnover where it binds; prices are the multipliers that certify the solution. Rows without a feasible
    point have no finite weights.
    """
    rows = len(raw)
    moved = lambda w: np.abs(w - before).sum(axis=1)
    mu = np.zeros(rows)
    price, w = _balanced(raw, before, mu, lim)
    bound = moved(w) > lim.turnover + 1e-12
    if bound.any():
        far = np.abs(raw - before).max(initial=0) + np.abs(raw).max(initial=0) + np.abs(before).max(initial=0)
        lo, hi = np.zeros(rows), np.full(rows, 4 + far)
        for _ in range(60):
            mid = (lo + hi) / 2
            over = moved(_balanced(raw, before, mid, lim)[1]) > lim.turnover
            lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
        mu = np.where(bound, hi, 0.0)
        price, w = _balanced(raw, before, mu, lim)
    feasible = (np.abs(w.sum(axis=1) - 1) < 1e-9) & (moved(w) <= lim.turnover + 1e-6)
    w = w / np.where(feasible, w.sum(axis=1), 1)[:, None]
    return np.where(feasible[:, None], w, np.nan), price, mu, feasible


def project(raw: np.ndarray, before: np.ndarray, lim: Limits = Limits()) -> np.ndarray:
    """``project_many`` of one row, or of rows that must all be feasible."""
    w, _, _, feasible = project_many(np.atleast_2d(raw), np.atleast_2d(before), lim)
    if not feasible.all():
        raise Infeasible("the limits hold no weights that sum to 1, or the holdings can't reach them within the turnover")
    return w.reshape(np.shape(raw))


def best_feasible(cov: np.ndarray, before: np.ndarray, starts: np.ndarray, lim: Limits, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(weights, squared errors) of risk parity within the limits from each start, by projected steps that don't raise the error."""
    n = len(before)
    even = np.full(n, 1 / n)
    put = lambda v: project_many(v, np.broadcast_to(before, v.shape), lim)[0]
    error_of = lambda v: np.array([squared_error(x, cov, even) for x in v])
    w = put(starts)
    error, t = error_of(w), np.ones(len(w))
    for _ in range(rounds):
        g = np.stack([2 * _share_jacobian(x, cov).T @ (risk_shares(x, cov) - even) for x in w])
        new = put(w - t[:, None] * g)
        found = error_of(new)
        better = found <= error - 1e-4 / t * ((new - w) ** 2).sum(axis=1)
        still = better & (np.abs(new - w).max(axis=1) < 1e-11)
        w, error, t = np.where(better[:, None], new, w), np.where(better, found, error), np.where(better, 2 * t, t / 4)
        if (still | (t < 1e-12)).all():
            break
    return w, error


def drift(w: np.ndarray, gross: np.ndarray) -> np.ndarray:
    out = w * gross
    return out / out.sum()
