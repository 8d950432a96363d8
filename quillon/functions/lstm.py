"""A small LSTM that maps feature windows to bounded risk budgets, with its gradients in NumPy."""

from __future__ import annotations

import json

import numpy as np

from .allocation import drift, risk_budget, risk_budget_gradient


def bounded_softmax(z: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(budgets of at least ``floor``, which entries are free); the k largest share what the floors leave."""
    n = len(z)
    if not 0 <= floor < 1 / n:
        raise ValueError("the floor must be in [0, 1/n)")
    order = np.argsort(-z, kind="stable")
    e = np.exp(z - z.max())
    sums = np.cumsum(e[order])
    k = np.arange(1, n + 1)
    ok = (1 - (n - k) * floor) * e[order] / sums >= floor
    best = int(k[ok][-1])
    out, free = np.full(n, floor), np.zeros(n, bool)
    free[order[:best]] = True
    out[free] = (1 - (n - best) * floor) * e[free] / sums[best - 1]
    return out, free


class BudgetLstm:
    """One layer, last hidden state, linear head, bounded softmax."""

    def __init__(self, features: int, assets: int, hidden: int = 32, floor: float = 0.05, seed: int = 123):
        r = np.random.default_rng(seed)
        u = lambda *s: r.uniform(-1, 1, s) / np.sqrt(hidden)
        self.floor, self.hidden = floor, hidden
        self.p = {"x": u(features, 4 * hidden), "h": u(hidden, 4 * hidden), "b": u(4 * hidden), "w": u(hidden, assets), "c": u(assets)}

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(budgets, tape) of one window (L, F), or of a batch (B, L, F) with one row of budgets each."""
        single = windows.ndim == 2
        x = windows[None] if single else windows
        n = self.hidden
        h, c, tape = np.zeros((len(x), n)), np.zeros((len(x), n)), []
        for t in range(x.shape[1]):
            a = x[:, t] @ self.p["x"] + h @ self.p["h"] + self.p["b"]
            s = 1 / (1 + np.exp(-np.clip(np.concatenate([a[:, : 2 * n], a[:, 3 * n :]], axis=1), -40, 40)))
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(a[:, 2 * n : 3 * n])
            c2 = f * c + i * g
            tape.append((x[:, t], h, c, i, f, g, o, c2))
            h, c = o * np.tanh(c2), c2
        heads = [bounded_softmax(z, self.floor) for z in h @ self.p["w"] + self.p["c"]]
        budgets, free = np.stack([b for b, _ in heads]), np.stack([f for _, f in heads])
        return budgets[0] if single else budgets, (tape, h, budgets, free)

    def backward(self, tape: tuple, d_budgets: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients summed over the batch of ``tape``."""
        steps, h_last, b, free = tape
        d = np.where(free, d_budgets.reshape(b.shape), 0)
        held = np.where(free, b, 0)
        dz = held * (d - (d * held).sum(axis=1, keepdims=True) / held.sum(axis=1, keepdims=True))
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["c"] = h_last.T @ dz, dz.sum(axis=0)
        dh, dc = dz @ self.p["w"].T, np.zeros_like(h_last)
        for x, h, c, i, f, gg, o, c2 in reversed(steps):
            t = np.tanh(c2)
            dc = dc + dh * o * (1 - t * t)
            da = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - gg * gg), dh * t * o * (1 - o)], axis=1)
            g["x"] += x.T @ da
            g["h"] += h.T @ da
            g["b"] += da.sum(axis=0)
            dh, dc = da @ self.p["h"].T, dc * f
        return g

    def save(self, path: str, *, seed: int, variant: str, epochs: int) -> None:
        """Parameters and what is needed to rebuild the model, as one NPZ file."""
        about = {"seed": seed, "variant": variant, "epochs": epochs, "budget_floor": self.floor, "hidden_size": self.hidden, "n_features": len(self.p["x"]), "n_assets": len(self.p["c"])}
        np.savez_compressed(path, about=np.array(json.dumps(about)), **{f"p_{k}": v for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> tuple["BudgetLstm", dict]:
        """(model, its settings); shapes that don't match the settings are an error."""
        with np.load(path, allow_pickle=False) as f:
            about = json.loads(str(f["about"]))
            model = cls(about["n_features"], about["n_assets"], about["hidden_size"], about["budget_floor"])
            for k, v in model.p.items():
                if f[f"p_{k}"].shape != v.shape:
                    raise ValueError(f"{path}: {k} has shape {f[f'p_{k}'].shape}, not {v.shape}")
                model.p[k] = f[f"p_{k}"]
        return model, about


def loss_and_gradient(weights: np.ndarray, forward: np.ndarray, penalty: float, periods: int = 12) -> tuple[float, np.ndarray]:
    """Minus annualised Sharpe plus a price on mean turnover; previous weights drift and count as constants."""
    r = (weights * (forward - 1)).sum(axis=1)
    sd = r.std(ddof=1) + 1e-8
    before = np.stack([weights[0], *(drift(w, g) for w, g in zip(weights[:-1], forward[:-1]))])
    moved = weights - before
    moved[0] = 0
    n = len(r)
    loss = -r.mean() / sd * np.sqrt(periods) + penalty * np.abs(moved).sum(axis=1).mean()
    dr = -np.sqrt(periods) * (1 / (n * sd) - r.mean() / sd**2 * (r - r.mean()) / ((n - 1) * max(sd - 1e-8, 1e-12)))
    return float(loss), dr[:, None] * (forward - 1) + penalty * np.sign(moved) / n


def train(model: BudgetLstm, windows: np.ndarray, covs: np.ndarray, forward: np.ndarray, epochs: int = 200, rate: float = 1e-3, penalty: float = 0.1) -> list[float]:
    """Full-batch Adam through the risk-budget solution's implicit gradient; returns the losses."""
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    losses = []
    for epoch in range(1, epochs + 1):
        budgets, tape = model.forward(windows)
        weights = np.stack([risk_budget(c, b) for c, b in zip(covs, budgets)])
        loss, dw = loss_and_gradient(weights, forward, penalty)
        losses.append(loss)
        total = model.backward(tape, np.stack([risk_budget_gradient(c, b, w).T @ d for c, b, w, d in zip(covs, budgets, weights, dw)]))
        for k, g in total.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            model.p[k] -= rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)
    return losses
