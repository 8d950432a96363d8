"""The monthly walk-forward: one sequential fold a scenario, scenarios side by side on the cluster.

Signals depend on returns alone; only the projection at decisions depends on holdings. A scenario is a few thousand days of a
few assets, so it fits a task by nature; seeds, universes and options multiply scenarios, which is what scales out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import allocation as al
from ..functions import densities as de
from ..functions import hmm
from ..functions.lstm import BudgetLstm, train
from ..functions.allocation import Limits


@dataclass
class Options:
    n_states: int = 3
    initial_window: int = 252
    alpha: float = 0.97
    shrinkage: float = 0.10
    limits: Limits = field(default_factory=Limits)
    refit_at_rebalance: bool = True
    refit_every_n_rebalances: int = 3
    refit_n_iter: int = 50
    first_n_iter: int = 200
    refit_warm_start: bool = True
    refit_state_cov_ewma: float | None = None
    refit_align_to_fixed_reference: bool = False
    include_hrp: bool = False
    per_regime_nu: bool = False
    risk_budget_solver: str = "exact"
    lstm_seq_len: int = 60
    lstm_cov_window: int = 252
    lstm_epochs: int = 0  # more than 0: two allocators are trained on the initial window and walked
    lstm_retrain_every_n_rebalances: int | None = None
    lstm_retrain_n_epochs: int = 50
    lstm_turnover_penalty: float = 0.1
    seed: int = 123

    def __post_init__(self):
        if self.risk_budget_solver not in al.SOLVERS:
            raise ValueError(f"risk_budget_solver must be one of {', '.join(al.SOLVERS)}")
        if self.lstm_retrain_every_n_rebalances and not self.lstm_epochs:
            raise ValueError("retraining needs trained allocators")


def from_dict(o: dict) -> Options:
    return Options(**{**o, "limits": Limits(**o["limits"])})


@dataclass
class _Signals:
    """What is estimated at a fit and used until the next one."""

    regimes: hmm.Regimes
    pooled: de.Pooled
    mixture: de.Mixture
    cov: np.ndarray
    raw_covs: np.ndarray
    covs: np.ndarray


def _estimate(x: np.ndarray, o: Options, begin: hmm.Regimes | None, reference: hmm.Regimes | None, rounds: int, seed: int, before: np.ndarray | None) -> tuple[_Signals, np.ndarray]:
    """The signals and the filtered regime probabilities of all days in ``x``."""
    m = hmm.fit(x, o.n_states, seed, rounds, begin=begin)
    if reference is not None:
        m = hmm.aligned(m, reference)
    probs, _ = hmm.filtered(m, hmm.emissions(m, x))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    nu = de.fit_nu(z.ravel())
    nus = np.array([de.fit_nu(z.ravel(), w=np.repeat(p, x.shape[1])) for p in probs.T]) if o.per_regime_nu else nu
    mix = de.Mixture.fit(x, probs, nus)
    raw = mix.covariances()
    covs = raw if o.refit_state_cov_ewma is None or before is None else o.refit_state_cov_ewma * before + (1 - o.refit_state_cov_ewma) * raw
    return _Signals(m, de.Pooled.fit(x, nu), mix, np.cov(x.T), raw, covs), probs


TABLES = {
    "returns": "date date, config string, ret double",
    "weights": "date date, config string, weights array<double>",
    "pi": "date date, pi double, l0 double, l1 double",
    "executions": "date date, config string, turnover double",
    "decisions": "date date, config string, turnover double, turnover_binding boolean, n_lower int, n_upper int, dev_target double, dev_final double",
}
LIMIT = np.log((1 - 1e-6) / 1e-6)


@dataclass
class Day:
    """What later fits read of a day; features and the next day's forecast only where networks are trained."""

    ret: np.ndarray
    decides: bool
    features: np.ndarray | None = None
    ahead: np.ndarray | None = None


class Walk:
    """One scenario's walk, a day at a time: what is known after a day is all that the next one needs.

    The first ``initial_window`` days are gathered; from then on a day accrues, scores, predicts, and decides where ``decides``
    says so. With overnight and intraday returns orders wait for the next open, otherwise they are executed at the same close. Decisions use
    end-of-day holdings and each day has one weight row. ``past`` gives the earlier days when a fit asks for them; a
    caller that keeps them elsewhere takes new ones from ``fresh`` and, at the first fit, all from ``rewritten``.
    """

    def __init__(self, o: Options, past: Callable[[], list[Day]] = list, nets: dict[str, BudgetLstm] | None = None):
        self.o, self._past, self.fresh, self.rewritten = o, past, [], False
        self.last, self.seen, self.count, self.refits, self.ell = "", 0, 0, 1, 0.0
        self.state: np.ndarray | None = None
        self.signals: _Signals | None = None
        self.reference: hmm.Regimes | None = None
        self.held: dict[str, np.ndarray] = {}
        self.pending: dict[str, np.ndarray] = {}
        self.nets: dict[str, BudgetLstm] = nets or {}

    def names(self) -> list[str]:
        names = ["erc_baseline", "erc_regime", "erc_blend", "equal_weight"]
        return names + ["hrp_baseline", "hrp_regime", "hrp_blend"] * self.o.include_hrp + ["lstm_baseline", "lstm_regime", "lstm_blend"] * bool(self.o.lstm_epochs)

    def history(self) -> list[Day]:
        if not self.rewritten:
            self.fresh, self.rewritten = [*self._past(), *self.fresh], True
        return self.fresh

    def _begin(self) -> None:
        days, o = self.history(), self.o
        x = np.stack([d.ret for d in days])
        self.signals, probs = _estimate(x, o, None, None, o.first_n_iter, o.seed, None)
        self.state, self.reference = probs[-1], self.signals.regimes
        self.held = {c: np.full(x.shape[1], 1 / x.shape[1]) for c in self.names()}
        if o.lstm_epochs:
            for d, ahead in zip(days, probs @ self.signals.regimes.step):
                d.ahead = ahead
            self.nets = self.nets or _networks(days, o)

    def step(self, day, r: np.ndarray, decides: bool, co: np.ndarray | None = None, oc: np.ndarray | None = None, features: np.ndarray | None = None) -> dict[str, list[tuple]]:
        """The day's rows of all tables."""
        o, out = self.o, {k: [] for k in TABLES}
        if self.seen == o.initial_window:
            self._begin()
        today = Day(r, decides, (100 * r if features is None else features) if o.lstm_epochs else None)
        self.fresh.append(today)
        self.seen += 1
        if self.signals is None:
            return out
        next_open = co is not None and oc is not None
        w, n = self.held, len(r)
        for c in self.names():
            if c in self.pending:
                old, new = w[c], self.pending[c]
                overnight = float(old @ (np.exp(co) - 1))
                intraday = float(new @ (np.exp(oc) - 1))
                out["returns"].append((day, c, (1 + overnight) * (1 + intraday) - 1))
                out["executions"].append((day, c, float(np.abs(new - al.drift(old, np.exp(co))).sum())))
                w[c] = al.drift(new, np.exp(oc))
            else:
                out["returns"].append((day, c, float(w[c] @ (np.exp(r) - 1))))
                w[c] = al.drift(w[c], np.exp(r))
        self.pending = {}
        s = self.signals
        forecast = self.state @ s.regimes.step
        l0, l1 = float(s.pooled.log_density(r)[0]), float(s.mixture.log_density(r, forecast)[0])
        self.ell = float(np.clip(o.alpha * self.ell + (l1 - l0), -LIMIT, LIMIT))
        pi = 1 / (1 + np.exp(-self.ell))
        out["pi"].append((day, pi, l0, l1))
        a = forecast * hmm.emissions(s.regimes, r[None])[0]
        self.state = a / a.sum()
        if o.lstm_epochs:
            today.ahead = self.state @ s.regimes.step
        if decides:
            wanted = self._targets(day, pi)
            finals = al.project(np.stack([t for _, t, _ in wanted]), np.stack([w[c] for c, _, _ in wanted]), o.limits)
            for (c, target, base), final in zip(wanted, finals):
                moved = float(np.abs(final - w[c]).sum())
                out["decisions"].append((day, c, moved, moved >= o.limits.turnover - 1e-6, int((final <= o.limits.lower + 1e-6).sum()), int((final >= o.limits.upper - 1e-6).sum()), float(np.abs(al.risk_shares(target, base) - 1 / n).max()), float(np.abs(al.risk_shares(final, base) - 1 / n).max())))
                if next_open:
                    self.pending[c] = final
                else:
                    out["executions"].append((day, c, moved))
                    w[c] = final
        out["weights"] += [(day, c, w[c].tolist()) for c in self.names()]
        return out

    def _targets(self, day, pi: float) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(config, target weights, baseline covariance) of a decision, after a refit if one is due."""
        o = self.o
        self.count += 1
        if o.refit_at_rebalance and self.count % o.refit_every_n_rebalances == 0:
            s = self.signals
            ref = self.reference if o.refit_align_to_fixed_reference else s.regimes
            x = np.stack([d.ret for d in self.history()])
            self.signals, probs = _estimate(x, o, s.regimes if o.refit_warm_start else None, ref, o.refit_n_iter, o.seed if o.refit_warm_start else 1000 + self.refits, s.covs)
            self.state = probs[-1]
            self.refits += 1
        s = self.signals
        ahead = self.state @ s.regimes.step
        base, regime = al.shrink(s.cov, o.shrinkage), al.shrink(np.tensordot(ahead, s.covs, 1), o.shrinkage)
        even = np.full(len(base), 1 / len(base))
        solve = al.SOLVERS[o.risk_budget_solver]
        target = {"erc_baseline": solve(base, even), "erc_regime": solve(regime, even), "equal_weight": even}
        if o.include_hrp:
            target |= {"hrp_baseline": al.hierarchical(base), "hrp_regime": al.hierarchical(regime)}
        if self.nets:
            days = self.history()
            if o.lstm_retrain_every_n_rebalances and self.count % o.lstm_retrain_every_n_rebalances == 0:
                self.nets = _networks(days, o, self.nets)
            window = np.stack([d.features for d in days[-o.lstm_seq_len :]])
            if not np.isfinite(window).all():
                raise ValueError(f"a feature is missing in the {o.lstm_seq_len} days up to {day}")
            raw = al.shrink(np.tensordot(ahead, s.raw_covs, 1), o.shrinkage)
            forecasts = np.stack([d.ahead for d in days[-o.lstm_seq_len :]])
            for kind, data, cov in (("baseline", window, base), ("regime", np.hstack([window, forecasts]), raw)):
                target[f"lstm_{kind}"] = solve(cov, self.nets[kind].forward(data)[0])
        for family in ("erc", "hrp", "lstm"):
            if f"{family}_regime" in target:
                target[f"{family}_blend"] = pi * target[f"{family}_regime"] + (1 - pi) * target[f"{family}_baseline"]
        return [(c, target[c], base) for c in self.names()]


def month_ends(dates: np.ndarray) -> np.ndarray:
    """Whether a day is the last of its month; the last day counts as one."""
    months = pd.PeriodIndex(pd.to_datetime(dates), freq="M")
    return np.append(months[1:] != months[:-1], True)


def walk(dates: np.ndarray, x: np.ndarray, o: Options, co: np.ndarray | None = None, oc: np.ndarray | None = None, features: np.ndarray | None = None, nets: dict[str, BudgetLstm] | None = None) -> dict[str, pd.DataFrame]:
    """All tables of a walk over whole series. The networks read ``features`` (a row a day, not finite where there is none), or without
    them the day's returns in per cent; ``nets`` are trained ones."""
    decides = month_ends(dates)
    one, out = Walk(o, nets=nets), {k: [] for k in TABLES}
    legs = (co, oc) if co is not None and oc is not None else None
    for k, day in enumerate(dates):
        rows = one.step(day, x[k], bool(decides[k]), *((legs[0][k], legs[1][k]) if legs else (None, None)), None if features is None else features[k])
        for name, found in rows.items():
            out[name] += found
    return {k: pd.DataFrame(v, columns=columns_of(TABLES[k])) for k, v in out.items()}


def training_windows(inputs: np.ndarray, decides: np.ndarray, days: int, length: int, cov_window: int) -> list[tuple[int, int]]:
    """(decision, next decision) of the first ``days`` rows with a full window of finite inputs and of covariances."""
    at = np.flatnonzero(decides[:days])
    return [(a, b) for a, b in zip(at, at[1:]) if a + 1 >= max(length, cov_window) and np.isfinite(inputs[a + 1 - length : a + 1]).all()]


KINDS = ("baseline", "regime")


def network(days: list[Day], o: Options, kind: str, old: BudgetLstm | None = None) -> BudgetLstm:
    """One allocator trained on ``days``; an old one goes on from its weights."""
    x, inputs = (np.stack([getattr(d, f) for d in days]) for f in ("ret", "features"))
    n = x.shape[1]
    # whether the last day decides is no matter: a pair needs a later decision
    pairs = training_windows(inputs, np.array([d.decides for d in days]), len(x), o.lstm_seq_len, o.lstm_cov_window)
    if len(pairs) < 2:
        raise ValueError("too few decisions to train on")
    covs = np.stack([al.shrink(np.cov(x[a + 1 - o.lstm_cov_window : a + 1].T), o.shrinkage) for a, _ in pairs])
    forward = np.stack([np.exp(x[a + 1 : b + 1].sum(axis=0)) for a, b in pairs])
    data = inputs if kind == "baseline" else np.hstack([inputs, np.stack([d.ahead for d in days])])
    windows = np.stack([data[a + 1 - o.lstm_seq_len : a + 1] for a, _ in pairs])
    net = old or BudgetLstm(data.shape[1], n, floor=0.5 / n, seed=o.seed)
    train(net, windows, covs, forward, o.lstm_retrain_n_epochs if old else o.lstm_epochs, penalty=o.lstm_turnover_penalty)
    return net


def _networks(days: list[Day], o: Options, old: dict | None = None) -> dict[str, BudgetLstm]:
    return {kind: network(days, o, kind, (old or {}).get(kind)) for kind in KINDS}


def first_network(x: np.ndarray, decides: np.ndarray, features: np.ndarray | None, o: Options, kind: str) -> BudgetLstm:
    """The allocator that a walk would train before its first day."""
    one = Walk(replace(o, lstm_epochs=0))
    for k in range(o.initial_window):
        one.step(k, x[k], bool(decides[k]))
    days = one.fresh
    signals, probs = _estimate(x[: o.initial_window], o, None, None, o.first_n_iter, o.seed, None)
    for k, (d, ahead) in enumerate(zip(days, probs @ signals.regimes.step)):
        d.features, d.ahead = (100 * x[k] if features is None else features[k]), ahead
    return network(days, o, kind)


#: All tables in one: a row has the columns of its ``table``, others are null.
ALL = "table string, " + ", ".join(dict.fromkeys(c for t in TABLES.values() for c in t.split(", ")))


def columns_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def dense(pdf: pd.DataFrame, next_open: bool) -> tuple:
    """(dates, returns, overnight, intraday, features) of one scenario's long rows; the last three are None where there are none."""
    pdf = pdf.sort_values(["date", "asset"])
    wide = {v: pdf.pivot(index="date", columns="asset", values=v) for v in ("ret", "overnight", "intraday")}
    legs = (wide["overnight"].to_numpy(), wide["intraday"].to_numpy()) if next_open else (None, None)
    features = None
    if "features" in pdf.columns:
        found = pdf.drop_duplicates("date").set_index("date")["features"].reindex(wide["ret"].index)
        length = next(len(v) for v in found if v is not None)
        features = np.stack([np.full(length, np.nan) if v is None else np.asarray(v, float) for v in found])
    return wide["ret"].index.to_numpy(), wide["ret"].to_numpy(), *legs, features


def all_rows(tables: dict[str, pd.DataFrame]) -> pd.DataFrame:
    out = [{**dict.fromkeys(columns_of(ALL)), "table": t, **r} for t, f in tables.items() for r in f.to_dict("records")]
    return pd.DataFrame(out, columns=columns_of(ALL), dtype=object)


def run_all(returns: DataFrame, scenarios: dict[str, Options], next_open: bool = True) -> DataFrame:
    """scenario and ``ALL``: every table of all scenarios' walks; ``returns`` (scenario, date, asset, ret, overnight, intraday) is grouped by scenario.
    A column ``features`` (the same array for all assets of a day, null before the first) is what the networks read."""
    options = {k: asdict(v) for k, v in scenarios.items()}

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        dates, x, *rest = dense(pdf, next_open)
        return all_rows(walk(dates, x, from_dict(options[key[0]]), *rest)).assign(scenario=key[0])

    return returns.groupBy("scenario").applyInPandas(fold, f"{ALL}, scenario string").select("scenario", *columns_of(ALL))


def table(rows: DataFrame, name: str) -> DataFrame:
    """scenario and the columns of one table out of all."""
    return rows.where(F.col("table") == name).select("scenario", *columns_of(TABLES[name]))


def run(returns: DataFrame, scenarios: dict[str, Options], name: str, next_open: bool = True) -> DataFrame:
    """One table of all scenarios' walks."""
    return table(run_all(returns, scenarios, next_open), name)
