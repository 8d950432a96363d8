import numpy as np
import pytest

from quillon.functions import allocation as al
from quillon.functions import densities as de
from quillon.functions import hmm, inference, lstm
from quillon.plans import walkforward as wf
from quillon.sources.panel import synthetic_panel


def covariances(n=50):
    r = np.random.default_rng(7)
    for _ in range(n):
        f = r.standard_normal((10, 3))
        yield f @ f.T * 1e-4 + np.diag(r.uniform(1e-5, 1e-4, 10)), r.dirichlet(np.ones(10) * 3)


def test_risk_budget_hits_budgets():
    for cov, b in covariances():
        w = al.risk_budget(cov, b)
        assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
        assert np.abs(al.risk_shares(w, cov) - b).max() < 1e-8


def test_risk_budget_gradient():
    cov, b = next(covariances(1))
    w = al.risk_budget(cov, b)
    g = al.risk_budget_gradient(cov, b, w)
    for j in range(3):
        e = np.zeros(10)
        e[j] = 1e-6
        assert np.allclose((al.risk_budget(cov, b + e) - w) / 1e-6, g[:, j] - g @ b, atol=2e-4)


def test_projection_is_feasible_and_nearest():
    r = np.random.default_rng(3)
    lim = al.Limits(0, 0.30, 0.30)
    for _ in range(30):
        before = np.minimum(r.dirichlet(np.ones(8) * 6), 0.3)
        before /= before.sum()
        raw = r.dirichlet(np.ones(8))
        try:
            w = al.project(raw, before, lim)
        except al.Infeasible:
            continue
        assert abs(w.sum() - 1) < 1e-9 and w.min() > -1e-9 and w.max() < 0.3 + 1e-6 and np.abs(w - before).sum() < 0.3 + 1e-5
        best = ((w - raw) ** 2).sum()
        for _ in range(200):
            other = w + 0.02 * r.standard_normal(8)
            other += (1 - other.sum()) / 8
            if other.min() >= 0 and other.max() <= 0.3 and np.abs(other - before).sum() <= 0.3:
                assert ((other - raw) ** 2).sum() >= best - 1e-6


def test_projection_refuses():
    with pytest.raises(al.Infeasible):
        al.project(np.full(3, 1 / 3), np.full(3, 1 / 3), al.Limits(0, 0.3, 0.3))


def test_hierarchical_weights():
    cov, _ = next(covariances(1))
    w = al.hierarchical(cov)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
    assert np.allclose(al.hierarchical(np.diag([1.0, 4.0])), [0.8, 0.2])
    assert al.leaf_order(np.array([[0, 5, 1], [5, 0, 4], [1, 4, 0.0]])) in ([1, 0, 2], [0, 2, 1])


def test_regime_recovery_and_bic():
    x, states = synthetic_panel(1500, list("abcdefghij"), seed=3)
    m = hmm.fit(x, 2, seed=1)
    p, _ = hmm.filtered(m, hmm.emissions(m, x))
    hit = (p.argmax(axis=1) == states).mean()
    assert max(hit, 1 - hit) > 0.85
    assert np.allclose(p.sum(axis=1), 1)
    gamma, _, ll = hmm.smoothed(m, hmm.emissions(m, x))
    assert np.allclose(gamma.sum(axis=1), 1)
    assert ll >= m.loglik - 1e-3  # the ridge on covariances keeps EM from being strictly monotone
    q = m.permuted(np.array([1, 0]))
    back = hmm.aligned(q, m)
    assert np.allclose(back.means, m.means) and np.allclose(back.step, m.step)
    assert hmm.bic(m, len(x)) < hmm.bic(hmm.fit(x, 3, seed=1), len(x)) + 500


def test_filter_continues():
    x, _ = synthetic_panel(300, list("abc"), seed=1)
    m = hmm.fit(x, 2, rounds=10)
    d = hmm.emissions(m, x)
    whole, _ = hmm.filtered(m, d)
    first, _ = hmm.filtered(m, d[:200])
    rest, _ = hmm.filtered(m, d[200:], prior=first[-1])
    assert np.allclose(whole[200:], rest)


def test_densities():
    x, _ = synthetic_panel(800, list("abcde"), seed=2)
    m = hmm.fit(x, 2, rounds=40)
    p, _ = hmm.filtered(m, hmm.emissions(m, x))
    z = ((x - x.mean(axis=0)) / x.std(axis=0)).ravel()
    nu = de.fit_nu(z)
    assert nu in de.NU_GRID and de.unit_loglik(z, nu) >= max(de.unit_loglik(z, v) for v in de.NU_GRID)
    mix = de.Mixture.fit(x, p, nu)
    assert mix.log_density(x, p).sum() > de.Pooled.fit(x, nu).log_density(x).sum()
    grid = np.linspace(-60, 60, 200_001)
    dens = np.exp(de.log_t(grid[:, None], 4.0, np.zeros(1), np.eye(1)))
    assert abs(np.trapezoid(dens, grid) - 1) < 1e-4


def test_order_statistics_pins():
    assert np.allclose(inference.order_moments(5), (1.162964, 0.668980), atol=1e-6)
    assert np.allclose(inference.order_moments(10), (1.538753, 0.586808), atol=1e-6)


def test_block_length_pins():
    """Published values of the rule for white noise and two autoregressions."""
    r = np.random.default_rng(123)
    got = [inference.block_length(r.normal(size=2500))]
    for a in (0.5, 0.9):
        e, x = r.normal(size=2500), np.zeros(2500)
        for t in range(1, 2500):
            x[t] = a * x[t - 1] + e[t]
        got.append(inference.block_length(x))
    assert np.allclose(got, [1.5316189209351796, 14.168003687099148, 47.09238475262077], rtol=1e-10)
    assert inference.block_length(np.ones(20)) == 1
    with pytest.raises(ValueError):
        inference.block_length(np.arange(9.0))


def test_bootstrap():
    p = inference.paths(1000, 10, 3, 1, np.arange(200))
    step = np.diff(p, axis=1)
    assert p.min() >= 0 and p.max() < 1000 and abs(((step == 1) | (step == -999)).mean() - 0.9) < 0.005
    assert np.abs(np.bincount(p.ravel(), minlength=1000) / 200 - 1).mean() < 0.3  # every day about as often
    assert (inference.paths(1000, 10, 3, 1, np.array([17, 5])) == p[[17, 5]]).all() and (inference.paths(1000, 10, 3, 2, np.arange(1)) != p[:1]).any()
    r = np.random.default_rng(1)
    x = r.normal(0.001, 0.01, 500)
    out = inference.difference_interval([x, x], [1, -1], draws=50, seed=1)
    assert out["point"] == out["low"] == out["high"] == 0
    one = inference.difference_interval([x], [1], seed=4)
    assert one["low"] < one["point"] < one["high"] and abs((one["high"] - one["low"]) / 2 / (1.96 * np.sqrt(252 / 500)) - 1) < 0.15  # as wide as theory has it


def test_deflation():
    assert inference.deflated(0.1, 0.001, 1, 500, 0, 3) > inference.deflated(0.1, 0.001, 50, 500, 0, 3)
    gauss, gumbel = inference.location_scale(0.1, 0.001, 9, 500, -0.5, 5)
    assert 0 < gauss < 1 and 0 < gumbel < 1


def test_bounded_softmax_and_lstm_gradient():
    r = np.random.default_rng(5)
    for _ in range(50):
        z = r.normal(0, 3, 6)
        b, _ = lstm.bounded_softmax(z, 0.08)
        assert abs(b.sum() - 1) < 1e-12 and b.min() >= 0.08 - 1e-12
    assert np.allclose(lstm.bounded_softmax(z, 0.0)[0], np.exp(z) / np.exp(z).sum())
    net = lstm.BudgetLstm(3, 4, hidden=5, floor=0.05, seed=1)
    window, d = r.standard_normal((6, 3)), r.standard_normal(4)
    b, tape = net.forward(window)
    grads = net.backward(tape, d)
    for k, i in (("x", (1, 2)), ("h", (0, 7)), ("b", (3,)), ("w", (2, 1)), ("c", (0,))):
        net.p[k][i] += 1e-6
        up = net.forward(window)[0] @ d
        net.p[k][i] -= 2e-6
        down = net.forward(window)[0] @ d
        net.p[k][i] += 1e-6
        assert abs((up - down) / 2e-6 - grads[k][i]) < 1e-5


def walk(zero_gap=False, **options):
    x, _ = synthetic_panel(420, list("abcdef"), seed=4)
    dates = np.array(np.busday_offset("2020-01-01", np.arange(420), roll="forward"), dtype="datetime64[ns]")
    o = wf.Options(n_states=2, initial_window=252, refit_n_iter=5, first_n_iter=15, limits=al.Limits(0, 0.3, 0.3), **options)
    legs = (np.zeros_like(x), x) if zero_gap else (None, None)
    return x, dates, wf.walk(dates, x, o, *legs)


def test_walk_ledger_and_zero_gap():
    x, dates, out = walk()
    w = out["weights"]
    assert (abs(w["weights"].map(sum) - 1) < 1e-9).all()
    # an independent ledger: yesterday's weights times today's simple returns
    r = out["returns"]
    for c in ("erc_blend", "equal_weight"):
        own, got = np.stack(w[w.config == c]["weights"]), r[r.config == c]["ret"].to_numpy()
        assert np.allclose((own[:-1] * (np.exp(x[253:]) - 1)).sum(axis=1), got[1:], atol=1e-12)
    assert out["decisions"]["turnover"].max() <= 0.3 + 1e-6
    _, _, gap = walk(zero_gap=True)
    assert np.allclose(gap["returns"]["ret"], r["ret"], atol=1e-10)


def test_walk_options():
    with pytest.raises(ValueError):
        wf.Options(risk_budget_solver="other")
    _, _, out = walk(include_hrp=True, per_regime_nu=True, refit_state_cov_ewma=0.5, refit_warm_start=False, refit_align_to_fixed_reference=True)
    assert set(out["returns"]["config"]) == {"erc_baseline", "erc_regime", "erc_blend", "equal_weight", "hrp_baseline", "hrp_regime", "hrp_blend"}


def test_alignment_is_the_best_assignment():
    from itertools import permutations

    from quillon.functions import hmm

    r = np.random.default_rng(5)
    for k in (2, 3, 4):
        a, b = (hmm.Regimes(np.full(k, 1 / k), np.full((k, k), 1 / k), r.normal(size=(k, 2)), np.stack([np.eye(2) * v for v in r.uniform(0.5, 2, k)])) for _ in range(2))
        cost = lambda p: sum(hmm.bhattacharyya(a.means[i], a.covs[i], b.means[j], b.covs[j]) for j, i in enumerate(p))
        best = min(permutations(range(k)), key=cost)
        assert (hmm.aligned(a, b).means == a.means[list(best)]).all()
