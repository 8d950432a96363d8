"""Many matrices at once: trailing covariances, trees, bisection, projections and their certificates, the squared solver, the audit."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import allocation as al
from quillon.operators import portfolio as pf
from quillon.plans import walkforward as wf


def random_covariances(sizes, seed=2):
    r = np.random.default_rng(seed)
    for k, n in enumerate(sizes):
        f = r.standard_normal((n, min(3, n)))
        yield k, f @ f.T * 1e-4 + np.diag(r.uniform(1e-5, 1e-4, n))


def long_rows(spark, covs):
    rows = [(k, f"a{i:02d}", f"a{j:02d}", float(c[i, j])) for k, c in covs for i in range(len(c)) for j in range(len(c))]
    return spark.createDataFrame(rows, "k int, i string, j string, cov double")


def test_trailing_covariance(spark):
    r = np.random.default_rng(0)
    x = r.normal(0, 0.01, (60, 3))
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(60)]
    returns = spark.createDataFrame([(d, f"a{j}", float(x[k, j])) for k, d in enumerate(days) for j in range(3)], "date date, asset string, ret double")
    at = [9, 19, 20, 59]
    got = pf.trailing_covariance(returns, spark.createDataFrame([(days[k],) for k in at], "date date"), 20).collect()
    assert {g.date for g in got} == {days[k] for k in at[1:]}  # the first has too few days
    for g in got:
        k = days.index(g.date)
        assert abs(g.cov - np.cov(x[k - 19 : k + 1].T)[int(g.i[1]), int(g.j[1])]) < 1e-15


def test_trees_and_bisection_equal_the_kernels(spark):
    covs = list(random_covariances([1, 2, 3, 5, 8, 13, 13, 13]))
    df = long_rows(spark, covs)
    got = {}
    for g in pf.hierarchical_weights(df, ["k"]).collect():
        got.setdefault(g.k, {})[int(g.asset[1:])] = g.weight
    assert set(got) == {k for k, _ in covs}
    for k, c in covs:
        assert np.allclose([got[k][i] for i in range(len(c))], al.hierarchical(c), atol=1e-12)
    sd = {k: np.sqrt(np.diag(c)) for k, c in covs}
    dist = spark.createDataFrame([(k, f"a{i:02d}", f"a{j:02d}", float(np.sqrt(0.5 * (1 - c[i, j] / sd[k][i] / sd[k][j])))) for k, c in covs for i in range(len(c)) for j in range(len(c)) if i != j or len(c) == 1], "k int, i string, j string, distance double")
    tree = pf.spanning_tree(dist, ["k"])
    assert {r.k: r["count"] for r in tree.groupBy("k").count().collect()} == {k: len(c) - 1 for k, c in covs if len(c) > 1}
    leaves = {r.k: [int(x[1:]) for x in r.leaves] for r in pf.leaf_order(tree, dist.select("k", F.col("i").alias("node")), ["k"]).collect()}
    for k, c in covs:
        d = np.sqrt(np.maximum(0.5 * (1 - c / np.outer(sd[k], sd[k])), 0))
        assert leaves[k] == al.leaf_order(d)


def test_trees_with_ties(spark):
    """Equal distances: any matrix gives a whole tree and an order of all its assets."""
    rows = [(k, f"a{i}", f"a{j}", 1.0 if k == 0 else float(abs(i - j))) for k in (0, 1) for i in range(9) for j in range(9) if i != j]
    df = spark.createDataFrame(rows, "k int, i string, j string, distance double")
    tree = pf.spanning_tree(df, ["k"])
    assert {r.k: (r.n, r.s) for r in tree.groupBy("k").agg(F.count("*").alias("n"), F.sum("distance").alias("s")).collect()} == {0: (8, 8.0), 1: (8, 8.0)}
    assert all(sorted(r.leaves) == [f"a{i}" for i in range(9)] for r in pf.leaf_order(tree, df.select("k", F.col("i").alias("node")), ["k"]).collect())


def test_projections_carry_their_proof(spark):
    r, lim, rows = np.random.default_rng(5), al.Limits(0.0, 0.30, 0.25), []
    for k in range(200):
        n = (4, 6, 10)[k % 3]
        before = np.minimum(r.dirichlet(np.ones(n) * 20), 0.3)
        before /= before.sum()
        raw = r.dirichlet(np.ones(n) * r.choice([0.3, 1, 30])) if k % 7 else before
        rows += [(k, f"a{i}", float(raw[i]), float(before[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, asset string, raw double, before double")
    solved = pf.projected(df.repartition(5), ["k"], lim).cache()
    proof = pf.certificates(solved, ["k"], lim).collect()
    assert len(proof) == 200 and max(p.residual for p in proof) < 1e-8 and max(p.turnover for p in proof) < 0.25 + 1e-8
    assert solved.where("turnover_price > 0").select("k").distinct().count() > 50
    # a moved weight is no longer certified
    worse = solved.withColumn("weight", F.col("weight") + F.when(F.col("asset") == "a0", 0.01).when(F.col("asset") == "a1", -0.01).otherwise(0.0))
    assert min(p.residual for p in pf.certificates(worse, ["k"], lim).collect()) > 1e-3
    with pytest.raises(Exception, match="no weights within the limits"):
        pf.projected(df, ["k"], al.Limits(0.0, 0.05, 0.3)).collect()


def test_projection_reaches_far_holdings():
    lim = al.Limits(0.0, 0.3, 0.3)
    before = np.array([[0.6, 0.2, 0.1, 0.1], [0.4, 0.2, 0.2, 0.2], [0.3, 0.3, 0.3, 0.1]])
    w, price, mu, ok = al.project_many(np.full((3, 4), 0.25), before, lim)
    assert ok.tolist() == [False, True, True] and np.isnan(w[0]).all() and np.allclose(w[1:].sum(axis=1), 1) and (w[1:] <= 0.3 + 1e-12).all()
    assert (np.abs(w - before).sum(axis=1)[1:] <= 0.3 + 1e-9).all()
    assert al.project(before[2], before[2], lim) == pytest.approx(before[2])


def test_squared_solver():
    r = np.random.default_rng(7)
    for _, cov in random_covariances([4, 7, 10] * 6, seed=9):
        n = len(cov)
        b = r.dirichlet(np.ones(n) * 3)
        w = al.risk_budget_squared(cov, b)
        exact = al.project(al.risk_budget(cov, b), np.full(n, 1 / n), al.Limits(0, 0.6, 2.0))
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= 0.6 + 1e-9
        assert al.squared_error(w, cov, b) <= al.squared_error(exact, cov, b) + 1e-12
        # first-order conditions by differences
        slope = np.array([(al.squared_error(w + 1e-6 * e, cov, b) - al.squared_error(w - 1e-6 * e, cov, b)) / 2e-6 for e in np.eye(n)])
        free = (w > 1e-7) & (w < 0.6 - 1e-7)
        price = slope[free].mean() if free.any() else 0
        assert np.abs(slope[free] - price).max(initial=0) < 1e-5 and (slope[w <= 1e-7] >= price - 1e-5).all() and (slope[w >= 0.6 - 1e-7] <= price + 1e-5).all()
    tight = al.risk_budget_squared(cov, np.eye(n)[0], (0.0, 0.5))  # a budget that no weights within the bounds meet
    assert abs(tight.sum() - 1) < 1e-9 and tight.max() <= 0.5 + 1e-9


def test_quadratic_steps():
    r = np.random.default_rng(1)
    for _ in range(40):
        n = 6
        a = r.standard_normal((n, n))
        h, g = a @ a.T + 0.1 * np.eye(n), r.standard_normal(n)
        low, high = -r.uniform(0, 0.5, n) * (r.random(n) < 0.8), r.uniform(0, 0.5, n) * (r.random(n) < 0.8)
        d, price, sides = al.bounded_step(h, g, low, high)
        assert abs(d.sum()) < 1e-10 and (d >= low - 1e-12).all() and (d <= high + 1e-12).all()
        value = lambda v: 0.5 * v @ h @ v + g @ v
        for _ in range(300):
            other = np.clip(d + 0.1 * r.standard_normal(n), low, high)
            gap = -other.sum()
            room = (high - other) if gap > 0 else (other - low)
            if room.sum() >= abs(gap):
                other = other + np.sign(gap) * room * abs(gap) / max(room.sum(), 1e-300)
                assert value(other) >= value(d) - 1e-9


def test_solver_names(spark):
    with pytest.raises(ValueError, match="exact, squared"):
        wf.Options(risk_budget_solver="none")
    whole = pf.matrices(long_rows(spark, random_covariances([3, 5])), ["k"])
    with pytest.raises(ValueError, match="exact, squared"):
        pf.risk_budget_weights(whole, ["k"], "none")
    for solver in al.SOLVERS:
        got = pf.risk_budget_weights(whole, ["k"], solver).collect()
        assert len(got) == 8 and all(abs(g.share - (1 / 3 if g.k == 0 else 1 / 5)) < 1e-5 for g in got)
    x = np.random.default_rng(0).normal(0.0003, 0.01, (330, 4))
    days = np.array([dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(330)])
    a, b = (wf.walk(days, x, wf.Options(n_states=2, initial_window=260, first_n_iter=5, refit_n_iter=2, risk_budget_solver=s)) for s in al.SOLVERS)
    assert np.allclose(a["returns"]["ret"], b["returns"]["ret"], atol=1e-6)


def test_audit_takes_the_best_start(spark):
    covs = list(random_covariances([5, 6], seed=4))
    lim, r = al.Limits(0.0, 0.25, 0.2), np.random.default_rng(8)
    held = {k: np.full(len(c), 1 / len(c)) for k, c in covs}
    holdings = spark.createDataFrame([(k, v.tolist()) for k, v in held.items()], "k int, before array<double>")
    whole = pf.matrices(long_rows(spark, covs), ["k"])
    got = {g.k: g for g in pf.best_feasible(whole, holdings, ["k"], 6, 1, lim).collect()}
    again = {g.k: g for g in pf.best_feasible(whole.repartition(3), holdings, ["k"], 6, 1, lim).collect()}
    for k, c in covs:
        w, even = np.array(got[k].weights), np.full(len(c), 1 / len(c))
        assert abs(w.sum() - 1) < 1e-9 and w.max() <= 0.25 + 1e-6 and np.abs(w - held[k]).sum() <= 0.2 + 1e-6
        assert abs(al.squared_error(w, c, even) - got[k].error) < 1e-12 and got[k].start == again[k].start
        assert got[k].error <= al.squared_error(al.project(al.risk_budget(c, even), held[k], lim), c, even) + 1e-12
        for _ in range(300):
            other = al.project(w + 0.05 * r.standard_normal(len(c)), held[k], lim)
            assert al.squared_error(other, c, even) >= got[k].error - 1e-7
