"""Regimes over blocks and bootstrap draws as rows: any block, any number of tasks, the same result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import hmm, inference
from quillon.operators import bootstrap as bs
from quillon.operators import regimes as rg

SERIES = {"long": 150, "short": 23, "one": 1}


@pytest.fixture(scope="module")
def observed(spark):
    r = np.random.default_rng(6)
    values = {k: r.normal(0, 1, (n, 4)) * np.where((np.arange(n) // 20 % 2)[:, None], 2.5, 0.7) for k, n in SERIES.items()}
    return values, spark.createDataFrame([(k, t + 1, x.tolist()) for k, v in values.items() for t, x in enumerate(v)], "s string, t bigint, x array<double>").repartition(3)


def begin():
    step = np.full((3, 3), 0.05) + 0.85 * np.eye(3)
    return hmm.Regimes(np.array([0.5, 0.3, 0.2]), step, np.zeros((3, 4)), np.stack([v * np.eye(4) for v in (0.3, 1.5, 6.0)]))


def models(spark, keys):
    m = begin()
    return spark.createDataFrame([(k, m.start.tolist(), m.step.ravel().tolist(), m.means.ravel().tolist(), m.covs.ravel().tolist()) for k in keys], "s string, start array<double>, step array<double>, means array<double>, covs array<double>")


@pytest.mark.parametrize("block", [2, 7, 64, 10_000])
def test_paths_for_any_block(spark, observed, block):
    values, df = observed
    got = {(r.s, r.t): (r.filtered, r.smoothed) for r in rg.probabilities(df, models(spark, SERIES), ["s"], block).collect()}
    assert len(got) == sum(SERIES.values())
    for k, x in values.items():
        dens = hmm.emissions(begin(), x)
        alpha = hmm.filtered(begin(), dens)[0]
        gamma = hmm.smoothed(begin(), dens)[0] if len(x) > 1 else alpha
        assert np.allclose([got[k, t + 1][0] for t in range(len(x))], alpha, atol=1e-12) and np.allclose([got[k, t + 1][1] for t in range(len(x))], gamma, atol=1e-12)


@pytest.mark.parametrize("block", [11, 1000])
def test_fits_for_any_block(spark, observed, block):
    values, df = observed
    keys = ["long", "short"]
    got = {r.s: r for r in rg.fit(df.where("s <> 'one'"), models(spark, keys), ["s"], rounds=4, tolerance=1e-9, block=block).collect()}
    for k in keys:
        m = hmm.fit(values[k], 3, rounds=4, tolerance=1e-9, begin=begin())
        assert got[k].steps == 4 and abs(got[k].loglik - m.loglik) < 1e-8 and abs(got[k].bic - hmm.bic(m, len(values[k]))) < 1e-7
        assert np.allclose(got[k].means, m.means.ravel(), atol=1e-9) and np.allclose(got[k].covs, m.covs.ravel(), atol=1e-9) and np.allclose(got[k].step, m.step.ravel(), atol=1e-9)


def test_fits_rest_one_by_one(spark, observed):
    values, df = observed
    got = {r.s: r.steps for r in rg.fit(df.where("s <> 'one'"), models(spark, ["long", "short"]), ["s"], rounds=5, tolerance=2.0, block=50).collect()}
    assert got == {k: hmm.fit(values[k], 3, rounds=5, tolerance=2.0, begin=begin()).steps for k in got}


def test_no_observations(spark, observed):
    assert rg.probabilities(observed[1].limit(0), models(spark, SERIES), ["s"]).count() == 0
    assert rg.fit(observed[1].limit(0), models(spark, []), ["s"], rounds=2).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_quantiles_of_a_sort(spark, parts):
    r = np.random.default_rng(2)
    values = {"a": r.normal(size=1001), "b": np.repeat(r.normal(size=7), 30), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, v double").repartition(parts)
    at = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = {(g.k, g.q): g.quantile for g in bs.quantiles(df, ["k"], "v", at).collect()}
    assert len(got) == 20 and all(abs(got[k, q] - np.quantile(v, q)) < 1e-12 for k, v in values.items() for q in at)


def test_draws_are_numbered(spark):
    r = np.random.default_rng(3)
    x = r.normal(0.001, 0.01, (2, 90))
    rows = spark.createDataFrame([("p", 3, [1, -1], x.tolist())], "contrast string, stream int, signs array<int>, series array<array<double>>")
    ready = bs.points(rows, [], 6.5)
    a, b = ({d.draw: d.statistic for d in bs.draw(ready, [], 130, 9, block).collect()} for block in (7, 1000))
    want = inference.drawn(x, np.array([1, -1]), 6.5, 9, 3, np.arange(130))
    assert a == b and [a[k] for k in range(130)] == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        bs.points(rows, [], 0.5)
    with pytest.raises(ValueError):
        bs.intervals(rows, [], level=1.0)
    got = bs.intervals(rows.withColumn("stage", F.lit("test")), ["stage"], 50, 1, length=5.0).first()
    here = inference.difference_interval(list(x), [1, -1], draws=50, seed=1, stream=3, length=5.0)
    assert (got.stage, got.contrast) == ("test", "p") and abs(got.low - here["low"]) < 1e-12 and abs(got.high - here["high"]) < 1e-12


def test_densities_of_many_series(spark, observed):
    """Degrees of freedom, moments and scores equal the kernels' for each series; a series that doesn't move has no residuals."""
    from quillon.functions import densities as de
    from quillon.operators import densities as dn

    values, df = observed
    df = df.where("s <> 'one'")
    m = begin()
    paths = rg.probabilities(df, models(spark, ["long", "short"]), ["s"], 40).drop("smoothed").cache()
    z = dn.residuals(df, ["s"])
    pooled = dn.models(dn.moments(df, ["s"], 4), dn.degrees_of_freedom(z, ["s"]), ["s"])
    states = dn.models(dn.moments(dn.state_rows(df, paths, ["s"]), ["s", "state"], 4, "p"), dn.degrees_of_freedom(dn.state_rows(z, paths, ["s"]), ["s", "state"], "p"), ["s", "state"])
    got = {(r.s, r.t): (r.pooled, r.mixed) for r in dn.scores(df, paths, pooled, states, ["s"]).collect()}
    whole, each = {r.s: r for r in pooled.collect()}, {(r.s, r.state): r for r in states.collect()}
    for k in ("long", "short"):
        x = values[k]
        p = hmm.filtered(m, hmm.emissions(m, x))[0]
        u = (x - x.mean(axis=0)) / x.std(axis=0)
        one = de.Pooled.fit(x, de.fit_nu(u.ravel()))
        nus = np.array([de.fit_nu(u.ravel(), w=np.repeat(c, 4)) for c in p.T])
        mix = de.Mixture.fit(x, p, nus)
        assert whole[k].nu == one.nu and np.allclose(whole[k].scale, one.scale.ravel(), atol=1e-12)
        assert [each[k, j].nu for j in range(3)] == nus.tolist()
        assert all(np.allclose(each[k, j].implied, mix.covariances()[j].ravel(), atol=1e-10) and np.allclose(each[k, j].mean, mix.means[j], atol=1e-12) for j in range(3))
        assert np.allclose([got[k, t + 1][0] for t in range(len(x))], one.log_density(x), atol=1e-9)
        assert np.allclose([got[k, t + 1][1] for t in range(len(x))], mix.log_density(x, p), atol=1e-9)
    still = spark.createDataFrame([("q", t, [1.0]) for t in range(5)], "s string, t bigint, x array<double>")
    assert dn.degrees_of_freedom(dn.residuals(still, ["s"]), ["s"]).count() == 0
