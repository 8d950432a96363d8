"""Study drivers, strict sources and the networks' checkpoints."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import hmm, inference, lstm
from quillon.operators import evaluation as ev
from quillon.operators import joins as jo
from quillon.plans import studies as st
from quillon.plans import walkforward as wf
from quillon.sources import io
from quillon.sources import panel as pn


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_arms_and_specs():
    base = wf.Options()
    arms = st.refit_arms(base)
    assert not arms["no_refit"].refit_at_rebalance and arms["monthly"].refit_every_n_rebalances == 1 and arms["quarterly"].refit_every_n_rebalances == 3
    assert st.robustness(base, ["A"])["without_A"] == (base, "A") and st.robustness(base, [])["two_states"][0].n_states == 2
    with pytest.raises(ValueError):
        st.retraining_arms(base)  # nothing was trained


def test_scenario_rows(spark):
    rows = [(dt.date(2024, 1, d), a, 0.1) for d in (1, 2, 3) for a in "AB"]
    got = st.scenario_rows(table(spark, rows, "date date, asset string, ret double"), {"all": None, "one": "B"}, last_day="2024-01-02").collect()
    assert sorted((r.scenario, r.date.day, r.asset) for r in got) == [("all", 1, "A"), ("all", 1, "B"), ("all", 2, "A"), ("all", 2, "B"), ("one", 1, "A"), ("one", 2, "A")]


def test_contrasts_share_paths(spark):
    r = np.random.default_rng(0)
    names = sorted({c for d in st.CONTRASTS.values() for c in d})
    values = {c: r.normal(0.001, 0.01, 120) for c in names}
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(k), c, float(v)) for c in names for k, v in enumerate(values[c])]
    daily = table(spark, rows, "date date, config string, ret double")
    got = {x.contrast: x for x in st.contrasts(daily, draws=50, seed=7).collect()}
    assert set(got) == set(st.CONTRASTS)
    of = lambda n: sum(s * inference.sharpe(values[c]) for c, s in st.CONTRASTS[n].items())
    for n, x in got.items():
        assert abs(x.point - of(n)) < 1e-9 and x.low <= x.high
    third = got["rq2_difference_in_differences"].point
    assert abs(third - (got["rq1_lstm_regime_effect"].point - got["rq1_erc_regime_effect"].point)) < 1e-9
    for k, (n, d) in enumerate(st.CONTRASTS.items()):
        here = inference.difference_interval([values[c] for c in d], list(d.values()), draws=50, seed=7, stream=k)
        assert abs(got[n].low - here["low"]) < 1e-12 and abs(got[n].high - here["high"]) < 1e-12 and abs(got[n].block_length - here["block_length"]) < 1e-9
    again = {x.contrast: x.low for x in st.contrasts(daily.repartition(7), draws=50, seed=7).collect()}
    assert all(abs(again[n] - got[n].low) < 1e-12 for n in got)  # the same draws for any number of tasks
    with pytest.raises(Exception, match="lstm_blend"):
        st.contrasts(daily.where("config <> 'lstm_blend'"), draws=5).collect()
    with pytest.raises(Exception, match="days differ"):
        st.contrasts(daily.where("NOT (config = 'erc_blend' AND date = DATE '2024-01-05')"), draws=5).collect()
    with pytest.raises(Exception, match="finite"):
        st.contrasts(daily.withColumn("ret", F.when(F.col("date") == "2024-01-05", float("nan")).otherwise(F.col("ret"))), draws=5).collect()
    with pytest.raises(Exception, match="repeated"):
        st.contrasts(daily.unionByName(daily.where("date = DATE '2024-01-05'")), draws=5).collect()
    with pytest.raises(Exception, match="at least 10"):
        st.contrasts(daily.where("date < DATE '2024-01-05'"), draws=5).collect()


def test_arm_tables(spark):
    day = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(4)]
    daily = table(spark, [("a", d, x, 0.0, t) for d, x, t in zip(day, (0.01, -0.02, 0.03, 0.0), (None, 0.5, None, None))], "arm string, date date, ret double, risk_free double, executed double")
    decided = table(spark, [("a", day[0], 0.5, True), ("a", day[2], 0.1, False)], "arm string, date date, turnover double, turnover_binding boolean")
    got = {r.fee_bps: r for r in st.arm_tables(daily, decided, F.lit("test"), [0, 100], ["arm"]).collect()}
    net = np.array([0.01, 0.98 * (1 - 0.005) - 1, 0.03, 0.0])
    assert abs(got[100.0].sharpe_net - inference.sharpe(net)) < 1e-9 and abs(got[100.0].cagr_net - (np.prod(1 + net) ** (252 / 4) - 1)) < 1e-9
    assert got[0.0].binding == 1 and got[0.0].rebalances == 2 and abs(got[0.0].mean_turnover - 0.3) < 1e-12


def test_seed_checks_and_comparison(spark):
    rows = [(s, c, v, 0.1 * s + k + (v == "new"), 0.0, 0.0) for s in (0, 1) for k, c in enumerate(("x", "y")) for v in ("old", "new")]
    t = table(spark, rows, "seed int, config string, version string, sharpe double, cagr double, max_drawdown double")
    new = t.where("version = 'new'")
    assert st.checked_seeds(new, [0, 1], ["x", "y"]).count() == 4
    for bad in (new.limit(3), new.unionByName(new.limit(1)), new.unionByName(new.limit(1).withColumn("seed", F.lit(9)))):
        with pytest.raises(ValueError):
            st.checked_seeds(bad, [0, 1], ["x", "y"])
    x = {r.config: r for r in st.comparison(t, "version", ("old", "new")).collect()}["x"]
    assert abs(x.sharpe_old - 0.05) < 1e-12 and abs(x.sharpe_change - 1) < 1e-12 and abs(x.sharpe_old_sd - np.std([0, 0.1], ddof=1)) < 1e-12
    e = {r.version: r for r in st.effect_summary(t, "version", ("y", "x")).collect()}
    assert e["old"].n == 2 and e["old"].positive == 2 and abs(e["old"].mean - 1) < 1e-12


def test_sensitivity_grid(spark):
    c = table(spark, [("f", 0.1), ("f", 0.3), ("g", 0.2)], "family string, v double")
    s = st.search_scenarios(c, "family", "v", {"all": F.lit(True), "none": F.lit(False)}, logged=4)
    got = {(r.kind, r.name): r.value for r in s.collect()}
    assert got == pytest.approx({("variance", "pooled_all"): 0.01, ("variance", "family_f"): 0.02, ("variance", "conventional_unit_variance"): 1.0, ("trials", "deduped_candidate_count"): 3.0, ("trials", "coherent_search_families"): 2.0, ("trials", "literal_logged_trials"): 4.0})
    x = np.random.default_rng(1).normal(0.001, 0.01, 200)
    daily = table(spark, [("p", float(v)) for v in x], "config string, ret double")
    grid = st.sensitivity_grid(daily, ["config"], s).collect()
    assert len(grid) == 9
    d = x - x.mean()
    skew, kurt = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2
    for r in grid:
        about = (x.mean() / x.std(ddof=1), r.variance, r.trials, 200, skew, kurt)
        assert abs(r.dsr_l - inference.deflated(*about)) < 1e-9 and abs(r.dsr_ls_gaussian - inference.location_scale(*about)[0]) < 1e-9
    for bad in ((0.1, 0.0, 3), (0.1, float("nan"), 3), (0.1, 0.1, 0)):
        with pytest.raises(ValueError):
            inference.location_scale(*bad, 100, 0, 3)


def test_strict_joins(spark):
    a, b = table(spark, [(1, 1.0), (2, 2.0)], "k int, weight double"), table(spark, [(1, 3.0), (2, 1.0), (3, 0.0)], "k int, other double")
    assert jo.one_to_one_left(a, b, ["k"]).count() == 2
    for left, right in ((a, b.where("k <> 2")), (a.unionByName(a), b), (a, b.unionByName(b))):
        with pytest.raises(Exception, match="no match|repeated"):
            jo.one_to_one_left(left, right, ["k"]).collect()
    w = table(spark, [(dt.date(2024, 1, d), x, v) for d, x, v in ((1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.4), (2, "b", 0.6))], "date date, asset string, weight double")
    assert abs(ev.average_turnover(w, w.withColumn("weight", F.lit(0.5))).first()[0] - 0.1) < 1e-12


def test_sources(spark, tmp_path):
    (tmp_path / "rf.csv").write_text("date,yield_pct_prior,rf_daily\n2024-01-02,5.0,0.0002\n2024-01-03,5.1,0.00021\n2024-01-04,,\n")
    days = lambda *d: table(spark, [(dt.date(2024, 1, x),) for x in d], "date date")
    assert [r.rf_daily for r in pn.read_risk_free(spark, str(tmp_path / "rf.csv"), days(2, 3)).orderBy("date").collect()] == [0.0002, 0.00021]
    for d in (days(2, 5), days(4)):
        with pytest.raises(Exception, match="no match|no rf_daily"):
            pn.read_risk_free(spark, str(tmp_path / "rf.csv"), d).collect()
    (tmp_path / "y.csv").write_text("DATE,Y\n2024-01-02,5.25\n2024-01-03,.\n")
    assert [r.yield_pct for r in pn.read_yields(spark, str(tmp_path / "y.csv")).orderBy("obs_date").collect()] == [5.25, None]
    f = table(spark, [(1.0,), (None,), (float("nan"),), (float("-inf"),)], "x double")
    assert [r.x for r in pn.finite(f, ["x"]).collect()] == [1.0]
    panel, regimes = pn.synthetic_prices(spark, 30, ["a", "b"], seed=3)
    r, states = pn.synthetic_panel(30, ["a", "b"], seed=3)
    assert panel.count() == 60 and [x.regime for x in regimes.orderBy("date").collect()] == states.tolist()
    last = panel.where("asset = 'b'").orderBy(F.desc("date")).first().close
    assert abs(last - 100 * np.exp(r[:, 1].sum())) < 1e-9


def test_shards(spark, tmp_path):
    shards = tmp_path / "shards"
    shards.mkdir()
    for k in range(3):
        (shards / f"shard_{k}.csv").write_text(f"seed,v\n{k},0.{k}\n")
    (shards / "other.csv").write_text("seed,v\n9,9\n")
    out = io.merge_shards(spark, str(shards), "seed int, v double", str(tmp_path / "all"))
    assert sorted((r.seed, r.v) for r in out.collect()) == [(0, 0.0), (1, 0.1), (2, 0.2)] and "other.csv" in os.listdir(shards) and not any(f.startswith("shard_") for f in os.listdir(shards))
    with pytest.raises(Exception):
        io.merge_shards(spark, str(shards), "seed int, v double", str(tmp_path / "all"))
    assert io.union_all([out, out.withColumn("more", F.lit(1))]).where("more IS NULL").count() == 3


def test_checkpoint(tmp_path):
    net = lstm.BudgetLstm(3, 4, hidden=6, floor=0.05, seed=2)
    net.save(str(tmp_path / "n.npz"), seed=2, variant="regime", epochs=5)
    again, about = lstm.BudgetLstm.load(str(tmp_path / "n.npz"))
    x = np.random.default_rng(0).normal(size=(5, 7, 3))
    assert (again.forward(x)[0] == net.forward(x)[0]).all() and about["variant"] == "regime" and about["n_features"] == 3
    assert np.allclose(net.forward(x)[0][2], net.forward(x[2])[0], atol=1e-14)  # a batch is its windows


def test_features_reach_the_networks():
    x, _ = pn.synthetic_panel(420, list("abcdef"), seed=4)
    dates = np.array(np.busday_offset("2020-01-01", np.arange(420), roll="forward"), dtype="datetime64[ns]")
    o = wf.Options(n_states=2, initial_window=330, refit_n_iter=3, first_n_iter=10, lstm_epochs=2, lstm_cov_window=100)
    features = np.full((420, 4), np.nan)
    features[62:] = np.random.default_rng(0).normal(size=(358, 4))
    one, two = (wf.walk(dates, x, o, features=f)["returns"].set_index("config").ret for f in (features, 2 * features))
    assert (one["erc_regime"].to_numpy() == two["erc_regime"].to_numpy()).all() and not np.allclose(one["lstm_regime"], two["lstm_regime"], atol=1e-12)
    features[400] = np.nan
    with pytest.raises(ValueError):
        wf.walk(dates, x, o, features=features)


def test_alignment():
    r = np.random.default_rng(3)
    m = hmm.Regimes(np.array([0.2, 0.3, 0.5]), r.dirichlet(np.ones(3), 3), r.normal(size=(3, 2)), np.stack([np.eye(2) * k for k in (1, 2, 3)]))
    p = np.array([2, 0, 1])
    back = hmm.aligned(m.permuted(p), m)
    assert np.allclose(back.means, m.means) and np.allclose(back.step, m.step) and np.allclose(back.start, m.start)
    assert hmm.bhattacharyya(m.means[0], m.covs[0], m.means[0], m.covs[0]) == pytest.approx(0)
    assert hmm.bhattacharyya(np.zeros(2), np.eye(2), np.zeros(2), np.diag([-1.0, 1.0])) == float("inf")
