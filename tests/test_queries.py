"""Every query with SQL against DuckDB at the smallest scale; the others for rows and finite values."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import numeric_queries  # noqa: F401  adds its queries
from quillon.plans import queries as q

SLOW = {"walk_forward_full", "lstm_walk", "walk_forward_decisions"}


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return f"{round(v, 7) + 0.0:.7f}"
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows(df, columns):
    return sorted(tuple(cell(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in q.ORACLES if n in {"panel_ohlc", "rolling_volatility", "rolling_avg_correlation", "asof_prior_yield", "carry_forward", "pairwise_l1", "bounded_softmax", "performance_by_stage", "cost_sensitivity", "reliability_path", "opening_turnover", "autocovariance", "lstm_windows", "erc_shrunk_weights", "regime_probabilities", "regime_em_round", "predictive_densities", "feature_rows", "search_scenarios", "asof_prior_yield", "excess_sharpe", "scenario_grid", "sensitivity_grid", "regime_fits_by_pair", "regime_paths_by_pair", "density_models_by_pair", "density_scores_by_pair", "block_lengths", "bootstrap_intervals", "trailing_covariances", "erc_by_decision", "leaf_orders", "hierarchical_by_decision", "projected_decisions"}])
def test_against_sql(spark, sf, duck, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got, sorted(got.columns)), rows(want, sorted(got.columns))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or abs(float(u) - float(v)) < 1e-6


def test_all_have_names(spark, sf):
    assert len(q.QUERIES) > 75 and set(q.ORACLES) <= set(q.QUERIES)


@pytest.mark.parametrize("name", ["erc_weights", "projection", "hmm_filter", "scenario_grid", "bootstrap_contrasts"])
def test_kernels_run(spark, sf, name):
    got = q.QUERIES[name](spark, sf).toPandas()
    assert len(got) and not got.isna().any().any()


@pytest.mark.parametrize("name, rows", [("seed_study", q._lstm_returns), ("study_contrasts", q._lstm_returns), ("solver_audit", numeric_queries._shrunk)])
def test_jobs_after_the_first_read_no_lines(spark, sf, name, rows):
    assert not [f for f in rows(spark, sf).inputFiles() if "lineitem" in f]


def test_rates_read_no_orders_again(spark, sf):
    days = spark.sql("SELECT explode(sequence(DATE'1993-01-01', DATE'1993-03-01')) AS date")
    assert not [f for f in q.daily_rates(spark, sf, days).inputFiles() if "orders" in f]


def test_solver_audit_has_one_panel(spark, sf, monkeypatch):
    panels, build = [], q.pn.derived_panel
    monkeypatch.setattr(q.pn, "derived_panel", lambda *a: panels.append(a) or build(*a))
    q.QUERIES["solver_audit"](spark, sf)
    assert len(panels) == 1
