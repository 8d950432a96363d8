"""The streamed walk equals the batch walk in every table, after restarts in mid-run too."""

import shutil

import numpy as np
import pandas as pd
import pytest

from quillon.plans import walkforward as wf
from quillon.streaming import walk as sw

DAYS, ASSETS = 420, 4
SCENARIOS = {
    "open": wf.Options(n_states=2, initial_window=200, first_n_iter=10, refit_n_iter=4, refit_every_n_rebalances=2, include_hrp=True, refit_state_cov_ewma=0.5),
    "nets": wf.Options(n_states=2, initial_window=200, first_n_iter=10, refit_n_iter=4, lstm_epochs=3, lstm_retrain_every_n_rebalances=3, lstm_retrain_n_epochs=2, lstm_cov_window=80, lstm_seq_len=20),
}


@pytest.fixture(scope="module")
def days():
    r = np.random.default_rng(4)
    x = r.normal(0.0004, 0.01, (DAYS, ASSETS))
    overnight = 0.3 * x + r.normal(0, 0.002, x.shape)
    features = r.normal(size=(DAYS, 5))
    features[:30] = np.nan
    return np.array(pd.bdate_range("2021-01-01", periods=DAYS).date), x, overnight, x - overnight, features


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, sw.STORE)
    yield spark
    spark.conf.set(name, old)


def rows_of(days, scenarios, at):
    dates, x, co, oc, features = days
    months = pd.PeriodIndex(pd.to_datetime(dates), freq="M")
    decides = np.append(months[1:] != months[:-1], True)
    cell = lambda f: None if np.isnan(f).any() else f.tolist()
    return [(s, dates[k], bool(decides[k]), x[k].tolist(), co[k].tolist(), oc[k].tolist(), cell(features[k])) for s in scenarios for k in at]


@pytest.mark.parametrize("next_open", [True, False])
def test_restarts_change_nothing(rocks, tmp_path, days, next_open):
    names = list(SCENARIOS)
    schema = f"scenario string, {sw.DAY}"
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    # before the first fit, in mid-month, between a decision and its execution; the third part repeats days
    cuts = [(0, 150), (150, 290), (280, 324), (324, DAYS)]
    for k, (a, b) in enumerate(cuts):
        part = rows_of(days, names, np.random.default_rng(k).permutation(np.arange(a, b)))
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = sw.stream(rocks.readStream.schema(schema).parquet(source), SCENARIOS, next_open, features=5)
        run = query.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination(300)
        run.stop()  # a new query goes on from the checkpoint
    got = rocks.read.parquet(out)
    dates, x, co, oc, features = days
    for name, o in SCENARIOS.items():
        want = wf.walk(dates, x, o, *((co, oc) if next_open else (None, None)), features)
        for t, frame in want.items():
            mine = wf.table(got, t).where(f"scenario = '{name}'").drop("scenario").toPandas()
            keys = ["date"] + ["config"] * ("config" in frame)
            a, b = (f.sort_values(keys).reset_index(drop=True) for f in (mine, frame))
            assert len(a) == len(b) and len(a) > 0
            for c in b.columns:
                assert a[c].map(lambda v: tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v).tolist() == b[c].map(lambda v: tuple(v) if isinstance(v, list) else v).tolist(), (name, t, c)
    shutil.rmtree(out)


def test_needs_its_store(spark):
    schema = f"scenario string, {sw.DAY}"
    with pytest.raises(ValueError, match="providerClass"):
        sw.stream(spark.createDataFrame([], schema), SCENARIOS)


def test_day_rows(spark):
    import datetime as dt

    rows = [(s, dt.date(2024, m, d), a, 0.1, 0.2, k) for s in "xy" for k, (m, d) in enumerate([(1, 30), (1, 31), (2, 1)]) for a in "BA"]
    got = sw.day_rows(spark.createDataFrame([(s, d, a, float(k) + (a == "B"), o, i * 1.0) for s, d, a, o, i, k in rows], "scenario string, date date, asset string, ret double, overnight double, intraday double")).orderBy("scenario", "date").collect()
    assert [r.decides for r in got] == [False, True, True] * 2 and [r.ret for r in got[:3]] == [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]] and got[0].features is None
