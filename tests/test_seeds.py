"""The study over seeds resumes after an interruption and equals walks that train on their own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.plans import seeds
from quillon.plans import walkforward as wf

O = wf.Options(n_states=2, initial_window=200, first_n_iter=8, refit_n_iter=3, lstm_epochs=2, lstm_cov_window=80, lstm_seq_len=20)  # noqa: E741


@pytest.fixture(scope="module")
def panel(spark):
    x = np.random.default_rng(1).normal(0.0004, 0.01, (260, 4))
    days = np.array([dt.date(2021, 1, 1) + dt.timedelta(k) for k in range(260)])
    rows = [(days[k], f"a{j}", float(x[k, j]), float(0.4 * x[k, j]), float(0.6 * x[k, j])) for k in range(260) for j in range(4)]
    return days, x, spark.createDataFrame(rows, "date date, asset string, ret double, overnight double, intraday double")


def test_resumes(spark, tmp_path, panel, monkeypatch):
    days, x, returns = panel
    folder = str(tmp_path / "study")
    seeds.train(returns, [1], O, folder)
    first = {(r.seed, r.network): r.f for r in spark.read.parquet(f"{folder}/networks").select("seed", "network", F.input_file_name().alias("f")).collect()}
    # interrupted after the first lot of walks
    lots, real = [], seeds._in_lots

    def breaks(pending, at_once):
        for k, lot in enumerate(real(pending, at_once)):
            if len(lot[0]) == 1 and k == 1:
                raise KeyboardInterrupt
            lots.append(lot)
            yield lot

    monkeypatch.setattr(seeds, "_in_lots", breaks)
    with pytest.raises(KeyboardInterrupt):
        seeds.study(returns, [1, 2, 3], O, folder, at_once=2)
    assert lots == [[(2, "baseline"), (2, "regime")], [(3, "baseline"), (3, "regime")], [(1,), (2,)]]
    lots.clear()
    monkeypatch.setattr(seeds, "_in_lots", lambda p, n: (lots.append(lot) or lot for lot in real(p, n)))
    got = seeds.study(returns, [1, 2, 3], O, folder, at_once=2).toPandas()
    assert lots == [[(3,)]]  # only what was missing
    again = {(r.seed, r.network): r.f for r in spark.read.parquet(f"{folder}/networks").select("seed", "network", F.input_file_name().alias("f")).collect()}
    assert all(again[k] == f for k, f in first.items()) and len(again) == 6
    for s in (1, 2, 3):
        want = wf.walk(days, x, wf.Options(**{**O.__dict__, "seed": s}), 0.4 * x, 0.6 * x)["returns"]
        mine = got[(got["seed"] == s) & (got["table"] == "returns")]
        a, b = (f.sort_values(["date", "config"])["ret"].to_numpy(float) for f in (mine, want))
        assert len(a) == len(b) and np.abs(a - b).max() < 1e-13
    lots.clear()
    assert seeds.study(returns, [3, 1], O, folder).select("seed").distinct().count() == 2 and not lots


def test_missing_parts_are_errors(spark, tmp_path, panel):
    _, _, returns = panel
    folder = str(tmp_path / "study")
    seeds.train(returns, [5], O, folder)
    spark.read.parquet(f"{folder}/networks").where("network = 'regime'").write.partitionBy("seed", "network").parquet(f"{tmp_path}/half/networks")
    with pytest.raises(Exception, match="a network is missing"):
        seeds.walk(returns, [5], O, str(tmp_path / "half"))
