"""Yields from a server, writes that are checked in passing, and the small sources and sinks."""

import datetime as dt
import http.server
import json
import os
import shutil
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import io, yields
from quillon.sources import panel as pn

DAYS = {dt.date(2019, 12, 30) + dt.timedelta(k): "." if k % 7 == 0 else f"{1 + k / 1000:.3f}" for k in range(800)}


@pytest.fixture(scope="module")
def server():
    """A server of yields that fails the first time it is asked for a range, and always for the year 2030."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
            again = self.path in asked
            asked.append(self.path)
            if self.path.startswith("/missing"):
                return self.send_error(404)
            if q.get("to", "").startswith("2030") or (q and not again):
                return self.send_error(503)
            a, b = (dt.date.fromisoformat(q.get(k, v)) for k, v in (("from", "1900-01-01"), ("to", "2100-01-01")))
            body = "no,header\n".replace("no,header", "oops") if self.path == "/odd" else "DATE,DGS\n" + "".join(f"{d},{v}\n" for d, v in DAYS.items() if a <= d <= b)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_yields_by_year(spark, server):
    url, asked = server
    df = yields.read_yields(spark, url + "/y?from={start}&to={end}", start="2019-12-31", end="2022-02-28")
    assert df.rdd.getNumPartitions() == 4
    got = {r.obs_date: r.yield_pct for r in df.collect()}
    assert got == {d: None if v == "." else float(v) for d, v in DAYS.items() if dt.date(2019, 12, 31) <= d <= dt.date(2022, 2, 28)}
    assert "/y?from=2020-01-01&to=2020-12-31" in asked and asked.count("/y?from=2021-01-01&to=2021-12-31") >= 2  # asked again after a failure
    whole = yields.read_yields(spark, url + "/all", start="2020-01-01", end="2020-01-31")
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 31
    dates = spark.createDataFrame([(dt.date(2020, 3, 2),), (dt.date(2020, 3, 3),)], "date date")
    rates = {r.date: r for r in pn.risk_free_daily(dates, yields.read_yields(spark, url + "/all")).collect()}
    for d, r in rates.items():
        before = max(x for x, v in DAYS.items() if x < d and v != ".")
        assert r.yield_pct_prior == float(DAYS[before]) and abs((1 + r.rf_daily) ** 252 - 1 - float(DAYS[before]) / 100) < 1e-12


def test_yields_that_fail(spark, server, tmp_path):
    url, asked = server
    for bad, words in (("/missing", "404"), ("/y?from={start}&to={end}", "503"), ("/odd", "no header")):
        with pytest.raises(Exception, match=words):
            yields.read_yields(spark, url + bad, start="2030-01-01", end="2030-12-31", retries="2").collect()
    assert asked.count("/missing") >= 1
    with pytest.raises(Exception, match="start must not"):
        yields.read_yields(spark, url, start="2030-01-01", end="2020-01-01").collect()
    (tmp_path / "y.csv").write_text("DATE,Y\n2024-01-02,5.25\n2024-01-03,\n\n2024-01-04T00:00:00,.\n")
    assert sorted((r.obs_date.day, r.yield_pct) for r in yields.read_yields(spark, f"file://{tmp_path}/y.csv").collect()) == [(2, 5.25), (3, None), (4, None)]


def test_days_before_the_first_yield(spark):
    dates = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 3),)], "date date")
    y = spark.createDataFrame([(dt.date(2020, 1, 1), 2.0), (dt.date(2020, 1, 2), None)], "obs_date date, yield_pct double")
    with pytest.raises(Exception, match="no rf_daily"):
        pn.risk_free_daily(dates, y).collect()
    assert sorted((r.date.day, r.rf_daily) for r in pn.risk_free_daily(dates, y, strict=False).collect()) == [(1, 0.0), (3, pytest.approx(1.02 ** (1 / 252) - 1))]


def test_checked_writes(spark, tmp_path):
    df = spark.range(100).withColumn("share", F.lit(0.01))
    sound = {"hundred": F.count("*") == 100, "whole": F.abs(F.sum("share") - 1) < 1e-9}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "")
    out = io.checked_write(df, str(tmp_path / "a"), **sound)
    assert len(tracker.getJobIdsForGroup("checked")) == 1  # no job of its own for the check
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 100 and out.dtypes == df.dtypes
    with pytest.raises(FileExistsError):
        io.checked_write(df, str(tmp_path / "a"), **sound)
    with pytest.raises(ValueError, match="^failed: hundred$"):
        io.checked_write(df.limit(99), str(tmp_path / "b"), hundred=F.count("*") == 100, any=F.count("*") > 0)
    assert os.listdir(tmp_path) == ["a"]
    assert io.checked_write(df, str(tmp_path / "c"), "csv", **sound).agg(F.sum("id")).first()[0] == 4950


def test_dates_candidates_and_fixed_text(spark):
    rows = [("2024-01-31",), ("2024-01-31 10:11:12",), ("2024-01-31T10:11:12",), ("1/31/2024",), ("soon",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(io.mixed_dates("t").alias("d"), "t").collect()
    assert [r.d for r in got] == [dt.date(2024, 1, 31)] * 4 + [None] * 2
    c = spark.createDataFrame([(1, "sharpe", None), (2, "sharpe", " "), (3, "sharpe", "1"), (4, "cagr", None)], "trial_id int, metric_type string, redundant_with string")
    assert [r.trial_id for r in io.candidates(c, "sharpe").collect()] == [1, 2] and io.candidates(c, "sharpe", dedupe=False).count() == 3
    assert spark.createDataFrame([(1 / 3,)], "x double").select(io.fixed_text("x")).first()[0] == "0.333333333333"


def test_caches_are_verified(spark, tmp_path):
    built, path = [], str(tmp_path / "cache")

    def build():
        built.append(1)
        return spark.range(5 * len(built))

    five = lambda df: df.count() == 5
    assert io.verified_cache(spark, path, build, five).count() == 5 and io.verified_cache(spark, path, build, five).count() == 5 and len(built) == 1
    assert io.verified_cache(spark, path, build, lambda df: df.count() == 10).count() == 10 and len(built) == 2  # a result that fails its check is built anew


def test_arrays_and_manifest(tmp_path):
    path = str(tmp_path / "a.npz")
    io.save_arrays(path, x=np.arange(3), y=np.eye(2))
    assert (io.load_arrays(path)["y"] == np.eye(2)).all()
    out = io.manifest(str(tmp_path / "m.json"), [path], {"seed": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == out and out["files"][path] == io.file_sha256(path) and len(out["files"][path]) == 64


def test_new_folders_and_requirements(spark, tmp_path):
    df = spark.range(4).withColumn("k", F.col("id") % 2)
    io.write_new(df, str(tmp_path / "n"), ["k"], "parquet")
    assert sorted(f for f in os.listdir(tmp_path / "n") if f.startswith("k=")) == ["k=0", "k=1"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_new(df, str(tmp_path / "n"))
    with pytest.raises(ValueError, match="many, odd"):
        io.require(df, many=F.count("*") > 5, odd=F.max("id") == 9, some=F.count("*") > 0)


def test_a_panel_reads_its_lines_once(spark, tmp_path):
    day = dt.datetime(1997, 5, 1)
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, 0), (1, 0), (2, 1)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(1, 0), (2, 1), (3, 2), (4, 9)], "s_suppkey bigint, s_nationkey int"),
        "lineitem": ([(1, day, 0.05, 0.04), (2, day, None, 0.07), (2, day, 0.09, None), (4, day, 0.5, 0.5), (None, day, 0.5, 0.5)], "l_suppkey bigint, l_shipdate timestamp, l_discount double, l_tax double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    panel = pn.derived_panel(spark, str(tmp_path))
    shutil.rmtree(tmp_path / "lineitem.parquet")
    found = {r["asset"]: r for r in panel.collect()}  # every later job works on the stored cells
    assert set(found) == {"AFRICA", "ASIA"} and found["ASIA"]["r"] == found["ASIA"]["co"] == 0
    assert found["AFRICA"]["r"] == pytest.approx(0.3 * (0.07 - 0.05)) and found["AFRICA"]["co"] == pytest.approx(0.1 * (0.055 - 0.04))
