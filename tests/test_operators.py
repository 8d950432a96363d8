import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import evaluation as ev
from quillon.operators import joins as jo
from quillon.operators import timeseries as ts
from quillon.sources import io
from quillon.sources import panel as pn


def day(s):
    return dt.date.fromisoformat(s)


def test_csv_panel(spark, tmp_path):
    for a, o in (("AAA", ",AdjOpen"), ("BBB", "")):
        (tmp_path / f"{a}.csv").write_text(f"Date,AdjClose{o}\n2024-01-02,10{',9' if o else ''}\n2024-01-03,11{',10' if o else ''}\n")
    p = pn.read_csv_panel(spark, str(tmp_path), ["AAA", "BBB"])
    assert p.count() == 4 and p.where("open is not null").count() == 0
    with pytest.raises(Exception):
        pn.read_csv_panel(spark, str(tmp_path), ["AAA", "CCC"])
    with pytest.raises(ValueError):
        pn.checked_panel(p.unionByName(p), ["AAA", "BBB"])


def test_month_ends_and_labels(spark):
    d = spark.createDataFrame([(day(x),) for x in ("2024-01-15", "2024-01-31", "2024-02-29", "2024-04-10")], "date date")
    assert sorted(r.date for r in ts.month_ends(d).collect()) == [day("2024-01-31"), day("2024-02-29"), day("2024-04-10")]
    got = {r.date: r.s for r in d.select("date", ts.stage_label([("train", "2024-01-31")]).alias("s")).collect()}
    assert got[day("2024-01-31")] == "train" and got[day("2024-02-29")] == "post"
    assert {r.k: r.refit for r in ts.every_nth(ts.month_ends(d), 3).collect()} == {1: False, 2: False, 3: True}


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(day("2024-01-01"),), (day("2024-01-02"),), (day("2024-01-05"),)], "date date")
    right = spark.createDataFrame([(day("2024-01-01"), 1.0), (day("2024-01-02"), None), (day("2024-01-05"), 5.0)], "o date, y double")
    got = {r.date: r.y for r in jo.as_of_prior(left, right, "date", "o", "y").collect()}
    assert got == {day("2024-01-01"): None, day("2024-01-02"): 1.0, day("2024-01-05"): 1.0}
    loose = {r.date: r.y for r in jo.as_of_prior(left, right, "date", "o", "y", strict=False).collect()}
    assert loose == {day("2024-01-01"): 1.0, day("2024-01-02"): 1.0, day("2024-01-05"): 5.0}
    with pytest.raises(Exception):
        jo.require_matched(jo.as_of_prior(left, right, "date", "o", "y"), "y").collect()


def test_strict_left(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(Exception, match="no match|repeated"):
        jo.strict_left(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="repeated"):
        jo.strict_left(a.where("k = 1"), b, ["k"]).collect()
    with pytest.raises(Exception, match="no match"):
        jo.strict_left(a, b.limit(1), ["k"]).collect()
    assert [tuple(r) for r in jo.strict_left(a.where("k = 1").unionByName(a.where("k = 1")), b.limit(1), ["k"]).collect()] == [(1, 5)] * 2
    assert {(r.k, r.side) for r in jo.one_to_one_outer(a, b.limit(1), ["k"]).collect()} == {(1, "both"), (2, "left_only")}


def test_measures(spark):
    rows = [(day("2024-01-01") + dt.timedelta(k), x) for k, x in enumerate((0.01, -0.02, 0.03, -0.01))]
    d = spark.createDataFrame(rows, "date date, ret double").withColumn("c", F.lit("x"))
    got = ev.performance(d, ["c"]).first()
    assert abs(got.max_drawdown + 0.02) < 1e-12 and got.n_days == 4
    flat = d.withColumn("ret", F.lit(0.0))
    got = ev.performance(flat, ["c"]).first()
    assert got.sharpe == 0 and got.sortino is None and got.calmar is None
    turns = spark.createDataFrame([(day("2024-01-02"), 0.5), (day("2030-01-01"), 1.0)], "date date, turnover double")
    net = {r.date: r.net for r in ev.net_returns(d.drop("c"), turns, [], 10.0).collect()}
    assert abs(net[day("2024-01-02")] - (0.98 * (1 - 0.0005) - 1)) < 1e-12 and net[day("2024-01-01")] == pytest.approx(0.01)


def test_sources(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text('trial_id,category,description,values_evaluated,selection_criterion,selected_value,counts_toward_dsr_trials,notes\n1,a,"x, y",1;2,c,1, True ,n\n2,a,x,1,c,1,False,n\n')
    assert io.counted_trials(io.read_csv(spark, str(log), io.TRIALS)).first().n == 1
    d = spark.createDataFrame([("2024-01-02",), ("2024-01-02 10:00:00",), ("1/2/2024",), ("x",)], "s string").select(io.mixed_dates("s").alias("d"))
    assert [r.d for r in d.collect()] == [day("2024-01-02")] * 3 + [None]
    io.write_new(d.where("d is not null"), str(tmp_path / "out"))
    with pytest.raises(Exception):
        io.write_new(d, str(tmp_path / "out"))
    assert io.manifest(str(tmp_path / "m.json"), [str(log)], {"a": 1})["files"][str(log)] == io.file_sha256(str(log))
    with pytest.raises(ValueError, match="many"):
        io.require(d, many=F.count("*") > 100)


def test_stream_equals_batch(spark, tmp_path):
    from quillon.operators import reliability as re
    from quillon.streaming.reliability import stream

    schema = "scenario string, date date, l0 double, l1 double"
    rows = [("s", day("2024-01-01") + dt.timedelta(k), -1.0, -1.0 + (-1) ** k * 0.3 * k) for k in range(6)]
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("pi_path").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.date: r.pi for r in spark.table("pi_path").collect()}
    want = {r.date: r.pi for r in re.path(spark.createDataFrame(rows, schema), ["scenario"], 0.97).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_one_to_one_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), spark.createDataFrame([(1, 5)], "k int, w int")
    for x, y in ((a, b), (b, a)):
        with pytest.raises(Exception, match="repeated"):
            jo.one_to_one_outer(x, y, ["k"]).collect()


def test_markdown_refuses_to_cut(spark):
    from quillon.sources import io

    assert io.markdown(spark.range(2)).count("\n") == 3
    with pytest.raises(ValueError):
        io.markdown(spark.range(11), 10)
