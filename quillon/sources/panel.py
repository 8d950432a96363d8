"""Price panels in long form: (date, asset, close, open)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as jo
from .io import staged

PANEL_SCHEMA = "date date, asset string, close double, open double"
UNIVERSE = ["SPY", "EFA", "EEM", "TLT", "IEF", "LQD", "HYG", "GLD", "DBC", "VNQ"]  # fixed values: the order of the universe


def derived_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel from order lines: asset = region of the supplier, date = day of shipping.

    Mean discounts and taxes of a cell give its log return and its overnight part; empty cells return 0. Prices
    compound the returns, so they are exact inverses of W1 and W2. Columns: date, asset, r, co, oc, close, open.

    Lines are read once, whatever a query does with its panel: the cells, a row a (day, asset), are written into the shared folder.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region = read("region").select("r_regionkey", F.col("r_name").alias("asset"))
    places = read("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "asset")
    lines = read("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_discount", "l_tax")
    # lines meet two columns of their supplier, which Spark sends to the tasks unless it is large; a task then keeps one row a (day, nation)
    supplied = lines.join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    daily = supplied.groupBy("date", "s_nationkey").agg(F.sum("l_discount").alias("d"), F.count("l_discount").alias("n"), F.sum("l_tax").alias("t"), F.count("l_tax").alias("m"))
    placed = daily.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("date", "asset")
    cells = staged(placed.agg((0.3 * (F.sum("d") / F.sum("n") - 0.05)).alias("r"), (0.1 * (F.sum("t") / F.sum("m") - 0.04)).alias("co")), "cells")
    grid = cells.select("date").distinct().crossJoin(F.broadcast(region.select("asset")))  # a handful of assets
    base = grid.join(cells, ["date", "asset"], "left").na.fill(0.0, ["r", "co"]).withColumn("oc", F.col("r") - F.col("co"))
    w = Window.partitionBy("asset").orderBy("date")
    return base.withColumn("close", 100 * F.exp(F.sum("r").over(w))).withColumn("open", F.col("close") / F.exp("oc"))


def read_csv_panel(spark: SparkSession, directory: str, universe: list[str] = UNIVERSE) -> DataFrame:
    """One ``<ASSET>.csv`` (Date, AdjClose[, AdjOpen]) for each asset; a missing file is an error.

    Opens are all or nothing: if any asset lacks them, the panel has none. Dates are aligned as a full outer join: a long
    panel has no row where an asset has no price.
    """
    parts, opens = [], True
    for asset in universe:
        part = spark.read.option("header", True).csv(f"{directory}/{asset}.csv")
        if "AdjClose" not in part.columns:
            raise ValueError(f"{asset}: no AdjClose column")
        opens &= "AdjOpen" in part.columns
        opened = F.col("AdjOpen") if "AdjOpen" in part.columns else F.lit(None)
        parts.append(part.select(F.to_date("Date").alias("date"), F.lit(asset).alias("asset"), F.col("AdjClose").cast("double").alias("close"), opened.cast("double").alias("open")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return checked_panel(out if opens else out.withColumn("open", F.lit(None).cast("double")), universe)


def checked_panel(panel: DataFrame, universe: list[str]) -> DataFrame:
    """Raises unless the assets are exactly the universe and (date, asset) is unique; one aggregation."""
    row = panel.groupBy().agg(F.count("*").alias("n"), F.countDistinct("date", "asset").alias("u"), F.collect_set("asset").alias("a")).first()
    if set(row["a"]) != set(universe):
        raise ValueError(f"assets {sorted(row['a'])} are not the universe {sorted(universe)}")
    if row["n"] != row["u"]:
        raise ValueError("a date occurs twice for an asset")
    return panel


def as_of(panel: DataFrame, cutoff) -> DataFrame:
    """What was known at a date: rows up to and including it."""
    return panel.where(F.col("date") <= F.lit(cutoff).cast("date"))


def wide(panel: DataFrame, universe: list[str], value: str = "close") -> DataFrame:
    """One column an asset, in the universe's order."""
    return panel.groupBy("date").pivot("asset", universe).agg(F.first(value)).select("date", *universe)


def synthetic_panel(n_days: int, universe: list[str] = UNIVERSE, seed: int = 0, stay: tuple[float, float] = (0.985, 0.95)) -> tuple[np.ndarray, np.ndarray]:
    """(daily log returns, regime of each day): a two-state chain; the second state is volatile, falling and correlated."""
    r, n = np.random.default_rng(seed), len(universe)
    states = np.zeros(n_days, int)
    for t in range(1, n_days):
        states[t] = states[t - 1] if r.random() < stay[states[t - 1]] else 1 - states[t - 1]
    vol = np.linspace(0.008, 0.020, n)
    out = np.empty((n_days, n))
    for s, (drift, scale, rho) in enumerate(((0.0003, 1.0, 0.2), (-0.0010, 2.2, 0.6))):
        days = np.flatnonzero(states == s)
        cov = np.outer(vol, vol) * scale**2 * np.where(np.eye(n), 1, rho)
        out[days] = r.multivariate_normal(np.full(n, drift), cov, size=len(days))
    return out, states


def synthetic_prices(spark: SparkSession, n_days: int, universe: list[str] = UNIVERSE, seed: int = 0, first: str = "2000-01-03") -> tuple[DataFrame, DataFrame]:
    """(panel, regimes): close prices that compound the synthetic returns from 100 on business days, without opens; and date, regime."""
    r, states = synthetic_panel(n_days, universe, seed)
    days = [d.date() for d in pd.bdate_range(first, periods=n_days)]
    close = 100 * np.exp(np.cumsum(r, axis=0))
    table = pd.DataFrame({"date": np.repeat(np.array(days, object), len(universe)), "asset": universe * n_days, "close": close.ravel()})
    panel = spark.createDataFrame(table, "date date, asset string, close double").withColumn("open", F.lit(None).cast("double"))
    return panel, spark.createDataFrame([(d, int(s)) for d, s in zip(days, states)], "date date, regime int")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` are all numbers: neither null, NaN nor infinite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def read_yields(spark: SparkSession, path: str) -> DataFrame:
    """obs_date, yield_pct of a local CSV whose first column is the date and whose second the yield; "." is a missing value."""
    raw = spark.read.option("header", True).csv(path)
    day, value = raw.columns[:2]
    return raw.select(F.to_date(day).alias("obs_date"), F.expr(f"try_cast(nullif(trim(`{value}`), '.') AS double)").alias("yield_pct"))


def read_risk_free(spark: SparkSession, path: str, dates: DataFrame) -> DataFrame:
    """date, rf_daily for each of ``dates`` from a CSV (date, yield_pct_prior, rf_daily). A repeated date, a date
    that the file lacks or one without a value fails the job; nothing is carried forward."""
    table = spark.read.schema("date date, yield_pct_prior double, rf_daily double").option("header", True).csv(path)
    return jo.require_matched(jo.one_to_one_left(dates.select("date").distinct(), table.select("date", "rf_daily"), ["date"]), "rf_daily")


def daily_rate(yield_pct: F.Column, periods: int = 252) -> F.Column:
    """A year's yield in percent as the rate of one day, which compounds to it."""
    return F.pow(1 + yield_pct / 100, F.lit(1.0 / periods)) - 1


def risk_free_daily(dates: DataFrame, yields: DataFrame, strict: bool = True) -> DataFrame:
    """date, yield_pct_prior, rf_daily: the last yield observed before each day. Days before the first one fail the job, or have a rate of 0 if not ``strict``."""
    out = jo.as_of_prior(dates.select("date").distinct(), yields, "date", "obs_date", "yield_pct").withColumnRenamed("yield_pct", "yield_pct_prior")
    rated = out.withColumn("rf_daily", daily_rate(F.col("yield_pct_prior")))
    return jo.require_matched(rated, "rf_daily") if strict else rated.withColumn("rf_daily", F.coalesce("rf_daily", F.lit(0.0)))


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly yields in percent from order values: (obs_date, yield_pct), some months without a value."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    monthly = orders.groupBy(F.trunc("o_orderdate", "month").alias("obs_date")).agg((F.sum("o_totalprice") / F.count("o_totalprice") / 50000).alias("yield_pct"))
    return monthly.withColumn("yield_pct", F.when(F.month("obs_date") != 7, F.col("yield_pct")))
