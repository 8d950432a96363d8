"""A study over seeds that goes on where it was broken off.

A task is one (seed, network): it trains and leaves the network's parameters as rows. A second round of tasks, one a seed, walks with the trained
networks and leaves all tables. Tasks run in lots; a lot's rows are committed together into a folder of their own seeds and networks, so a rerun finds
what is done by reading the folder and starts only what is missing. At most one lot is lost with a driver; a lost
executor costs its own tasks alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lstm import BudgetLstm
from . import studies as st
from . import walkforward as wf

PARTS = "seed int, network string, part string, shape array<int>, value array<double>"
TABLES = f"seed int, {wf.ALL}"


def _done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs committed; nothing where there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except pyspark.errors.AnalysisException:
        return spark.createDataFrame([], schema)


def _in_lots(pending: list[tuple], at_once: int) -> Iterator[list[tuple]]:
    for k in range(0, len(pending), at_once):
        yield pending[k : k + at_once]


def train(returns: DataFrame, seeds: list[int], base: wf.Options, folder: str, at_once: int = 8, next_open: bool = True) -> DataFrame:
    """Parameters of both networks of every seed, trained where ``folder`` lacks them; ``returns`` as for ``walkforward.run_all`` without scenario."""
    spark, path, options = returns.sparkSession, f"{folder}/networks", asdict(base)
    have = {(r["seed"], r["network"]) for r in _done(spark, path, PARTS).select("seed", "network").distinct().collect()}  # two rows a seed
    pending = [(s, k) for s in seeds for k in wf.KINDS if (s, k) not in have]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, kind = key
        dates, x, _, _, features = wf.dense(pdf, next_open)
        net = wf.first_network(x, wf.month_ends(dates), features, replace(wf.from_dict(options), seed=int(seed)), kind)
        return pd.DataFrame([{"seed": seed, "network": kind, "part": p, "shape": list(v.shape), "value": v.ravel()} for p, v in net.p.items()])

    for lot in _in_lots(pending, at_once):
        tasks = F.broadcast(spark.createDataFrame(lot, "seed int, network string"))  # a lot
        rows = returns.withColumn("_all", F.lit(1)).join(tasks.withColumn("_all", F.lit(1)), "_all").drop("_all").repartition(len(lot), "seed", "network")
        rows.groupBy("seed", "network").applyInPandas(one, PARTS).write.mode("append").partitionBy("seed", "network").parquet(path)
    return _done(spark, path, PARTS)


def walk(returns: DataFrame, seeds: list[int], base: wf.Options, folder: str, at_once: int = 8, next_open: bool = True) -> DataFrame:
    """seed and all tables of every seed's walk with the networks of ``train``, walked where ``folder`` lacks them."""
    spark, path, options = returns.sparkSession, f"{folder}/tables", asdict(base)
    have = {r["seed"] for r in _done(spark, path, TABLES).select("seed").distinct().collect()}  # a row a seed
    networks = _done(spark, f"{folder}/networks", PARTS)

    def one(key: tuple, own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        o = replace(wf.from_dict(options), seed=int(key[0]))
        dates, x, co, oc, features = wf.dense(pdf.drop(columns="seed"), next_open)
        nets = {}
        for kind, parts in own.groupby("network"):
            net = nets[kind] = BudgetLstm(1, x.shape[1], floor=0.5 / x.shape[1])
            net.p = {r.part: np.reshape(np.asarray(r.value, float), tuple(r.shape)) for r in parts.itertuples()}
        if set(nets) != set(wf.KINDS):
            raise ValueError(f"seed {key[0]}: a network is missing")
        return wf.all_rows(wf.walk(dates, x, o, co, oc, features, nets)).assign(seed=key[0])[wf.columns_of(TABLES)]

    for lot in _in_lots([(s,) for s in seeds if s not in have], at_once):
        tasks = F.broadcast(spark.createDataFrame(lot, "seed int"))
        rows = returns.withColumn("_all", F.lit(1)).join(tasks.withColumn("_all", F.lit(1)), "_all").drop("_all")
        out = networks.join(tasks, "seed", "left_semi").groupBy("seed").cogroup(rows.groupBy("seed")).applyInPandas(one, TABLES)
        out.repartition(len(lot), "seed").write.mode("append").partitionBy("seed").parquet(path)
    return _done(spark, path, TABLES)


def study(returns: DataFrame, seeds: list[int], base: wf.Options, folder: str, at_once: int = 8, next_open: bool = True) -> DataFrame:
    """seed and all tables; what ``folder`` holds already isn't done again. A result that lacks a seed or a configuration is an error."""
    train(returns, seeds, base, folder, at_once, next_open)
    tables = walk(returns, seeds, base, folder, at_once, next_open)
    names = wf.Walk(base).names()
    last = tables.where("table = 'returns'").groupBy("seed", "config").agg(F.count("*").alias("days"))
    st.checked_seeds(last.where(F.col("seed").isin(seeds)), seeds, names)
    return tables.where(F.col("seed").isin(seeds))
