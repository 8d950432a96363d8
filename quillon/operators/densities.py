"""Student-t densities of many series: degrees of freedom by a grid, pooled and regime-weighted moments, log scores day by day.

Tables as in ``operators.regimes``: observations (keys, t, x) and probabilities (keys, t, array over states). Likelihoods and moments are sums
that Spark adds up; only a day's own score is computed from dense matrices, in batches, with its series' model beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import densities as de


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def residuals(observations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, asset (place), z: each asset's returns less their mean over their population deviation."""
    w = Window.partitionBy(*keys, "asset")
    long = observations.select(*keys, "t", F.posexplode("x").alias("asset", "_x"))
    return long.select(*keys, "t", "asset", F.try_divide(F.col("_x") - F.avg("_x").over(w), F.stddev_pop("_x").over(w)).alias("z"))


def degrees_of_freedom(rows: DataFrame, keys: list[str], weight: str | None = None, grid: list[float] = de.NU_GRID) -> DataFrame:
    """keys, nu, loglik: of the grid the value under which z is likeliest, the first of several; ``weight`` multiplies each term. Null residuals are left out.

    The grid unfolds from an array with its constants, as the logarithm of the gamma function has no SQL function here.
    """
    constants = [(v, math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)) for v in grid]
    table = F.array(*(F.struct(F.lit(float(v)).alias("nu"), F.lit(c).alias("c")) for v, c in constants))
    term = F.col("g.c") - (F.col("g.nu") + 1) / 2 * F.log1p(F.col("z") * F.col("z") / F.col("g.nu"))
    each = rows.where("z IS NOT NULL").withColumn("g", F.explode(table))
    sums = each.groupBy(*keys, F.col("g.nu").alias("nu")).agg(F.sum(term if weight is None else F.col(weight) * term).alias("loglik"))
    best = sums.groupBy(*keys).agg(F.max(F.struct("loglik", (-F.col("nu")).alias("_n"))).alias("b"))
    return best.select(*keys, (-F.col("b._n")).alias("nu"), F.col("b.loglik").alias("loglik"))


def state_rows(rows: DataFrame, probabilities: DataFrame, keys: list[str], value: str = "filtered") -> DataFrame:
    """``rows`` once for each state with its probability ``p`` on the day."""
    each = probabilities.select(*keys, "t", F.posexplode(value).alias("state", "p"))
    return rows.join(each, [*keys, "t"])


def moments(rows: DataFrame, keys: list[str], assets: int, weight: str | None = None) -> DataFrame:
    """keys, mean, cov (flat arrays): with ``weight`` normalised to 1 and no correction, without it divided by n - 1; sums of squares run about the keys' plain means."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    pairs = [(i, j) for i in range(assets) for j in range(assets)]
    centre = rows.groupBy(*keys).agg(F.array(*(F.avg(F.col("x")[i]) for i in range(assets))).alias("_c"))
    d = [F.col("x")[i] - F.col("_c")[i] for i in range(assets)]
    sums = rows.join(centre, keys).groupBy(*keys, "_c").agg(F.sum(w).alias("_w"), F.array(*(F.sum(w * v) for v in d)).alias("_s"), F.array(*(F.sum(w * d[i] * d[j]) for i, j in pairs)).alias("_q"))
    total = F.col("_w")
    shift = [F.col("_s")[i] / total for i in range(assets)]
    cov = [(F.col("_q")[k] / total - shift[i] * shift[j]) * (1 if weight else total / (total - 1)) for k, (i, j) in enumerate(pairs)]
    return sums.select(*keys, F.array(*(F.col("_c")[i] + shift[i] for i in range(assets))).alias("mean"), F.array(*cov).alias("cov"))


def models(moments_: DataFrame, nus: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nu, mean, scale (flat) of Student-t densities with these moments, and ``implied``: the covariance of such a density, its ridge included."""
    n = F.sqrt(F.size("cov")).cast("int")
    ridged = F.transform("cov", lambda c, k: c + F.when(k % (n + 1) == 0, de.RIDGE).otherwise(0.0))
    out = moments_.join(nus.select(*keys, "nu"), keys)
    return out.select(*keys, "nu", "mean", F.transform(ridged, lambda c: c * (F.col("nu") - 2) / F.col("nu")).alias("scale"), ridged.alias("implied"))


def scores(observations: DataFrame, ahead: DataFrame, pooled: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, pooled, mixed: log densities of a day under the pooled model and under the states' models weighted by ``ahead`` (keys, t, array)."""
    parts = F.sort_array(F.collect_list(F.struct("state", "nu", "mean", "scale"))).alias("states")
    each = states.groupBy(*keys).agg(parts).join(pooled.select(*keys, F.struct("nu", "mean", "scale").alias("whole")), keys)
    rows = observations.join(ahead.select(*keys, "t", F.col(ahead.columns[-1]).alias("ahead")), [*keys, "t"]).join(each, keys)
    flat = rows.select(*keys, "t", "x", "ahead", F.col("whole.nu").alias("nu"), F.col("whole.mean").alias("mean"), F.col("whole.scale").alias("scale"), F.col("states.nu").alias("nus"), F.flatten("states.mean").alias("means"), F.flatten("states.scale").alias("scales"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            l0, l1 = np.empty(len(pdf)), np.empty(len(pdf))
            for _, own in pdf.reset_index(drop=True).groupby(keys):
                first, x = own.iloc[0], np.stack(own["x"].to_numpy())
                n, k = x.shape[1], len(first["nus"])
                whole = de.Pooled(first["nu"], np.array(first["mean"]), np.reshape(first["scale"], (n, n)))
                mixture = de.Mixture(np.array(first["nus"]), np.reshape(first["means"], (k, n)), np.reshape(first["scales"], (k, n, n)))
                l0[own.index], l1[own.index] = whole.log_density(x), mixture.log_density(x, np.stack(own["ahead"].to_numpy()))
            yield pdf[[*keys, "t"]].assign(pooled=l0, mixed=l1)

    return flat.mapInPandas(run, f"{_schema(flat, [*keys, 't'])}, pooled double, mixed double")
