"""The reliability recursion as an ordered fold, and choices among candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = math.log((1 - 1e-6) / 1e-6)


def path(scores: DataFrame, keys: list[str], alpha: float | F.Column) -> DataFrame:
    """keys, date, pi_before, pi: weight of the second model from log scores l0, l1.

    In log-odds the update is a damped sum, clamped where the weight reaches 1e-6 or 1 - 1e-6. Series are folded as one array
    a key (series of days; keys spread over the cluster).
    """
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    s = scores.withColumn("_a", a).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", (F.col("l1") - F.col("l0")).alias("d"), "_a"))).alias("s"))
    fold = f"aggregate(s, array(named_struct('date', CAST(NULL AS DATE), 'b', CAST(0 AS DOUBLE), 'l', CAST(0 AS DOUBLE))), (acc, x) -> concat(acc, array(named_struct('date', x.date, 'b', element_at(acc, -1).l, 'l', greatest(-{LIMIT!r}D, least({LIMIT!r}D, x._a * element_at(acc, -1).l + x.d))))))"
    out = s.select(*keys, F.explode(F.expr(f"slice({fold}, 2, size(s))")).alias("p"))
    return out.select(*keys, F.col("p.date").alias("date"), (1 / (1 + F.exp(-F.col("p.b")))).alias("pi_before"), (1 / (1 + F.exp(-F.col("p.l")))).alias("pi"))


def blend(first: DataFrame, second: DataFrame, pi: DataFrame, on: list[str]) -> DataFrame:
    """Weights of the two tables mixed by pi (of the second)."""
    both = second.withColumnRenamed("weight", "_s").join(first.withColumnRenamed("weight", "_f"), [*on, "asset"]).join(pi, on)
    return both.select(*on, "asset", (F.col("pi") * F.col("_s") + (1 - F.col("pi")) * F.col("_f")).alias("weight"))


def choose_alpha(scores: DataFrame, candidates: list[float]) -> DataFrame:
    """alpha, score: cumulative log score of the mixture with the weight before each update, one group a candidate."""
    each = scores.withColumn("alpha", F.explode(F.array(*map(F.lit, candidates))))
    p = path(each, ["alpha"], F.col("alpha")).join(scores, "date")
    top = F.greatest("l0", "l1")
    mix = top + F.ln(F.col("pi_before") * F.exp(F.col("l1") - top) + (1 - F.col("pi_before")) * F.exp(F.col("l0") - top))
    return p.groupBy("alpha").agg(F.sum(mix).alias("score"))


def student_nu(residuals: DataFrame, grid: list[float], value: str = "z") -> DataFrame:
    """nu, loglik of unit-scale Student-t densities; the constants with lgamma come from Python as a column a candidate.

    One pass: each candidate is a sum, unfolded afterwards.
    """
    const = [math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in grid]
    z = F.col(value)
    sums = residuals.agg(*(F.sum(c - F.lit((v + 1) / 2) * F.log1p(z * z / v)).alias(f"_{k}") for k, (v, c) in enumerate(zip(grid, const))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(v).alias("nu"), F.col(f"_{k}").alias("loglik")) for k, v in enumerate(grid)))).alias("p")).select("p.*")
