"""Covariances, risk shares, bounded softmax and constraint reports as relations (key, i, j, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(returns: DataFrame, value: str = "ret") -> DataFrame:
    """date, v: (asset, value) structs in asset order."""
    return returns.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("asset", F.col(value).alias("x")))).alias("v"))


def products(day: DataFrame, keep: list[str]) -> DataFrame:
    """All ordered pairs within a day's vector, unfolded in place: keep, i, j, x, y."""
    both = F.expr("flatten(transform(v, p -> transform(v, q -> struct(p.asset AS i, q.asset AS j, p.x AS x, q.x AS y))))")
    return day.select(*keep, F.explode(both).alias("p")).select(*keep, "p.*")


def covariance(returns: DataFrame) -> DataFrame:
    """i, j, cov (divisor n - 1)."""
    return products(vectors(returns), ["date"]).groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def weighted_covariance(returns: DataFrame, weights: DataFrame, weight: str = "w") -> DataFrame:
    """i, j, mean_i, cov: moments with weights that are normalised to 1 (no degrees-of-freedom correction)."""
    p = products(vectors(returns).join(weights, "date"), ["date", weight])
    s = F.sum(weight)
    mx, my = F.sum(F.col(weight) * F.col("x")) / s, F.sum(F.col(weight) * F.col("y")) / s
    return p.groupBy("i", "j").agg(mx.alias("mean_i"), (F.sum(F.col(weight) * F.col("x") * F.col("y")) / s - mx * my).alias("cov"))


def shrunk(cov: DataFrame, keys: list[str] | None = None, share: float = 0.10) -> DataFrame:
    """Moves a share of the way to the mean variance times the identity."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    diagonal = F.avg(F.when(F.col("i") == F.col("j"), F.col("cov"))).over(w)
    return cov.withColumn("cov", (1 - share) * F.col("cov") + F.when(F.col("i") == F.col("j"), share * diagonal).otherwise(0.0))


def mixture(covs: DataFrame, probabilities: DataFrame, by: str = "state") -> DataFrame:
    """date, i, j, cov: state covariances weighted by each date's probabilities; the states' side is small by nature."""
    return probabilities.join(covs, by).groupBy("date", "i", "j").agg(F.sum(F.col("prob") * F.col("cov")).alias("cov"))


def risk_shares(cov: DataFrame, weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, asset, weight, share: part of each asset in the portfolio's variance."""
    keys = keys or []
    wi = weights.select(*keys, F.col("asset").alias("i"), F.col("weight").alias("wi"))
    wj = weights.select(*keys, F.col("asset").alias("j"), F.col("weight").alias("wj"))
    marginal = cov.join(wj, [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("cov") * F.col("wj")).alias("m")).join(wi, [*keys, "i"])
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    return marginal.select(*keys, F.col("i").alias("asset"), F.col("wi").alias("weight"), (F.col("wi") * F.col("m") / F.sum(F.col("wi") * F.col("m")).over(w)).alias("share"))


def correlation_distance(cov: DataFrame) -> DataFrame:
    """i, j, distance: sqrt(max((1 - correlation) / 2, 0)), 0 on the diagonal."""
    d = cov.where("i = j").select("i", F.sqrt("cov").alias("s"))
    out = cov.join(F.broadcast(d), "i").join(F.broadcast(d.withColumnsRenamed({"i": "j", "s": "t"})), "j")  # one row an asset
    dist = F.sqrt(F.greatest(F.lit(0.0), 0.5 * (1 - F.try_divide(F.col("cov"), F.col("s") * F.col("t")))))
    return out.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(dist).alias("distance"))


def bounded_softmax(logits: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Adds budget: a softmax whose entries are at least ``floor`` (below 1/n); with floor 0 the plain softmax.

    Entries are filled by descending logit: the k largest share 1 - (n - k) floor as a softmax, k being the largest number for
    which the smallest of them stays at the floor or above.
    """
    w = Window.partitionBy(*keys)
    top = w.orderBy(F.desc("logit"), "asset")
    out = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(top))
    out = out.withColumn("_s", F.sum("_e").over(top.rowsBetween(Window.unboundedPreceding, 0)))
    mass = 1 - (F.col("_n") - F.col("_k")) * F.lit(floor)
    out = out.withColumn("_ok", mass * F.col("_e") / F.col("_s") >= floor)
    out = out.withColumn("_best", F.max(F.when(F.col("_ok"), F.col("_k"))).over(w))
    out = out.withColumn("_sum", F.max(F.when(F.col("_k") == F.col("_best"), F.col("_s"))).over(w))
    free = (1 - (F.col("_n") - F.col("_best")) * F.lit(floor)) * F.col("_e") / F.col("_sum")
    return out.withColumn("budget", F.when(F.col("_k") <= F.col("_best"), free).otherwise(F.lit(floor))).drop("_e", "_n", "_k", "_s", "_ok", "_best", "_sum")


def binding(weights: DataFrame, drifted: DataFrame, keys: list[str], lower: float = 0.0, upper: float = 0.30, turnover: float = 0.30, tolerance: float = 1e-6) -> DataFrame:
    """keys, turnover, turnover_binding, lower_binding, upper_binding (assets joined by commas)."""
    both = weights.join(drifted.withColumnRenamed("weight", "_before"), [*keys, "asset"])
    moved = F.sum(F.abs(F.col("weight") - F.col("_before")))
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("asset")))), ",")
    return both.groupBy(*keys).agg(moved.alias("turnover"), (moved >= turnover - tolerance).alias("turnover_binding"), names(F.col("weight") <= lower + tolerance).alias("lower_binding"), names(F.col("weight") >= upper - tolerance).alias("upper_binding"))


def pairwise_l1(vectors_: DataFrame, by: list[str], member: str, asset: str, value: str) -> DataFrame:
    """by, a, b, distance for members a < b of each group, from one sorted list a (group, asset); members are few (seeds)."""
    lists = vectors_.groupBy(*by, asset).agg(F.sort_array(F.collect_list(F.struct(F.col(member).alias("m"), F.col(value).alias("x")))).alias("v"))
    both = F.expr("flatten(transform(v, (p, k) -> transform(slice(v, k + 2, size(v)), q -> struct(p.m AS a, q.m AS b, abs(p.x - q.x) AS d))))")
    return lists.select(*by, F.explode(both).alias("p")).groupBy(*by, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.d").alias("distance"))


def dominant_agreement(vectors_: DataFrame, by: list[str], member: str, asset: str, value: str) -> DataFrame:
    """by, agreement: share of a group's members whose largest entry is the most common one; ties take the first asset."""
    top = vectors_.groupBy(*by, member).agg(F.min_by(asset, F.struct(-F.col(value), F.col(asset))).alias("top"))
    return top.groupBy(*by, "top").agg(F.count("*").alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n")).alias("agreement"))
