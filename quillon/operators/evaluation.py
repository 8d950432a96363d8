"""Performance measures and study statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import one_to_one_left
from .timeseries import YEAR, drawdown


def sharpe(value: F.Column, periods: int = YEAR) -> F.Column:
    """Annualised; 0 for a series without variance, null below two values."""
    sd = F.stddev_samp(value)
    return F.when(sd == 0, 0.0).otherwise(F.avg(value) / sd * F.sqrt(F.lit(float(periods))))


def cagr(value: F.Column, periods: int = YEAR) -> F.Column:
    """Null where wealth isn't positive."""
    return F.when(F.min(1 + value) > 0, F.exp(F.sum(F.log1p(value)) * F.lit(float(periods)) / F.count(value)) - 1)


def sortino(value: F.Column, periods: int = YEAR) -> F.Column:
    """By the sample deviation of the negative returns; null with fewer than two of them.

    Returns within 1e-12 of 0 are 0: days on which nothing moved differ from 0 by rounding alone, in either direction.
    """
    negative = F.when(value < -1e-12, value)
    return F.when(F.count(negative) >= 2, F.try_divide(F.avg(value), F.stddev_samp(negative)) * F.sqrt(F.lit(float(periods))))


def moments(value: F.Column) -> list[F.Column]:
    """Population skewness and non-excess population kurtosis."""
    return [F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")]


def performance(returns: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """keys, n_days, sharpe, cagr, max_drawdown, sortino, calmar of simple returns."""
    v = F.col(value)
    out = returns.groupBy(*keys).agg(F.count(v).alias("n_days"), sharpe(v).alias("sharpe"), cagr(v).alias("cagr"), sortino(v).alias("sortino"))
    out = out.join(drawdown(returns, keys, value), keys)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") != 0, F.col("cagr") / F.abs("max_drawdown")))


def herfindahl(weights: DataFrame, keys: list[str]) -> DataFrame:
    return weights.groupBy(*keys, "date").agg(F.sum(F.col("weight") ** 2).alias("h")).groupBy(*keys).agg(F.avg("h").alias("hhi"))


def net_returns(gross: DataFrame, executions: DataFrame, keys: list[str], bps: float) -> DataFrame:
    """Adds net: wealth is multiplied by 1 - fee * turnover on execution dates; repeated dates compound; other dates are ignored."""
    cost = executions.groupBy(*keys, "date").agg(F.exp(F.sum(F.log1p(-F.lit(bps / 1e4) * F.col("turnover")))).alias("_f"))
    return gross.join(cost, [*keys, "date"], "left").withColumn("net", (1 + F.col("ret")) * F.coalesce("_f", F.lit(1.0)) - 1).drop("_f")


def cost_sensitivity(gross: DataFrame, executions: DataFrame, keys: list[str], fees: list[float]) -> DataFrame:
    """keys, fee_bps, sharpe_net, cagr_net for each fee level: the fees unfold from an array, gross returns are read once."""
    cost = executions.groupBy(*keys, "date").agg(F.sum("turnover").alias("_t"))
    rows = gross.join(cost, [*keys, "date"], "left").withColumn("fee_bps", F.explode(F.array(*map(F.lit, map(float, fees)))))
    rows = rows.withColumn("_r", (1 + F.col("ret")) * (1 - F.col("fee_bps") / 1e4 * F.coalesce("_t", F.lit(0.0))) - 1)
    return rows.groupBy(*keys, "fee_bps").agg(sharpe(F.col("_r")).alias("sharpe_net"), cagr(F.col("_r")).alias("cagr_net"))


def mean_turnover(executions: DataFrame, keys: list[str], dates: DataFrame) -> DataFrame:
    """keys, mean_turnover over decisions dated in ``dates``."""
    return executions.join(dates, "date", "left_semi").groupBy(*keys).agg(F.avg("turnover").alias("mean_turnover"))


def average_turnover(weights: DataFrame, drifted: DataFrame) -> DataFrame:
    """mean_turnover: mean over dates of the summed differences between two weight panels (date, asset, weight), which must match one to one."""
    both = one_to_one_left(weights, drifted.withColumnRenamed("weight", "_before"), ["date", "asset"])
    return both.groupBy("date").agg(F.sum(F.abs(F.col("weight") - F.col("_before"))).alias("t")).agg(F.avg("t").alias("mean_turnover"))


def effects(table: DataFrame, keys: list[str], by: str, value: str, contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """keys and one column a contrast: value of the first group minus that of the second."""
    of = lambda g: F.max(F.when(F.col(by) == g, F.col(value)))
    return table.groupBy(*keys).agg(*((of(a) - of(b)).alias(n) for n, (a, b) in contrasts.items()))


def distribution(table: DataFrame, keys: list[str], value: str, control: float | None = None) -> DataFrame:
    """keys, n, mean, median, q25, q75, min, max, positive, negative and, with a control, its rank (values at or below it)."""
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))  # noqa: E731  exact, linear
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative")]
    if control is not None:
        aggs.append((F.count_if(v <= control) + 1).alias("control_rank"))
    return table.groupBy(*keys).agg(*aggs) if keys else table.agg(*aggs)


def paired_t(table: DataFrame, keys: list[str], unit: str, by: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """keys, n, mean_diff, se, t of the paired differences of two groups over units."""
    each = table.groupBy(*keys, unit).agg((F.max(F.when(F.col(by) == pair[0], F.col(value))) - F.max(F.when(F.col(by) == pair[1], F.col(value)))).alias("d"))
    se = F.stddev_samp("d") / F.sqrt(F.count("d"))
    aggs = [F.count("d").alias("n"), F.avg("d").alias("mean_diff"), se.alias("se"), F.try_divide(F.avg("d"), se).alias("t")]
    return each.groupBy(*keys).agg(*aggs) if keys else each.agg(*aggs)


def mean_of_deviations(table: DataFrame, keys: list[str], inner: list[str], value: str) -> DataFrame:
    """keys, mean_sd, widest: mean over inner groups of their sample deviations, and the inner group with the largest."""
    each = table.groupBy(*keys, *inner).agg(F.stddev_samp(value).alias("sd"))
    return each.groupBy(*keys).agg(F.avg("sd").alias("mean_sd"), F.max_by(inner[0], F.struct("sd", inner[0])).alias("widest"))


def shares_at(table: DataFrame, keys: list[str], value: str, level: float, slack: float = 1e-4) -> DataFrame:
    """keys, share: part of the entries at or below a floor."""
    return table.groupBy(*keys).agg(F.avg((F.col(value) <= level + slack).cast("int")).alias("share"))


def largest_difference(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    return a.select(*on, F.col(value).alias("_x")).join(b.select(*on, F.col(value).alias("_y")), on).agg(F.max(F.abs(F.col("_x") - F.col("_y"))).alias("max_diff"))


def attribution(weights_a: DataFrame, weights_b: DataFrame, returns: DataFrame) -> DataFrame:
    """asset, contribution: sum over days of weight differences times simple returns."""
    both = weights_a.withColumnRenamed("weight", "_a").join(weights_b.withColumnRenamed("weight", "_b"), ["date", "asset"]).join(returns, ["date", "asset"])
    return both.groupBy("asset").agg(F.sum((F.col("_a") - F.col("_b")) * (F.exp("ret") - 1)).alias("contribution"))


def rule_variances(table: DataFrame, value: str, rules: dict[str, F.Column]) -> DataFrame:
    """One column a rule: sample variance of the values that it lets in, null below two."""
    return table.agg(*(F.var_samp(F.when(c, F.col(value))).alias(n) for n, c in rules.items()))


def family_variances(table: DataFrame, family: str, value: str) -> DataFrame:
    return table.groupBy(family).agg(F.count(value).alias("n"), F.var_samp(value).alias("variance")).where("n > 1")
