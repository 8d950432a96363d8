"""Window operators. All windows are partitioned by asset (or scenario), so they scale with the number of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def per_asset():
    """A function, as windows need a session."""
    return Window.partitionBy("asset").orderBy("date")


def log_returns(panel: DataFrame) -> DataFrame:
    """date, asset, ret (close to close), overnight (close to open), intraday (open to close); the first date has none."""
    before = F.lag("close").over(per_asset())
    out = panel.select("date", "asset", F.ln(F.col("close") / before).alias("ret"), F.ln(F.col("open") / before).alias("overnight"), F.ln(F.col("close") / F.col("open")).alias("intraday"))
    return out.where("ret is not null")


def _full(value: F.Column, column: str, frame, n: int) -> F.Column:
    """A windowed value, null unless the window is full."""
    return F.when(F.count(column).over(frame) == n, value)


def rolling_volatility(returns: DataFrame, window: int = 21) -> DataFrame:
    w = per_asset().rowsBetween(1 - window, 0)
    return returns.withColumn("vol", _full(F.stddev_samp("ret").over(w) * F.sqrt(F.lit(float(YEAR))), "ret", w, window))


def rolling_trend(returns: DataFrame, window: int = 63) -> DataFrame:
    w = per_asset().rowsBetween(1 - window, 0)
    return returns.withColumn("trend", _full(F.sum("ret").over(w), "ret", w, window))


def pairs(returns: DataFrame) -> DataFrame:
    """date, a, b, x, y: all pairs of assets a < b on a date. One shuffle by date: a day's vector is built once and unfolded."""
    day = returns.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("asset", "ret"))).alias("v"))
    both = F.expr("flatten(transform(v, (p, i) -> transform(slice(v, i + 2, size(v)), q -> struct(p.asset AS a, q.asset AS b, p.ret AS x, q.ret AS y))))")
    return day.select("date", F.explode(both).alias("p")).select("date", "p.*")


def rolling_correlation(returns: DataFrame, window: int = 63) -> DataFrame:
    """date, avg_corr: mean over all pairs of their correlation in a full window; pairs without a value are left out."""
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(1 - window, 0)
    corr = F.try_divide(F.covar_pop("x", "y").over(w), F.stddev_pop("x").over(w) * F.stddev_pop("y").over(w))  # null where a series doesn't move
    each = pairs(returns).withColumn("c", F.when(F.count("*").over(w) == window, corr))
    return each.groupBy("date").agg(F.avg("c").alias("avg_corr"))


def spread_trend(returns: DataFrame, long_asset: str, short_asset: str, short: int = 21, long: int = 63) -> DataFrame:
    """date, spread: difference of the rolling sums of two assets' returns over two windows' difference."""
    wide = returns.where(F.col("asset").isin(long_asset, short_asset)).groupBy("date").agg(F.max(F.when(F.col("asset") == long_asset, F.col("ret"))).alias("x"), F.max(F.when(F.col("asset") == short_asset, F.col("ret"))).alias("y"))
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # one series of days
    ws, wl = order.rowsBetween(1 - short, 0), order.rowsBetween(1 - long, 0)
    diff = F.col("x") - F.col("y")
    return wide.withColumn("d", diff).select("date", F.when(F.count("d").over(wl) == long, F.sum("d").over(wl) - F.sum("d").over(ws)).alias("spread"))


def feature_matrix(returns: DataFrame, assets: list[str], vol: int = 21, trend: int = 63, corr: int = 63) -> DataFrame:
    """date, <asset>_ret, <asset>_vol, <asset>_trend, avg_corr, spread; rows with any missing value are dropped."""
    long = rolling_trend(rolling_volatility(returns, vol), trend)
    aggs = [F.max(F.when(F.col("asset") == a, F.col(v))).alias(f"{a}_{n}") for n, v in (("ret", "ret"), ("vol", "vol"), ("trend", "trend")) for a in assets]
    out = long.groupBy("date").agg(*aggs).join(rolling_correlation(returns, corr), "date").join(spread_trend(returns, assets[0], assets[-1]), "date")
    return out.dropna("any")


def drawdown(returns: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """keys, max_drawdown of simple returns; the peak starts at the first wealth value, not at 1."""
    w = Window.partitionBy(*keys).orderBy("date")
    wealth = returns.withColumn("wealth", F.exp(F.sum(F.log1p(value)).over(w)))
    return wealth.withColumn("dd", F.col("wealth") / F.max("wealth").over(w) - 1).groupBy(*keys).agg(F.min("dd").alias("max_drawdown"))


def month_ends(dates: DataFrame) -> DataFrame:
    """date: the last observed date of every month, the last partial one included."""
    return dates.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.max("date").alias("date")).select("date")


def every_nth(rebalances: DataFrame, n: int) -> DataFrame:
    """date, k, refit: rebalances counted from 1; the nth, 2nth ... refit. Rebalances are at most one a month."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return rebalances.select("date", F.row_number().over(w).alias("k")).withColumn("refit", F.col("k") % n == 0)


def last_of_month(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of every month for each key."""
    w = Window.partitionBy(*keys, F.trunc("date", "month")).orderBy(F.desc("date"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stage_label(bounds: list[tuple[str, str]], rest: str = "post") -> F.Column:
    """Label of a date; a boundary belongs to the earlier stage."""
    out = None
    for name, end in bounds:
        c = F.col("date") <= F.lit(end).cast("date")
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(rest) if out is not None else F.lit(rest)


def stage_counts(dates: DataFrame, bounds: list[tuple[str, str]], rest: str = "post") -> DataFrame:
    """stage, n: days of each stage, 0 for absent ones."""
    names = dates.sparkSession.createDataFrame([(n,) for n, _ in bounds] + [(rest,)], "stage string")
    found = dates.select(stage_label(bounds, rest).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))
    return names.join(found, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def autocovariance(series: DataFrame, keys: list[str], value: str, lags: int) -> DataFrame:
    """keys, lag, acov: autocovariances with divisor n. Lags unfold from a trailing window, so no row meets more than ``lags`` others."""
    w = Window.partitionBy(*keys)
    centred = series.withColumn("_x", F.col(value) - F.avg(value).over(w)).withColumn("_n", F.count(value).over(w))
    past = centred.withColumn("_past", F.collect_list("_x").over(w.orderBy("date").rowsBetween(-lags, 0)))
    each = past.select(*keys, "_x", "_n", F.posexplode(F.reverse("_past")).alias("lag", "_y"))
    return each.groupBy(*keys, "lag").agg((F.sum(F.col("_x") * F.col("_y")) / F.max("_n")).alias("acov"))


def trailing_vectors(features: DataFrame, decisions: DataFrame, length: int = 60, value: str = "features") -> DataFrame:
    """date, window: the last ``length`` feature vectors up to each decision date, oldest first; short ones are left out."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1 - length, 0)
    out = features.withColumn("window", F.collect_list(value).over(w)).join(decisions, "date", "left_semi")
    return out.where(F.size("window") == length).select("date", "window")


def ewma_fold(table: DataFrame, keys: list[str], value: str, decay: float) -> DataFrame:
    """keys, date, blended: new * (1 - decay) + previous blend * decay, folded in date order."""
    lists = table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v")))).alias("s"))
    fold = f"aggregate(slice(s, 2, size(s)), array(s[0]), (acc, x) -> concat(acc, array(named_struct('date', x.date, 'v', {decay}D * element_at(acc, -1).v + (1 - {decay}D) * x.v))))"
    return lists.select(*keys, F.explode(F.expr(fold)).alias("p")).select(*keys, F.col("p.date").alias("date"), F.col("p.v").alias("blended"))
