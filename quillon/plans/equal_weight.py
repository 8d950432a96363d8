"""The equal-weight walk as windows: between decisions holdings drift in closed form, so no fold is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import periods
from ..operators.timeseries import month_ends


def walk(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(date, ret: simple return of the portfolio; date, turnover: gross, at each month-end decision).

    Weights are 1/n at each month end (also before the first day) and drift with the assets. Decisions use end-of-day holdings.
    The turnover of these decisions has to stay below its cap, else the projection of the full walk is required.
    """
    decisions = month_ends(returns.select("date").distinct())
    days = returns.select("date").distinct()
    of = periods(days, decisions)
    first = days.join(of, "date", "left_anti").withColumn("decided", F.lit("1900-01-01").cast("date"))
    held = returns.join(of.unionByName(first), "date")
    inside = Window.partitionBy("asset", "decided").orderBy("date")
    grown = held.withColumn("after", F.exp(F.sum("ret").over(inside))).withColumn("before", F.coalesce(F.lag("after").over(inside), F.lit(1.0)))
    daily = grown.groupBy("date").agg((F.sum("after") / F.sum("before") - 1).alias("ret"), F.count("*").alias("n"), F.collect_list("after").alias("a"))
    turnover = daily.join(decisions, "date", "left_semi").select("date", F.expr("aggregate(a, 0D, (s, x) -> s + abs(x / aggregate(a, 0D, (u, y) -> u + y) - 1D / n))").alias("turnover"))
    return daily.select("date", "ret"), turnover


def drifted(returns: DataFrame) -> DataFrame:
    """date, asset, weight: end-of-day holdings before any trade of that day."""
    decisions = month_ends(returns.select("date").distinct())
    days = returns.select("date").distinct()
    of = periods(days, decisions)
    held = returns.join(of.unionByName(days.join(of, "date", "left_anti").withColumn("decided", F.lit("1900-01-01").cast("date"))), "date")
    grown = held.withColumn("g", F.exp(F.sum("ret").over(Window.partitionBy("asset", "decided").orderBy("date"))))
    return grown.withColumn("weight", F.col("g") / F.sum("g").over(Window.partitionBy("date"))).select("date", "asset", "weight")
