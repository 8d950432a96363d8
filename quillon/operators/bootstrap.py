"""Stationary bootstrap with draws as rows, and exact quantiles by a distributed sort.

A contrast's series are days of a few strategies, so they are one row. Draws are rows of their own: each block of them
takes that row along, and every random number is a function of (seed, contrast, draw, step). The result is the same for any number of
tasks, and a lost task makes the same draws again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inference
from ..sources.io import staged


def signed_series(returns: DataFrame, keys: list[str], value: str, definitions: dict[str, dict[str, int]]) -> DataFrame:
    """keys, contrast, stream (its number), signs, series (arrays by date) from daily returns (keys, date, config, value).

    A strategy that is missing, days that differ between strategies, repeated days, fewer than 10 days or a value that isn't finite fails the job.
    """
    parts = returns.sparkSession.createDataFrame([(n, k, c, s, len(d)) for k, (n, d) in enumerate(definitions.items()) for c, s in d.items()], "contrast string, stream int, config string, sign int, _n int")
    v = F.col(value).cast("double")
    sound = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("values must be finite")).cast("double")).otherwise(v)
    both = returns.select(*keys, "date", "config", sound.alias("_r")).join(F.broadcast(parts), "config")  # a few strategies
    each = both.groupBy(*keys, "contrast", "stream", "_n", "config", "sign").agg(F.sort_array(F.collect_list(F.struct("date", "_r"))).alias("v"))
    each = each.select(*keys, "contrast", "stream", "_n", F.struct("config", "sign", F.col("v.date").alias("days"), F.col("v._r").alias("x")).alias("s"))
    rows = each.groupBy(*keys, "contrast", "stream", "_n").agg(F.sort_array(F.collect_list("s")).alias("s"))
    names = F.create_map(*(x for n, d in definitions.items() for x in (F.lit(n), F.array(*map(F.lit, sorted(d))))))
    missing = F.array_join(F.array_except(names[F.col("contrast")], F.col("s.config")), ", ")
    days = F.col("s")[0]["days"]
    problem = (
        F.when(F.size("s") < F.col("_n"), F.concat("contrast", F.lit(": no returns of "), missing))
        .when(F.exists("s", lambda x: x["days"] != days), F.concat("contrast", F.lit(": the days differ")))
        .when(F.size(F.array_distinct(days)) < F.size(days), F.concat("contrast", F.lit(": a day is repeated")))
        .when(F.size(days) < 10, F.concat("contrast", F.lit(": at least 10 days are required")))
    )
    return rows.select(*keys, "contrast", "stream", F.when(problem.isNotNull(), F.raise_error(problem).cast("array<int>")).otherwise(F.col("s.sign")).alias("signs"), F.col("s.x").alias("series"))


def _keyed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _arrays(r) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.asarray(x, float) for x in r.series]), np.asarray(r.signs)


def points(rows: DataFrame, keys: list[str], length: float | None = None) -> DataFrame:
    """Adds point and block_length: given, or chosen from the contrast's own signed sum."""
    if length is not None and not 1 <= length < float("inf"):
        raise ValueError("the block length must be finite and at least 1")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for r in pdf.itertuples():
                x, signs = _arrays(r)
                found.append((float(signs @ inference.sharpe(x)), length or inference.block_length(signs @ x)))
            yield pdf.assign(point=[p for p, _ in found], block_length=[b for _, b in found])

    return rows.mapInPandas(run, f"{_keyed(rows, rows.columns)}, point double, block_length double")


def draw(rows: DataFrame, keys: list[str], draws: int, seed: int, block: int = 100) -> DataFrame:
    """keys, contrast, draw, statistic for each draw of every row of ``points``."""
    if draws < 1:
        raise ValueError("draws must be at least 1")
    spread = rows.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(block)))).repartition(*keys, "contrast", "_first")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for own, r in zip(pdf[[*keys, "contrast"]].to_dict("records"), pdf.rename(columns={"_first": "first_"}).itertuples()):
                x, signs = _arrays(r)
                at = np.arange(r.first_, min(r.first_ + block, draws))
                yield pd.DataFrame({**{k: [v] * len(at) for k, v in own.items()}, "draw": at, "statistic": inference.drawn(x, signs, r.block_length, seed, r.stream, at)})

    return spread.mapInPandas(run, f"{_keyed(rows, [*keys, 'contrast'])}, draw int, statistic double")


def quantiles(values: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys, q, quantile: exact, linear between neighbours, by one sort over ranges of (keys, value).

    A value's place is its place within the partition plus the sizes of the key's earlier partitions; only the places
    that a quantile needs leave the sort.
    """
    order = [*keys, value]
    rows = staged(values.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    runs = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).withColumn("_all", F.sum("_n").over(w))
    # a quantile asks for at most two places, which stand in known partitions
    asked = runs.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("_h", F.col("q") * (F.col("_all") - 1))
    asked = asked.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))).where("_place >= _before AND _place < _before + _n")
    asked = asked.select(*keys, "q", "_h", "_place", (F.col("_from") + F.col("_place") - F.col("_before")).alias("_id"))
    found = asked.join(rows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_v"), "_id"), "_id")
    low, high = F.min_by("_v", "_place"), F.max_by("_v", "_place")
    return found.groupBy(*keys, "q").agg((low + (F.max("_h") - F.floor(F.max("_h"))) * (high - low)).alias("quantile"))


def intervals(rows: DataFrame, keys: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95, length: float | None = None) -> DataFrame:
    """keys, contrast, point, low, high, block_length of the signed sums of Sharpe ratios of ``signed_series``."""
    if not 0 < level < 1:
        raise ValueError("the level must be within (0, 1)")
    ready = staged(points(rows, keys, length), "series")
    ends = [(1 - level) / 2, (1 + level) / 2]
    q = quantiles(draw(ready, keys, draws, seed), [*keys, "contrast"], "statistic", ends)
    both = q.groupBy(*keys, "contrast").agg(F.min_by("quantile", "q").alias("low"), F.max_by("quantile", "q").alias("high"))
    return ready.select(*keys, "contrast", "point", "block_length").join(both, [*keys, "contrast"]).select(*keys, "contrast", "point", "low", "high", "block_length")
