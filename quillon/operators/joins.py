"""Alignments: as-of, carry-forward, strict, set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_prior(left: DataFrame, right: DataFrame, left_on: str, right_on: str, value: str, keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Left rows with the last non-null ``value`` of the right side strictly before them (or, not ``strict``, up to them).

    One sort-based pass: both sides are stacked and a window carries the last value on. No range join, no pair of rows.
    """
    keys = keys or []
    l = left.withColumn("_t", F.col(left_on)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(0 if strict else 1))
    r = right.select(*keys, F.col(right_on).alias("_t"), F.col(value).alias("_v"), F.lit(1 if strict else 0).alias("_side"), F.lit(True).alias("_right"))
    # at equal times a strict search sees left rows first
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    both = l.withColumn("_right", F.lit(False)).unionByName(r, allowMissingColumns=True)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("NOT _right").drop("_t", "_side", "_right").withColumnRenamed("_v", value)


def require_matched(df: DataFrame, value: str) -> DataFrame:
    """Fails at run time on a row without a value."""
    return df.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit(f"no {value}"))).otherwise(F.col(value)))


def carry_forward(dates: DataFrame, decisions: DataFrame, value: str, lag: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Every date with the last decision's value, ``lag`` rows later."""
    keys = keys or []
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date")
    out = dates.join(decisions.select(*keys, "date", value), [*keys, "date"], "left")
    return out.withColumn(value, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -lag)))


def strict_gaps(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """keys, problem: keys of the left side without a match, and keys that the right side has twice."""
    missing = left.select(on).distinct().join(right.select(on).distinct(), on, "left_anti").withColumn("problem", F.lit("missing"))
    twice = right.groupBy(on).agg(F.count("*").alias("n")).where("n > 1").select(on).withColumn("problem", F.lit("duplicate"))
    return missing.unionByName(twice)


def _unique(on: list[str]) -> F.Column:
    """1 in each row; fails the job on a repeated key."""
    return F.when(F.count(F.lit(1)).over(Window.partitionBy(*on)) > 1, F.raise_error(F.lit(f"a key of {on} is repeated")).cast("int")).otherwise(F.lit(1))


def strict_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that fails the job on a left row without match or a key that the right side repeats."""
    found = F.when(F.col("_r").isNull(), F.raise_error(F.lit(f"a key of {on} has no match")).cast("int")).otherwise(1)
    return left.join(right.withColumn("_r", _unique(on)), on, "left").where(found == 1).drop("_r")


def one_to_one_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join of two tables with unique keys; a repeated key on either side or a left row without match fails the job."""
    l, r = left.withColumn("_l", _unique(on)), right.withColumn("_r", _unique(on))
    found = F.when(F.col("_r").isNull(), F.raise_error(F.lit(f"a key of {on} has no match")).cast("int")).otherwise(F.col("_l"))
    return l.join(r, on, "left").where(found == 1).drop("_l", "_r")


def one_to_one_outer(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Full outer join with suffixes on clashing columns and a ``side`` column: both, left_only, right_only. A repeated key fails the job."""
    clash = (set(left.columns) & set(right.columns)) - set(on)
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).withColumn("_l", _unique(on))
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in clash}).withColumn("_r", _unique(on))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return l.join(r, on, "full_outer").withColumn("side", side).drop("_l", "_r")


def with_features(returns: DataFrame, features: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """``returns`` with an array column ``features`` of the day's feature row (null before the first); features and regime
    probabilities, both by date, are joined by an inner join."""
    both = features if probabilities is None else features.join(probabilities, "date")
    packed = both.select("date", F.array(*(F.col(c).cast("double") for c in both.columns if c != "date")).alias("features"))
    return returns.join(packed, "date", "left")


def key_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys in only one of the two tables, with the side they are on."""
    return a.select(on).exceptAll(b.select(on)).withColumn("side", F.lit("a")).unionByName(b.select(on).exceptAll(a.select(on)).withColumn("side", F.lit("b")))


def periods(days: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each day after the first decision with the decision whose period (decision, next] it is in: an as-of join, not a range join."""
    return as_of_prior(days, decisions.withColumn("decided", F.col("date")), "date", "date", "decided").where("decided is not null")
