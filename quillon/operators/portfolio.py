"""Portfolio construction for many matrices at once: trailing covariances, risk budgets, single linkage, recursive bisection, projections.

Relations are long, (keys, i, j, value); the keys say which matrix (a decision, a scenario, a universe). Matrices spread over the
cluster by their keys; only what belongs to one matrix (its assets, a few dozen) meets in one row. Small dense solves run on batches of such rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import allocation as al
from ..sources.io import staged
from . import allocation as oa


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def trailing_covariance(returns: DataFrame, decisions: DataFrame, days: int = 252) -> DataFrame:
    """date, i, j, cov (divisor n - 1) of the last ``days`` days up to each decision; decisions without as many have none.

    Sums of products run on by pair, and a decision reads their difference over its window: one pass, whatever the window's length.
    """
    p = oa.products(oa.vectors(returns), ["date"])
    w = Window.partitionBy("i", "j").orderBy("date")
    running = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    sums = p.select("date", "i", "j", running(F.col("x")).alias("sx"), running(F.col("y")).alias("sy"), running(F.col("x") * F.col("y")).alias("sxy"), F.row_number().over(w).alias("n"))
    for c in ("sx", "sy", "sxy"):
        sums = sums.withColumn(c, F.col(c) - F.coalesce(F.lag(c, days).over(w), F.lit(0.0)))
    rows = sums.where(F.col("n") >= days).join(F.broadcast(decisions.select("date")), "date", "left_semi")  # one row a month
    return rows.select("date", "i", "j", ((F.col("sxy") - F.col("sx") * F.col("sy") / days) / (days - 1)).alias("cov"))


def matrices(cov: DataFrame, keys: list[str], value: str = "cov") -> DataFrame:
    """keys, assets, m: one row a matrix, rows flattened in the order of the assets."""
    rows = cov.groupBy(*keys, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", value))), lambda p: p[value]).alias("r"))
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("v"))
    return whole.select(*keys, F.col("v.i").alias("assets"), F.flatten(F.col("v.r")).alias("m"))


def _square(m) -> np.ndarray:
    n = math.isqrt(len(m))
    return np.reshape(np.asarray(m, float), (n, n))


def risk_budget_weights(whole: DataFrame, keys: list[str], solver: str = "exact") -> DataFrame:
    """keys, asset, weight, share: equal risk budgets of every matrix by the solver of that name; an unknown name is an error."""
    if solver not in al.SOLVERS:
        raise ValueError(f"the solver must be one of {', '.join(al.SOLVERS)}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for m in pdf["m"]:
                cov = _square(m)
                w = al.SOLVERS[solver](cov, np.full(len(cov), 1 / len(cov)))
                found.append((w, al.risk_shares(w, cov)))
            yield pdf[[*keys, "assets"]].assign(w=[w for w, _ in found], s=[s for _, s in found])

    out = whole.mapInPandas(run, f"{_schema(whole, [*keys, 'assets'])}, w array<double>, s array<double>")
    return out.select(*keys, F.explode(F.arrays_zip("assets", "w", "s")).alias("p")).select(*keys, F.col("p.assets").alias("asset"), F.col("p.w").alias("weight"), F.col("p.s").alias("share"))


def spanning_tree(distances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, distance: the edges of every matrix's minimum spanning tree; ties are broken by (i, j).

    In each round every component takes its shortest edge to another one, and components that are thereby connected become one; the
    number of components falls to half at least, so log2 of the largest matrix' size rounds do.
    """
    edges = distances.where("i < j").select(*keys, "i", "j", "distance")
    part = distances.select(*keys, F.col("i").alias("node")).distinct().withColumn("part", F.col("node"))
    most = part.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    tree = None
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        a, b = (part.select(*keys, F.col("node").alias(e), F.col("part").alias(f"p{e}")) for e in "ij")
        across = edges.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where("pi <> pj")
        both = across.select(*keys, F.struct("distance", "i", "j").alias("e"), F.explode(F.array(F.struct(F.col("pi").alias("of"), F.col("pj").alias("to")), F.struct(F.col("pj").alias("of"), F.col("pi").alias("to")))).alias("p"))
        best = staged(both.groupBy(*keys, F.col("p.of").alias("of")).agg(F.min("e").alias("e"), F.min_by("p.to", "e").alias("to")), "shortest")
        found = best.select(*keys, "e.*").distinct()
        tree = found if tree is None else tree.unionByName(found)
        # the components' choices form trees whose two topmost components choose each other: the smaller of them is the root
        links = best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("of", "to"))).alias("up"), F.count("*").alias("n"))
        step = "IF(up[up[x]] = x AND x < up[x], x, up[x])"
        joined = part.join(links, keys, "left")
        root = F.expr(f"IF(up[part] IS NULL, part, aggregate(sequence(1, n), part, (x, k) -> {step}))")
        part = staged(joined.select(*keys, "node", root.alias("part")), "parts")
    return tree if tree is not None else edges.limit(0)


def leaf_order(tree: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, leaves: assets in the order of the single-linkage tree; of two joined clusters that with the smaller number stands left.

    Single linkage joins clusters along the spanning tree's edges, shortest first; assets are numbered by name, clusters as they arise.
    """
    first = nodes.groupBy(*keys).agg(F.sort_array(F.collect_set("node")).alias("names"))
    sorted_edges = tree.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("distance", "i", "j"))).alias("edges"))
    both = first.join(sorted_edges, keys, "left")
    begin = "transform(names, (x, k) -> named_struct('id', k, 'leaves', array(x)))"
    pair = "filter(acc, c -> array_contains(c.leaves, e.i) OR array_contains(c.leaves, e.j))"  # clusters stand in order of their numbers
    rest = "filter(acc, c -> NOT array_contains(c.leaves, e.i) AND NOT array_contains(c.leaves, e.j))"
    new = f"named_struct('id', element_at(acc, -1).id + 1, 'leaves', flatten(transform({pair}, c -> c.leaves)))"
    fold = f"aggregate(coalesce(edges, array()), {begin}, (acc, e) -> concat({rest}, array({new})))"
    return both.select(*keys, F.expr(f"{fold}[0].leaves").alias("leaves"))


def hierarchical_weights(cov: DataFrame, keys: list[str]) -> DataFrame:
    """keys, asset, weight: hierarchical risk parity of every matrix.

    Assets in leaf order are halved again and again (the left half has floor(n / 2)); of two halves each gets a share by the other's
    risk, that of its inverse-variance portfolio.
    """
    sd = cov.where("i = j").select(*keys, "i", F.sqrt("cov").alias("s"))
    dist = cov.join(sd, [*keys, "i"]).join(sd.withColumnsRenamed({"i": "j", "s": "t"}), [*keys, "j"])
    correlation = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("cov"), F.col("s") * F.col("t"))))
    dist = dist.select(*keys, "i", "j", F.sqrt(0.5 * (1 - correlation)).alias("distance"))
    nodes = sd.select(*keys, F.col("i").alias("node"))
    order = leaf_order(spanning_tree(staged(dist, "distances"), keys), nodes, keys)
    places = order.select(*keys, F.posexplode("leaves").alias("place", "asset"))
    most = order.agg(F.max(F.size("leaves"))).first()[0] or 0
    inverse = cov.where("i = j").select(*keys, F.col("i").alias("asset"), (1 / F.col("cov")).alias("inv"))
    # a segment is named by its first place and length; each level's factor multiplies the weight
    now = places.join(inverse, [*keys, "asset"]).join(order.select(*keys, F.size("leaves").alias("size")), keys).select(*keys, "asset", "place", "inv", F.lit(0).alias("first"), "size", F.lit(1.0).alias("weight"))
    now = staged(now, "leaves")
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        half = F.floor(F.col("size") / 2).cast("int")
        left = F.col("place") < F.col("first") + half
        split = now.withColumn("side", F.when(F.col("size") < 2, 0).otherwise(F.when(left, 1).otherwise(2)))
        a = split.select(*keys, "first", "side", F.col("asset").alias("i"), F.col("inv").alias("u"))
        b = split.select(*keys, F.col("first").alias("first2"), F.col("side").alias("side2"), F.col("asset").alias("j"), F.col("inv").alias("v"))
        inside = cov.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where("first = first2 AND side = side2 AND side > 0")
        total = F.sum(F.when(F.col("i") == F.col("j"), F.col("u")))
        risk = inside.groupBy(*keys, "first", "side").agg((F.sum(F.col("u") * F.col("v") * F.col("cov")) / (total * total)).alias("risk"))
        halves = risk.groupBy(*keys, "first").agg(F.sum(F.when(F.col("side") == 1, F.col("risk"))).alias("ra"), F.sum(F.when(F.col("side") == 2, F.col("risk"))).alias("rb"))
        both = split.join(halves, [*keys, "first"], "left")
        share = F.when(F.col("side") == 0, 1.0).when(F.col("side") == 1, 1 - F.col("ra") / (F.col("ra") + F.col("rb"))).otherwise(F.col("ra") / (F.col("ra") + F.col("rb")))
        new_first = F.when(F.col("side") == 2, F.col("first") + half).otherwise(F.col("first"))
        new_size = F.when(F.col("side") == 0, F.col("size")).when(F.col("side") == 1, half).otherwise(F.col("size") - half)
        now = staged(both.select(*keys, "asset", "place", "inv", new_first.alias("first"), new_size.cast("int").alias("size"), (F.col("weight") * share).alias("weight")), "halves")
    return now.select(*keys, "asset", "weight")


def projected(decisions: DataFrame, keys: list[str], limits: al.Limits = al.Limits()) -> DataFrame:
    """keys, asset, raw, before, weight, price, turnover_price of each asset of every decision (keys, asset, raw, before).

    All decisions of a batch are solved together. A decision whose limits hold no weights fails the job.
    """
    rows = decisions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("asset", "raw", "before"))).alias("v"))
    rows = rows.select(*keys, F.col("v.asset").alias("assets"), F.col("v.raw").alias("raw"), F.col("v.before").alias("before"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes = pdf["assets"].map(len)
            for _, own in pdf.groupby(sizes):  # universes of different sizes
                raw, before = (np.stack([np.asarray(v, float) for v in own[c]]) for c in ("raw", "before"))
                w, price, mu, feasible = al.project_many(raw, before, limits)
                if not feasible.all():
                    raise al.Infeasible(f"no weights within the limits for {own[keys][~feasible].iloc[0].tolist()}")
                yield own.assign(weight=list(w), price=price, turnover_price=mu)

    out = rows.mapInPandas(run, f"{_schema(rows, rows.columns)}, weight array<double>, price double, turnover_price double")
    return out.select(*keys, "price", "turnover_price", F.explode(F.arrays_zip("assets", "raw", "before", "weight")).alias("p")).select(*keys, F.col("p.assets").alias("asset"), "p.raw", "p.before", "p.weight", "price", "turnover_price")


def certificates(solved: DataFrame, keys: list[str], limits: al.Limits = al.Limits(), slack: float = 1e-9) -> DataFrame:
    """keys, turnover, residual: the largest violation of the optimality conditions by weights and prices of ``projected``.

    Conditions: the budget, the box, the turnover limit and its price, and for each asset that raw - weight - price lies where its
    position allows: between the two signs of the turnover price, below it at the lower and above it at the upper limit.
    """
    g, mu, moved = F.col("raw") - F.col("weight") - F.col("price"), F.col("turnover_price"), F.col("weight") - F.col("before")
    low = F.when(F.col("weight") <= limits.lower + slack, float("-inf")).when(moved > slack, mu).otherwise(-mu)
    high = F.when(F.col("weight") >= limits.upper - slack, float("inf")).when(moved < -slack, -mu).otherwise(mu)
    off = F.greatest(low - g, g - high, limits.lower - F.col("weight"), F.col("weight") - limits.upper, F.lit(0.0))
    out = solved.groupBy(*keys).agg(F.sum(F.abs(moved)).alias("turnover"), F.max(off).alias("_off"), F.abs(F.sum("weight") - 1).alias("_sum"), F.max(mu).alias("_mu"))
    over = F.col("turnover") - limits.turnover
    return out.select(*keys, "turnover", F.greatest("_off", "_sum", over, F.least(F.col("_mu"), -over), F.lit(0.0)).alias("residual"))


def best_feasible(whole: DataFrame, holdings: DataFrame, keys: list[str], starts: int = 8, seed: int = 0, limits: al.Limits = al.Limits()) -> DataFrame:
    """keys, start, error, weights: of each matrix the start that leads to the smallest squared error of risk shares within the limits.

    ``whole`` are ``matrices``, ``holdings`` (keys, before: array in the order of the assets). Starts are rows: equal weights, the exact solution and
    random ones; each random one is a function of its number. The problem isn't convex: the best error is an upper bound.
    """
    rows = whole.join(holdings, keys).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).repartition(*keys, "start")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for r in pdf.itertuples():
                cov, before = _square(r.m), np.asarray(r.before, float)
                n = len(before)
                even = np.full(n, 1 / n)
                begin = even if r.start == 0 else al.risk_budget(cov, even) if r.start == 1 else np.random.default_rng([seed, r.start]).dirichlet(np.ones(n))
                w, e = al.best_feasible(cov, before, begin[None], limits)
                found.append((w[0], float(e[0])))
            yield pdf[[*keys, "start"]].assign(error=[e for _, e in found], weights=[w for w, _ in found])

    tried = rows.mapInPandas(run, f"{_schema(rows, [*keys, 'start'])}, error double, weights array<double>")
    best = F.min_by(F.struct("start", "error", "weights"), F.struct(F.round("error", 12), "start")).alias("b")
    return tried.where("NOT isnan(error)").groupBy(*keys).agg(best).select(*keys, "b.*")
