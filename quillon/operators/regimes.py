"""Regime filters, smoothers and EM over blocks of days, for many series at once.

A day's step multiplies the vector of state weights by a K x K matrix, so a block of days is one scaled matrix whatever its length. Products are
associative: the blocks' matrices are scanned, in levels of at most ``block`` rows a group, which gives every block the
distribution it starts from and the weight of what follows it. Then all blocks run forward and backward side by side and Spark
adds up their sufficient statistics. No group is longer than a block; a series of any length, or any number of series, spreads over
the cluster. Blocks of any length give the same result up to rounding.

Tables: observations (keys, t from 1 without gaps, x array of assets) and models (keys, start, step, means, covs: flat arrays in row
order). Each key of the observations needs one model. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hmm
from ..sources.io import staged

MODEL = ["start", "step", "means", "covs"]


def _regimes(r) -> hmm.Regimes:
    k = len(r.start)
    f = len(r.means) // k
    return hmm.Regimes(np.array(r.start), np.reshape(r.step, (k, k)), np.reshape(r.means, (k, f)), np.reshape(r.covs, (k, f, f)))


def _densities(r) -> tuple[hmm.Regimes, np.ndarray, np.ndarray]:
    m, x = _regimes(r), np.stack([np.asarray(v, float) for v in r.xs])
    return m, x, hmm.emissions(m, x)


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def in_blocks(observations: DataFrame, keys: list[str], block: int) -> DataFrame:
    """keys, block, xs: runs of at most ``block`` days in order."""
    at = F.floor((F.col("t") - 1) / block).cast("bigint").alias("block")
    return observations.groupBy(*keys, at).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("xs"))


def _product(rows: Iterator[np.ndarray]) -> np.ndarray:
    """A product of matrices, rescaled at each step: only its direction counts."""
    out = None
    for m in rows:
        out = m if out is None else out @ m
        out = out / out.max()
    return out


def _matrices(blocks: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, start, m: each block's matrix; the first block's begins without a transition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                m, _, dens = _densities(r)
                steps = (np.diag(b) if r.block == 0 and k == 0 else m.step * b for k, b in enumerate(dens))
                out.append(_product(steps).ravel())
            yield pdf[[*keys, "block", "start"]].assign(m=out)

    joined = blocks.join(models, keys)
    return joined.mapInPandas(run, f"{_schema(joined, [*keys, 'block', 'start'])}, m array<double>")


def _scan(parts: DataFrame, keys: list[str], block: int) -> DataFrame:
    """keys, block, enter, leave: the state weights that a block starts from, and the weight of each last state by all later blocks."""
    most = parts.agg(F.max("block")).first()[0] or 0
    upper = F.floor(F.col("block") / block).cast("bigint")

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        k = len(pdf["start"][0])
        ms = [np.reshape(m, (k, k)) for m in pdf["m"]]
        enter, leave = np.array(pdf["enter"][0]), np.array(pdf["leave"][0])
        before, after = [], []
        for m in ms:
            before.append(enter)
            enter = enter @ m
            enter = enter / enter.sum()
        for m in reversed(ms):
            after.append(leave)
            leave = m @ leave
            leave = leave / leave.max()
        return pdf[[*keys, "block"]].assign(enter=before, leave=after[::-1])

    if most < block:
        whole = parts.withColumn("enter", F.col("start")).withColumn("leave", F.transform("start", lambda _: F.lit(1.0)))
        return whole.groupBy(*keys).applyInPandas(within, f"{_schema(parts, [*keys, 'block'])}, enter array<double>, leave array<double>")

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        k = len(pdf["start"][0])
        return pdf[[*keys, "upper", "start"]].iloc[:1].assign(m=[_product(np.reshape(m, (k, k)) for m in pdf["m"]).ravel()])

    grouped = parts.withColumn("upper", upper)
    products = grouped.groupBy(*keys, "upper").applyInPandas(multiply, f"{_schema(grouped, [*keys, 'upper', 'start'])}, m array<double>")
    ends = _scan(staged(products.withColumnRenamed("upper", "block"), "products"), keys, block).withColumnRenamed("block", "upper")
    return grouped.join(ends, [*keys, "upper"]).groupBy(*keys, "upper").applyInPandas(within, f"{_schema(parts, [*keys, 'block'])}, enter array<double>, leave array<double>")


def _inside(r) -> tuple:
    """(model, x, filtered, scales, smoothed, expected moves into each day of the block but the series' first)."""
    m, x, dens = _densities(r)
    enter, leave = np.array(r.enter), np.array(r.leave)
    first = hmm.Regimes(enter if r.block == 0 else enter @ m.step, m.step, m.means, m.covs)
    alpha, scale = hmm.filtered(first, dens)
    z, beta = leave, [leave]
    for b in dens[:0:-1]:
        z = m.step @ (b * z)
        z = z / z.max()
        beta.append(z)
    beta = np.array(beta[::-1])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    before = np.vstack([enter, alpha[:-1]])
    pairs = before[:, :, None] * m.step * (dens * beta)[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return m, x, alpha, scale, gamma, pairs[1 if r.block == 0 else 0 :].sum(axis=0)


def _ready(blocks: DataFrame, models: DataFrame, keys: list[str], block: int) -> DataFrame:
    models = models.select(*keys, *MODEL)
    parts = staged(_matrices(blocks, models, keys), "matrices")
    return blocks.join(models, keys).join(_scan(parts, keys, block), [*keys, "block"])


def probabilities(observations: DataFrame, models: DataFrame, keys: list[str], block: int = 512) -> DataFrame:
    """keys, t, filtered, smoothed (arrays over states)."""
    blocks = staged(in_blocks(observations, keys, block), "blocks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for own, r in zip(pdf[keys].to_dict("records"), pdf.itertuples()):
                _, x, alpha, _, gamma, _ = _inside(r)
                yield pd.DataFrame({**{k: [v] * len(x) for k, v in own.items()}, "t": r.block * block + 1 + np.arange(len(x)), "filtered": list(alpha), "smoothed": list(gamma)})

    return _ready(blocks, models, keys, block).mapInPandas(run, f"{_schema(observations, keys)}, t bigint, filtered array<double>, smoothed array<double>")


def em_round(blocks: DataFrame, models: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The models after one round, with loglik (of the models before it) and n, the number of days."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                m, x, _, scale, gamma, moves = _inside(r)
                from_mean = x[:, None, :] - m.means  # moments about the old means keep their digits
                first = gamma[0] if r.block == 0 else np.zeros(len(m.start))
                sums = np.einsum("tk,tkf->kf", gamma, from_mean)
                squares = np.einsum("tk,tkf,tkg->kfg", gamma, from_mean, from_mean)
                out.append(np.concatenate([[np.log(scale).sum(), len(x)], first, gamma.sum(axis=0), moves.ravel(), sums.ravel(), squares.ravel()]))
            yield pdf[keys].assign(stats=out)

    ready = _ready(blocks, models, keys, block)
    each = ready.mapInPandas(gather, f"{_schema(ready, keys)}, stats array<double>")
    shape = models.select(F.size("start").alias("k"), F.size("means").alias("f")).first()
    if shape is None:
        return models.select(*keys, *MODEL).withColumn("loglik", F.lit(0.0)).withColumn("n", F.lit(0).cast("bigint"))
    k, f = shape["k"], shape["f"] // shape["k"]
    length = 2 + 2 * k + k * k + k * f + k * f * f
    total = each.groupBy(*keys).agg(F.array(*(F.sum(F.col("stats")[i]) for i in range(length))).alias("stats"))

    def maximise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                s = np.array(r.stats)
                start, mass, moves, sums, squares = np.split(s[2:], np.cumsum([k, k, k * k, k * f]))
                moves, shift = moves.reshape(k, k), sums.reshape(k, f) / mass[:, None]
                covs = squares.reshape(k, f, f) / mass[:, None, None] - shift[:, :, None] * shift[:, None, :] + hmm.COVARIANCE_RIDGE * np.eye(f)
                out.append((start, (moves / moves.sum(axis=1, keepdims=True)).ravel(), (np.reshape(r.means, (k, f)) + shift).ravel(), covs.ravel(), s[0], int(s[1])))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=[*MODEL, "loglik", "n"])], axis=1)

    joined = total.join(models.select(*keys, "means"), keys)
    return joined.mapInPandas(maximise, f"{_schema(joined, keys)}, {', '.join(f'{c} array<double>' for c in MODEL)}, loglik double, n bigint")


def fit(observations: DataFrame, begin: DataFrame, keys: list[str], rounds: int = 200, tolerance: float = 1e-4, block: int = 512) -> DataFrame:
    """keys, start, step, means, covs, loglik, steps, bic of every series; a series whose likelihood moves by less than ``tolerance`` rests."""
    blocks = staged(in_blocks(observations, keys, block), "blocks")
    now = begin.select(*keys, *MODEL).withColumn("loglik", F.lit(None).cast("double")).withColumn("n", F.lit(0).cast("bigint")).withColumn("steps", F.lit(0)).withColumn("done", F.lit(False))
    for _ in range(rounds):
        moving = now.where("NOT done")
        new = em_round(blocks, moving, keys, block).join(moving.select(*keys, F.col("loglik").alias("_last"), "steps"), keys)
        new = new.withColumn("done", F.coalesce(F.abs(F.col("loglik") - F.col("_last")) < tolerance, F.lit(False))).withColumn("steps", F.col("steps") + 1).drop("_last")
        now = staged(new.unionByName(now.where("done")), "models")
        if not now.where("NOT done").limit(1).count():
            break
    k, f = F.size("start"), F.size("means") / F.size("start")
    free = k * f + k * f * (f + 1) / 2 + k * (k - 1) + (k - 1)
    return now.select(*keys, *MODEL, "loglik", "steps", (-2 * F.col("loglik") + free * F.ln("n")).alias("bic"))
