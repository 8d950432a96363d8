"""Study drivers: scenario tables, arms of refitting and retraining, contrasts, seed checks, search sensitivity."""

from __future__ import annotations

import math
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inference
from ..operators import bootstrap as bs
from ..operators import evaluation as ev
from ..operators import joins as jo
from ..sources import io
from . import walkforward as wf
from .walkforward import Options

#: The arms of the refit study.
REFIT_ARMS = {"no_refit": {"refit_at_rebalance": False}, "monthly": {"refit_every_n_rebalances": 1}, "quarterly": {"refit_every_n_rebalances": 3}}

#: Signed strategies of the five contrasts; the third is a difference of differences.
CONTRASTS = {
    "rq1_erc_regime_effect": {"erc_regime": 1, "erc_baseline": -1},
    "rq1_lstm_regime_effect": {"lstm_regime": 1, "lstm_baseline": -1},
    "rq2_difference_in_differences": {"lstm_regime": 1, "lstm_baseline": -1, "erc_regime": -1, "erc_baseline": 1},
    "rq3_erc_reliability_effect": {"erc_blend": 1, "erc_regime": -1},
    "rq3_lstm_reliability_effect": {"lstm_blend": 1, "lstm_regime": -1},
}


def refit_arms(base: Options) -> dict[str, Options]:
    return {name: replace(base, **change) for name, change in REFIT_ARMS.items()}


def retraining_arms(base: Options) -> dict[str, Options]:
    """Allocators trained once, and again every third rebalance."""
    return {"fixed": replace(base, lstm_retrain_every_n_rebalances=None), "quarterly": replace(base, lstm_retrain_every_n_rebalances=3)}


def robustness(base: Options, drop: list[str]) -> dict[str, tuple[Options, str | None]]:
    """Scenario -> (options, asset left out): the primary run, two states, one asset less, hierarchical targets, a tail for each regime."""
    specs = {"primary": (base, None), "two_states": (replace(base, n_states=2), None), "hierarchical": (replace(base, include_hrp=True), None), "tail_per_regime": (replace(base, per_regime_nu=True), None)}
    return specs | {f"without_{a}": (base, a) for a in drop}


def scenario_rows(returns: DataFrame, dropped: dict[str, str | None], last_day: str | None = None) -> DataFrame:
    """``returns`` once for each scenario, without the asset that it leaves out and without days after ``last_day``.

    Rows unfold from an array of a few names; the filter on days reaches the scan.
    """
    rows = returns if last_day is None else returns.where(F.col("date") <= F.lit(last_day).cast("date"))
    rows = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, dropped))))
    for name, asset in dropped.items():
        if asset is not None:
            rows = rows.where((F.col("scenario") != name) | (F.col("asset") != asset))
    return rows.repartition(len(dropped), "scenario")


def contrasts(returns: DataFrame, keys: list[str] | None = None, value: str = "ret", draws: int = 2000, seed: int = 0, definitions: dict[str, dict[str, int]] = CONTRASTS, length: float | None = None) -> DataFrame:
    """keys, contrast, point, low, high, block_length of daily returns (keys, date, config, value); see ``operators.bootstrap``."""
    return bs.intervals(bs.signed_series(returns, keys or [], value, definitions), keys or [], draws, seed, length=length)


def net_excess(daily: DataFrame, executions: DataFrame, risk_free: DataFrame, keys: list[str], bps: float = 5.0) -> DataFrame:
    """``daily`` (keys, date, ret) with excess: returns after fees on executed turnover less the day's risk-free rate (date, rf_daily), which every day must have."""
    net = ev.net_returns(daily, executions, keys, bps)
    rated = net.join(risk_free.select("date", "rf_daily"), "date", "left")
    return jo.require_matched(rated, "rf_daily").withColumn("excess", F.col("net") - F.col("rf_daily"))


def arm_tables(daily: DataFrame, decisions: DataFrame, stages: F.Column, fees: list[float], keys: list[str]) -> DataFrame:
    """keys, stage, fee_bps, sharpe_net, cagr_net, mean_turnover, binding, rebalances.

    ``daily`` (keys, date, ret, risk_free, executed) has the turnover executed on a day or null; ``decisions`` (keys, date, turnover, turnover_binding).
    """
    rows = daily.withColumn("stage", stages).withColumn("fee_bps", F.explode(F.array(*map(F.lit, map(float, fees)))))
    net = (1 + F.col("ret")) * (1 - F.col("fee_bps") / 1e4 * F.coalesce("executed", F.lit(0.0))) - 1
    rows = rows.withColumn("_net", net).withColumn("_excess", F.col("_net") - F.col("risk_free"))
    left = rows.groupBy(*keys, "stage", "fee_bps").agg(ev.sharpe(F.col("_excess")).alias("sharpe_net"), ev.cagr(F.col("_net")).alias("cagr_net"))
    right = decisions.withColumn("stage", stages).groupBy(*keys, "stage").agg(F.avg("turnover").alias("mean_turnover"), F.count_if("turnover_binding").alias("binding"), F.count("*").alias("rebalances"))
    return left.join(right, [*keys, "stage"], "left")


def stage_tables(tables: DataFrame, daily: DataFrame, stages: F.Column) -> DataFrame:
    """scenario, config, stage: measures of net returns (the Sharpe ratio of excess ones), mean turnover of executions, concentration, and decisions at the turnover limit.

    ``tables`` are all tables of walks, ``daily`` their returns with net, excess and stage.
    """
    keys = ["scenario", "config", "stage"]
    out = ev.performance(daily, keys, "net").withColumnRenamed("sharpe", "sharpe_zero_rate")
    out = out.join(daily.groupBy(*keys).agg(ev.sharpe(F.col("excess")).alias("sharpe")), keys)
    of = lambda name: wf.table(tables, name).withColumn("stage", stages)
    hhi = of("weights").groupBy(*keys).agg(F.avg(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)).alias("hhi"))
    turnover = of("executions").groupBy(*keys).agg(F.avg("turnover").alias("mean_turnover"))
    bound = of("decisions").groupBy(*keys).agg(F.count("*").alias("rebalances"), F.count_if("turnover_binding").alias("binding"))
    for other in (hhi, turnover, bound):
        out = out.join(other, keys, "left")
    return out


def arm_difference(daily: DataFrame, arms: tuple[str, str], keys: list[str], value: str = "excess", draws: int = 2000, seed: int = 0) -> DataFrame:
    """keys, point, low, high, block_length of the first arm's Sharpe ratio less the second's; ``daily`` (arm, keys, date, value)."""
    out = contrasts(daily.withColumnRenamed("arm", "config"), keys, value, draws, seed, {"difference": {arms[0]: 1, arms[1]: -1}})
    return out.drop("contrast")


def checked_seeds(table: DataFrame, seeds: list[int], configs: list[str], seed: str = "seed", config: str = "config") -> DataFrame:
    """The table, if it has each pair of seed and configuration exactly once and nothing else; one aggregation."""
    pairs = F.struct(seed, config)
    known = F.col(seed).isin(seeds) & F.col(config).isin(configs)
    return io.require(table, complete=F.count_distinct(pairs) == len(seeds) * len(configs), no_pair_twice=F.count("*") == F.count_distinct(pairs), nothing_else=F.count_if(~F.coalesce(known, F.lit(False))) == 0)


def comparison(table: DataFrame, by: str, versions: tuple[str, str], config: str = "config", metrics: tuple[str, ...] = ("sharpe", "cagr", "max_drawdown")) -> DataFrame:
    """config and, for each metric and version, mean and deviation over seeds, and the difference of the means."""
    aggs = []
    for m in metrics:
        at = [F.when(F.col(by) == v, F.col(m)) for v in versions]
        for v, c in zip(versions, at):
            aggs += [F.avg(c).alias(f"{m}_{v}"), F.stddev_samp(c).alias(f"{m}_{v}_sd")]
        aggs.append((F.avg(at[1]) - F.avg(at[0])).alias(f"{m}_change"))
    return table.groupBy(config).agg(*aggs)


def effect_summary(table: DataFrame, by: str, pair: tuple[str, str], seed: str = "seed", config: str = "config", value: str = "sharpe") -> DataFrame:
    """by, n, mean, sd, positive: over seeds, value of the first configuration less that of the second."""
    each = ev.effects(table, [by, seed], config, value, {"effect": pair})
    return each.groupBy(by).agg(F.count("effect").alias("n"), F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("sd"), F.count_if(F.col("effect") > 0).alias("positive"))


def search_scenarios(candidates: DataFrame, family: str, value: str, rules: dict[str, F.Column], logged: int | None = None) -> DataFrame:
    """kind (variance or trials), name, value: variances of the pooled rules and of each family with two candidates, unit variance;
    logged trials, candidates and families as numbers of trials."""
    pooled = ev.rule_variances(candidates, value, rules)
    stack = ", ".join(f"'pooled_{n}', `{n}`" for n in rules)
    variances = pooled.select(F.expr(f"stack({len(rules)}, {stack}) AS (name, value)")).where("value IS NOT NULL")
    families = ev.family_variances(candidates, family, value).select(F.concat(F.lit("family_"), F.col(family).cast("string")).alias("name"), F.col("variance").alias("value"))
    out = variances.unionByName(families).withColumn("kind", F.lit("variance"))
    counts = candidates.agg(F.count(value).cast("double").alias("c"), F.count_distinct(family).cast("double").alias("f"))
    fixed = "'variance', 'conventional_unit_variance', 1D, 'trials', 'deduped_candidate_count', c, 'trials', 'coherent_search_families', f"
    n = 3
    if logged is not None:
        fixed, n = f"{fixed}, 'trials', 'literal_logged_trials', {float(logged)}D", 4
    return out.unionByName(counts.select(F.expr(f"stack({n}, {fixed}) AS (kind, name, value)"))).select("kind", "name", "value")


def sensitivity_grid(excess: DataFrame, keys: list[str], scenarios: DataFrame, value: str = "ret") -> DataFrame:
    """One row for each group of ``keys``, variance and number of trials: Sharpe ratio and its three search-adjusted probabilities.

    Groups become one row of moments each before they meet the scenarios, a few dozen settings.
    """
    v = F.col(value)
    base = excess.groupBy(*keys).agg(ev.sharpe(v).alias("sharpe"), F.count(v).alias("_n"), *ev.moments(v))
    variances = scenarios.where("kind = 'variance'").select(F.col("name").alias("variance_scenario"), F.col("value").alias("variance"))
    trials = scenarios.where("kind = 'trials'").select(F.col("name").alias("k_scenario"), F.col("value").cast("int").alias("trials"))
    rows = base.crossJoin(F.broadcast(variances)).crossJoin(F.broadcast(trials))  # settings, not data
    schema = ", ".join([*(f"`{k}` {excess.schema[k].dataType.simpleString()}" for k in keys), "sharpe double, variance_scenario string, variance double, k_scenario string, trials int, dsr_l double, dsr_ls_gaussian double, dsr_ls_gumbel double"])

    def run(frames):
        for pdf in frames:
            out = []
            for x in pdf.to_dict("records"):
                about = (x["sharpe"] / math.sqrt(252), x["variance"], x["trials"], x["_n"], x["skew"], x["kurt"])
                normal, gumbel = inference.location_scale(*about)
                out.append({**{c: x[c] for c in (*keys, "sharpe", "variance_scenario", "variance", "k_scenario", "trials")}, "dsr_l": inference.deflated(*about), "dsr_ls_gaussian": normal, "dsr_ls_gumbel": gumbel})
            yield pd.DataFrame(out, columns=[*keys, "sharpe", "variance_scenario", "variance", "k_scenario", "trials", "dsr_l", "dsr_ls_gaussian", "dsr_ls_gumbel"])

    return rows.mapInPandas(run, schema)
