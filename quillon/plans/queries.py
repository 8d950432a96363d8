"""Named queries over the derived panel, each with SQL for another engine where SQL can express it.

Values are rounded to 9 decimals on both sides: sums run in another order there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import allocation as al
from ..functions import densities as de
from ..functions import hmm, inference
from ..operators import allocation as oa
from ..operators import evaluation as ev
from ..operators import joins as jo
from ..operators import reliability as re
from ..operators import timeseries as ts
from ..sources import io
from ..sources import panel as pn
from . import equal_weight as ew
from . import studies as st
from . import walkforward as wf

ASSETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
BOUNDS = [("train", "1997-12-31"), ("validation", "1999-06-30"), ("test", "2001-06-30")]
FEES = [5.0, 10.0, 25.0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = """cells AS (SELECT CAST(l_shipdate AS DATE) AS date, r_name AS asset, 0.3 * (avg(l_discount) - 0.05) AS r, 0.1 * (avg(l_tax) - 0.04) AS co
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
grid AS (SELECT date, r_name AS asset FROM (SELECT DISTINCT date FROM cells) CROSS JOIN region),
base AS (SELECT date, asset, coalesce(r, 0) AS r, coalesce(co, 0) AS co, coalesce(r, 0) - coalesce(co, 0) AS oc FROM grid LEFT JOIN cells USING (date, asset)),
prices AS (SELECT *, 100 * exp(sum(r) OVER (PARTITION BY asset ORDER BY date)) AS close FROM base),
panel AS (SELECT *, close / exp(oc) AS open FROM prices),
rets AS (SELECT * FROM (SELECT date, asset, ln(close / lag(close) OVER w) AS ret, ln(open / lag(close) OVER w) AS overnight, ln(close / open) AS intraday FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE ret IS NOT NULL),
days AS (SELECT DISTINCT date FROM rets), ends AS (SELECT max(date) AS date FROM days GROUP BY year(date), month(date)),
stages AS (SELECT date, CASE WHEN date <= DATE '1997-12-31' THEN 'train' WHEN date <= DATE '1999-06-30' THEN 'validation' WHEN date <= DATE '2001-06-30' THEN 'test' ELSE 'post' END AS stage FROM days)"""
WALK = """, held AS (SELECT r.date, r.asset, r.ret, (SELECT max(e.date) FROM ends e WHERE e.date < r.date) AS decided FROM rets r),
grown AS (SELECT date, asset, decided, exp(sum(ret) OVER (PARTITION BY asset, decided ORDER BY date)) AS after, exp(sum(ret) OVER (PARTITION BY asset, decided ORDER BY date) - ret) AS before FROM held),
daily AS (SELECT date, sum(after) / sum(before) - 1 AS ret FROM grown GROUP BY date),
drifted AS (SELECT date, asset, after / sum(after) OVER (PARTITION BY date) AS weight FROM grown),
turns AS (SELECT date, sum(abs(weight - 0.2)) AS turnover FROM drifted WHERE date IN (SELECT date FROM ends) GROUP BY date)"""
PAIRS = """, pairs AS (SELECT x.date, x.asset AS a, y.asset AS b, x.ret AS x, y.ret AS y FROM rets x JOIN rets y ON x.date = y.date)"""


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.derived_panel(spark, d)


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return ts.log_returns(_panel(spark, d))


def _prices(panel: DataFrame) -> DataFrame:
    """Prices are about 100, so they are compared to 6 decimals."""
    return panel.withColumn("close", F.round("close", 6)).withColumn("open", F.round("open", 6))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, walk: bool = False, pairs: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, d: _rounded(f(spark, d))
        if sql:
            ORACLES[name] = f"WITH {BASE}{WALK if walk else ''}{PAIRS if pairs else ''} {sql}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


@query("panel_ohlc", "SELECT date, asset, round(r, 9) AS r, round(co, 9) AS co, round(oc, 9) AS oc, round(close, 6) AS close, round(open, 6) AS open FROM panel")
def panel_ohlc(spark, d):
    return _prices(_panel(spark, d))


@query("panel_as_of", "SELECT date, asset, round(close, 6) AS close FROM panel WHERE date <= DATE '1996-06-30'")
def panel_as_of(spark, d):
    return pn.as_of(_prices(_panel(spark, d)), "1996-06-30").select("date", "asset", "close")


@query("panel_wide", "SELECT date, " + ", ".join(f"round(max(CASE WHEN asset = '{a}' THEN close END), 6) AS \"{a}\"" for a in ASSETS) + " FROM panel GROUP BY date")
def panel_wide(spark, d):
    return pn.wide(_prices(_panel(spark, d)), ASSETS)


@query("initial_window", "SELECT count(*) AS n FROM days WHERE date <= DATE '1997-12-31'")
def initial_window(spark, d):
    return _returns(spark, d).select("date").distinct().where("date <= DATE '1997-12-31'").agg(F.count("*").alias("n"))


@query("log_returns", "SELECT date, asset, round(ret, 9) AS ret FROM rets")
def log_returns(spark, d):
    return _returns(spark, d).select("date", "asset", "ret")


@query("overnight_intraday_returns", "SELECT date, asset, round(overnight, 9) AS overnight, round(intraday, 9) AS intraday FROM rets")
def overnight_intraday(spark, d):
    return _returns(spark, d).select("date", "asset", "overnight", "intraday")


@query("drop_one_asset", "SELECT date, asset, round(ret, 9) AS ret FROM rets WHERE asset <> 'ASIA'")
def drop_one_asset(spark, d):
    return _returns(spark, d).where("asset <> 'ASIA'").select("date", "asset", "ret")


@query("rolling_volatility", "SELECT date, asset, round(CASE WHEN count(ret) OVER w = 21 THEN stddev_samp(ret) OVER w * sqrt(252) END, 9) AS vol FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")
def rolling_volatility(spark, d):
    return ts.rolling_volatility(_returns(spark, d)).select("date", "asset", "vol")


@query("rolling_trend", "SELECT date, asset, round(CASE WHEN count(ret) OVER w = 63 THEN sum(ret) OVER w END, 9) AS trend FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)")
def rolling_trend(spark, d):
    return ts.rolling_trend(_returns(spark, d)).select("date", "asset", "trend")


CORR = "corrs AS (SELECT date, avg(c) AS avg_corr FROM (SELECT date, CASE WHEN count(*) OVER w = 63 THEN covar_pop(x, y) OVER w / nullif(stddev_pop(x) OVER w * stddev_pop(y) OVER w, 0) END AS c FROM pairs WHERE a < b WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) GROUP BY date)"
SPREAD = "spreads AS (SELECT date, CASE WHEN count(v) OVER l = 63 THEN sum(v) OVER l - sum(v) OVER s END AS spread FROM (SELECT date, max(CASE WHEN asset = 'AFRICA' THEN ret END) - max(CASE WHEN asset = 'MIDDLE EAST' THEN ret END) AS v FROM rets GROUP BY date) WINDOW l AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), s AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))"


@query("rolling_avg_correlation", f", {CORR} SELECT date, round(avg_corr, 9) AS avg_corr FROM corrs", pairs=True)
def rolling_avg_correlation(spark, d):
    return ts.rolling_correlation(_returns(spark, d))


@query("spread_trend", f", {SPREAD} SELECT date, round(spread, 9) AS spread FROM spreads")
def spread_trend(spark, d):
    return ts.spread_trend(_returns(spark, d), "AFRICA", "MIDDLE EAST")


_FEATURES = ", ".join(f"round(max(CASE WHEN asset = '{a}' THEN {v} END), 9) AS \"{a}_{v}\"" for v in ("ret", "vol", "trend") for a in ASSETS)
ORACLES_FEATURES = f""", {CORR}, {SPREAD}, f AS (SELECT date, asset, ret, CASE WHEN count(ret) OVER v = 21 THEN stddev_samp(ret) OVER v * sqrt(252) END AS vol, CASE WHEN count(ret) OVER t = 63 THEN sum(ret) OVER t END AS trend FROM rets
WINDOW v AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), t AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
w AS (SELECT date, {_FEATURES} FROM f GROUP BY date)
SELECT w.*, round(avg_corr, 9) AS avg_corr, round(spread, 9) AS spread FROM w JOIN corrs USING (date) JOIN spreads USING (date) WHERE avg_corr IS NOT NULL AND spread IS NOT NULL AND "ASIA_trend" IS NOT NULL"""


@query("feature_matrix", ORACLES_FEATURES, pairs=True)
def feature_matrix(spark, d):
    return ts.feature_matrix(_returns(spark, d), ASSETS)


@query("month_end_dates", "SELECT date FROM ends")
def month_end_dates(spark, d):
    return ts.month_ends(_returns(spark, d).select("date").distinct())


@query("last_row_of_month", "SELECT date, asset, round(ret, 9) AS ret FROM rets QUALIFY row_number() OVER (PARTITION BY asset, year(date), month(date) ORDER BY date DESC) = 1")
def last_row_of_month(spark, d):
    return ts.last_of_month(_returns(spark, d).select("date", "asset", "ret"), ["asset"])


@query("nth_rebalance", "SELECT date, k::INT AS k, k % 3 = 0 AS refit FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM ends)")
def nth_rebalance(spark, d):
    return ts.every_nth(ts.month_ends(_returns(spark, d).select("date").distinct()), 3)


@query("stage_labels", "SELECT date, stage FROM stages")
def stage_labels(spark, d):
    return _returns(spark, d).select("date").distinct().select("date", ts.stage_label(BOUNDS).alias("stage"))


@query("stage_counts", "SELECT stage, coalesce(n, 0) AS n FROM (VALUES ('train'), ('validation'), ('test'), ('post')) AS s(stage) LEFT JOIN (SELECT stage, count(*) AS n FROM stages GROUP BY stage) USING (stage)")
def stage_counts(spark, d):
    return ts.stage_counts(_returns(spark, d).select("date").distinct(), BOUNDS)


YIELDS = "yields AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date, CASE WHEN month(o_orderdate) <> 7 THEN avg(o_totalprice) / 50000 END AS y FROM orders GROUP BY 1, month(o_orderdate))"


@query("asof_prior_yield", f", {YIELDS} SELECT d.date, round(q.y, 9) AS yield_pct, round(pow(1 + q.y / 100, 1.0 / 252) - 1, 9) AS rf_daily FROM days d ASOF LEFT JOIN (SELECT * FROM yields WHERE y IS NOT NULL) q ON d.date > q.obs_date")
def asof_prior_yield(spark, d):
    out = jo.as_of_prior(_returns(spark, d).select("date").distinct(), pn.risk_free(spark, d), "date", "obs_date", "yield_pct")
    return out.withColumn("rf_daily", pn.daily_rate(F.col("yield_pct")))


@query("carry_forward", ", t AS (SELECT date, turnover FROM turns), c AS (SELECT d.date, last_value(turnover IGNORE NULLS) OVER (ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turnover FROM days d LEFT JOIN t USING (date)) SELECT date, round(turnover, 9) AS turnover FROM c", walk=True)
def carry_forward(spark, d):
    r = _returns(spark, d)
    return jo.carry_forward(r.select("date").distinct(), ew.walk(r)[1], "turnover")


@query("strict_alignment_gaps", f", {YIELDS} SELECT d.date, 'missing' AS problem FROM days d WHERE NOT EXISTS (SELECT 1 FROM yields y WHERE y.obs_date = d.date)")
def strict_alignment_gaps(spark, d):
    return jo.strict_gaps(_returns(spark, d).select("date").distinct(), pn.risk_free(spark, d).withColumnRenamed("obs_date", "date"), ["date"])


@query("key_set_diff", ", o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) (SELECT date, 'a' AS side FROM days EXCEPT SELECT date, 'a' FROM o) UNION ALL (SELECT date, 'b' AS side FROM o EXCEPT SELECT date, 'b' FROM days)")
def key_set_diff(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("date")).distinct()
    return jo.key_difference(_returns(spark, d).select("date").distinct(), o, ["date"])


@query("semi_join_decisions", "SELECT date, round(turnover, 9) AS turnover FROM turns WHERE date IN (SELECT date FROM stages WHERE stage = 'test')", walk=True)
def semi_join_decisions(spark, d):
    r = _returns(spark, d)
    test = r.select("date").distinct().where(ts.stage_label(BOUNDS) == "test")
    return ew.walk(r)[1].join(test, "date", "left_semi")


@query("outer_merge_sides", ", o AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT date, count(*) AS n FROM rets GROUP BY 1) SELECT date, l.n AS n_x, o.n AS n_y, CASE WHEN l.n IS NULL THEN 'right_only' WHEN o.n IS NULL THEN 'left_only' ELSE 'both' END AS side FROM l FULL JOIN o USING (date)")
def outer_merge_sides(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    return jo.one_to_one_outer(_returns(spark, d).groupBy("date").agg(F.count("*").alias("n")), o, ["date"])


BUDGET = ", raw AS (SELECT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS date, l_linenumber AS seed, r_name AS asset, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), budgets AS (SELECT date, seed, asset, q / sum(q) OVER (PARTITION BY date, seed) AS budget FROM raw)"


def _budgets(spark, d) -> DataFrame:
    """Shares of quantity by region, month and line number: budget vectors of several seeds."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    where = read("supplier").join(F.broadcast(read("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("asset"))
    q = read("lineitem").groupBy("l_suppkey", F.to_date(F.trunc("l_shipdate", "month")).alias("date"), F.col("l_linenumber").alias("seed")).agg(F.sum("l_quantity").alias("q"))
    q = q.join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("date", "seed", "asset").agg(F.sum("q").alias("q"))
    return q.select("date", "seed", "asset", (F.col("q") / F.sum("q").over(Window.partitionBy("date", "seed"))).alias("budget"))


@query("pairwise_l1", BUDGET + " SELECT x.date, x.seed AS a, y.seed AS b, round(sum(abs(x.budget - y.budget)), 9) AS distance FROM budgets x JOIN budgets y ON x.date = y.date AND x.asset = y.asset AND x.seed < y.seed GROUP BY ALL")
def pairwise_l1(spark, d):
    return oa.pairwise_l1(_budgets(spark, d), ["date"], "seed", "asset", "budget")


@query("dominant_agreement", BUDGET + ", top AS (SELECT date, seed, asset FROM budgets QUALIFY row_number() OVER (PARTITION BY date, seed ORDER BY budget DESC, asset) = 1), n AS (SELECT date, asset, count(*) AS n FROM top GROUP BY ALL) SELECT date, round(max(n) / sum(n), 9) AS agreement FROM n GROUP BY date")
def dominant_agreement(spark, d):
    return oa.dominant_agreement(_budgets(spark, d), ["date"], "seed", "asset", "budget")


@query("dispersion_summary", BUDGET + ", s AS (SELECT asset, date, stddev_samp(budget) AS sd FROM budgets GROUP BY ALL) SELECT asset, round(avg(sd), 9) AS mean_sd, max_by(date, struct_pack(sd := sd, date := date)) AS widest FROM s WHERE sd IS NOT NULL GROUP BY asset")
def dispersion_summary(spark, d):
    return ev.mean_of_deviations(_budgets(spark, d), ["asset"], ["date"], "budget")


@query("floor_concentration", BUDGET + " SELECT asset, round(avg(CASE WHEN budget <= 0.15 + 1e-4 THEN 1 ELSE 0 END), 9) AS share FROM budgets GROUP BY asset")
def floor_concentration(spark, d):
    return ev.shares_at(_budgets(spark, d), ["asset"], "budget", 0.15)


@query("seed_distribution", BUDGET + " SELECT asset, count(*) AS n, round(avg(budget), 9) AS mean, round(quantile_cont(budget, 0.5), 9) AS median, round(quantile_cont(budget, 0.25), 9) AS q25, round(quantile_cont(budget, 0.75), 9) AS q75, round(min(budget), 9) AS min, round(max(budget), 9) AS max, count(*) FILTER (budget > 0) AS positive, count(*) FILTER (budget < 0) AS negative, count(*) FILTER (budget <= 0.2) + 1 AS control_rank FROM budgets GROUP BY asset")
def seed_distribution(spark, d):
    return ev.distribution(_budgets(spark, d), ["asset"], "budget", 0.2)


@query("paired_t", BUDGET + ", e AS (SELECT seed, date, max(CASE WHEN asset = 'ASIA' THEN budget END) - max(CASE WHEN asset = 'EUROPE' THEN budget END) AS v FROM budgets GROUP BY ALL) SELECT seed, count(v) AS n, round(avg(v), 9) AS mean_diff, round(stddev_samp(v) / sqrt(count(v)), 9) AS se, round(avg(v) / (stddev_samp(v) / sqrt(count(v))), 9) AS t FROM e GROUP BY seed")
def paired_t(spark, d):
    return ev.paired_t(_budgets(spark, d), ["seed"], "date", "asset", "budget", ("ASIA", "EUROPE"))


@query("seed_pivot", BUDGET + " SELECT asset, " + ", ".join(f"round(avg(budget) FILTER (seed = {s}), 9) AS \"{s}\"" for s in (1, 2, 3, 4)) + " FROM budgets GROUP BY asset")
def seed_pivot(spark, d):
    return _budgets(spark, d).groupBy("asset").pivot("seed", [1, 2, 3, 4]).agg(F.avg("budget"))


@query("seed_average", BUDGET + " SELECT date, asset, round(avg(budget), 9) AS budget FROM budgets GROUP BY ALL")
def seed_average(spark, d):
    return _budgets(spark, d).groupBy("date", "asset").agg(F.avg("budget").alias("budget"))


@query("largest_difference", BUDGET + " SELECT round(max(abs(x.budget - y.budget)), 9) AS max_diff FROM budgets x JOIN budgets y USING (date, asset) WHERE x.seed = 1 AND y.seed = 2")
def largest_difference(spark, d):
    b = _budgets(spark, d)
    return ev.largest_difference(b.where("seed = 1"), b.where("seed = 2"), ["date", "asset"], "budget")


@query("effect_contrasts", BUDGET + ", e AS (SELECT date, asset, avg(budget) AS b FROM budgets GROUP BY ALL) SELECT date, round(max(CASE WHEN asset = 'ASIA' THEN b END) - max(CASE WHEN asset = 'EUROPE' THEN b END), 9) AS asia_europe, round(max(CASE WHEN asset = 'AFRICA' THEN b END) - max(CASE WHEN asset = 'AMERICA' THEN b END), 9) AS africa_america FROM e GROUP BY date")
def effect_contrasts(spark, d):
    e = _budgets(spark, d).groupBy("date", "asset").agg(F.avg("budget").alias("b"))
    return ev.effects(e, ["date"], "asset", "b", {"asia_europe": ("ASIA", "EUROPE"), "africa_america": ("AFRICA", "AMERICA")})


@query("interval_flags", BUDGET + " SELECT asset, round(quantile_cont(budget - 0.2, 0.025), 9) AS low, round(quantile_cont(budget - 0.2, 0.975), 9) AS high, quantile_cont(budget - 0.2, 0.025) > 0 OR quantile_cont(budget - 0.2, 0.975) < 0 AS excludes_zero FROM budgets GROUP BY asset")
def interval_flags(spark, d):
    v = F.col("budget") - 0.2
    return _budgets(spark, d).groupBy("asset").agg(F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high")).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


@query("bounded_softmax", BUDGET + """, z AS (SELECT date, seed, asset, 10 * budget AS logit FROM budgets), s AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY date, seed)) AS e, count(*) OVER (PARTITION BY date, seed) AS n, row_number() OVER (PARTITION BY date, seed ORDER BY logit DESC, asset) AS k FROM z),
c AS (SELECT *, sum(e) OVER (PARTITION BY date, seed ORDER BY k) AS c FROM s), b AS (SELECT date, seed, max(k) AS best FROM c WHERE (1 - (n - k) * 0.1) * e / c >= 0.1 GROUP BY ALL),
t AS (SELECT c.date, c.seed, c.c AS total, best FROM c JOIN b ON c.date = b.date AND c.seed = b.seed AND c.k = b.best)
SELECT date, seed, asset, round(CASE WHEN k <= best THEN (1 - (n - best) * 0.1) * e / total ELSE 0.1 END, 9) AS budget FROM c JOIN t USING (date, seed)""")
def bounded_softmax(spark, d):
    z = _budgets(spark, d).select("date", "seed", "asset", (10 * F.col("budget")).alias("logit"))
    return oa.bounded_softmax(z, ["date", "seed"], 0.1).select("date", "seed", "asset", "budget")


@query("covariance_long", "SELECT a AS i, b AS j, round(1e4 * covar_samp(x, y), 9) AS cov FROM pairs GROUP BY ALL", pairs=True)
def covariance_long(spark, d):
    return oa.covariance(_returns(spark, d)).withColumn("cov", 1e4 * F.col("cov"))


@query("weighted_covariance", ", w AS (SELECT date, 1.0 / (1 + day(date)) AS w FROM days) SELECT a AS i, b AS j, round(1e4 * sum(w * x) / sum(w), 9) AS mean_i, round(1e4 * (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)), 9) AS cov FROM pairs JOIN w USING (date) GROUP BY ALL", pairs=True)
def weighted_covariance(spark, d):
    r = _returns(spark, d)
    w = r.select("date").distinct().withColumn("w", 1.0 / (1 + F.dayofmonth("date")))
    return oa.weighted_covariance(r, w).withColumn("cov", 1e4 * F.col("cov")).withColumn("mean_i", 1e4 * F.col("mean_i"))


COV = ", cov AS (SELECT a AS i, b AS j, covar_samp(x, y) AS c FROM pairs GROUP BY ALL)"


@query("shrunk_covariance", COV + " SELECT i, j, round(1e4 * (0.9 * c + CASE WHEN i = j THEN 0.1 * (SELECT avg(c) FROM cov WHERE i = j) ELSE 0 END), 9) AS cov FROM cov", pairs=True)
def shrunk_covariance(spark, d):
    return oa.shrunk(oa.covariance(_returns(spark, d))).withColumn("cov", 1e4 * F.col("cov"))


@query("risk_shares", COV + ", m AS (SELECT i, sum(0.2 * c) AS m FROM cov GROUP BY i) SELECT i AS asset, 0.2 AS weight, round(0.2 * m / sum(0.2 * m) OVER (), 9) AS share FROM m", pairs=True)
def risk_shares(spark, d):
    r = _returns(spark, d)
    return oa.risk_shares(oa.covariance(r), r.select("asset").distinct().withColumn("weight", F.lit(0.2)))


@query("correlation_distance", COV + " SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE sqrt(greatest(0, 0.5 * (1 - c / sqrt(vi * vj)))) END, 9) AS distance FROM cov JOIN (SELECT i, c AS vi FROM cov WHERE i = j) USING (i) JOIN (SELECT j, c AS vj FROM cov WHERE i = j) USING (j)", pairs=True)
def correlation_distance(spark, d):
    return oa.correlation_distance(oa.covariance(_returns(spark, d)))


@query("mixture_covariance", ", h AS (SELECT date, CAST(month(date) % 2 AS INT) AS state FROM days), sc AS (SELECT state, a AS i, b AS j, covar_samp(x, y) AS c FROM pairs JOIN h USING (date) GROUP BY ALL), p AS (SELECT date, 0 AS state, day(date) / 31 AS prob FROM ends UNION ALL SELECT date, 1, 1 - day(date) / 31 FROM ends) SELECT date, i, j, round(1e4 * sum(prob * c), 9) AS cov FROM p JOIN sc USING (state) GROUP BY ALL", pairs=True)
def mixture_covariance(spark, d):
    r = _returns(spark, d)
    both = oa.products(oa.vectors(r), ["date"]).groupBy((F.month("date") % 2).alias("state"), "i", "j").agg(F.covar_samp("x", "y").alias("cov"))
    p = ts.month_ends(r.select("date").distinct()).select("date", F.explode(F.array(F.struct(F.lit(0).alias("state"), (F.dayofmonth("date") / 31).alias("prob")), F.struct(F.lit(1).alias("state"), (1 - F.dayofmonth("date") / 31).alias("prob")))).alias("p")).select("date", "p.*")
    return oa.mixture(both, p).withColumn("cov", 1e4 * F.col("cov"))


@query("equal_weight_walk", "SELECT date, stage, round(ret, 9) AS ret FROM daily JOIN stages USING (date)", walk=True)
def equal_weight_walk(spark, d):
    return ew.walk(_returns(spark, d))[0].withColumn("stage", ts.stage_label(BOUNDS))


@query("drifted_weights", "SELECT date, asset, round(weight, 9) AS weight FROM drifted", walk=True)
def drifted_weights(spark, d):
    return ew.drifted(_returns(spark, d))


@query("turnover_by_decision", "SELECT date, round(turnover, 9) AS turnover FROM turns", walk=True)
def turnover_by_decision(spark, d):
    return ew.walk(_returns(spark, d))[1]


@query("turnover_within_cap", "SELECT count(*) AS n, count(*) FILTER (turnover > 0.3) AS above FROM turns", walk=True)
def turnover_within_cap(spark, d):
    return ew.walk(_returns(spark, d))[1].agg(F.count("*").alias("n"), F.count_if(F.col("turnover") > 0.3).alias("above"))


NET = ", net AS (SELECT date, stage, d.ret, (1 + d.ret) * (1 - 0.0005 * coalesce(turnover, 0)) - 1 AS net FROM daily d JOIN stages USING (date) LEFT JOIN turns USING (date))"


def _net(spark, d) -> DataFrame:
    gross, turns = ew.walk(_returns(spark, d))
    return ev.net_returns(gross, turns, [], 5.0).withColumn("stage", ts.stage_label(BOUNDS))


@query("net_returns_fees", NET + " SELECT date, stage, round(ret, 9) AS ret, round(net, 9) AS net FROM net", walk=True)
def net_returns_fees(spark, d):
    return _net(spark, d)


@query("transaction_log", "SELECT date, round(turnover, 9) AS turnover, 5.0 AS fee_bps, round(0.0005 * turnover, 9) AS cost_as_fraction_of_nav FROM turns", walk=True)
def transaction_log(spark, d):
    return ew.walk(_returns(spark, d))[1].select("date", "turnover", F.lit(5.0).alias("fee_bps"), (0.0005 * F.col("turnover")).alias("cost_as_fraction_of_nav"))


@query("sharpe", NET + " SELECT stage, round(avg(net) / stddev_samp(net) * sqrt(252), 9) AS sharpe FROM net GROUP BY stage", walk=True)
def sharpe(spark, d):
    return _net(spark, d).groupBy("stage").agg(ev.sharpe(F.col("net")).alias("sharpe"))


def daily_rates(spark, d, days: DataFrame) -> DataFrame:
    """date, rf_daily of the days; 0 before the first yield. Stored, so a query reads orders once."""
    return io.staged(pn.risk_free_daily(days, pn.risk_free(spark, d), strict=False).select("date", "rf_daily"), "rates")


@query("excess_sharpe", NET + f", {YIELDS}, x AS (SELECT n.stage, n.net - pow(1 + coalesce(q.y, 0) / 100, 1.0 / 252) + 1 AS e FROM net n ASOF LEFT JOIN (SELECT * FROM yields WHERE y IS NOT NULL) q ON n.date > q.obs_date) SELECT stage, round(avg(e) / stddev_samp(e) * sqrt(252), 9) AS sharpe FROM x GROUP BY stage", walk=True)
def excess_sharpe(spark, d):
    net = _net(spark, d)
    rated = net.join(daily_rates(spark, d, net), "date")
    return rated.groupBy("stage").agg(ev.sharpe(F.col("net") - F.col("rf_daily")).alias("sharpe"))


@query("cagr", NET + " SELECT stage, round(exp(sum(ln(1 + net)) * 252 / count(*)) - 1, 9) AS cagr FROM net GROUP BY stage", walk=True)
def cagr(spark, d):
    return _net(spark, d).groupBy("stage").agg(ev.cagr(F.col("net")).alias("cagr"))


DRAWDOWN = ", wealth AS (SELECT stage, date, exp(sum(ln(1 + net)) OVER (PARTITION BY stage ORDER BY date)) AS v FROM net), dd AS (SELECT stage, min(g) AS max_drawdown FROM (SELECT stage, v / max(v) OVER (PARTITION BY stage ORDER BY date) - 1 AS g FROM wealth) GROUP BY stage)"


@query("max_drawdown", NET + DRAWDOWN + " SELECT stage, round(max_drawdown, 9) AS max_drawdown FROM dd", walk=True)
def max_drawdown(spark, d):
    return ts.drawdown(_net(spark, d), ["stage"], "net")


@query("performance_by_stage", NET + DRAWDOWN + """, p AS (SELECT stage, count(*) AS n_days, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, exp(sum(ln(1 + net)) * 252 / count(*)) - 1 AS cagr, CASE WHEN count(*) FILTER (net < -1e-12) >= 2 THEN avg(net) / stddev_samp(net) FILTER (net < -1e-12) * sqrt(252) END AS sortino FROM net GROUP BY stage)
SELECT stage, n_days, round(sharpe, 9) AS sharpe, round(cagr, 9) AS cagr, round(sortino, 9) AS sortino, round(max_drawdown, 9) AS max_drawdown, round(CASE WHEN max_drawdown <> 0 THEN cagr / abs(max_drawdown) END, 9) AS calmar FROM p JOIN dd USING (stage)""", walk=True)
def performance_by_stage(spark, d):
    return ev.performance(_net(spark, d), ["stage"], "net")


@query("herfindahl", "SELECT stage, round(avg(h), 9) AS hhi FROM (SELECT date, sum(weight * weight) AS h FROM drifted GROUP BY date) JOIN stages USING (date) GROUP BY stage", walk=True)
def herfindahl(spark, d):
    return ev.herfindahl(ew.drifted(_returns(spark, d)).withColumn("stage", ts.stage_label(BOUNDS)), ["stage"])


@query("mean_turnover", "SELECT round(avg(turnover), 9) AS mean_turnover FROM turns WHERE date IN (SELECT date FROM stages WHERE stage = 'test')", walk=True)
def mean_turnover(spark, d):
    r = _returns(spark, d)
    return ev.mean_turnover(ew.walk(r)[1], [], r.select("date").distinct().where(ts.stage_label(BOUNDS) == "test"))


@query("cost_sensitivity", ", f AS (SELECT stage, fee_bps, (1 + ret) * (1 - fee_bps / 1e4 * coalesce(turnover, 0)) - 1 AS r FROM daily JOIN stages USING (date) LEFT JOIN turns USING (date) CROSS JOIN (VALUES (5.0::DOUBLE), (10.0), (25.0)) AS x(fee_bps)) SELECT stage, fee_bps, round(avg(r) / stddev_samp(r) * sqrt(252), 9) AS sharpe_net, round(exp(sum(ln(1 + r)) * 252 / count(*)) - 1, 9) AS cagr_net FROM f GROUP BY ALL", walk=True)
def cost_sensitivity(spark, d):
    gross, turns = ew.walk(_returns(spark, d))
    rows = gross.withColumn("stage", ts.stage_label(BOUNDS))
    return ev.cost_sensitivity(rows, turns.withColumn("stage", ts.stage_label(BOUNDS)), ["stage"], FEES)


@query("moments", "SELECT asset, round(avg(power(ret - m, 3)) / power(avg(power(ret - m, 2)), 1.5), 9) AS skew, round(avg(power(ret - m, 4)) / power(avg(power(ret - m, 2)), 2), 9) AS kurt FROM (SELECT asset, ret, avg(ret) OVER (PARTITION BY asset) AS m FROM rets) GROUP BY asset")
def moments(spark, d):
    return _returns(spark, d).groupBy("asset").agg(*ev.moments(F.col("ret")))


@query("series_correlation", "SELECT round(corr(x, y), 9) AS corr FROM pairs WHERE a = 'ASIA' AND b = 'EUROPE'", pairs=True)
def series_correlation(spark, d):
    return ts.pairs(_returns(spark, d)).where("a = 'ASIA' AND b = 'EUROPE'").agg(F.corr("x", "y").alias("corr"))


@query("autocovariance", ", c AS (SELECT asset, ret - avg(ret) OVER (PARTITION BY asset) AS x, row_number() OVER (PARTITION BY asset ORDER BY date) AS k, count(*) OVER (PARTITION BY asset) AS n FROM rets) SELECT p.asset, CAST(p.k - q.k AS INT) AS lag, round(1e6 * sum(p.x * q.x) / max(p.n), 9) AS acov FROM c p JOIN c q ON p.asset = q.asset AND q.k BETWEEN p.k - 10 AND p.k GROUP BY ALL")
def autocovariance(spark, d):
    return ts.autocovariance(_returns(spark, d), ["asset"], "ret", 10).withColumn("acov", 1e6 * F.col("acov"))


SCORES = """, z AS (SELECT date, asset, (ret - avg(ret) OVER w) / stddev_pop(ret) OVER w AS z FROM rets WINDOW w AS (PARTITION BY asset)), ls AS (SELECT date, sum(-0.5 * z * z) AS l0, sum(-0.4 * z * z - 0.05) AS l1 FROM z GROUP BY date)"""


def _scores(spark, d) -> DataFrame:
    """Two log scores of each day: unit normals against slightly wider, penalised ones."""
    w = Window.partitionBy("asset")
    z = _returns(spark, d).withColumn("z", (F.col("ret") - F.avg("ret").over(w)) / F.stddev_pop("ret").over(w))
    return z.groupBy("date").agg(F.sum(-0.5 * F.col("z") ** 2).alias("l0"), F.sum(-0.4 * F.col("z") ** 2 - 0.05).alias("l1"))


@query("standardised_residuals", SCORES + " SELECT date, asset, round(z, 9) AS z FROM z")
def standardised_residuals(spark, d):
    w = Window.partitionBy("asset")
    return _returns(spark, d).select("date", "asset", ((F.col("ret") - F.avg("ret").over(w)) / F.stddev_pop("ret").over(w)).alias("z"))


_RECURSIVE = f"WITH RECURSIVE {BASE}{SCORES}, o AS (SELECT date, l0, l1, l1 - l0 AS d, row_number() OVER (ORDER BY date) AS k FROM ls)"


@query("reliability_path", _RECURSIVE + f", p AS (SELECT k, date, 0.0::DOUBLE AS b, greatest(-{re.LIMIT!r}, least({re.LIMIT!r}, d))::DOUBLE AS l FROM o WHERE k = 1 UNION ALL SELECT o.k, o.date, p.l, greatest(-{re.LIMIT!r}, least({re.LIMIT!r}, 0.97 * p.l + o.d))::DOUBLE FROM p JOIN o ON o.k = p.k + 1) SELECT date, round(1 / (1 + exp(-b)), 9) AS pi_before, round(1 / (1 + exp(-l)), 9) AS pi FROM p")
def reliability_path(spark, d):
    return re.path(_scores(spark, d).withColumn("scenario", F.lit(0)), ["scenario"], 0.97).drop("scenario")


@query("alpha_selection", _RECURSIVE + f", c AS (SELECT unnest([0.9, 0.95, 0.97, 0.99])::DOUBLE AS alpha), p AS (SELECT alpha, k, 0.0::DOUBLE AS b, greatest(-{re.LIMIT!r}, least({re.LIMIT!r}, d))::DOUBLE AS l FROM o, c WHERE k = 1 UNION ALL SELECT alpha, o.k, p.l, greatest(-{re.LIMIT!r}, least({re.LIMIT!r}, alpha * p.l + o.d))::DOUBLE FROM p JOIN o ON o.k = p.k + 1) SELECT alpha, round(sum(greatest(l0, l1) + ln(exp(l1 - greatest(l0, l1)) / (1 + exp(-b)) + exp(l0 - greatest(l0, l1)) * (1 - 1 / (1 + exp(-b))))), 4) AS score FROM p JOIN o USING (k) GROUP BY alpha")
def alpha_selection(spark, d):
    return re.choose_alpha(_scores(spark, d), [0.9, 0.95, 0.97, 0.99]).withColumn("score", F.round("score", 4))


@query("nu_grid", SCORES + " SELECT nu, round(sum(lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - (nu + 1) / 2 * ln(1 + z * z / nu)), 4) AS loglik FROM z, (SELECT unnest([3.0, 4.0, 5.0, 8.0, 12.0, 20.0, 30.0])::DOUBLE AS nu) GROUP BY nu")
def nu_grid(spark, d):
    return re.student_nu(standardised_residuals(spark, d), [3.0, 4.0, 5.0, 8.0, 12.0, 20.0, 30.0]).withColumn("loglik", F.round("loglik", 4))


@query("ewma_blend", _RECURSIVE.replace(SCORES, WALK + ", ls AS (SELECT date, turnover AS l0, turnover AS l1 FROM turns)") + ", p AS (SELECT k, date, l0 AS v FROM o WHERE k = 1 UNION ALL SELECT o.k, o.date, 0.8 * p.v + 0.2 * o.l0 FROM p JOIN o ON o.k = p.k + 1) SELECT date, round(v, 9) AS blended FROM p")
def ewma_blend(spark, d):
    return ts.ewma_fold(ew.walk(_returns(spark, d))[1].withColumn("scenario", F.lit(0)), ["scenario"], "turnover", 0.8).drop("scenario")


@query("blended_weights", ", t AS (SELECT date, asset, weight, day(date) / 31 AS pi FROM drifted JOIN ends USING (date)) SELECT date, asset, round(pi * weight + (1 - pi) * 0.2, 9) AS weight FROM t", walk=True)
def blended_weights(spark, d):
    r = _returns(spark, d)
    w, ends = ew.drifted(r), ts.month_ends(r.select("date").distinct())
    return re.blend(w.withColumn("weight", F.lit(0.2)), w, ends.withColumn("pi", F.dayofmonth("date") / 31), ["date"])


@query("binding_report", ", t AS (SELECT date, asset, weight FROM drifted JOIN ends USING (date)) SELECT date, round(sum(abs(0.2 - weight)), 9) AS turnover, sum(abs(0.2 - weight)) >= 0.3 - 1e-6 AS turnover_binding, '' AS lower_binding, string_agg(asset, ',' ORDER BY asset) AS upper_binding FROM t GROUP BY date", walk=True)
def binding_report(spark, d):
    r = _returns(spark, d)
    w = ew.drifted(r).join(ts.month_ends(r.select("date").distinct()), "date", "left_semi")
    return oa.binding(w.withColumn("weight", F.lit(0.2)), w, ["date"], upper=0.2)


@query("attribution", ", t AS (SELECT asset, (g.weight - 0.2) * (exp(r.ret) - 1) AS c FROM drifted g JOIN rets r USING (date, asset)) SELECT asset, round(sum(c), 9) AS contribution FROM t GROUP BY asset", walk=True)
def attribution(spark, d):
    r = _returns(spark, d)
    w = ew.drifted(r)
    return ev.attribution(w, w.withColumn("weight", F.lit(0.2)), r.select("date", "asset", "ret"))


@query("opening_turnover", ", x AS (SELECT date, asset, lead(date) OVER (PARTITION BY asset ORDER BY date) AS opened, lead(overnight) OVER (PARTITION BY asset ORDER BY date) AS co FROM rets), w AS (SELECT x.opened AS date, x.asset, g.weight * exp(x.co) AS v FROM x JOIN ends e ON x.date = e.date JOIN drifted g ON g.date = x.date AND g.asset = x.asset WHERE opened IS NOT NULL), n AS (SELECT date, v / sum(v) OVER (PARTITION BY date) AS w FROM w) SELECT date, round(sum(abs(0.2 - w)), 9) AS opening_turnover FROM n GROUP BY date", walk=True)
def opening_turnover(spark, d):
    r = _returns(spark, d)
    nxt = r.select("asset", "date", F.lead("date").over(ts.per_asset()).alias("opened"), F.lead("overnight").over(ts.per_asset()).alias("co")).join(ts.month_ends(r.select("date").distinct()), "date", "left_semi")
    at = ew.drifted(r).join(nxt, ["date", "asset"]).where("opened is not null").select(F.col("opened").alias("date"), "asset", (F.col("weight") * F.exp("co")).alias("v"))
    share = at.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("date")))
    return share.groupBy("date").agg(F.sum(F.abs(0.2 - F.col("w"))).alias("opening_turnover"))


@query("forward_gross_returns", ", f AS (SELECT asset, ret, (SELECT max(e.date) FROM ends e WHERE e.date < r.date) AS decided FROM rets r) SELECT decided, asset, round(exp(sum(ret)), 9) AS gross FROM f WHERE decided IS NOT NULL GROUP BY ALL")
def forward_gross_returns(spark, d):
    r = _returns(spark, d)
    of = jo.periods(r.select("date").distinct(), ts.month_ends(r.select("date").distinct()))
    return r.join(of, "date").groupBy("decided", "asset").agg(F.exp(F.sum("ret")).alias("gross"))


@query("rebalance_pairs", "SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM ends")
def rebalance_pairs(spark, d):
    return ts.month_ends(_returns(spark, d).select("date").distinct()).select("date", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("next_date"))


@query("rule_variances", BUDGET + " SELECT round(var_samp(budget), 9) AS every_seed, round(var_samp(budget) FILTER (seed <> 1), 9) AS without_first, round(var_samp(budget) FILTER (asset IN ('ASIA', 'EUROPE')), 9) AS two_assets FROM budgets")
def rule_variances(spark, d):
    return ev.rule_variances(_budgets(spark, d), "budget", {"every_seed": F.lit(True), "without_first": F.col("seed") != 1, "two_assets": F.col("asset").isin("ASIA", "EUROPE")})


@query("family_variances", BUDGET + " SELECT seed, count(*) AS n, round(var_samp(budget), 9) AS variance FROM budgets GROUP BY seed HAVING count(*) > 1")
def family_variances(spark, d):
    return ev.family_variances(_budgets(spark, d), "seed", "budget")


@query("trial_counts", "WITH t AS (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS n FROM t WHERE lower(trim(event_type)) <> 'view' GROUP BY event_type")
def trial_counts(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("lower(trim(event_type)) <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))


def _scenarios(spark, d, options: dict[str, wf.Options]) -> DataFrame:
    r = _returns(spark, d)
    return r.withColumn("scenario", F.explode(F.array(*map(F.lit, options)))).repartition(len(options), "scenario")


_LIMITS = al.Limits(0.0, 0.30, 0.30)


@query("walk_forward_full")
def walk_forward_full(spark, d):
    options = {"three_states": wf.Options(initial_window=1000, limits=_LIMITS, include_hrp=True), "two_states": wf.Options(n_states=2, initial_window=1000, limits=_LIMITS)}
    out = wf.run(_scenarios(spark, d, options), options, "returns")
    return ev.performance(out, ["scenario", "config"])


@query("walk_forward_decisions")
def walk_forward_decisions(spark, d):
    options = {"close": wf.Options(n_states=2, initial_window=1500, limits=_LIMITS)}
    return wf.run(_scenarios(spark, d, options), options, "decisions", next_open=False)


def _lstm_returns(spark, d) -> DataFrame:
    r = _returns(spark, d)
    return jo.with_features(r, ts.feature_matrix(r, ASSETS))


@query("lstm_walk")
def lstm_walk(spark, d):
    """Two networks trained for 200 epochs on the feature matrix of the first 800 days, then walked."""
    options = wf.Options(n_states=2, initial_window=800, limits=_LIMITS, lstm_epochs=200)
    rows = st.scenario_rows(_lstm_returns(spark, d), {"lstm": None})
    return ev.performance(wf.run(rows, {"lstm": options}, "returns"), ["scenario", "config"])


def _walked(spark, d, scenarios: dict[str, wf.Options]) -> tuple[DataFrame, DataFrame]:
    """(all tables of the trained walks; daily returns with net and excess ones and their stage)."""
    r = _lstm_returns(spark, d)
    tables = io.staged(wf.run_all(st.scenario_rows(r, dict.fromkeys(scenarios)), scenarios), "walks")
    daily = st.net_excess(wf.table(tables, "returns"), wf.table(tables, "executions"), daily_rates(spark, d, r), ["scenario", "config"])
    return tables, daily.withColumn("stage", ts.stage_label(BOUNDS))


@query("study_contrasts")
def study_contrasts(spark, d):
    """The five contrasts of the trained walk on excess net returns of the test stage, 2,000 draws each."""
    _, daily = _walked(spark, d, {"lstm": wf.Options(n_states=2, initial_window=800, limits=_LIMITS, lstm_epochs=200)})
    return st.contrasts(daily.where("stage = 'test'"), value="excess")


@query("primary_run")
def primary_run(spark, d):
    """The primary walk, three states and both networks: each stage's measures after fees, turnover, concentration and binding decisions."""
    tables, daily = _walked(spark, d, {"primary": wf.Options(initial_window=800, limits=_LIMITS, lstm_epochs=200)})
    return st.stage_tables(tables, daily, ts.stage_label(BOUNDS))


@query("refit_cadence")
def refit_cadence(spark, d):
    """Performance of the refit arms up to the validation stage's end; later days are never read into the walk."""
    arms = st.refit_arms(wf.Options(n_states=2, initial_window=1000, limits=_LIMITS))
    rows = st.scenario_rows(_returns(spark, d), dict.fromkeys(arms), last_day=BOUNDS[1][1])
    return ev.performance(wf.run(rows, arms, "returns"), ["scenario", "config"])


@query("robustness_specs")
def robustness_specs(spark, d):
    """Performance of the robustness scenarios; each is one task."""
    specs = st.robustness(wf.Options(initial_window=1000, limits=_LIMITS), ["AFRICA", "ASIA"])
    rows = st.scenario_rows(_returns(spark, d), {k: dropped for k, (_, dropped) in specs.items()})
    return ev.performance(wf.run(rows, {k: o for k, (o, _) in specs.items()}, "returns"), ["scenario", "config"])


@query("retraining_difference")
def retraining_difference(spark, d):
    """Quarterly less fixed training: difference of Sharpe ratios of excess net returns and its interval, by stage and network."""
    arms = st.retraining_arms(wf.Options(n_states=2, initial_window=800, limits=_LIMITS, lstm_epochs=200))
    _, daily = _walked(spark, d, arms)
    daily = daily.where(F.col("config").startswith("lstm")).withColumnsRenamed({"scenario": "arm", "config": "network"})
    return st.arm_difference(daily, ("quarterly", "fixed"), ["stage", "network"])


@query("feature_rows", """, v AS (SELECT date, count(*) AS n_assets, sum(ret) AS s FROM rets GROUP BY date) SELECT date, n_assets, round(s, 9) AS total, n_assets * 3 + 2 AS n_features FROM v
  WHERE date >= (SELECT date FROM v ORDER BY date LIMIT 1 OFFSET 62)""")
def feature_rows(spark, d):
    """Days with a whole feature row: number of features and sum of the returns among them."""
    r = _lstm_returns(spark, d).where("features IS NOT NULL")
    return r.groupBy("date").agg(F.count("*").alias("n_assets"), F.sum("ret").alias("total"), F.max(F.size("features")).alias("n_features"))


@query("search_scenarios", BUDGET + """ SELECT 'variance' AS kind, 'pooled_every_seed' AS name, round(var_samp(budget), 9) AS value FROM budgets
  UNION ALL SELECT 'variance', 'pooled_without_first', round(var_samp(budget) FILTER (seed <> 1), 9) FROM budgets
  UNION ALL SELECT 'variance', 'pooled_two_assets', round(var_samp(budget) FILTER (asset IN ('ASIA', 'EUROPE')), 9) FROM budgets
  UNION ALL SELECT 'variance', 'family_' || CAST(seed AS VARCHAR), round(var_samp(budget), 9) FROM budgets GROUP BY seed HAVING count(*) > 1
  UNION ALL SELECT 'variance', 'conventional_unit_variance', 1.0 UNION ALL SELECT 'trials', 'deduped_candidate_count', count(budget) FROM budgets
  UNION ALL SELECT 'trials', 'coherent_search_families', count(DISTINCT seed) FROM budgets UNION ALL SELECT 'trials', 'literal_logged_trials', 9""")
def search_scenarios(spark, d):
    return st.search_scenarios(_budgets(spark, d), "seed", "budget", _search_rules(), logged=9)


def _search_rules() -> dict[str, F.Column]:
    return {"every_seed": F.lit(True), "without_first": F.col("seed") != 1, "two_assets": F.col("asset").isin("ASIA", "EUROPE")}


@query("sensitivity_grid")
def sensitivity_grid(spark, d):
    """Every asset and the equal-weight walk over all variances and numbers of trials."""
    r = _returns(spark, d).select(F.col("asset").alias("config"), "date", (F.exp("ret") - 1).alias("ret"))
    every = r.unionByName(r.groupBy("date").agg(F.avg("ret").alias("ret")).withColumn("config", F.lit("equal_weight")))
    return st.sensitivity_grid(every, ["config"], st.search_scenarios(_budgets(spark, d), "seed", "budget", _search_rules(), logged=9))


def _kernel(schema: str):
    """A numerical kernel over one scenario's wide returns (a few thousand days of a few assets)."""

    def wrap(f):
        def run(spark, d):
            def one(pdf: pd.DataFrame) -> pd.DataFrame:
                wide = pdf.pivot(index="date", columns="asset", values="ret").sort_index()
                return f(wide)

            return _returns(spark, d).select(F.lit(0).alias("scenario"), "date", "asset", "ret").groupBy("scenario").applyInPandas(one, schema)

        return run

    return wrap


@query("hmm_filter")
@_kernel("date date, state int, prob double")
def hmm_filter(wide):
    x = wide.to_numpy()
    m = hmm.fit(x, 2)
    p, _ = hmm.filtered(m, hmm.emissions(m, x))
    return pd.DataFrame({"date": np.repeat(wide.index, 2), "state": np.tile([0, 1], len(x)).astype("int32"), "prob": p.ravel()})


@query("hmm_state_counts")
@_kernel("states int, loglik double, bic double")
def hmm_state_counts(wide):
    fits = [hmm.fit(wide.to_numpy(), k) for k in (2, 3, 4)]
    return pd.DataFrame({"states": np.array([2, 3, 4], "int32"), "loglik": [m.loglik for m in fits], "bic": [hmm.bic(m, len(wide)) for m in fits]})


@query("density_scores")
@_kernel("date date, l0 double, l1 double")
def density_scores(wide):
    x = wide.to_numpy()
    m = hmm.fit(x, 2, rounds=20)
    p, _ = hmm.filtered(m, hmm.emissions(m, x))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    nu = de.fit_nu(z.ravel())
    ahead = np.vstack([m.start, p[:-1] @ m.step])
    return pd.DataFrame({"date": wide.index, "l0": de.Pooled.fit(x, nu).log_density(x), "l1": de.Mixture.fit(x, p, nu).log_density(x, ahead)})


@query("erc_weights")
@_kernel("asset string, erc double, hrp double, share double")
def erc_weights(wide):
    cov = al.shrink(np.cov(wide.to_numpy().T))
    w = al.risk_budget(cov, np.full(len(cov), 1 / len(cov)))
    return pd.DataFrame({"asset": wide.columns, "erc": w, "hrp": al.hierarchical(cov), "share": al.risk_shares(w, cov)})


@query("projection")
@_kernel("asset string, raw double, weight double")
def projection(wide):
    n = wide.shape[1]
    raw = np.arange(1, n + 1) / (n * (n + 1) / 2)
    return pd.DataFrame({"asset": wide.columns, "raw": raw, "weight": al.project(raw, np.full(n, 1 / n), al.Limits(0, 0.30, 0.30))})


@query("bootstrap_contrasts")
def bootstrap_contrasts(spark, d):
    """Five contrasts side by side, 2,000 draws each, each with its own stream and one path for all its series."""
    names = [*ASSETS, ASSETS[0]]
    r = _returns(spark, d).select("date", F.col("asset").alias("config"), (F.exp("ret") - 1).alias("ret"))
    return st.contrasts(r, seed=123, definitions={f"{x} less {y}": {x: 1, y: -1} for x, y in zip(names, names[1:])})


@query("scenario_grid")
def scenario_grid(spark, d):
    """Search-adjusted Sharpe ratios of each stage over variances and numbers of trials."""
    base = _net(spark, d).groupBy("stage").agg((ev.sharpe(F.col("net")) / math.sqrt(252)).alias("sr"), F.count("*").alias("n"), *ev.moments(F.col("net")))
    grid = spark.createDataFrame([(v, k) for v in (0.0001, 0.001, 0.01) for k in (3, 7, 9)], "variance double, trials int")
    rows = base.crossJoin(F.broadcast(grid))  # nine settings

    def run(frames):
        for pdf in frames:
            each = [(inference.deflated(x.sr, x.variance, x.trials, x.n, x.skew, x.kurt), *inference.location_scale(x.sr, x.variance, x.trials, x.n, x.skew, x.kurt)) for x in pdf.itertuples()]
            out = pd.DataFrame(each, columns=["dsr_l", "dsr_ls_gaussian", "dsr_ls_gumbel"], index=pdf.index)
            yield pd.concat([pdf[["stage", "sr", "variance", "trials"]], out], axis=1)

    return rows.mapInPandas(run, "stage string, sr double, variance double, trials int, dsr_l double, dsr_ls_gaussian double, dsr_ls_gumbel double")


@query("lstm_windows", """SELECT date, days, mean FROM (SELECT date, count(*) OVER w AS days, round(sum(s) OVER w / sum(n) OVER w, 9) AS mean FROM (SELECT date, sum(ret) AS s, count(*) AS n FROM rets GROUP BY date) WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)) WHERE days = 60 AND date IN (SELECT date FROM ends)""")
def lstm_windows(spark, d):
    """Length and mean of the 60-day vector windows at each decision."""
    r = _returns(spark, d)
    v = oa.vectors(r).select("date", F.expr("transform(v, p -> p.x)").alias("features"))
    w = ts.trailing_vectors(v, ts.month_ends(r.select("date").distinct()))
    return w.select("date", F.size("window").alias("days"), F.expr("aggregate(flatten(window), 0D, (a, x) -> a + x) / size(flatten(window))").alias("mean"))


@query("erc_shrunk_weights", f"""WITH RECURSIVE {BASE}{PAIRS}, c AS (SELECT a, b, covar_samp(x, y) AS c FROM pairs GROUP BY a, b),
t AS (SELECT sum(c) / 5 AS t FROM c WHERE a = b),
shrunk AS (SELECT a, b, 0.9 * c + CASE WHEN a = b THEN 0.1 * t ELSE 0 END AS c FROM c CROSS JOIN t),
m AS (SELECT list(r ORDER BY a) AS m, list(a ORDER BY a) AS names FROM (SELECT a, list(c ORDER BY b) AS r FROM shrunk GROUP BY a)),
steps AS (SELECT 0 AS k, list_transform(range(1, 6), lambda i: 1 / sqrt(m[i][i])) AS y FROM m
  UNION ALL SELECT k + 1, list_transform(range(1, 6), lambda i: sqrt(y[i] * 0.2 / list_dot_product(m[i], y))) FROM steps CROSS JOIN m WHERE k < 400),
w AS (SELECT list_transform(y, lambda v: v / list_sum(y)) AS w FROM steps WHERE k = 400),
p AS (SELECT names, w, list_transform(range(1, 6), lambda i: w[i] * list_dot_product(m[i], w)) AS part FROM w CROSS JOIN m)
SELECT unnest(names) AS asset, round(unnest(w), 9) AS weight, round(unnest(list_transform(part, lambda v: v / list_sum(part))), 9) AS share FROM p""")
@_kernel("asset string, weight double, share double")
def erc_shrunk_weights(wide):
    """Equal risk contributions of the shrunk covariance; the other engine finds them by a fixed-point iteration."""
    cov = al.shrink(np.cov(wide.to_numpy().T))
    w = al.equal_risk(np.cov(wide.to_numpy().T))
    return pd.DataFrame({"asset": wide.columns, "weight": w, "share": al.risk_shares(w, cov)})


#: Two regimes of the assets' mean return in per cent, from which filters and EM start.
_BEGIN = hmm.Regimes(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.zeros((2, 1)), np.array([[[0.05]], [[0.5]]]))
_DENSE = "greatest(exp(-0.5 * x * x / ({v} + 1e-8)) / sqrt(2 * pi() * ({v} + 1e-8)), 1e-300)"
_FORWARD = f"""WITH RECURSIVE {BASE}, xs AS (SELECT row_number() OVER (ORDER BY date) AS t, date, 100 * avg(ret) AS x FROM rets GROUP BY date),
e AS (SELECT t, date, x, {_DENSE.format(v=0.05)} AS b0, {_DENSE.format(v=0.5)} AS b1 FROM xs),
f AS (SELECT t, 0.5 * b0 / (0.5 * b0 + 0.5 * b1) AS a0, 0.5 * b1 / (0.5 * b0 + 0.5 * b1) AS a1, 0.5 * b0 + 0.5 * b1 AS s FROM e WHERE t = 1
  UNION ALL SELECT t, n0 / (n0 + n1), n1 / (n0 + n1), n0 + n1 FROM (SELECT e.t, (0.95 * a0 + 0.1 * a1) * b0 AS n0, (0.05 * a0 + 0.9 * a1) * b1 AS n1 FROM f JOIN e ON e.t = f.t + 1))"""
_SMOOTH = f"""{_FORWARD}, joined AS (SELECT e.t, date, x, b0, b1, a0, a1, s FROM e JOIN f USING (t)),
g AS (SELECT max(t) AS t, 1.0::DOUBLE AS z0, 1.0::DOUBLE AS z1 FROM joined
  UNION ALL SELECT g.t - 1, (0.95 * b0 * z0 + 0.05 * b1 * z1) / s, (0.1 * b0 * z0 + 0.9 * b1 * z1) / s FROM g JOIN joined ON joined.t = g.t WHERE g.t > 1),
every AS (SELECT t, date, x, b0, b1, a0, a1, s, z0, z1, a0 * z0 / (a0 * z0 + a1 * z1) AS g0, a1 * z1 / (a0 * z0 + a1 * z1) AS g1 FROM joined JOIN g USING (t))"""


def _percent(wide: pd.DataFrame) -> np.ndarray:
    return 100 * wide.to_numpy().mean(axis=1, keepdims=True)


@query("regime_probabilities", f"{_SMOOTH} SELECT date, round(a0, 9) AS calm, round(g0, 9) AS calm_in_hindsight FROM every")
@_kernel("date date, calm double, calm_in_hindsight double")
def regime_probabilities(wide):
    """Filtered and smoothed probability of the calm regime."""
    dens = hmm.emissions(_BEGIN, _percent(wide))
    return pd.DataFrame({"date": wide.index, "calm": hmm.filtered(_BEGIN, dens)[0][:, 0], "calm_in_hindsight": hmm.smoothed(_BEGIN, dens)[0][:, 0]})


@query("regime_em_round", f"""{_SMOOTH}, moves AS (SELECT sum(p.a0 * 0.95 * n.b0 * n.z0 / n.s) AS m00, sum(p.a0 * 0.05 * n.b1 * n.z1 / n.s) AS m01, sum(p.a1 * 0.1 * n.b0 * n.z0 / n.s) AS m10, sum(p.a1 * 0.9 * n.b1 * n.z1 / n.s) AS m11 FROM every p JOIN every n ON n.t = p.t + 1),
mu AS (SELECT sum(g0 * x) / sum(g0) AS u0, sum(g1 * x) / sum(g1) AS u1, sum(ln(s)) AS ll, count(*) AS n FROM every),
v AS (SELECT sum(g0 * (x - u0) ** 2) / sum(g0) + 1e-6 AS v0, sum(g1 * (x - u1) ** 2) / sum(g1) + 1e-6 AS v1 FROM every CROSS JOIN mu),
one AS (SELECT g0, g1 FROM every WHERE t = 1)
SELECT 0 AS state, round(g0, 9) AS start, round(u0, 9) AS mean, round(v0, 9) AS var, round(m00 / (m00 + m01), 9) AS to_calm, round(ll, 5) AS loglik, round(-2 * ll + 7 * ln(n), 5) AS bic FROM one, mu, v, moves
UNION ALL SELECT 1, round(g1, 9), round(u1, 9), round(v1, 9), round(m10 / (m10 + m11), 9), round(ll, 5), round(-2 * ll + 7 * ln(n), 5) FROM one, mu, v, moves""")
@_kernel("state int, start double, mean double, var double, to_calm double, loglik double, bic double")
def regime_em_round(wide):
    """One round of EM from two given regimes: start, means, variances, transitions, likelihood and criterion."""
    m = hmm.fit(_percent(wide), 2, rounds=1, begin=_BEGIN)
    return pd.DataFrame({"state": np.array([0, 1], "int32"), "start": m.start, "mean": m.means[:, 0], "var": m.covs[:, 0, 0], "to_calm": m.step[:, 0], "loglik": round(m.loglik, 5), "bic": round(hmm.bic(m, len(wide)), 5)})


_LOG_T = "lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - 0.5 * ln({s}) - (nu + 1) / 2 * ln(1 + (x - {u}) ** 2 / ({s}) / nu)"


@query("predictive_densities", f"""{_FORWARD}, joined AS (SELECT e.t, date, x, a0, a1, lag(a0) OVER (ORDER BY e.t) AS p0, lag(a1) OVER (ORDER BY e.t) AS p1 FROM e JOIN f USING (t)),
z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x FROM joined),
nus AS (SELECT unnest(list_concat(list_transform(range(0, 15), lambda k: 2.5 + 0.5 * k), list_transform(range(0, 11), lambda k: 10.0 + 2 * k)))::DOUBLE AS nu),
best AS (SELECT arg_max(nu, score) AS nu FROM (SELECT nu, sum({_LOG_T.format(s="1", u="0")}) AS score FROM nus CROSS JOIN z GROUP BY nu)),
m AS (SELECT avg(x) AS u, var_samp(x) AS v, sum(a0 * x) / sum(a0) AS u0, sum(a1 * x) / sum(a1) AS u1 FROM joined),
v AS (SELECT sum(a0 * (x - u0) ** 2) / sum(a0) AS v0, sum(a1 * (x - u1) ** 2) / sum(a1) AS v1 FROM joined CROSS JOIN m),
d AS (SELECT date, nu, coalesce(0.95 * p0 + 0.1 * p1, 0.5) AS q0, coalesce(0.05 * p0 + 0.9 * p1, 0.5) AS q1, {_LOG_T.format(s="(v + 1e-6) * (nu - 2) / nu", u="u")} AS l, {_LOG_T.format(s="(v0 + 1e-6) * (nu - 2) / nu", u="u0")} AS l0, {_LOG_T.format(s="(v1 + 1e-6) * (nu - 2) / nu", u="u1")} AS l1 FROM joined CROSS JOIN best CROSS JOIN m CROSS JOIN v)
SELECT date, nu, round(l, 8) AS pooled, round(ln(greatest(q0 * exp(l0) + q1 * exp(l1), 1e-300)), 8) AS mixed FROM d""")
@_kernel("date date, nu double, pooled double, mixed double")
def predictive_densities(wide):
    """Log-densities of the mean return: one Student t, and a mixture of two weighted by yesterday's regimes."""
    x = _percent(wide)
    p, _ = hmm.filtered(_BEGIN, hmm.emissions(_BEGIN, x))
    nu = de.fit_nu(((x - x.mean()) / x.std()).ravel())
    ahead = np.vstack([_BEGIN.start, p[:-1] @ _BEGIN.step])
    return pd.DataFrame({"date": wide.index, "nu": nu, "pooled": de.Pooled.fit(x, nu).log_density(x).round(8), "mixed": de.Mixture.fit(x, p, nu).log_density(x, ahead).round(8)})
