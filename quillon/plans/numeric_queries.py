"""Queries of the numerical operators by real keys (pairs of assets, decisions, contrasts), with SQL that finds the same numbers on its own.

Importing this module adds them to ``queries.QUERIES`` and ``queries.ORACLES``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import allocation as al
from ..operators import allocation as oa
from ..operators import bootstrap as bs
from ..operators import densities as dn
from ..operators import evaluation as ev
from ..operators import portfolio as pf
from ..operators import regimes as rg
from ..operators import timeseries as ts
from ..sources import io
from ..streaming import walk as sw
from . import equal_weight as ew
from . import seeds
from . import studies as st
from . import walkforward as wf
from .queries import ASSETS, BASE, BOUNDS, NET, ORACLES, PAIRS, WALK, YIELDS, _lstm_returns, _returns, daily_rates, query

#: Three regimes from which the fits of pairs start: returns in per cent, no correlation.
_STAY, _SPREADS = 0.9, [0.2, 1.0, 4.0, 9.0]


def _pair_series(spark, d) -> DataFrame:
    """pair, t, date, x: both returns of every pair of assets in per cent."""
    p = ts.pairs(_returns(spark, d)).select(F.concat_ws("/", "a", "b").alias("pair"), "date", F.array(F.col("x") * 100, F.col("y") * 100).alias("x"))
    return p.withColumn("t", F.row_number().over(Window.partitionBy("pair").orderBy("date")).cast("bigint"))


def _pair_models(series: DataFrame, states: int = 3) -> DataFrame:
    step = [_STAY if i == j else (1 - _STAY) / (states - 1) for i in range(states) for j in range(states)]
    covs = [v if i == j else 0.0 for v in _SPREADS[:states] for i in range(2) for j in range(2)]
    arrays = {"start": [1 / states] * states, "step": step, "means": [0.0] * (2 * states), "covs": covs}
    return series.select("pair").distinct().select("pair", *(F.array(*map(F.lit, v)).alias(k) for k, v in arrays.items()))


def _em_sql(rounds: int, states: int = 3) -> str:
    """CTEs xs, m0 ... m<rounds> (a row of parameters a pair) and, for each round, densities e, filter f, smoother y.

    Every step is a row of a recursive query; 2 x 2 inverses are written out.
    """
    ks = range(states)
    spreads = _SPREADS[:states]
    cols = [f"p{k}" for k in ks] + [f"a{i}{j}" for i in ks for j in ks] + [f"u{k}{f}" for k in ks for f in (0, 1)] + [f"v{k}{fg}" for k in ks for fg in ("00", "01", "11")]
    first = [1 / states] * states + [_STAY if i == j else (1 - _STAY) / (states - 1) for i in ks for j in ks] + [0.0] * (2 * states) + [x for v in spreads for x in (v, 0.0, v)]
    out = [
        "xs AS MATERIALIZED (SELECT a || '/' || b AS s, date, row_number() OVER (PARTITION BY a, b ORDER BY date) AS t, 100 * x AS x, 100 * y AS y FROM pairs WHERE a < b)",
        "lens AS MATERIALIZED (SELECT s, max(t) AS n FROM xs GROUP BY s)",
        f"m0 AS MATERIALIZED (SELECT s, {', '.join(f'{v!r}::DOUBLE AS {c}' for c, v in zip(cols, first))} FROM lens)",
    ]
    for r in range(rounds):
        dens = []
        for k in ks:
            c0, c1, c2 = f"(v{k}00 + 1e-8)", f"v{k}01", f"(v{k}11 + 1e-8)"
            q = f"({c2} * (x - u{k}0) ** 2 - 2 * {c1} * (x - u{k}0) * (y - u{k}1) + {c0} * (y - u{k}1) ** 2) / ({c0} * {c2} - {c1} ** 2)"
            dens.append(f"greatest(exp(-0.5 * {q}) / (2 * pi() * sqrt({c0} * {c2} - {c1} ** 2)), 1e-300) AS b{k}")
        steps = [f"a{i}{j}" for i in ks for j in ks]
        out.append(f"e{r} AS MATERIALIZED (SELECT s, t, x, y, {', '.join(dens + steps)} FROM xs JOIN m{r} USING (s))")
        into = [f"({' + '.join(f'f.g{i} * e.a{i}{k}' for i in ks)}) * e.b{k} AS n{k}" for k in ks]
        total = f"({' + '.join(f'n{k}' for k in ks)})"
        norm = ", ".join(f"n{k} / {total} AS g{k}" for k in ks)
        out.append(f"f{r} AS (SELECT s, t, {norm}, {total} AS c FROM (SELECT e.s, e.t, {', '.join(f'p{k} * b{k} AS n{k}' for k in ks)} FROM e{r} e JOIN m{r} USING (s) WHERE t = 1) UNION ALL SELECT s, t, {norm}, {total} FROM (SELECT e.s, e.t, {', '.join(into)} FROM f{r} f JOIN e{r} e ON e.s = f.s AND e.t = f.t + 1))")
        back = ", ".join(f"({' + '.join(f'h.a{i}{j} * h.b{j} * z.z{j}' for j in ks)}) / h.c AS z{i}" for i in ks)
        out.append(f"h{r} AS MATERIALIZED (SELECT * FROM e{r} JOIN f{r} USING (s, t))")
        out.append(f"z{r} AS (SELECT s, n AS t, {', '.join(f'1.0::DOUBLE AS z{k}' for k in ks)} FROM lens UNION ALL SELECT h.s, h.t - 1, {back} FROM z{r} z JOIN h{r} h ON h.s = z.s AND h.t = z.t WHERE h.t > 1)")
        weight = " + ".join(f"g{k} * z{k}" for k in ks)
        out.append(f"y{r} AS MATERIALIZED (SELECT *, {', '.join(f'g{k} * z{k} / ({weight}) AS w{k}' for k in ks)} FROM h{r} JOIN z{r} USING (s, t))")
        moves = ", ".join(f"sum(p.g{i} * n.a{i}{j} * n.b{j} * n.z{j} / n.c) AS q{i}{j}" for i in ks for j in ks)
        means = ", ".join(f"sum(w{k} * {v}) / sum(w{k}) AS n{k}{f}" for k in ks for f, v in ((0, "x"), (1, "y")))
        out.append(f"k{r} AS MATERIALIZED (SELECT n.s, {moves} FROM y{r} p JOIN y{r} n ON n.s = p.s AND n.t = p.t + 1 GROUP BY n.s)")
        out.append(f"c{r} AS MATERIALIZED (SELECT s, {means} FROM y{r} GROUP BY s)")
        xy = {"0": "x", "1": "y"}
        covs = ", ".join(f"sum(w{k} * ({xy[fg[0]]} - n{k}{fg[0]}) * ({xy[fg[1]]} - n{k}{fg[1]})) / sum(w{k}){' + 1e-6' if fg != '01' else ''} AS v{k}{fg}" for k in ks for fg in ("00", "01", "11"))
        starts = ", ".join(f"max(w{k}) FILTER (t = 1) AS p{k}" for k in ks)
        out.append(f"d{r} AS MATERIALIZED (SELECT s, {covs}, {starts}, sum(ln(c)) AS ll FROM y{r} JOIN c{r} USING (s) GROUP BY s)")
        rows = ", ".join(f"q{i}{j} / ({' + '.join(f'q{i}{k}' for k in ks)}) AS a{i}{j}" for i in ks for j in ks)
        out.append(f"m{r + 1} AS MATERIALIZED (SELECT s, {', '.join(f'p{k}' for k in ks)}, {rows}, {', '.join(f'n{k}{f} AS u{k}{f}' for k in ks for f in (0, 1))}, {', '.join(f'v{k}{fg}' for k in ks for fg in ('00', '01', '11'))}, ll, n FROM k{r} JOIN c{r} USING (s) JOIN d{r} USING (s) JOIN lens USING (s))")
    return f"WITH RECURSIVE {BASE}{PAIRS}, " + ", ".join(out)


_STATES = " UNION ALL ".join(f"SELECT s AS pair, {k} AS state, round(p{k}, 7) AS start, round(a{k}{k}, 7) AS stay, round(u{k}0, 7) AS mean_a, round(u{k}1, 7) AS mean_b, round(v{k}00, 7) AS var_a, round(v{k}01, 7) AS cov, round(v{k}11, 7) AS var_b, round(ll, 5) AS loglik, round(-2 * ll + 23 * ln(n), 5) AS bic FROM m2" for k in range(3))


@query("regime_fits_by_pair", f"{_em_sql(2)} {_STATES}")
def regime_fits_by_pair(spark, d):
    """Two rounds of EM with three states for every pair of assets, in blocks of 100 days."""
    x = io.staged(_pair_series(spark, d), "pairs")
    fits = rg.fit(x, _pair_models(x), ["pair"], rounds=2, block=100)
    at = lambda c, i: F.round(F.expr(f"{c}[{i}]"), 7)
    rows = fits.withColumn("state", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.select("pair", "state", at("start", "state").alias("start"), at("step", "4 * state").alias("stay"), at("means", "2 * state").alias("mean_a"), at("means", "2 * state + 1").alias("mean_b"), at("covs", "4 * state").alias("var_a"), at("covs", "4 * state + 1").alias("cov"), at("covs", "4 * state + 3").alias("var_b"), F.round("loglik", 5).alias("loglik"), F.round("bic", 5).alias("bic"))


@query("regime_paths_by_pair", f"{_em_sql(1)} SELECT s AS pair, date, round(g0, 7) AS calm, round(g2, 7) AS wild, round(w0, 7) AS calm_in_hindsight, round(w2, 7) AS wild_in_hindsight FROM y0 JOIN xs USING (s, t)")
def regime_paths_by_pair(spark, d):
    """Filtered and smoothed probabilities of three given regimes for every pair and day, in blocks of 64 days."""
    x = _pair_series(spark, d)
    p = rg.probabilities(x.select("pair", "t", "x"), _pair_models(x), ["pair"], block=64)
    at = lambda c, i: F.round(F.col(c)[i], 7)
    return p.join(x.select("pair", "t", "date"), ["pair", "t"]).select("pair", "date", at("filtered", 0).alias("calm"), at("filtered", 2).alias("wild"), at("smoothed", 0).alias("calm_in_hindsight"), at("smoothed", 2).alias("wild_in_hindsight"))


#: Signed strategies of the bootstrap queries; the last is a difference of differences.
_CONTRASTS = {
    "even_less_africa": {"EVEN": 1, "AFRICA": -1},
    "america_less_asia": {"AMERICA": 1, "ASIA": -1},
    "west_less_east": {"AMERICA": 1, "EUROPE": -1, "ASIA": -1, "MIDDLE EAST": 1},
}
_DRAWS, _SEED = 2000, 11


def _excess(spark, d) -> DataFrame:
    """date, config, excess of the test stage: net returns of the equal-weight walk and returns of the assets, less the risk-free rate."""
    r = _returns(spark, d)
    gross, turns = ew.walk(r)
    held = r.select("date", F.col("asset").alias("config"), (F.exp("ret") - 1).alias("ret"))
    every = held.unionByName(gross.select("date", F.lit("EVEN").alias("config"), "ret"))
    rates = daily_rates(spark, d, r)
    out = st.net_excess(every, turns.withColumn("config", F.lit("EVEN")), rates, ["config"])
    return out.where(ts.stage_label(BOUNDS) == "test").select("date", "config", "excess")


_SERIES = f""", {YIELDS}, rates AS (SELECT d.date, pow(1 + coalesce(q.y, 0) / 100, 1.0 / 252) - 1 AS rf FROM days d ASOF LEFT JOIN (SELECT * FROM yields WHERE y IS NOT NULL) q ON d.date > q.obs_date),
every AS (SELECT date, asset AS config, exp(ret) - 1 AS net FROM rets UNION ALL SELECT date, 'EVEN', net FROM net),
excess AS MATERIALIZED (SELECT date, config, net - rf AS x FROM every JOIN rates USING (date) JOIN stages USING (date) WHERE stage = 'test'),
signs AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {k}, '{c}', {s})" for k, (n, d) in enumerate(_CONTRASTS.items()) for c, s in d.items())}) AS v(contrast, stream, config, sign)),
series AS MATERIALIZED (SELECT contrast, stream, config, sign, row_number() OVER (PARTITION BY contrast, config ORDER BY date) - 1 AS t, x FROM excess JOIN signs USING (config)),
sums AS (SELECT contrast, t, sum(sign * x) AS x FROM series GROUP BY ALL),
centred AS MATERIALIZED (SELECT contrast, t, x - avg(x) OVER (PARTITION BY contrast) AS x FROM sums),
sizes AS MATERIALIZED (SELECT contrast, count(*) AS n, greatest(5, floor(sqrt(log10(count(*)))))::INT AS run, least(ceil(sqrt(count(*)) + greatest(5, floor(sqrt(log10(count(*)))))), count(*) - 1)::INT AS most FROM centred GROUP BY contrast),
acov AS MATERIALIZED (SELECT a.contrast, b.t - a.t AS lag, sum(a.x * b.x) / max(n) AS g FROM centred a JOIN sizes USING (contrast) JOIN centred b ON a.contrast = b.contrast AND b.t BETWEEN a.t AND a.t + most GROUP BY ALL),
small AS (SELECT contrast, lag, abs(g / first(g) OVER (PARTITION BY contrast ORDER BY lag)) < 2 * sqrt(log10(n) / n) AS ok, run, most FROM acov JOIN sizes USING (contrast)),
begins AS (SELECT contrast, min(lag) AS k FROM (SELECT *, bool_and(ok) OVER w AS good, count(*) OVER w AS c FROM small WINDOW w AS (PARTITION BY contrast ORDER BY lag ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE lag >= 1 AND good AND c = run GROUP BY contrast),
widths AS (SELECT contrast, n, least(2 * coalesce(k, most), most) AS m FROM sizes LEFT JOIN begins USING (contrast)),
lengths AS MATERIALIZED (SELECT contrast, max(n) AS n, greatest(1, least(pow(pow(2 * sum(least(1, 2 * (1 - lag / m)) * lag * g), 2) / pow(max(g) FILTER (lag = 0) + 2 * coalesce(sum(least(1, 2 * (1 - lag / m)) * g) FILTER (lag > 0), 0), 2) * max(n), 1.0 / 3), ceil(least(3 * sqrt(max(n)), max(n) / 3)))) AS block_length
  FROM acov JOIN widths USING (contrast) WHERE lag <= m GROUP BY contrast)"""


def _mix_sql(name: str, source: str, column: str) -> str:
    """CTEs that replace a 32-bit number by its mixed one, step by step; the last is called ``name``."""
    out, last = [], source
    for k in range(2):
        out.append(f"{name}_{k} AS (SELECT * REPLACE (((xor({column} >> 16, {column})) * 73244475) & 4294967295 AS {column}) FROM {last})")
        last = f"{name}_{k}"
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT * REPLACE (xor({column} >> 16, {column}) AS {column}) FROM {last})"])


_DRAWN = f""", k0 AS (SELECT contrast, stream, {_SEED}::BIGINT AS h FROM (SELECT DISTINCT contrast, stream FROM signs)), {_mix_sql("k1", "k0", "h")},
k2 AS (SELECT contrast, xor(h, stream::BIGINT) AS h FROM k1), {_mix_sql("k3", "k2", "h")},
k4 AS (SELECT contrast, draw, xor(h, draw) AS h FROM k3, range({_DRAWS}) AS r(draw)), {_mix_sql("k5", "k4", "h")},
k6 AS (SELECT contrast, draw, n, block_length, t, xor(h, 2 * t) AS a, xor(h, 2 * t + 1) AS b FROM k5 JOIN lengths USING (contrast), LATERAL (SELECT unnest(range(n)) AS t)), {_mix_sql("k7", "k6", "a")}, {_mix_sql("k8", "k7", "b")},
k9 AS (SELECT contrast, draw, n, t, b % n AS start, max(CASE WHEN t = 0 OR a < 4294967296 / block_length THEN t ELSE 0 END) OVER (PARTITION BY contrast, draw ORDER BY t) AS at FROM k8),
path AS (SELECT p.contrast, p.draw, (s.start + p.t - p.at) % p.n AS t FROM k9 p JOIN k9 s ON s.contrast = p.contrast AND s.draw = p.draw AND s.t = p.at),
stats AS (SELECT contrast, draw, sum(s) AS statistic FROM (SELECT contrast, draw, sign * avg(x) / stddev_samp(x) * sqrt(252) AS s FROM path JOIN series USING (contrast, t) GROUP BY contrast, draw, config, sign) GROUP BY contrast, draw)"""


@query("block_lengths", f"{NET}{_SERIES} SELECT contrast, n, round(block_length, 7) AS block_length FROM lengths", walk=True)
def block_lengths(spark, d):
    """Automatic mean block lengths of the contrasts' signed sums of excess net returns."""
    rows = bs.points(bs.signed_series(_excess(spark, d), [], "excess", _CONTRASTS), [])
    return rows.select("contrast", F.size(F.col("series")[0]).cast("bigint").alias("n"), F.round("block_length", 7).alias("block_length"))


@query("bootstrap_intervals", f"{NET}{_SERIES}{_DRAWN}, points AS (SELECT contrast, sum(s) AS point FROM (SELECT contrast, sign * avg(x) / stddev_samp(x) * sqrt(252) AS s FROM series GROUP BY contrast, config, sign) GROUP BY contrast) SELECT contrast, round(any_value(point), 7) AS point, round(quantile_cont(statistic, 0.025), 7) AS low, round(quantile_cont(statistic, 0.975), 7) AS high, round(any_value(block_length), 7) AS block_length FROM stats JOIN points USING (contrast) JOIN lengths USING (contrast) GROUP BY contrast", walk=True)
def bootstrap_intervals(spark, d):
    """Differences of Sharpe ratios of excess net returns in the test stage and their intervals, from the same numbered draws as the SQL's."""
    out = bs.intervals(bs.signed_series(_excess(spark, d), [], "excess", _CONTRASTS), [], _DRAWS, _SEED)
    return out.select("contrast", *(F.round(c, 7).alias(c) for c in ("point", "low", "high", "block_length")))


@query("draw_statistics", f"{NET}{_SERIES}{_DRAWN} SELECT contrast, draw, round(statistic, 8) AS statistic FROM stats WHERE draw < 50", walk=True)
def draw_statistics(spark, d):
    """The first 50 draws of every contrast."""
    rows = bs.points(bs.signed_series(_excess(spark, d), [], "excess", _CONTRASTS), [])
    return bs.draw(rows, [], 50, _SEED, block=16).select("contrast", F.col("draw").cast("bigint").alias("draw"), F.round("statistic", 8).alias("statistic"))


def _trailing_of(r: DataFrame) -> DataFrame:
    return pf.trailing_covariance(r, ts.month_ends(r.select("date").distinct()))


def _trailing(spark, d) -> DataFrame:
    return _trailing_of(_returns(spark, d))


_TRAILING = """, seq AS (SELECT date, asset, ret, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM rets), decided AS (SELECT date, k FROM seq WHERE date IN (SELECT date FROM ends) AND k >= 252 GROUP BY ALL),
trails AS MATERIALIZED (SELECT d.date, x.asset AS i, y.asset AS j, covar_samp(x.ret, y.ret) AS cov FROM decided d JOIN seq x ON x.k BETWEEN d.k - 251 AND d.k JOIN seq y ON y.k = x.k GROUP BY ALL)"""
_SHRUNK = """, shrunk AS MATERIALIZED (SELECT date, i, j, 0.9 * cov + CASE WHEN i = j THEN 0.1 * avg(CASE WHEN i = j THEN cov END) OVER (PARTITION BY date) ELSE 0 END AS cov FROM trails),
mats AS MATERIALIZED (SELECT date, list(r ORDER BY i) AS m, list(i ORDER BY i) AS names FROM (SELECT date, i, list(cov ORDER BY j) AS r FROM shrunk GROUP BY date, i) GROUP BY date)"""


def _shrunk(spark, d) -> DataFrame:
    return oa.shrunk(_trailing(spark, d), ["date"])


@query("trailing_covariances", f"{_TRAILING} SELECT date, i, j, round(1e6 * cov, 7) AS cov FROM trails")
def trailing_covariances(spark, d):
    """Covariances of the last 252 days at every decision, in millionths."""
    return _trailing(spark, d).withColumn("cov", F.round(1e6 * F.col("cov"), 7))


_FIXED_POINT = """steps AS (SELECT date, 0 AS k, list_transform(range(1, 6), lambda i: 1 / sqrt(m[i][i])) AS y FROM mats
  UNION ALL SELECT date, k + 1, list_transform(range(1, 6), lambda i: sqrt(y[i] * 0.2 / list_dot_product(m[i], y))) FROM steps JOIN mats USING (date) WHERE k < 300),
w AS (SELECT date, list_transform(y, lambda v: v / list_sum(y)) AS w FROM steps WHERE k = 300),
p AS (SELECT date, names, w, list_transform(range(1, 6), lambda i: w[i] * list_dot_product(m[i], w)) AS part FROM w JOIN mats USING (date))"""


@query("erc_by_decision", f"WITH RECURSIVE {BASE}{_TRAILING}{_SHRUNK}, {_FIXED_POINT} " + """SELECT date, unnest(names) AS asset, round(unnest(w), 8) AS weight, round(unnest(list_transform(part, lambda v: v / list_sum(part))), 8) AS share FROM p""")
def erc_by_decision(spark, d):
    """Equal risk contributions of the shrunk trailing covariance of every decision; the SQL finds them by a fixed point."""
    out = pf.risk_budget_weights(pf.matrices(_shrunk(spark, d), ["date"]), ["date"])
    return out.select("date", "asset", F.round("weight", 8).alias("weight"), F.round("share", 8).alias("share"))


#: Single linkage as the SQL has it: of all pairs of clusters the nearest are joined, the one with the smaller number first.
_LINKAGE = """dist AS MATERIALIZED (SELECT date, m, names, list_transform(range(1, len(names) + 1), lambda i: list_transform(range(1, len(names) + 1), lambda j: sqrt(0.5 * (1 - greatest(-1, least(1, m[i][j] / sqrt(m[i][i] * m[j][j]))))))) AS d FROM mats),
links AS (SELECT date, list_transform(range(1, len(names) + 1), lambda i: {'id': i, 'leaves': [i]}) AS c, len(names) AS top FROM dist
  UNION ALL SELECT date, list_append(list_filter(c, lambda x: x.id <> near.a AND x.id <> near.b), {'id': top + 1, 'leaves': list_concat(list_filter(c, lambda x: x.id = near.a)[1].leaves, list_filter(c, lambda x: x.id = near.b)[1].leaves)}), top + 1
  FROM (SELECT date, c, top, list_min(flatten(list_transform(c, lambda x: list_transform(list_filter(c, lambda y: y.id > x.id), lambda y: {'d': list_min(flatten(list_transform(x.leaves, lambda i: list_transform(y.leaves, lambda j: d[i][j])))), 'a': x.id, 'b': y.id})))) AS near FROM links JOIN dist USING (date) WHERE len(c) > 1)),
leaves AS MATERIALIZED (SELECT date, m, names, c[1].leaves AS o FROM links JOIN dist USING (date) WHERE len(c) = 1)"""
_RISK = "list_sum(list_transform({s}, lambda i: list_sum(list_transform({s}, lambda j: m[i][j] / m[i][i] / m[j][j])))) / pow(list_sum(list_transform({s}, lambda i: 1 / m[i][i])), 2)"


@query("leaf_orders", f"WITH RECURSIVE {BASE}{_TRAILING}{_SHRUNK}, {_LINKAGE} SELECT date, array_to_string(list_transform(o, lambda i: names[i]), ',') AS leaves FROM leaves")
def leaf_orders(spark, d):
    """Single-linkage leaf orders of every decision, by spanning trees of all matrices at once."""
    cov = _shrunk(spark, d)
    sd = cov.where("i = j").select("date", "i", F.sqrt("cov").alias("s"))
    dist = cov.join(sd, ["date", "i"]).join(sd.withColumnsRenamed({"i": "j", "s": "t"}), ["date", "j"]).select("date", "i", "j", F.sqrt(0.5 * (1 - F.least(F.lit(1.0), F.col("cov") / (F.col("s") * F.col("t"))))).alias("distance"))
    dist = io.staged(dist, "distances")
    order = pf.leaf_order(pf.spanning_tree(dist, ["date"]), dist.select("date", F.col("i").alias("node")), ["date"])
    return order.select("date", F.array_join("leaves", ",").alias("leaves"))


_HALVES = f"halves AS (SELECT date, m, names, o AS s, 1.0::DOUBLE AS w FROM leaves UNION ALL SELECT date, m, names, CASE WHEN side = 1 THEN l ELSE r END, w * CASE WHEN side = 1 THEN 1 - rl / (rl + rr) ELSE rl / (rl + rr) END FROM (SELECT *, {_RISK.format(s='l')} AS rl, {_RISK.format(s='r')} AS rr FROM (SELECT date, m, names, w, s[1:len(s) // 2] AS l, s[len(s) // 2 + 1:] AS r FROM halves WHERE len(s) > 1)), (VALUES (1), (2)) AS v(side))"


@query("hierarchical_by_decision", f"WITH RECURSIVE {BASE}{_TRAILING}{_SHRUNK}, {_LINKAGE}, {_HALVES} SELECT date, names[s[1]] AS asset, round(w, 8) AS weight FROM halves WHERE len(s) = 1")
def hierarchical_by_decision(spark, d):
    """Hierarchical risk parity of every decision."""
    return pf.hierarchical_weights(_shrunk(spark, d), ["date"]).withColumn("weight", F.round("weight", 8))


_PROJECTED = """, trends AS (SELECT date, asset, sum(ret) OVER w AS trend, stddev_samp(ret) OVER w AS sd, count(*) OVER w AS n FROM rets WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
wanted AS (SELECT date, asset, unnest(['tilt', 'inverse']) AS config, unnest([exp(40 * trend), 1 / sd ** 6]) AS v FROM trends WHERE n = 63 AND sd > 0 AND date IN (SELECT date FROM ends)),
decided AS MATERIALIZED (SELECT config, date, list(raw ORDER BY asset) AS raw, list(weight ORDER BY asset) AS b, list(asset ORDER BY asset) AS names, len(list(asset)) AS n FROM (SELECT config, date, asset, v / sum(v) OVER (PARTITION BY config, date) AS raw, weight FROM wanted JOIN drifted USING (date, asset)) GROUP BY ALL)"""


def _decisions(spark, d) -> DataFrame:
    """config, date, asset, raw, before: two tilted targets beside the drifted equal weights of every month end."""
    r = _returns(spark, d)
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-62, 0)
    t = r.select("date", "asset", F.sum("ret").over(w).alias("trend"), F.stddev_samp("ret").over(w).alias("sd"), F.count("*").over(w).alias("n")).where("n = 63 AND sd > 0")
    t = t.join(ts.month_ends(r.select("date").distinct()), "date", "left_semi")
    t = t.select("date", "asset", F.expr("stack(2, 'tilt', exp(40 * trend), 'inverse', 1 / power(sd, 6)) AS (config, v)"))
    raw = t.withColumn("raw", F.col("v") / F.sum("v").over(Window.partitionBy("config", "date")))
    return raw.join(ew.drifted(r).withColumnRenamed("weight", "before"), ["date", "asset"]).select("config", "date", "asset", "raw", "before")


_LIMITS = al.Limits(0.0, 0.30, 0.30)
_W = "list_transform(range(1, n + 1), lambda i: least(greatest(b[i] + sign(raw[i] - {l} - b[i]) * greatest(abs(raw[i] - {l} - b[i]) - {u}, 0), 0), 0.3))"


_BISECTED = f"""bis AS (SELECT config, date, 0 AS k, -8.0::DOUBLE AS l0, 8.0::DOUBLE AS l1, 0.0::DOUBLE AS u0, 4.0::DOUBLE AS u1, 0.0::DOUBLE AS u FROM decided
  UNION ALL SELECT config, date, k + 1, CASE WHEN last THEN -8.0 WHEN list_sum(w) > 1 THEN mid ELSE l0 END, CASE WHEN last THEN 8.0 WHEN list_sum(w) > 1 THEN l1 ELSE mid END, CASE WHEN last AND over THEN u ELSE u0 END, CASE WHEN last AND NOT over THEN u ELSE u1 END,
    CASE WHEN NOT last THEN u WHEN k // 50 >= 45 THEN CASE WHEN over THEN u1 ELSE u END ELSE ((CASE WHEN over THEN u ELSE u0 END) + (CASE WHEN over THEN u1 ELSE u END)) / 2 END
  FROM (SELECT *, k % 50 = 49 AS last, list_sum(list_transform(range(1, n + 1), lambda i: abs(w[i] - b[i]))) > 0.3 + 1e-12 AS over FROM (SELECT *, {_W.format(l='mid', u='u')} AS w FROM (SELECT bis.*, raw, b, n, (l0 + l1) / 2 AS mid FROM bis JOIN decided USING (config, date) WHERE k < 2399)))),
done AS (SELECT config, date, names, raw, b, u, {_W.format(l='(l0 + l1) / 2', u='u')} AS w FROM bis JOIN decided USING (config, date) WHERE k = 2399)"""


@query("projected_decisions", f"WITH RECURSIVE {BASE}{WALK}{_PROJECTED}, {_BISECTED} " + """SELECT config, date, unnest(names) AS asset, round(unnest(w), 7) AS weight, u > 1e-9 AS turnover_binds, round(list_sum(list_transform(range(1, len(w) + 1), lambda i: abs(w[i] - b[i]))), 7) AS turnover, 0.0 AS residual FROM done""")
def projected_decisions(spark, d):
    """Every decision's projected weights, whether the turnover limit binds, and the residual of the optimality conditions."""
    solved = io.staged(pf.projected(_decisions(spark, d), ["config", "date"], _LIMITS), "projected")
    proof = pf.certificates(solved, ["config", "date"], _LIMITS)
    out = solved.join(proof, ["config", "date"])
    return out.select("config", "date", "asset", F.round("weight", 7).alias("weight"), (F.col("turnover_price") > 1e-9).alias("turnover_binds"), F.round("turnover", 7).alias("turnover"), F.round("residual", 8).alias("residual"))


@query("solver_audit")
def solver_audit(spark, d):
    """For every decision: errors of the squared solver's and the exact solver's weights, and the smallest error that starts reach within the limits."""
    r = _returns(spark, d)
    cov = io.staged(oa.shrunk(_trailing_of(r), ["date"]), "covariances")
    whole = pf.matrices(cov, ["date"])
    held = ew.drifted(r).groupBy("date").agg(F.transform(F.sort_array(F.collect_list(F.struct("asset", "weight"))), lambda p: p["weight"]).alias("before"))
    best = pf.best_feasible(whole, held, ["date"], limits=al.Limits(0.0, 0.22, 0.10))
    n = len(ASSETS)
    error = lambda solver: pf.risk_budget_weights(whole, ["date"], solver).groupBy("date").agg(F.sum((F.col("share") - 1 / n) ** 2).alias(f"{solver}_error"), F.max("weight").alias(f"{solver}_largest"))
    return error("squared").join(error("exact"), "date").join(best.select("date", "start", F.col("error").alias("feasible_error")), "date")


def _counted(k: int) -> str:
    return f"{_em_sql(2, k)} SELECT s AS pair, {k} AS states, round(ll, 5) AS loglik, round(-2 * ll + {2 * k + 3 * k + k * (k - 1) + k - 1} * ln(n), 5) AS bic FROM m2"


@query("regime_state_counts", f"WITH two AS ({_counted(2)}), three AS ({_counted(3)}), four AS ({_counted(4)}) SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four")
def regime_state_counts(spark, d):
    """Information criteria of two, three and four regimes for every pair, two rounds each."""
    x = io.staged(_pair_series(spark, d), "pairs")
    fits = [rg.fit(x, _pair_models(x, k), ["pair"], rounds=2, block=300).withColumn("states", F.lit(k)) for k in (2, 3, 4)]
    return io.union_all(fits).select("pair", "states", F.round("loglik", 5).alias("loglik"), F.round("bic", 5).alias("bic"))


_T2 = "lgamma(({v} + 2) / 2) - lgamma({v} / 2) - ln({v} * pi()) - 0.5 * ln(({a} + 1e-6) * ({c} + 1e-6) - {b} ** 2) - ln(({v} - 2) / {v}) - ({v} + 2) / 2 * ln(1 + (({c} + 1e-6) * (x - {m}) ** 2 - 2 * {b} * (x - {m}) * (y - {n}) + ({a} + 1e-6) * (y - {n}) ** 2) / (({a} + 1e-6) * ({c} + 1e-6) - {b} ** 2) / ({v} - 2))"
_T1 = "lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - (nu + 1) / 2 * ln(1 + z * z / nu)"
_DENSITIES = f"""{_em_sql(1)}, zs AS (SELECT s, t, unnest([(x - avg(x) OVER w) / stddev_pop(x) OVER w, (y - avg(y) OVER w) / stddev_pop(y) OVER w]) AS z FROM xs WINDOW w AS (PARTITION BY s)),
nus AS (SELECT unnest(list_concat(list_transform(range(0, 15), lambda k: 2.5 + 0.5 * k), list_transform(range(0, 11), lambda k: 10.0 + 2 * k)))::DOUBLE AS nu),
liks AS MATERIALIZED (SELECT s, nu, sum(l) AS l, {", ".join(f"sum(g{k} * l) AS l{k}" for k in range(3))} FROM (SELECT s, t, nu, {_T1} AS l FROM zs CROSS JOIN nus) JOIN f0 USING (s, t) GROUP BY s, nu),
best AS MATERIALIZED (SELECT s, arg_max(nu, l) AS nu, {", ".join(f"arg_max(nu, l{k}) AS nu{k}" for k in range(3))} FROM liks GROUP BY s),
days2 AS MATERIALIZED (SELECT s, t, date, x, y, {", ".join(f"g{k}" for k in range(3))}, {", ".join(f"{' + '.join(f'a{i}{k} * lag(g{i}) OVER w' for i in range(3))} AS q{k}" for k in range(3))} FROM xs JOIN f0 USING (s, t) JOIN m0 USING (s) WINDOW w AS (PARTITION BY s ORDER BY t)),
firsts AS MATERIALIZED (SELECT s, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy, {", ".join(f"sum(g{k} * x) / sum(g{k}) AS mx{k}, sum(g{k} * y) / sum(g{k}) AS my{k}" for k in range(3))} FROM days2 GROUP BY s),
seconds AS MATERIALIZED (SELECT s, {", ".join(f"sum(g{k} * (x - mx{k}) ** 2) / sum(g{k}) AS vx{k}, sum(g{k} * (y - my{k}) ** 2) / sum(g{k}) AS vy{k}, sum(g{k} * (x - mx{k}) * (y - my{k})) / sum(g{k}) AS vxy{k}" for k in range(3))} FROM days2 JOIN firsts USING (s) GROUP BY s)"""


def _densities(spark, d) -> tuple[DataFrame, ...]:
    """(observations, filtered paths, pooled models, states' models) of every pair, filtered by the three regimes that fits start from."""
    x = io.staged(_pair_series(spark, d), "pairs")
    paths = io.staged(rg.probabilities(x.select("pair", "t", "x"), _pair_models(x), ["pair"], block=200).drop("smoothed"), "paths")
    z = dn.residuals(x, ["pair"])
    pooled = dn.models(dn.moments(x, ["pair"], 2), dn.degrees_of_freedom(z, ["pair"]), ["pair"])
    nus = dn.degrees_of_freedom(dn.state_rows(z, paths, ["pair"]), ["pair", "state"], "p")
    states = dn.models(dn.moments(dn.state_rows(x.select("pair", "t", "x"), paths, ["pair"]), ["pair", "state"], 2, "p"), nus, ["pair", "state"])
    return x, paths, io.staged(pooled, "pooled"), io.staged(states, "states")


@query("density_models_by_pair", f"{_DENSITIES} " + " UNION ALL ".join(f"SELECT s AS pair, {k} AS state, nu{k} AS nu, round(mx{k}, 8) AS mean_a, round(vx{k} + 1e-6, 8) AS var_a, round(vxy{k}, 8) AS cov, round(vy{k} + 1e-6, 8) AS var_b FROM best JOIN firsts USING (s) JOIN seconds USING (s)" for k in range(3)) + " UNION ALL SELECT s, -1, nu, round(mx, 8), round(vx + 1e-6, 8), round(vxy, 8), round(vy + 1e-6, 8) FROM best JOIN firsts USING (s)")
def density_models_by_pair(spark, d):
    """Degrees of freedom, means and implied covariances of every pair: pooled (state -1) and by regime."""
    _, _, pooled, states = _densities(spark, d)
    rows = pooled.withColumn("state", F.lit(-1)).unionByName(states)
    return rows.select("pair", "state", "nu", F.round(F.col("mean")[0], 8).alias("mean_a"), *(F.round(F.col("implied")[i], 8).alias(n) for i, n in ((0, "var_a"), (1, "cov"), (3, "var_b"))))


@query("density_scores_by_pair", f"{_DENSITIES}, l AS (SELECT s, date, {_T2.format(v='nu', m='mx', n='my', a='vx', b='vxy', c='vy')} AS pooled, {', '.join(f'coalesce(q{k}, 1.0 / 3) AS q{k}' for k in range(3))}, {', '.join(_T2.format(v=f'nu{k}', m=f'mx{k}', n=f'my{k}', a=f'vx{k}', b=f'vxy{k}', c=f'vy{k}') + f' AS l{k}' for k in range(3))} FROM days2 JOIN best USING (s) JOIN firsts USING (s) JOIN seconds USING (s)) SELECT s AS pair, date, round(pooled, 5) AS pooled, round(ln(greatest(q0 * exp(l0) + q1 * exp(l1) + q2 * exp(l2), 1e-300)), 5) AS mixed FROM l")
def density_scores_by_pair(spark, d):
    """Log scores of every pair and day: one Student t, and regimes' densities weighted by yesterday's forecast."""
    x, paths, pooled, states = _densities(spark, d)
    step = np.full((3, 3), (1 - _STAY) / 2) + (_STAY - (1 - _STAY) / 2) * np.eye(3)
    before = F.lag("filtered").over(Window.partitionBy("pair").orderBy("t"))
    ahead = F.array(*(sum((F.col("_b")[i] * float(step[i, k]) for i in range(3)), F.lit(0.0)) for k in range(3)))
    first = F.array(*[F.lit(1 / 3)] * 3)
    forecasts = paths.withColumn("_b", before).select("pair", "t", F.when(F.col("_b").isNull(), first).otherwise(ahead).alias("ahead"))
    out = dn.scores(x.select("pair", "t", "x"), forecasts, pooled, states, ["pair"]).join(x.select("pair", "t", "date"), ["pair", "t"])
    return out.select("pair", "date", F.round("pooled", 5).alias("pooled"), F.round("mixed", 5).alias("mixed"))


def _phi(x: str) -> str:
    """The normal distribution function as its power series; beyond 8 it is 0 or 1."""
    series = f"list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(abs({x})) - (i + 1) * ln(2) - lgamma(i + 1.5) + 0.5 * ln(pi()))))"
    return f"(CASE WHEN {x} > 8 THEN 1 WHEN {x} < -8 THEN 0 WHEN {x} = 0 THEN 0.5 ELSE 0.5 + sign({x}) * exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) * {series} END)"


#: Quantiles by bisection and the moments of the largest of k normals by Simpson's rule, for the numbers of trials in ``ks``.
_LARGEST = f"""halvings AS (SELECT list_prepend(-8.0::DOUBLE, list_transform(range(1, 56), lambda k: 16.0 / 2 ** k)) AS h),
quants AS MATERIALIZED (SELECT trials, p, list_reduce(h, lambda x, w: CASE WHEN {_phi('(x + w)')} < p THEN x + w ELSE x END) AS q FROM (SELECT trials, unnest([1 - 1.0 / trials, 1 - 1.0 / (trials * exp(1))]) AS p FROM ks WHERE trials > 1) CROSS JOIN halvings),
tops AS (SELECT ks.trials, coalesce((1 - 0.5772156649015329) * min(q) + 0.5772156649015329 * max(q), 0) AS top FROM ks LEFT JOIN quants USING (trials) GROUP BY ks.trials),
nodes AS MATERIALIZED (SELECT z, CASE WHEN i IN (0, 2400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.01 / 3 AS w, {_phi('z')} AS c FROM (SELECT i, (i - 1200) / 100.0 AS z FROM range(2401) AS r(i))),
largest AS MATERIALIZED (SELECT trials, sum(w * z * f) AS mean, sqrt(sum(w * z * z * f) - sum(w * z * f) ** 2) AS sd FROM (SELECT trials, z, w, trials * exp(-0.5 * z * z) / sqrt(2 * pi()) * c ** (trials - 1) AS f FROM ks CROSS JOIN nodes) GROUP BY trials),
scored AS (SELECT *, (sr - sqrt(variance) * top) * sqrt(n - 1) / sqrt(spread) AS a, (sr - sqrt(variance) * mean) / sqrt(variance * sd * sd + spread / (n - 1)) AS b FROM (SELECT *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS spread FROM asked) JOIN tops USING (trials) JOIN largest USING (trials)),
probs AS (SELECT *, round({_phi('a')}, 9) AS dsr_l, round({_phi('b')}, 9) AS dsr_ls_gaussian, round(exp(-exp(-(b * pi() / sqrt(6) + 0.5772156649015329))), 9) AS dsr_ls_gumbel FROM scored)"""
_MOMENTS = "count({v}) AS n, avg({v}) / stddev_samp({v}) AS sr, avg(power({v} - m, 3)) / power(avg(power({v} - m, 2)), 1.5) AS skew, avg(power({v} - m, 4)) / power(avg(power({v} - m, 2)), 2) AS kurt"

ORACLES["scenario_grid"] = f"""WITH {BASE}{WALK}{NET}, base AS (SELECT stage, {_MOMENTS.format(v='net')} FROM (SELECT *, avg(net) OVER (PARTITION BY stage) AS m FROM net) GROUP BY stage),
ks AS (SELECT unnest([3, 7, 9]) AS trials), asked AS (SELECT * FROM base CROSS JOIN ks CROSS JOIN (SELECT unnest([0.0001, 0.001, 0.01])::DOUBLE AS variance)), {_LARGEST}
SELECT stage, round(sr, 9) AS sr, variance, trials, dsr_l, dsr_ls_gaussian, dsr_ls_gumbel FROM probs""".replace("base AS (SELECT stage,", "stats AS (SELECT stage,").replace("FROM base CROSS JOIN ks", "FROM stats CROSS JOIN ks")
ORACLES["sensitivity_grid"] = f"""{ORACLES['search_scenarios'].replace('SELECT ' + "'variance' AS kind", ", scenarios AS MATERIALIZED (SELECT 'variance' AS kind", 1).replace('round(var_samp(budget)', '(var_samp(budget)').replace(', 9) AS value', ') AS value').replace(', 9) FROM budgets', ') FROM budgets')}),
every AS (SELECT asset AS config, exp(ret) - 1 AS r FROM rets UNION ALL SELECT 'equal_weight', avg(exp(ret) - 1) FROM rets GROUP BY date),
stats AS (SELECT config, {_MOMENTS.format(v='r')} FROM (SELECT *, avg(r) OVER (PARTITION BY config) AS m FROM every) GROUP BY config),
ks AS (SELECT DISTINCT value::INT AS trials FROM scenarios WHERE kind = 'trials'),
asked AS (SELECT stats.*, v.name AS variance_scenario, v.value AS variance, k.name AS k_scenario, k.value::INT AS trials FROM stats CROSS JOIN (SELECT * FROM scenarios WHERE kind = 'variance') v CROSS JOIN (SELECT * FROM scenarios WHERE kind = 'trials') k), {_LARGEST}
SELECT config, round(sr * sqrt(252), 9) AS sharpe, variance_scenario, round(variance, 9) AS variance, k_scenario, trials, dsr_l, dsr_ls_gaussian, dsr_ls_gumbel FROM probs"""


@query("seed_study")
def seed_study(spark, d):
    """Three seeds trained and walked by the resumable study: Sharpe ratios of excess net returns in the test stage, and the networks' regime effect."""
    r = _lstm_returns(spark, d)
    base = wf.Options(n_states=2, initial_window=800, limits=_LIMITS, lstm_epochs=200)
    tables = seeds.study(r, [0, 1, 2], base, f"{io.shared_folder(spark)}/quillon-seeds-{uuid.uuid4().hex}")
    rows = tables.withColumnRenamed("seed", "scenario")
    daily = st.net_excess(wf.table(rows, "returns"), wf.table(rows, "executions"), daily_rates(spark, d, r), ["scenario", "config"])
    each = daily.where(ts.stage_label(BOUNDS) == "test").groupBy(F.col("scenario").alias("seed"), "config").agg(ev.sharpe(F.col("excess")).alias("sharpe"))
    return ev.effects(each, ["seed"], "config", "sharpe", {"lstm_regime_effect": ("lstm_regime", "lstm_baseline"), "erc_regime_effect": ("erc_regime", "erc_baseline")})


@query("walk_forward_stream")
def walk_forward_stream(spark, d):
    """The walk as a stream over files of days, broken off and started again from its checkpoint: the batch walk's measures."""
    options = {"two_states": wf.Options(n_states=2, initial_window=1000, limits=_LIMITS)}
    folder = f"{io.shared_folder(spark)}/quillon-stream-{uuid.uuid4().hex}"
    days = sw.day_rows(_returns(spark, d).withColumn("scenario", F.lit("two_states")))
    half = F.col("date") < F.lit("1999-01-16").cast("date")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, sw.STORE)
    try:
        for part in (days.where(half), days.where(~half)):
            part.coalesce(1).write.mode("append").parquet(f"{folder}/days")
            source = spark.readStream.schema(days.schema).parquet(f"{folder}/days")
            run = sw.stream(source, options).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return ev.performance(wf.table(spark.read.parquet(f"{folder}/rows"), "returns"), ["scenario", "config"])


ORACLES["projection"] = f"""WITH RECURSIVE {BASE}, decided AS MATERIALIZED (SELECT 'one' AS config, DATE '2000-01-01' AS date, list(asset ORDER BY asset) AS names, [1 / 15, 2 / 15, 3 / 15, 4 / 15, 5 / 15]::DOUBLE[] AS raw, [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] AS b, 5 AS n FROM (SELECT DISTINCT asset FROM rets)), {_BISECTED}
SELECT unnest(names) AS asset, round(unnest(raw), 9) AS raw, round(unnest(w), 9) AS weight FROM done"""
_WHOLE = _SHRUNK.replace("FROM trails)", "FROM whole)")
ORACLES["erc_weights"] = f"""WITH RECURSIVE {BASE}, whole AS MATERIALIZED (SELECT DATE '2000-01-01' AS date, x.asset AS i, y.asset AS j, covar_samp(x.ret, y.ret) AS cov FROM rets x JOIN rets y USING (date) GROUP BY x.asset, y.asset){_WHOLE}, {_FIXED_POINT}, {_LINKAGE}, {_HALVES},
risk AS (SELECT unnest(names) AS asset, unnest(w) AS erc, unnest(list_transform(part, lambda v: v / list_sum(part))) AS share FROM p), hrp AS (SELECT names[s[1]] AS asset, w AS hrp FROM halves WHERE len(s) = 1)
SELECT asset, round(erc, 9) AS erc, round(hrp, 9) AS hrp, round(share, 9) AS share FROM risk JOIN hrp USING (asset)"""
