"""The walk-forward as a stateful stream: one row a scenario and day in, the rows of every table out.

Per scenario the state holds what a day needs from those before it: the fitted regimes and densities, regime probabilities, log-odds,
holdings, pending orders and networks, each typed; and the days themselves, which are read at fits only. A query
that restarts from its checkpoint goes on in mid-run. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).

Days of a micro-batch are put in order; a day that is not after the last one of its scenario is late or repeated and ignored, as a decision
once made is never revised. Whether a day decides is part of the row: trading calendars are known in advance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import densities as de
from ..functions import hmm
from ..functions.lstm import BudgetLstm
from ..plans import walkforward as wf

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = "date date, decides boolean, ret array<double>, overnight array<double>, intraday array<double>, features array<double>"
OUT = f"scenario string, {wf.ALL}"
_COLUMNS = wf.columns_of(OUT)
_EMPTY = dict.fromkeys(_COLUMNS)
_REGIMES = "start array<double>, step array<double>, means array<double>, covs array<double>"
_FIT = f"{_REGIMES}, nu double, mean array<double>, scale array<double>, nus array<double>, mix_means array<double>, mix_scales array<double>, cov array<double>, raw_covs array<double>, state_covs array<double>"
_NOW = "last string, seen int, count int, refits int, ell double, state array<double>"
_PAST = "ret array<double>, decides boolean, features array<double>, ahead array<double>"


def day_rows(returns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, date, decides, ret, overnight, intraday, features: a row a day, arrays in asset order; the last day of each month decides."""
    keys = keys or ["scenario"]
    pick = F.sort_array(F.collect_list(F.struct("asset", "ret", "overnight", "intraday"))).alias("v")
    features = F.first("features").alias("features") if "features" in returns.columns else F.lit(None).cast("array<double>").alias("features")
    day = returns.groupBy(*keys, "date").agg(pick, features)
    later = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    decides = later.isNull() | (F.trunc(later, "month") != F.trunc("date", "month"))
    return day.withColumn("decides", decides).select(*keys, "date", "decides", F.col("v.ret").alias("ret"), F.col("v.overnight").alias("overnight"), F.col("v.intraday").alias("intraday"), "features")


def _flat(a: np.ndarray) -> list[float]:
    return np.asarray(a, float).ravel().tolist()


def _regimes(row: tuple) -> hmm.Regimes:
    k = len(row[0])
    f = len(row[2]) // k
    return hmm.Regimes(np.array(row[0]), np.reshape(row[1], (k, k)), np.reshape(row[2], (k, f)), np.reshape(row[3], (k, f, f)))


def _fit_row(s: wf._Signals) -> tuple:
    m = s.regimes
    parts = (m.start, m.step, m.means, m.covs), (s.pooled.mean, s.pooled.scale, s.mixture.nus, s.mixture.means, s.mixture.scales, s.cov, s.raw_covs, s.covs)
    return (*map(_flat, parts[0]), float(s.pooled.nu), *map(_flat, parts[1]))


def _signals(row: tuple) -> wf._Signals:
    m = _regimes(row[:4])
    k, f = m.means.shape
    mean, scale, nus, means, scales, cov, raw, covs = (np.array(v) for v in row[5:])
    mixture = de.Mixture(nus, means.reshape(k, f), scales.reshape(k, f, f))
    return wf._Signals(m, de.Pooled(row[4], mean, scale.reshape(f, f)), mixture, cov.reshape(f, f), raw.reshape(k, f, f), covs.reshape(k, f, f))


def _array(v) -> np.ndarray | None:
    """An array; null, which pandas may turn into a number, is None."""
    return np.asarray(v, float) if hasattr(v, "__len__") else None


class WalkProcessor(StatefulProcessor):
    """Keeps a ``Walk`` in typed state between micro-batches."""

    def __init__(self, options: dict[str, dict], next_open: bool, features: int | None):
        self.options, self.next_open, self.features = options, next_open, features

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", _NOW)
        self.fit = handle.getValueState("fit", _FIT)
        self.reference = handle.getValueState("reference", _REGIMES)
        self.days = handle.getListState("days", _PAST)
        self.held = handle.getMapState("held", "config string", "weights array<double>")
        self.pending = handle.getMapState("pending", "config string", "weights array<double>")
        self.nets = handle.getMapState("nets", "kind string, part string", "shape array<int>, value array<double>")

    def _past(self) -> list[wf.Day]:
        return [wf.Day(np.array(r[0]), bool(r[1]), _array(r[2]), _array(r[3])) for r in self.days.get()] if self.days.exists() else []

    def _load(self, o: wf.Options) -> wf.Walk:
        one = wf.Walk(o, self._past)
        if self.now.exists():
            one.last, one.seen, one.count, one.refits, one.ell, state = self.now.get()
            one.state = _array(state)
        if self.fit.exists():
            one.signals, one.reference = _signals(self.fit.get()), _regimes(self.reference.get())
            one.held = {k[0]: np.array(v[0]) for k, v in self.held.iterator()}
            one.pending = {k[0]: np.array(v[0]) for k, v in self.pending.iterator()}
            n = len(one.signals.cov)
            for (kind, part), (shape, value) in self.nets.iterator():
                net = one.nets.setdefault(kind, BudgetLstm(1, n, floor=0.5 / n))
                net.p[part] = np.reshape(np.array(value), tuple(shape))
        return one

    def _save(self, one: wf.Walk, fitted: object, trained: object) -> None:
        rows = [(_flat(d.ret), bool(d.decides), None if d.features is None else _flat(d.features), None if d.ahead is None else _flat(d.ahead)) for d in one.fresh]
        if one.rewritten:
            self.days.put(rows)
        elif rows:
            self.days.appendList(rows)
        self.now.update((one.last, one.seen, one.count, one.refits, one.ell, None if one.state is None else _flat(one.state)))
        if one.signals is None:
            return
        if one.signals is not fitted:
            m = one.reference
            self.fit.update(_fit_row(one.signals))
            self.reference.update(tuple(map(_flat, (m.start, m.step, m.means, m.covs))))
        for config, w in one.held.items():
            self.held.updateValue((config,), (_flat(w),))
        for config in one.names():
            if config in one.pending:
                self.pending.updateValue((config,), (_flat(one.pending[config]),))
            elif self.pending.containsKey((config,)):
                self.pending.removeKey((config,))
        if one.nets is not trained:
            for kind, net in one.nets.items():
                for part, value in net.p.items():
                    self.nets.updateValue((kind, part), (list(map(int, value.shape)), _flat(value)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        one = self._load(wf.from_dict(self.options[key[0]]))
        fitted, trained, out = one.signals, one.nets, []
        for r in pd.concat(list(rows)).sort_values("date").itertuples():
            if str(r.date) <= one.last:
                continue
            legs = (_array(r.overnight), _array(r.intraday)) if self.next_open else (None, None)
            features = _array(r.features)
            if features is None and self.features is not None:
                features = np.full(self.features, np.nan)
            found = one.step(r.date, np.asarray(r.ret, float), bool(r.decides), *legs, features)
            one.last = str(r.date)
            for table, values in found.items():
                names = wf.columns_of(wf.TABLES[table])
                out += [{**_EMPTY, "scenario": key[0], "table": table, **dict(zip(names, v))} for v in values]
        self._save(one, fitted, trained)
        yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def close(self) -> None:
        pass


def stream(days: DataFrame, scenarios: dict[str, wf.Options], next_open: bool = True, features: int | None = None) -> DataFrame:
    """The rows of all tables, marked by ``table``, from a stream of ``day_rows``.

    The networks read ``features`` values a day (none that are finite where the row has null), or without them the day's returns in per cent.
    """
    if days.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"the walk's state needs spark.sql.streaming.stateStore.providerClass={STORE}")
    options = {k: asdict(o) for k, o in scenarios.items()}
    return days.groupBy("scenario").transformWithStateInPandas(WalkProcessor(options, next_open, features), OUT, "Append", "None")

