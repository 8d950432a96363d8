"""A streaming edition of the reliability path: day files in, one updated weight a day and scenario out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reliability import LIMIT


def stream(scores: DataFrame, alpha: float = 0.97) -> DataFrame:
    """scenario, date, pi from a stream of (scenario, date, l0, l1).

    The log-odds are the state. Days of one micro-batch are put in order; a day that is not after the last one of its scenario
    is late and ignored, as a decision once made is never revised.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ell, last = state.get if state.exists else (0.0, "")
        rows = []
        for r in pd.concat(list(frames)).sort_values("date").itertuples():
            day = str(r.date)
            if day <= last:
                continue
            ell, last = max(-LIMIT, min(LIMIT, alpha * ell + r.l1 - r.l0)), day
            rows.append((key[0], r.date, 1 / (1 + math.exp(-ell))))
        state.update((ell, last))
        yield pd.DataFrame(rows, columns=["scenario", "date", "pi"])

    return scores.groupBy("scenario").applyInPandasWithState(update, "scenario string, date date, pi double", "ell double, last string", "append", GroupStateTimeout.NoTimeout)
