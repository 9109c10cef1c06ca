"""The causal filter on streams: event-time bins with a watermark, then a stateful fold per session."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hmm import filter_array


def windowed_counts(events: DataFrame, width: str, late: str, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """(keys, start, n): tumbling counts; a window is emitted once the watermark has passed it."""
    counted = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), "n")


def streaming_filter(likelihoods: DataFrame, initial: Sequence[float], transition: Sequence[Sequence[float]], key: str, order: str = "t_idx") -> DataFrame:
    """(key, t_idx, filtered, log_norm) for a stream of (key, t_idx, ll).

    The state of a session is its predicted vector; a batch's rows are folded in order of time.  Rows of a later
    batch are taken to come later; the smoother needs the future and stays a batch operator.
    """
    pi, a = np.asarray(initial, float), np.asarray(transition, float)
    kinds = dict(likelihoods.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, filtered array<double>, log_norm double"

    def step(name, frames, state: GroupState):
        p = np.asarray(state.get[0]) if state.exists else pi
        rows = pd.concat(list(frames)).sort_values(order)
        ll = np.stack(rows["ll"].to_list()).astype(float)
        filtered, _, norms = filter_array(p, ll, a)
        state.update(((filtered[-1] @ a).tolist(),))
        yield pd.DataFrame({key: [name[0]] * len(rows), order: rows[order].to_numpy(), "filtered": list(filtered), "log_norm": norms})

    return likelihoods.groupBy(key).applyInPandasWithState(step, out, "p array<double>", "append", GroupStateTimeout.NoTimeout)
