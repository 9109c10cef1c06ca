"""Putting likelihoods together: penalty, local kernel, missing data, the table of models, state bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .geometry import Environment
from .transitions import StateSpace


def _lost(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.isnan(c) | F.col(c).isNull()
    return out


def non_local_penalty(positions: DataFrame, env: Environment, amount: float, std: float, columns: Sequence[str] | None = None, out: str = "penalty") -> DataFrame:
    """``positions`` with an array over interior bins: -amount * exp(-d^2 / (2 std^2)) of the path length d.

    0 at bins that cannot be reached and wherever the position is unknown.
    """
    columns = list(columns or env.columns)
    zero = F.array_repeat(F.lit(0.0), len(env.interior_bins))
    d = env.distance[:, env.interior_bins]
    value = np.where(np.isfinite(d), -amount * np.exp(-0.5 * d * d / (std * std)), 0.0)
    near = env.with_bin_rows(positions, value, columns, "__row")
    return near.withColumn(out, F.when(_lost(columns), zero).otherwise(F.col("__row"))).drop("__row")


def local_kernel(positions: DataFrame, env: Environment, std: float, columns: Sequence[str] | None = None, out: str = "kernel") -> DataFrame:
    """``positions`` with the log kernel of the local state over interior bins; its exponentials sum to their number.

    std 0: all on the animal's bin.  Unknown positions give 0 everywhere.  The kernel depends on the bin alone: it is
    worked out once a bin, and rows are joined to it.
    """
    columns, inside = list(columns or env.columns), env.interior_bins
    n = len(inside)
    zero = F.array_repeat(F.lit(0.0), n)
    if std == 0:
        value = np.where(np.arange(len(env.points))[:, None] == np.asarray(inside)[None, :], np.log(n), -np.inf)
    else:
        d = env.distance[:, inside]
        raw = np.where(np.isfinite(d), -0.5 * d * d / (std * std), -np.inf)
        top = raw.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):  # a bin from which none can be reached has no kernel: NaN
            value = raw - (top + np.log(np.exp(raw - top).sum(axis=1, keepdims=True)) - np.log(n))
    near = env.with_bin_rows(positions, value, columns, "__row")
    return near.withColumn(out, F.when(_lost(columns), zero).otherwise(F.col("__row"))).drop("__row")


def add_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def missing_rows(positions: DataFrame, columns: Sequence[str], flag: str | None = None) -> DataFrame:
    """(t_idx, is_missing): flagged rows and those without a position."""
    own = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    return positions.select("t_idx", (own | _lost(columns)).alias("is_missing"))


def assemble(space: StateSpace, parts: dict, clock: DataFrame, missing: DataFrame | None = None, extra: dict[int, DataFrame] | None = None) -> DataFrame:
    """(t_idx, ll array over interior state bins).

    parts: likelihood tables (t_idx, ll) by what a state observes, each made once and shared by all states that
    observe the same: ("no_event",), ("local", environment, group), ("bins", environment, group); ll is a number or
    an array over interior bins.  extra: by state, an array to add (penalty or kernel).  Missing rows are 0.
    """
    out = clock.select("t_idx")
    pieces = []
    for k, o in enumerate(space.observations):
        n = int(((space.states == k) & space.inside).sum())
        key = ("no_event",) if o.no_event else ("local", *o.key) if o.local and not space.local_bins else ("bins", *o.key)
        name = f"__s{k}"
        table = parts[key]
        wide = dict(table.dtypes)["ll"].startswith("array")
        out = out.join(table.select("t_idx", F.col("ll").alias(name)), "t_idx", "left")
        piece = F.col(name) if wide else F.array_repeat(F.col(name), n)
        if extra and k in extra:
            out = out.join(extra[k].select("t_idx", F.col("value").alias(f"__e{k}")), "t_idx", "left")
            piece = add_arrays(piece, F.col(f"__e{k}"))
        pieces.append(F.coalesce(piece, F.array_repeat(F.lit(0.0), n)))
    total = F.concat(*pieces)
    if missing is not None:
        out = out.join(missing.select("t_idx", "is_missing"), "t_idx", "left")
        total = F.when(F.coalesce("is_missing", F.lit(False)), F.transform(total, lambda x: F.lit(0.0))).otherwise(total)
    return out.select("t_idx", total.alias("ll"))
