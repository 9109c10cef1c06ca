"""Goodness of fit of intensities: time rescaling, Kolmogorov-Smirnov, residuals, empirical distributions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.exprs import normal_ppf
from .asof import interpolate
from . import ordered
from .windows import cumulative_trapezoid, difference, over, running_sum

_TINY = 2.220446049250313e-16
#: Intervals of a block of the full autocorrelation.
BLOCK = 32_768


def rescaled_intervals(df: DataFrame, intensity: str = "intensity", spike: str = "is_spike", keys: Sequence[str] = (), order: str = "t_idx", censored: bool = True) -> DataFrame:
    """(keys, t_idx, isi, u) of each event: intervals of integrated intensity, and their exponential distribution.

    The integral is a running trapezoid with unit spacing (intensities are per bin).  ``censored`` divides by
    the share of an interval that the trial could have held.
    """
    keys = list(keys)
    area = cumulative_trapezoid(df, intensity, "__area", order, keys)
    if keys:
        area = area.withColumn("__end", F.max("__area").over(Window.partitionBy(*keys)))
    else:
        area = area.crossJoin(F.broadcast(area.agg(F.max("__area").alias("__end"))))  # one row
    hits = area.where(F.col(spike).cast("boolean"))
    out = difference(hits, "__area", "isi", order, keys).withColumn("isi", F.coalesce("isi", "__area"))
    room = 1 - F.exp(-(F.col("__end") - F.col("__area") + F.col("isi"))) if censored else F.lit(1.0)
    return out.select(*keys, order, "isi", ((1 - F.exp(-F.col("isi"))) / room).alias("u"))


def _ranked(intervals: DataFrame, keys: Sequence[str], u: str) -> DataFrame:
    """With ``__k``, the rank from 1 within the keys, and ``__n``, their number of rows."""
    if keys:
        w = Window.partitionBy(*keys)
        return intervals.withColumn("__k", F.row_number().over(w.orderBy(u))).withColumn("__n", F.count("*").over(w))
    placed = ordered.positions(intervals, [u]).withColumn("__k", F.col(ordered.POSITION) + 1)
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("__n"))))  # one row


def ks_statistic(intervals: DataFrame, keys: Sequence[str] = (), u: str = "u") -> DataFrame:
    """(keys, n, ks): largest gap between the sorted values and (k + 0.5) / n."""
    ranked = _ranked(intervals, keys, u)
    return ranked.groupBy(*keys).agg(F.max("__n").alias("n"), F.max(F.abs(F.col(u) - (F.col("__k") - 0.5) / F.col("__n"))).alias("ks"))


def qq_points(intervals: DataFrame, keys: Sequence[str] = (), u: str = "u") -> DataFrame:
    """(keys, model, empirical): the points of a quantile plot."""
    return _ranked(intervals, keys, u).select(*keys, ((F.col("__k") - 0.5) / F.col("__n")).alias("model"), F.col(u).alias("empirical"))


def interval_autocorrelation(intervals: DataFrame, max_lag: int, keys: Sequence[str] = (), u: str = "u", order: str = "t_idx") -> DataFrame:
    """(keys, lag, c): correlation of the intervals' normal scores at lags up to max_lag, 1 at lag 0.

    Lags are leads in one window pass (negative lags mirror them), not a join of all pairs.
    """
    keys = list(keys)
    p = F.least(F.greatest(F.col(u), F.lit(_TINY)), F.lit(1 - _TINY))
    w = Window.partitionBy(*keys).orderBy(order)
    z = intervals.select(*keys, order, normal_ppf(p).alias("z"))
    sums = z.select(*keys, *((F.col("z") * F.lead("z", k).over(w)).alias(f"l{k}") for k in range(max_lag + 1))).groupBy(*keys).agg(*(F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"l{k}") for k in range(max_lag + 1)))
    return sums.select(*keys, F.posexplode(F.array(*(F.col(f"l{k}") / F.col("l0") for k in range(max_lag + 1)))).alias("lag", "c"))


def lag_products(frames: Iterable[pd.DataFrame], keys: Sequence[str], block: int, max_lag: int | None) -> Iterator[pd.DataFrame]:
    """Sums of products of each two blocks of a session (or of one with itself) at the lags that their intervals reach.

    frames: rows sorted by (keys, __first, __second, __side, __i), so that the first row of a pair has side 0 and place 0.
    """
    def first(pdf):
        return np.flatnonzero((pdf["__side"].to_numpy() == 0) & (pdf["__i"].to_numpy() == 0))

    def sums(pdf):
        starts = first(pdf)
        side, at, z = pdf["__side"].to_numpy(int), pdf["__i"].to_numpy(int), pdf["__z"].to_numpy(float)
        shift = (pdf["__second"].to_numpy() - pdf["__first"].to_numpy()) * block
        lags, parts = [], []
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            n = np.bincount(side[a:b], minlength=2)
            size = 1 << int(n.sum() - 1).bit_length()
            lines = np.zeros((2, size))
            lines[side[a:b], at[a:b]] = z[a:b]
            ahead, behind = np.fft.rfft(lines)
            lag = np.arange(1 - n[0], n[1])
            lag = lag[(lag + shift[a] >= 0) & (lag + shift[a] <= (n[1] + shift[a] if max_lag is None else max_lag))]
            lags.append(lag + shift[a])
            parts.append(np.fft.irfft(np.conj(ahead) * behind, size)[lag % size])
        n = [len(x) for x in lags]
        return pd.DataFrame({**{k: pdf[k].iloc[starts].repeat(n).to_numpy() for k in keys}, "lag": np.concatenate(lags), "__part": np.concatenate(parts)})

    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(pdf):
            cut = first(pdf)[-1]
            if cut:
                yield sums(pdf.iloc[:cut])
            held = pdf.iloc[cut:]
    if held is not None:
        yield sums(held)


def full_autocorrelation(intervals: DataFrame, keys: Sequence[str] = (), u: str = "u", order: str = "t_idx", max_lag: int | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, lag, c): correlation of the intervals' normal scores at all lags (or up to ``max_lag``), 1 at lag 0.

    A session is cut in blocks of ``block`` intervals.  Each two blocks that a lag can join are neighbours in a sorted
    partition; their products at all lags are two FFTs of their own length, which return at most two lags a row; the
    products are added up by lag.
    """
    keys = list(keys)
    p = F.least(F.greatest(F.col(u), F.lit(_TINY)), F.lit(1 - _TINY))

    @F.pandas_udf("double")
    def scores(p: pd.Series) -> pd.Series:
        return p.map(NormalDist().inv_cdf)

    z = ordered.positions(intervals.select(*keys, F.col(order).alias("__at"), p.alias("__p")), ["__at"], keys)
    z = z.select(*keys, scores("__p").alias("__z"), F.pmod(ordered.POSITION, F.lit(block)).alias("__i"), F.floor(F.col(ordered.POSITION) / block).cast("long").alias("__b"))
    last = z.groupBy(*keys).agg(F.max("__b").alias("__last"))
    reach = F.col("__last") if max_lag is None else F.least(F.col("__last"), F.col("__b") + (max_lag // block + 1))
    lead = ordered.join_same(z, last, keys).select(*keys, F.col("__b").alias("__first"), F.explode(F.sequence("__b", reach)).alias("__second"), F.lit(0).alias("__side"), "__i", "__z")
    from_ = F.lit(0).cast("long") if max_lag is None else F.greatest(F.lit(0).cast("long"), F.col("__b") - (max_lag // block + 1))
    trail = z.select(*keys, F.explode(F.sequence(from_, F.col("__b"))).alias("__first"), F.col("__b").alias("__second"), F.lit(1).alias("__side"), "__i", "__z")
    schema = T.StructType([*(intervals.schema[k] for k in keys), T.StructField("lag", T.LongType()), T.StructField("__part", T.DoubleType())])

    pair = [*keys, "__first", "__second"]
    pairs = lead.unionByName(trail).repartition(*pair).sortWithinPartitions(*pair, "__side", "__i")
    sums = pairs.mapInPandas(lambda frames: lag_products(frames, keys, block, max_lag), schema).groupBy(*keys, "lag").agg(F.sum("__part").alias("__s"))
    count = z.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(F.col("__z") * F.col("__z")).alias("__all"))
    return ordered.join_same(sums, count, keys).where("lag < __n").select(*keys, "lag", over(F.col("__s"), F.col("__all")).alias("c"))


def residuals(df: DataFrame, intensity: str = "intensity", spike: str = "n", keys: Sequence[str] = (), order: str = "t_idx") -> DataFrame:
    """``df`` with the running sum of events less intensity."""
    return running_sum(df, F.col(spike) - F.col(intensity), "residual", order, list(keys))


def rescaled_at_events(intensity: DataFrame, events: DataFrame, keys: Sequence[str] = (), value: str = "intensity") -> DataFrame:
    """``events`` with isi and u: the integrated intensity interpolated at the exact event times."""
    keys = list(keys)
    area = cumulative_trapezoid(intensity, value, "area", "t", keys)
    at = interpolate(events, area.select(*keys, "t", "area"), ["area"], keys, extrapolate=False)
    at = difference(at, "area", "isi", "t", keys).withColumn("isi", F.coalesce("isi", "area"))
    return at.withColumn("u", 1 - F.exp(-F.col("isi"))).drop("area")


def empirical_cdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, cdf) at the distinct values."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    if keys:
        w = Window.partitionBy(*keys)
        return counted.select(*keys, value, (F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__n").over(w)).alias("cdf"))
    upto = ordered.scan(counted, "__n", "__upto", [value])
    return upto.crossJoin(F.broadcast(counted.agg(F.sum("__n").alias("__all")))).select(value, (F.col("__upto") / F.col("__all")).alias("cdf"))


def rosenblatt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with u_<column>: each feature's empirical distribution function at its own value (independent features)."""
    for c in columns:
        df = df.withColumn(f"u_{c}", F.cume_dist().over(Window.partitionBy(*keys).orderBy(c))) if keys else ordered.cume_dist(df, c, f"u_{c}")
    return df


def mark_rescaling(events: DataFrame, joint: Sequence[str], ground: str, keys: Sequence[str] = ()) -> DataFrame:
    """Uniform marks: joint over ground intensities, then the Rosenblatt transform of each."""
    for c in joint:
        events = events.withColumn(f"r_{c}", F.col(c) / F.col(ground))
    return rosenblatt(events, [f"r_{c}" for c in joint], keys)
