"""Ordered operators: differences, gradients, smoothing, running integrals.

With keys (sessions) each is a window over the session.  Without keys the rows are one long recording, which is cut in
parts with halo rows, and sums are prefix scans over its blocks (see ``ordered``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ordered


def _listed(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _order(keys: list[str] | None, t: str | list[str]) -> Window:
    return Window.partitionBy(*(keys or [])).orderBy(*_listed(t))


def over(a: Column, b: Column) -> Column:
    """a / b of floating-point numbers; b of 0 gives infinity with the sign of a, and NaN for 0 / 0."""
    return F.when(b == 0, a * float("inf")).otherwise(a / F.when(b != 0, b))


def gradient(df: DataFrame, value: str, out: str, t: str | None = None, order: str | list[str] = "t_idx", keys: list[str] | None = None) -> DataFrame:
    """Central differences inside, one-sided at the ends; spacing 1, or the (uneven) spacing of ``t``.

    Rows of the same ``t`` divide by 0, as floating-point numbers do: infinite, or NaN where the values are equal too.
    Which of them come first is open, and so is the result, unless ``order`` has further columns that tell.
    """
    if not keys:
        return ordered.windowed(df, lambda rows, k: gradient(rows, value, out, t, ordered.POSITION, k), 1, _listed(order))
    w = _order(keys, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    if t is None:
        inner = (after - before) / 2
        left, right = F.col(value) - before, after - F.col(value)
    else:
        a, b = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
        inner = over(a * a * after + (b * b - a * a) * F.col(value) - b * b * before, a * b * (a + b))
        left, right = over(F.col(value) - before, a), over(after - F.col(value), b)
    return df.withColumn(out, F.when(before.isNull(), right).when(after.isNull(), left).otherwise(inner))


def gaussian_weights(sigma: float, truncate: float = 8.0) -> list[float]:
    """Normalised weights at offsets -R..R, R = int(truncate * sigma + 0.5)."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def gaussian_smooth(df: DataFrame, value: str, out: str, sigma: float, order: str | list[str] = "t_idx", keys: list[str] | None = None, truncate: float = 8.0) -> DataFrame:
    """Gaussian filter with zeros beyond the ends; sigma in samples."""
    weights = gaussian_weights(sigma, truncate)
    radius = len(weights) // 2
    if not keys:
        return ordered.windowed(df, lambda rows, k: gaussian_smooth(rows, value, out, sigma, order, k, truncate), radius, _listed(order))
    w = _order(keys, order)
    around = F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w.rowsBetween(-radius, radius))
    place = F.row_number().over(w)
    missing = F.greatest(F.lit(0), F.lit(radius + 1) - place)  # rows missing before the window's first
    table = F.array(*map(F.lit, weights))
    total = F.aggregate(F.transform("__around", lambda x, i: x * F.element_at(table, (i + F.col("__missing") + 1).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("__around", around).withColumn("__missing", missing).withColumn(out, total).drop("__around", "__missing")


def cumulative_trapezoid(df: DataFrame, value: str, out: str, order: str = "t_idx", keys: list[str] | None = None, dx: float = 1.0) -> DataFrame:
    """Running integral by trapezoids of width dx, 0 at the first row."""
    if not keys:
        lag = F.lag(value).over(Window.partitionBy(ordered.PART).orderBy(ordered.POSITION))
        parts = ordered.with_halo(ordered.positions(df, [order]), 1).withColumn("__step", F.coalesce((F.col(value) + lag) / 2 * dx, F.lit(0.0))).where(ordered.HOME)
        summed = ordered.with_offsets(parts, F.col("__step"), [], ordered.PART, "__before")
        own = F.sum("__step").over(Window.partitionBy(ordered.PART).orderBy(ordered.POSITION).rowsBetween(Window.unboundedPreceding, 0))
        return summed.withColumn(out, own + F.col("__before")).drop("__step", "__before", ordered.PART, ordered.POSITION, ordered.HOME)
    w = _order(keys, order)
    step = df.withColumn("__step", F.coalesce((F.col(value) + F.lag(value).over(w)) / 2 * dx, F.lit(0.0)))
    return step.withColumn(out, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def running_sum(df: DataFrame, value: Column | str, out: str, order: str = "t_idx", keys: list[str] | None = None) -> DataFrame:
    if not keys:
        return ordered.scan(df, value, out, [order])
    return df.withColumn(out, F.sum(value).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def difference(df: DataFrame, value: str, out: str, order: str = "t_idx", keys: list[str] | None = None, first: float | None = None) -> DataFrame:
    """Difference to the row before; ``first`` for the first row."""
    if not keys:
        return ordered.windowed(df, lambda rows, k: difference(rows, value, out, order, k, first), 1, [order])
    gap = F.col(value) - F.lag(value).over(_order(keys, order))
    return df.withColumn(out, gap if first is None else F.coalesce(gap, F.lit(first)))


def lagged(df: DataFrame, value: str, out: str, order: str = "t_idx", keys: list[str] | None = None, first: float = 0.0) -> DataFrame:
    """A covariate one step late, ``first`` at the start."""
    if not keys:
        return ordered.windowed(df, lambda rows, k: lagged(rows, value, out, order, k, first), 1, [order])
    return df.withColumn(out, F.lag(value, 1, first).over(_order(keys, order)))


def trajectory_direction(df: DataFrame, value: str, out: str = "direction", order: str = "t_idx", keys: list[str] | None = None) -> DataFrame:
    """Inbound where the position falls, else Outbound; the first row is Outbound."""
    if not keys:
        return ordered.windowed(df, lambda rows, k: trajectory_direction(rows, value, out, order, k), 1, [order])
    falls = F.col(value) < F.lag(value).over(_order(keys, order))
    return df.withColumn(out, F.when(falls, "Inbound").otherwise("Outbound"))


def velocity(df: DataFrame, columns: list[str], t: str = "t", order: str | list[str] = "t_idx", keys: list[str] | None = None, sigma: float | None = None) -> DataFrame:
    """Columns v_<name>: gradients over time, of the smoothed positions where sigma (in samples) is given."""
    for c in columns:
        source = c
        if sigma:
            df = gaussian_smooth(df, c, f"__smooth_{c}", sigma, order, keys)
            source = f"__smooth_{c}"
        df = gradient(df, source, f"v_{c}", t, order, keys)
        if sigma:
            df = df.drop(source)
    return df


def speed(df: DataFrame, columns: list[str], out: str = "speed", t: str = "t", order: str | list[str] = "t_idx", keys: list[str] | None = None, sigma: float | None = None) -> DataFrame:
    moved = velocity(df, columns, t, order, keys, sigma)
    total = sum((F.col(f"v_{c}") * F.col(f"v_{c}") for c in columns), F.lit(0.0))
    return moved.withColumn(out, F.sqrt(total)).drop(*(f"v_{c}" for c in columns))


def movement_variance(df: DataFrame, columns: list[str], order: str = "t_idx", keys: list[str] | None = None) -> DataFrame:
    """Sample covariances (cov_<a>_<b>) of the first differences, rows with NaN left out."""
    w = _order(keys or [ordered.PART], order)
    if not keys:
        return _covariances(ordered.windowed(df, lambda rows, k: rows.select("*", *((F.col(c) - F.lag(c).over(w)).alias(f"__d{i}") for i, c in enumerate(columns))), 1, [order]).select(*(F.col(f"__d{i}").alias(c) for i, c in enumerate(columns))), columns, [])
    return _covariances(df.select(*(keys or []), *((F.col(c) - F.lag(c).over(w)).alias(c) for c in columns)), columns, keys)


def _covariances(steps: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    steps = steps.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns))
    return steps.groupBy(*keys).agg(*(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]))


def typical_step(clock: DataFrame, keys: list[str] | None = None) -> float:
    """Exact median of all steps of a clock (of all its sessions); 0 without any."""
    return difference(clock.select(*(keys or []), "t"), "t", "step", "t", keys).agg(F.percentile("step", 0.5)).first()[0] or 0.0


def median_step(clock: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Exact median of the clock's steps."""
    return difference(clock, "t", "step", "t_idx", keys).groupBy(*(keys or [])).agg(F.percentile("step", 0.5).alias("median_step"))
