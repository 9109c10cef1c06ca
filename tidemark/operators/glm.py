"""Spline Poisson regression of event counts on position.

The design is a natural cubic regression spline per dimension (tensor product for several), centered over the
samples.  Newton steps need only X'WX and X'(y - mu), which each task adds up for its rows; the driver solves a
system of the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.checks import FittingError
from ..functions.exprs import EPS

#: Groups of tasks whose sums are added before a unit's are.
GROUPS = 64


def inner_knots(low: float, high: float, spacing: float) -> np.ndarray:
    """Knots at multiples of the spacing strictly inside the data."""
    n = int(np.ceil((high - low) / spacing))
    k = low + spacing * np.arange(1, max(n, 1))
    return k[k < high]


class NaturalSpline:
    """Cubic regression spline by its values at the knots; linear beyond the ends."""

    def __init__(self, knots: np.ndarray):
        self.knots = np.asarray(knots, float)
        h = np.diff(self.knots)
        n = len(self.knots)
        d = np.zeros((max(n - 2, 0), n))
        b = np.zeros((max(n - 2, 0), max(n - 2, 0)))
        for i in range(n - 2):
            d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
            b[i, i] = (h[i] + h[i + 1]) / 3
            if i + 1 < n - 2:
                b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
        self.second = np.zeros((n, n))  # second derivatives at the knots as a map of the values there
        if n > 2:
            self.second[1:-1] = np.linalg.solve(b, d)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        k, n = self.knots, len(self.knots)
        j = np.clip(np.searchsorted(k, x, side="right") - 1, 0, n - 2)
        h = k[j + 1] - k[j]
        left, right = (k[j + 1] - x) / h, (x - k[j]) / h
        inside = (x >= k[0]) & (x <= k[-1])
        cl = np.where(inside, (left**3 - left) * h * h / 6, 0.0)
        cr = np.where(inside, (right**3 - right) * h * h / 6, 0.0)
        out = cl[:, None] * self.second[j] + cr[:, None] * self.second[j + 1]
        rows = np.arange(len(x))
        out[rows, j] += left
        out[rows, j + 1] += right
        if (~inside).any():  # slope at the end knot
            for side, at in ((x < k[0], 0), (x > k[-1], n - 1)):
                if side.any():
                    i, step = (0, k[1] - k[0]) if at == 0 else (n - 2, k[-1] - k[-2])
                    slope = np.zeros(n)
                    slope[i], slope[i + 1] = -1 / step, 1 / step
                    bend = self.second[0] / 3 + self.second[1] / 6 if at == 0 else -(self.second[n - 1] / 3 + self.second[n - 2] / 6)
                    slope = slope - bend * step if at == 0 else slope - bend * step
                    value = np.zeros(n)
                    value[at] = 1
                    out[side] = value[None] + (x[side] - k[at])[:, None] * slope[None]
        return out


@dataclass
class Design:
    """Columns: 1 and the centered tensor product of the dimensions' splines."""

    splines: list[NaturalSpline]
    center: np.ndarray | None = None

    @classmethod
    def over(cls, samples: DataFrame, columns: Sequence[str], spacing: float) -> "Design":
        ends = samples.agg(*(f(c) for c in columns for f in (F.min, F.max))).first()
        splines = []
        for k in range(len(columns)):
            low, high = float(ends[2 * k]), float(ends[2 * k + 1])
            splines.append(NaturalSpline(np.concatenate([[low], inner_knots(low, high, spacing), [high]])))
        out = cls(splines)
        n = out.raw(np.array([[s.knots[0] for s in splines]])).shape[1]

        def sums(frames):
            total, count = np.zeros(n), 0
            for pdf in frames:
                x = pdf[list(columns)].to_numpy(float)
                x = x[~np.isnan(x).any(axis=1)]
                total += out.raw(x).sum(axis=0)
                count += len(x)
            yield pd.DataFrame({"k": np.arange(n + 1), "v": np.append(total, count)})

        rows = samples.select(*columns).mapInPandas(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        v = np.array([r["v"] for r in rows])
        out.center = v[:-1] / max(v[-1], 1)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), 1))
        for k, s in enumerate(self.splines):
            b = s(x[:, k])
            out = (out[:, :, None] * b[:, None, :]).reshape(len(x), -1)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows with NaN give NaN; one spline column is left out, as centering makes one redundant."""
        x = np.atleast_2d(np.asarray(x, float))
        bad = np.isnan(x).any(axis=1)
        b = (self.raw(np.where(bad[:, None], 0.0, x)) - self.center)[:, :-1]
        out = np.concatenate([np.ones((len(x), 1)), b], axis=1)
        out[bad] = np.nan
        return out


def fit_poisson(counts: DataFrame, design: Design, columns: Sequence[str], n: str = "n", weight: str | None = None, l2: float = 1e-3, steps: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """Coefficients of the log rate: minimises mean weighted (mu - y log mu) + l2 * sum beta[1:]^2."""
    columns = list(columns)
    size = design(np.array([[s.knots[0] for s in design.splines]])).shape[1]
    rows = counts.select(*columns, F.col(n).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    for c in columns:
        rows = rows.where(~F.isnan(c) & F.col(c).isNotNull())
    mean = rows.agg(F.sum(F.col("__y") * F.col("__w")).alias("y"), F.sum("__w").alias("w")).first()
    if not mean["w"]:
        raise FittingError("no weight to fit to")
    beta = np.zeros(size)
    beta[0] = np.log(max(mean["y"] / mean["w"], EPS))
    pen = np.full(size, 2 * l2)
    pen[0] = 0

    def moments(beta):
        def run(frames):
            g, h, f = np.zeros(size), np.zeros((size, size)), 0.0
            for pdf in frames:
                x, y, w = design(pdf[columns].to_numpy(float)), pdf["__y"].to_numpy(), pdf["__w"].to_numpy()
                eta = np.clip(x @ beta, -50, 50)
                mu = np.exp(eta)
                g += x.T @ (w * (y - mu))
                h += (x * (w * mu)[:, None]).T @ x
                f += float((w * (mu - y * eta)).sum())
            yield pd.DataFrame({"k": np.arange(size * size + size + 1), "v": np.concatenate([h.ravel(), g, [f]])})

        got = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # columns squared
        v = np.array([r["v"] for r in got]) / mean["w"]
        return v[: size * size].reshape(size, size), v[size * size: -1], v[-1]

    h, g, f = moments(beta)
    value = f + (pen / 2 * beta**2).sum()
    for _ in range(steps):
        step = np.linalg.solve(h + np.diag(pen) + 1e-10 * np.eye(size), g - pen * beta)
        scale = 1.0
        for _ in range(20):
            h2, g2, f2 = moments(beta + scale * step)
            new = f2 + (pen / 2 * (beta + scale * step) ** 2).sum()
            if new <= value + 1e-12:
                break
            scale /= 2
        beta, h, g, moved, value = beta + scale * step, h2, g2, abs(value - new), new
        if np.abs(scale * step).max() < tolerance or moved < 1e-14:
            return beta
    return beta


def fit_units(samples: DataFrame, counted: DataFrame, design: Design, columns: Sequence[str], unit: str = "unit", n: str = "n", weight: str | None = None, l2: float = 1e-3, steps: int = 50, tolerance: float = 1e-6) -> dict:
    """{unit: coefficients}: fit_poisson() of every unit, all of them in the same passes over the samples.

    counted: (unit, columns, n, weight) of the samples with events, so no grid of units and samples is made.  A pass
    adds up, for each unit that still moves, as many numbers as the square of the columns: each task one array a
    unit, those in groups of tasks, and those in one group a unit, which also solves the unit's Newton step.  The
    driver gets steps and values only, a few numbers a column.
    """
    columns = list(columns)
    size = design(np.array([[s.knots[0] for s in design.splines]])).shape[1]
    rows = counts.select(*columns, F.col(n).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    for c in columns:
        rows = rows.where(~F.isnan(c) & F.col(c).isNotNull())
    mean = rows.agg(F.sum(F.col("__y") * F.col("__w")).alias("y"), F.sum("__w").alias("w")).first()
    if not mean["w"]:
        raise FittingError("no weight to fit to")
    beta = np.zeros(size)
    beta[0] = np.log(max(mean["y"] / mean["w"], EPS))
    pen = np.full(size, 2 * l2)
    pen[0] = 0

    def moments(beta):
        def run(frames):
            g, h, f = np.zeros(size), np.zeros((size, size)), 0.0
            for pdf in frames:
                x, y, w = design(pdf[columns].to_numpy(float)), pdf["__y"].to_numpy(), pdf["__w"].to_numpy()
                eta = np.clip(x @ beta, -50, 50)
                mu = np.exp(eta)
                g += x.T @ (w * (y - mu))
                h += (x * (w * mu)[:, None]).T @ x
                f += float((w * (mu - y * eta)).sum())
            yield pd.DataFrame({"k": np.arange(size * size + size + 1), "v": np.concatenate([h.ravel(), g, [f]])})

        got = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # columns squared
        v = np.array([r["v"] for r in got]) / mean["w"]
        return v[: size * size].reshape(size, size), v[size * size: -1], v[-1]

    h, g, f = moments(beta)
    value = f + (pen / 2 * beta**2).sum()
    for _ in range(steps):
        step = np.linalg.solve(h + np.diag(pen) + 1e-10 * np.eye(size), g - pen * beta)
        scale = 1.0
        for _ in range(20):
            h2, g2, f2 = moments(beta + scale * step)
            new = f2 + (pen / 2 * (beta + scale * step) ** 2).sum()
            if new <= value + 1e-12:
                break
            scale /= 2
        beta, h, g, moved, value = beta + scale * step, h2, g2, abs(value - new), new
        if np.abs(scale * step).max() < tolerance or moved < 1e-14:
            return beta
    return beta


def fit_units(samples: DataFrame, counted: DataFrame, design: Design, columns: Sequence[str], unit: str = "unit", n: str = "n", weight: str | None = None, l2: float = 1e-3, steps: int = 50, tolerance: float = 1e-6) -> dict:
    """{unit: coefficients}: fit_poisson() of every unit, all of them in the same passes over the samples.

    counted: (unit, columns, n, weight) of the samples with events, so no grid of units and samples is made.  A pass
    returns sums of the number of columns squared for each unit that still moves.
    """
    columns = list(columns)
    size = design(np.array([[s.knots[0] for s in design.splines]])).shape[1]
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)
    rows, hits = samples.where(known).select(*columns, w), counted.where(known).select(F.col(unit).alias("__u"), *columns, (F.col(n) * w).alias("__y"))
    mass = rows.agg(F.sum("__w")).first()[0]
    if not mass:
        raise FittingError("no weight to fit to")

    def seen(frames):
        for pdf in frames:
            for u, own in pdf.groupby("__u", sort=False):
                yield pd.DataFrame({"__u": u, "k": np.arange(size), "v": design(own[columns].to_numpy(float)).T @ own["__y"].to_numpy()})

    schema = T.StructType([hits.schema["__u"], T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])
    sums: dict = {}
    for r in hits.mapInPandas(seen, schema).groupBy("__u", "k").agg(F.sum("v").alias("v")).collect():  # columns a unit
        sums.setdefault(r["__u"], np.zeros(size))[r["k"]] = r["v"] / mass
    pen = np.full(size, 2 * l2)
    pen[0] = 0

    def moments(betas: dict) -> dict:
        """{unit: (Newton step, value)} at the given coefficients."""
        names, stack = list(betas), np.array(list(betas.values()))
        block = size * size + size + 1
        seen_y = np.array([sums[u] for u in names])

        def run(frames):
            out = np.zeros((len(names), block))
            for pdf in frames:
                x, w = design(pdf[columns].to_numpy(float)), pdf["__w"].to_numpy()
                mu = np.exp(np.clip(x @ stack.T, -50, 50)) * w[:, None]
                for k in range(len(names)):
                    out[k, :size * size] += ((x * mu[:, k:k + 1]).T @ x).ravel()
                out[:, size * size:-1] += mu.T @ x
                out[:, -1] += mu.sum(axis=0)
            task = TaskContext.get().partitionId()
            yield pd.DataFrame({"k": np.arange(len(names)), "task": task % GROUPS, "v": list(out)})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": [pdf["k"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

        def solved(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["k"].iloc[0])
            v, b = np.sum(np.stack(pdf["v"].to_list()), axis=0) / mass, stack[k]
            h, g = v[:size * size].reshape(size, size), seen_y[k] - v[size * size:-1]
            step = np.linalg.solve(h + np.diag(pen) + 1e-10 * np.eye(size), g - pen * b)
            return pd.DataFrame({"k": [k], "value": [v[-1] - seen_y[k] @ b + (pen / 2 * b**2).sum()], "step": [step]})

        parts = rows.mapInPandas(run, "k int, task int, v array<double>").groupBy("k", "task").applyInPandas(added, "k int, v array<double>")
        got = parts.groupBy("k").applyInPandas(solved, "k int, value double, step array<double>").collect()  # columns a unit
        return {names[r["k"]]: (np.array(r["step"]), r["value"]) for r in got}

    beta = {u: np.r_[np.log(max(v[0], EPS)), np.zeros(size - 1)] for u, v in sums.items()}
    now, moving = moments(beta), dict.fromkeys(beta, 1.0)
    step: dict = {}
    for _ in range(steps * 20):
        if not moving:
            break
        for u, scale in moving.items():
            if scale == 1.0:
                step[u] = now[u][0]
        tried = {u: beta[u] + scale * step[u] for u, scale in moving.items()}
        new = moments(tried)
        for u, scale in list(moving.items()):
            if new[u][1] > now[u][1] + 1e-12 and scale > 1e-5:
                moving[u] = scale / 2
                continue
            moved = abs(now[u][1] - new[u][1])
            beta[u], now[u], moving[u] = tried[u], new[u], 1.0
            if np.abs(scale * step[u]).max() < tolerance or moved < 1e-14:
                del moving[u]
    return beta


def fields(design: Design, coefficients: dict, points: np.ndarray, spark) -> DataFrame:
    """(unit, bin, field) of fitted units: exp(X beta), not under EPS."""
    x = design(points)
    rows = [(u, k, float(max(v, EPS))) for u, beta in coefficients.items() for k, v in enumerate(np.exp(x @ beta))]
    unit = "string" if rows and isinstance(rows[0][0], str) else "long"
    return spark.createDataFrame(rows, f"unit {unit}, bin long, field double")
