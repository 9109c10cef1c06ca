"""Gaussian mixtures with full, tied, diagonal and spherical covariances, fitted by sums over the table.

A round of expectation-maximisation is one pass: tasks return sums of responsibilities, of weighted points and of
their products; the driver updates the parameters.  Starts are k-means++ on a bounded sample, or responsibilities.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.checks import FittingError, ValidationError
from ..functions.exprs import EPS, LOG_EPS

KINDS = ("full", "tied", "diag", "spherical")
#: Rows that the starts are drawn from at most.
START_ROWS = 20_000


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str = "full"
    bound: float = float("-inf")
    converged: bool = False

    def full_covariances(self) -> np.ndarray:
        k, d = self.means.shape
        if self.kind == "full":
            return self.covariances
        if self.kind == "tied":
            return np.repeat(self.covariances[None], k, axis=0)
        if self.kind == "diag":
            return np.stack([np.diag(c) for c in self.covariances])
        return np.stack([np.eye(d) * c for c in self.covariances])

    def component_log_prob(self, x: np.ndarray) -> np.ndarray:
        """(rows, components) log weight plus log density."""
        d = self.means.shape[1]
        out = np.empty((len(x), len(self.weights)))
        for k, c in enumerate(self.full_covariances()):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - self.means[k]).T)
            out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
        with np.errstate(divide="ignore"):
            return out + np.log(self.weights)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        lp = self.component_log_prob(x)
        top = lp.max(axis=1)
        return top + np.log(np.exp(lp - top[:, None]).sum(axis=1))

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        lp = self.component_log_prob(x)
        p = np.exp(lp - lp.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.component_log_prob(x).argmax(axis=1)


def _moments(rows: DataFrame, columns: list[str], model: Mixture):
    """One pass: responsibilities' sums, weighted sums, weighted products, log likelihood, number of rows."""
    k, d = model.means.shape

    def run(frames):
        n, s, q, f, m = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0, 0
        for pdf in frames:
            x = pdf[columns].to_numpy(float)
            for a in range(0, len(x), 20_000):
                part = x[a:a + 20_000]
                r = model.responsibilities(part)
                n += r.sum(axis=0)
                s += r.T @ part
                q += np.einsum("nk,ni,nj->kij", r, part, part, optimize=True)
                f += float(model.log_prob(part).sum())
                m += len(part)
        v = np.concatenate([n, s.ravel(), q.ravel(), [f, m]])
        yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

    got = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # parameters only
    v = np.array([r["v"] for r in got])
    return v[:k], v[k:k + k * d].reshape(k, d), v[k + k * d:-2].reshape(k, d, d), v[-2], v[-1]


def _update(n, s, q, kind: str, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = n + 10 * np.finfo(float).eps
    means = s / n[:, None]
    spread = q / n[:, None, None] - means[:, :, None] * means[:, None, :]
    d = means.shape[1]
    if kind == "full":
        cov = spread + reg * np.eye(d)
    elif kind == "tied":
        cov = (n[:, None, None] * spread).sum(axis=0) / n.sum() + reg * np.eye(d)
    else:
        cov = np.einsum("kii->ki", spread) + reg
        if kind == "spherical":
            cov = cov.mean(axis=1)
    return n / n.sum(), means, cov


def _plus_plus(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ seeds and a few Lloyd rounds."""
    seeds = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in seeds], axis=0)
        seeds.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(seeds)
    for _ in range(10):
        near = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
    return c


def fit_mixture(df: DataFrame, columns: Sequence[str], k: int, kind: str = "full", reg: float = 1e-6, iterations: int = 200, tolerance: float = 1e-3, starts: int = 1, seed: int = 0, start: str = "kmeans", means: np.ndarray | None = None) -> Mixture:
    """The best of ``starts`` fits; stops when the mean log likelihood moves by at most the tolerance."""
    if kind not in KINDS:
        raise ValidationError("unknown kind of covariance", KINDS, kind)
    columns = list(columns)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    sample = rows.orderBy(F.xxhash64(*columns)).limit(START_ROWS).toPandas().to_numpy(float)
    if len(sample) < k:
        raise FittingError("fewer rows than components", k, len(sample))
    best, d = None, len(columns)
    for trial in range(starts):
        rng = np.random.default_rng(seed + trial)
        c = np.asarray(means, float) if means is not None else _plus_plus(sample, k, rng) if start == "kmeans" else None
        r = np.eye(k)[((sample[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)] if c is not None else rng.dirichlet(np.ones(k), size=len(sample))
        w, m, cov = _update(r.sum(axis=0), r.T @ sample, np.einsum("nk,ni,nj->kij", r, sample, sample, optimize=True), kind, reg)
        model = Mixture(w, np.asarray(means, float) if means is not None else m, cov, kind)
        before = -np.inf
        for _ in range(iterations):
            n, s, q, f, count = _moments(rows, columns, model)
            bound = f / count
            w, m, cov = _update(n, s, q, kind, reg)
            model = Mixture(w, m, cov, kind, bound)
            if abs(bound - before) <= tolerance:
                model.converged = True
                break
            before = bound
        if best is None or model.bound > best.bound:
            best = model
    assert best is not None and best.means.shape[1] == d
    return best


def score(df: DataFrame, columns: Sequence[str], model: Mixture, out: str = "log_density") -> DataFrame:
    """``df`` with the mixture's log density; an expression for diagonal kinds, Arrow batches else."""
    columns = list(columns)
    if model.kind in ("diag", "spherical"):
        terms = []
        for k, w in enumerate(model.weights):
            cov = np.broadcast_to(model.covariances[k], (len(columns),))
            z = sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) / float(v) for c, m, v in zip(columns, model.means[k], cov, strict=True)), F.lit(0.0))
            terms.append(F.lit(float(np.log(w) - 0.5 * np.log(cov).sum() - 0.5 * len(columns) * np.log(2 * np.pi))) - 0.5 * z)
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        return df.withColumn(out, top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0))))
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def dense(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.log_prob(np.stack(x.to_list())) if len(x) else [])

    return df.withColumn(out, dense(F.array(*columns)))


def marked_intensity(decode: DataFrame, joint: dict, rates: dict, occupancy: Mixture, points: np.ndarray, marks: Sequence[str], unit: str = "unit", event: str = "event_id") -> DataFrame:
    """(event, ll array): max(LOG_EPS, joint log density of (point, mark)) + log rate - log occupancy at each point."""
    spark = decode.sparkSession
    points = np.atleast_2d(points)
    sent = spark.sparkContext.broadcast((joint, {u: np.log(max(r, EPS)) for u, r in rates.items()}, occupancy.log_prob(points)))
    names = list(marks)
    schema = T.StructType([decode.schema[unit], decode.schema[event], T.StructField("ll", T.ArrayType(T.DoubleType(), False))])

    def run(frames):
        models, log_rate, log_occ = sent.value
        for pdf in frames:
            out = []
            for u, x in zip(pdf[unit], pdf[names].to_numpy(float), strict=True):
                both = np.concatenate([points, np.repeat(x[None], len(points), axis=0)], axis=1)
                out.append(np.maximum(models[u].log_prob(both), LOG_EPS) + log_rate[u] - log_occ)
            yield pd.DataFrame({unit: pdf[unit], event: pdf[event], "ll": out})

    return decode.select(unit, event, *names).mapInPandas(run, schema)
