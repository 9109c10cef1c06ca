"""Expectation-maximisation: sufficient statistics, M-steps and the driver loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.checks import ConvergenceError, ValidationError, positive
from ..sources.store import stored
from . import hmm, ordered

#: Predicted probabilities below this count as 0.
_ZERO = 1e-8


def _with_next(decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``__p`` and ``__s``, predicted and smoothed of the step after; a session's last row goes."""
    def lead(rows, by):
        w = Window.partitionBy(*by).orderBy("t_idx")
        return rows.withColumn("__p", F.lead("predicted").over(w)).withColumn("__s", F.lead("smoothed").over(w))

    rows = lead(decoded, keys) if keys else ordered.windowed(decoded, lead, 1, ["t_idx"])
    return rows.where("__p is not null")


def expected_transitions(decoded: DataFrame, transition: np.ndarray | None = None, keys: Sequence[str] = (), trans: str | None = None) -> DataFrame:
    """(i, j, n): expected numbers of transitions, sum over time of A_ij f_t(i) s_t+1(j) / p_t+1(j).

    decoded has filtered, predicted and smoothed arrays; ``trans`` names a column of matrices instead of one matrix.
    """
    n = None if transition is None else len(transition)
    ratio = F.zip_with("__s", "__p", lambda s, p: F.when(p <= _ZERO, 0.0).otherwise(s / p))
    left = _with_next(decoded, keys).select("filtered", ratio.alias("r"), *([trans] if trans else []))
    pairs = left.select(F.posexplode("filtered").alias("i", "f"), "r", *([trans] if trans else []))
    pairs = pairs.select("i", "f", F.posexplode("r").alias("j", "r"), *([trans] if trans else []))
    if trans:
        a = F.element_at(trans, (F.col("i") * F.sqrt(F.size(trans)).cast("int") + F.col("j") + 1).cast("int"))
    else:
        flat = F.array(*(F.lit(float(x)) for x in np.asarray(transition).ravel()))
        a = F.element_at(flat, (F.col("i") * n + F.col("j") + 1).cast("int"))
    return pairs.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum(a * F.col("f") * F.col("r")).alias("n"))


def transition_responses(decoded: DataFrame, trans: str = "trans", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t_idx, xi): the terms of expected_transitions() at each time, row-major; for few states."""
    ratio = F.zip_with("__s", "__p", lambda s, p: F.when(p <= _ZERO, 0.0).otherwise(s / p))
    rows = _with_next(decoded, keys).select(*keys, "t_idx", "filtered", ratio.alias("r"), trans)
    each = F.transform(trans, lambda a, k: a * F.element_at("filtered", (F.floor(k / F.size("r")) + 1).cast("int")) * F.element_at("r", (k % F.size("r") + 1).cast("int")))
    return rows.select(*keys, "t_idx", each.alias("xi"))


def matrix_of(rows: DataFrame, n: int, value: str = "n") -> np.ndarray:
    """States x states numbers as a matrix."""
    out = np.zeros((n, n))
    for r in rows.collect():
        out[r["i"], r["j"]] = r[value]
    return out


def dirichlet(concentration: float, stickiness, n: int) -> np.ndarray:
    """Parameters of the prior of each row; positive, also for sparse priors."""
    stick = np.diag(np.broadcast_to(np.asarray(stickiness, float), (n,)))
    return np.maximum(np.full((n, n), float(concentration)) + stick, 1e-10)


def update_transitions(expected: np.ndarray, concentration: float = 1.0, stickiness=0.0, weight=0.0, frozen: Sequence[int] = (), before: np.ndarray | None = None) -> np.ndarray:
    """Row-normalised expected counts plus prior.

    A row with ``weight`` 0 takes the prior's alpha - 1; with a positive one it takes weight times the row's
    expected count in the prior's direction, whatever the time resolution.  Rows without any mass take the
    prior's mean; frozen rows stay as before.
    """
    n = len(expected)
    weight = np.broadcast_to(np.asarray(weight, float), (n,))
    if (weight < 0).any():
        raise ValidationError("weight must not be negative", got=weight.tolist())
    alpha = dirichlet(concentration, stickiness, n)
    prior = alpha - 1
    rows = prior.sum(axis=1, keepdims=True)
    direction = np.divide(prior, rows, out=np.zeros_like(prior), where=rows != 0)
    adaptive = weight[:, None] * expected.sum(axis=1, keepdims=True) * direction
    new = expected + np.where(weight[:, None] > 0, adaptive, prior)
    total = new.sum(axis=1, keepdims=True)
    out = np.where(total == 0, alpha / alpha.sum(axis=1, keepdims=True), np.divide(new, total, out=np.zeros_like(new), where=total != 0))
    for k in frozen:
        out[k] = before[k]
    return out


def update_covariate_transitions(responses: DataFrame, coefficients: np.ndarray, x: str = "x", l2: float = 1e-10, alpha: np.ndarray | None = None, steps: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Newton steps for the coefficients of covariate-driven transitions; responses: x array, xi array (row-major).

    A step is one pass for the rows of all states that have not converged: each task adds up gradients and Hessians
    of its batches as arrays, Spark adds those up by place, and the driver solves one small system a state.
    A state that does not converge keeps its coefficients.
    """
    n_x, n, m = coefficients.shape
    out, beta = coefficients.copy(), coefficients.astype(float).copy()
    rows = responses.select(F.col(x).alias("x"), "xi")
    total = max(rows.count(), 1)
    prior = np.zeros((n, n)) if alpha is None else np.asarray(alpha, float) - 1
    size = n_x * m
    open_ = list(range(n))
    for _ in range(steps):
        if not open_:
            break
        at, wanted = beta.copy(), list(open_)

        def sums(batches, at=at, wanted=wanted):
            g, h = np.zeros((len(wanted), m, n_x)), np.zeros((len(wanted), m, m, n_x, n_x))
            for batch in batches:
                if not batch.num_rows:
                    continue
                design, xi = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (0, 1))
                for seat, s in enumerate(wanted):
                    z = np.concatenate([design @ at[:, s, :], np.zeros((len(design), 1))], axis=1)
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    p = (e / e.sum(axis=1, keepdims=True))[:, :m]
                    y = xi[:, s * n:(s + 1) * n] + prior[s]
                    mass = y.sum(axis=1)
                    g[seat] += (y[:, :m] - mass[:, None] * p).T @ design
                    for k in range(m):
                        for q in range(m):
                            w = mass * p[:, k] * ((k == q) - p[:, q])
                            h[seat, k, q] += (design * w[:, None]).T @ design
            flat = np.concatenate([g.reshape(len(wanted), -1), h.reshape(len(wanted), -1)], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["part"])

        parts = rows.mapInArrow(sums, "part array<double>").select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        flat = (np.array([r["v"] for r in parts]) / total).reshape(len(wanted), -1)
        for seat, s in enumerate(wanted):
            pen = np.full((n_x, m), 2 * l2)
            pen[0] = 0
            grad = flat[seat, :size].reshape(m, n_x).T - pen * beta[:, s, :]
            hess = flat[seat, size:].reshape(m, m, n_x, n_x).transpose(2, 0, 3, 1).reshape(size, size)
            step = np.linalg.lstsq(hess + np.diag(pen.ravel()) + 1e-12 * np.eye(size), grad.ravel(), rcond=None)[0].reshape(n_x, m)
            largest = np.abs(step).max()
            beta[:, s, :] += step * min(1.0, 5.0 / max(largest, 1e-300))
            if not np.isfinite(beta[:, s, :]).all():
                open_.remove(s)
            elif largest < tolerance:
                out[:, s, :] = beta[:, s, :]
                open_.remove(s)
    return out


def update_initial(decoded: DataFrame, keys: Sequence[str] = ()) -> np.ndarray:
    """Mean smoothed probabilities at each session's first step."""
    first = decoded.groupBy(*keys).agg(F.min_by("smoothed", "t_idx").alias("smoothed"))
    rows = first.select(F.posexplode("smoothed").alias("k", "p")).groupBy("k").agg(F.avg("p").alias("p")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["k"]] = r["p"]
    return out / out.sum()


def effective_size(weights: DataFrame, weight: str = "w", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mass, ess): sum of weights and (sum w)^2 / sum w^2."""
    out = weights.groupBy(*keys).agg(F.sum(weight).alias("mass"), F.sum(F.col(weight) * F.col(weight)).alias("__q"))
    return out.select(*keys, "mass", F.when(F.col("__q") == 0, 0.0).otherwise(F.col("mass") * F.col("mass") / F.col("__q")).alias("ess"))


def damped(old: DataFrame, new: DataFrame, share: float, by: Sequence[str] = ("unit", "bin"), value: str = "field") -> DataFrame:
    """Blend of two fields, ``share`` of the new one."""
    both = old.select(*by, F.col(value).alias("__old")).join(new, list(by))
    return both.withColumn(value, F.lit(1 - share) * F.col("__old") + F.lit(share) * F.col(value)).drop("__old")


def fit(likelihood: Callable[[DataFrame | None], DataFrame], initial: np.ndarray, transition: np.ndarray, keys: Sequence[str] = (), iterations: int = 20, tolerance: float = 1e-4, concentration: float = 1.0, stickiness=0.0, weight=0.0, frozen: Sequence[int] = (), update_start: bool = True, cut: Callable[[DataFrame], DataFrame] | None = None, strict: bool = False) -> dict:
    """Loop of E-step (decode) and M-step; each round's posterior is cut off from its lineage.

    ``likelihood`` gives (keys, t_idx, ll) from the last posterior (None at first); a function that ignores its
    argument is called once.  The posterior returned is that of the last E-step.  Returns posterior,
    transition, initial, log_likelihoods and converged.
    """
    positive("iterations", iterations)
    trace, decoded, ll, done = [], None, None, False
    pi, a = np.asarray(initial, float), np.asarray(transition, float)
    refit = getattr(likelihood, "refits", False)
    cut = cut or stored
    for k in range(iterations):
        if ll is None or refit:
            ll = likelihood(decoded)
        decoded = cut(hmm.decode(ll, pi, a, keys))
        trace.append(decoded.agg(F.sum("log_norm")).first()[0])
        expected = matrix_of(expected_transitions(decoded, a, keys), len(pi))
        new_a = update_transitions(expected, concentration, stickiness, weight, frozen, a)
        new_pi = update_initial(decoded, keys) if update_start else pi
        a, pi = new_a, new_pi
        if k:
            done, rising = hmm.converged(trace[-1], trace[-2], tolerance)
            if strict and not rising:
                raise ConvergenceError("the log likelihood fell", trace[-2], trace[-1])
            if done:
                break
    return {"posterior": decoded, "transition": a, "initial": pi, "log_likelihoods": trace, "converged": done}
