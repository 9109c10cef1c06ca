"""Transitions between position bins and between discrete states, and initial conditions.

Matrices are bins x bins: small, built on the driver, checked, and handed to the recursions.  What needs samples
(empirical movement) is aggregated by Spark first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.checks import ConfigurationError, ValidationError, probabilities, stochastic
from ..functions.exprs import centered_softmax, dot
from .geometry import Environment, closeness_center


def normalize_rows(m: np.ndarray) -> np.ndarray:
    """Rows of sum 1; rows of sum 0 stay 0."""
    total = m.sum(axis=1, keepdims=True)
    return np.divide(m, total, out=np.zeros_like(m), where=total != 0)


def _normal(d: np.ndarray, var: float) -> np.ndarray:
    return np.exp(-0.5 * d * d / var) / np.sqrt(2 * np.pi * var)


def _pick(environments: Sequence[Environment], name: str) -> Environment:
    for e in environments:
        if e.name == name:
            return e
    raise ConfigurationError("no such environment", [e.name for e in environments], name)


@dataclass
class RandomWalk:
    """Gaussian steps in space, or along the bin graph, also only towards or away from its center."""

    environment: str = ""
    variance: float = 6.0
    mean: float = 0.0
    along_graph: bool = False
    direction: str | None = None

    def matrix(self, environments: Sequence[Environment]) -> np.ndarray:
        env = _pick(environments, self.environment)
        n = len(env.points)
        if self.along_graph or env.track is not None:
            d = env.distance
            m = np.where(np.isfinite(d), _normal(np.where(np.isfinite(d), d, 0.0) - self.mean, self.variance), 0.0)
        else:
            gap = env.points[None, :, :] - env.points[:, None, :] - self.mean
            m = np.exp(-0.5 * (gap**2).sum(axis=2) / self.variance) / (2 * np.pi * self.variance) ** (env.points.shape[1] / 2)
        if self.direction is not None:
            if self.direction not in ("inward", "outward"):
                raise ValidationError("direction must be inward or outward", got=self.direction)
            hub = env.distance[closeness_center(env.distance, env.interior_bins)]
            closer = hub[None, :] <= hub[:, None] if self.direction == "inward" else hub[None, :] >= hub[:, None]
            m = m * closer
        inside = env.interior.ravel()
        m = np.where(inside[:, None] & inside[None, :], m, 0.0)
        return normalize_rows(m.reshape(n, n))


@dataclass
class Uniform:
    """Any interior bin of the environment, or of a second one, with equal probability."""

    environment: str = ""
    to: str | None = None

    def matrix(self, environments: Sequence[Environment]) -> np.ndarray:
        a = _pick(environments, self.environment)
        b = a if self.to is None else _pick(environments, self.to)
        m = np.outer(a.interior.ravel(), b.interior.ravel()).astype(float)
        return normalize_rows(m)


@dataclass
class Identity:
    environment: str = ""

    def matrix(self, environments: Sequence[Environment]) -> np.ndarray:
        return np.diag(_pick(environments, self.environment).interior.ravel().astype(float))


@dataclass
class EmpiricalMovement:
    """Steps as observed: a histogram of (bin, next bin); ``speedup`` steps in one; optionally both ways in time."""

    environment: str = ""
    speedup: int = 1
    reverse: bool = False

    def counts(self, samples: DataFrame, environments: Sequence[Environment], order: str = "t_idx", keys: Sequence[str] = (), where: str = "true") -> DataFrame:
        """(i, j, n): one aggregation of each sample with its follower."""
        env = _pick(environments, self.environment)
        w = Window.partitionBy(*keys).orderBy(order)
        placed = env.bin_of(samples.where(where)).withColumn("j", F.lead("bin").over(w)).where("j is not null")
        out = placed.groupBy(F.col("bin").alias("i"), "j").agg(F.count("*").alias("n"))
        if self.reverse:
            out = out.unionByName(out.select(F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
        return out

    def matrix(self, environments: Sequence[Environment], samples: DataFrame, **how) -> np.ndarray:
        env = _pick(environments, self.environment)
        m = np.zeros((len(env.points),) * 2)
        for r in self.counts(samples, environments, **how).collect():  # bins x bins at most
            m[r["i"], r["j"]] = r["n"]
        m = normalize_rows(m)
        return np.linalg.matrix_power(m, self.speedup)


@dataclass
class ForwardWalk(RandomWalk):
    """A random walk that only goes to the same bin or later ones."""

    def matrix(self, environments):
        return normalize_rows(np.triu(super().matrix(environments)))


@dataclass
class BackwardWalk(RandomWalk):
    """A random walk that only goes to the same bin or earlier ones."""

    def matrix(self, environments):
        return normalize_rows(np.tril(super().matrix(environments)))


@dataclass
class Discrete:
    """The transition of a state without positions."""

    environment: str = ""

    def matrix(self, environments: Sequence[Environment]) -> np.ndarray:
        return np.ones((1, 1))


# --- discrete states --------------------------------------------------------------------------

def from_diagonal(diagonal: Sequence[float]) -> np.ndarray:
    """Stay with the given probability, else go to any other state alike."""
    d = np.asarray(diagonal, float)
    n = len(d)
    if n == 1:
        return np.ones((1, 1))
    m = np.repeat(((1 - d) / (n - 1))[:, None], n, axis=1)
    m[np.diag_indices(n)] = d
    return m


@dataclass
class StationaryDiagonal:
    diagonal: Sequence[float]

    def make(self) -> np.ndarray:
        return stochastic("transition", from_diagonal(self.diagonal))


@dataclass
class StationaryCustom:
    matrix: Sequence[Sequence[float]]

    def make(self) -> np.ndarray:
        return stochastic("transition", self.matrix)


@dataclass
class NonStationary:
    """Transitions that follow covariates: centered softmax of a design row times coefficients, per state left.

    The coefficients start at the given matrix: its log ratios in the intercept row, 0 in the others.
    """

    matrix: Sequence[Sequence[float]]

    @classmethod
    def diagonal(cls, diagonal: Sequence[float]) -> "NonStationary":
        return cls(from_diagonal(diagonal))

    def coefficients(self, n_columns: int) -> np.ndarray:
        """(columns, from, to but the last)."""
        p = np.clip(stochastic("transition", self.matrix), 1e-10, None)
        out = np.zeros((n_columns, len(p), len(p) - 1))
        out[0] = np.log(p[:, :-1] / p[:, -1:])
        return out


def predict_transitions(design: DataFrame, coefficients: np.ndarray, x: str = "x", out: str = "trans") -> DataFrame:
    """``design`` with the row-major transition matrix that its design row gives."""
    _, n, m = coefficients.shape
    rows = []
    for s in range(n):
        logits = F.array(*(dot(F.col(x), F.array(*(F.lit(float(c)) for c in coefficients[:, s, k]))) for k in range(m)))
        rows.append(centered_softmax(logits))
    return design.withColumn(out, F.flatten(F.array(*rows)))


def knots_of(samples: DataFrame, column: str, n_inner: int) -> list[float]:
    """Boundary knots and inner knots at equal quantiles."""
    levels = [k / (n_inner + 1) for k in range(n_inner + 2)]
    return [float(x) for x in samples.agg(F.percentile(column, levels)).first()[0]]


def bspline_columns(x: Column, knots: Sequence[float], degree: int = 3) -> list[Column]:
    """B-spline basis by the two-term recurrence, the first function left out (an intercept stands for it)."""
    low, high = knots[0], knots[-1]
    t = [low] * degree + list(knots) + [high] * degree
    last = max(k for k in range(len(t) - 1) if t[k] < t[k + 1])
    level = [F.when((x >= t[k]) & ((x < t[k + 1]) | (x == high if k == last else F.lit(False))), F.lit(1.0)).otherwise(0.0) if t[k] < t[k + 1] else F.lit(0.0) for k in range(len(t) - 1)]
    for d in range(1, degree + 1):
        def term(k, d=d, level=level):
            left = (x - t[k]) / (t[k + d] - t[k]) * level[k] if t[k + d] > t[k] else F.lit(0.0)
            right = (t[k + d + 1] - x) / (t[k + d + 1] - t[k + 1]) * level[k + 1] if t[k + d + 1] > t[k + 1] else F.lit(0.0)
            return left + right
        level = [term(k) for k in range(len(level) - 1)]
    return level[1:]


@dataclass
class Design:
    """Design rows of covariates: an intercept, columns as they are, and B-spline bases on stored knots."""

    plain: Sequence[str] = ()
    knots: dict[str, list[float]] | None = None
    degree: int = 3

    @classmethod
    def over(cls, samples: DataFrame, plain: Sequence[str] = (), splines: dict[str, int] | None = None, degree: int = 3) -> "Design":
        """``splines``: the number of inner knots by column."""
        return cls(tuple(plain), {c: knots_of(samples, c, n) for c, n in (splines or {}).items()}, degree)

    def rows(self, df: DataFrame, out: str = "x") -> DataFrame:
        """``df`` with the design row; values beyond the boundary knots count as on them."""
        columns = [F.lit(1.0), *(F.col(c).cast("double") for c in self.plain)]
        for c, knots in (self.knots or {}).items():
            columns += bspline_columns(F.least(F.greatest(F.col(c).cast("double"), F.lit(knots[0])), F.lit(knots[-1])), knots, self.degree)
        return df.withColumn(out, F.array(*columns))


# --- assembly ---------------------------------------------------------------------------------

@dataclass(frozen=True)
class Observation:
    """What a discrete state observes; states that share environment and group share a likelihood."""

    environment: str = ""
    group: int | str = 0
    local: bool = False
    no_event: bool = False

    @property
    def key(self) -> tuple:
        return self.environment, self.group


@dataclass
class StateSpace:
    """Discrete states laid end to end: one bin for states without positions, all bins of their environment for others."""

    names: Sequence[str]
    observations: Sequence[Observation]
    environments: Sequence[Environment]
    local_bins: bool = False

    def __post_init__(self):
        self.states, self.bins, self.inside = [], [], []
        for k, o in enumerate(self.observations):
            if o.no_event or o.local and not self.local_bins:
                part = [(-1, True)]
            else:
                part = list(enumerate(_pick(self.environments, o.environment).interior.ravel().tolist()))
            self.states += [k] * len(part)
            self.bins += [b for b, _ in part]
            self.inside += [i for _, i in part]
        self.states, self.bins, self.inside = np.array(self.states), np.array(self.bins), np.array(self.inside)

    def table(self, spark: SparkSession) -> DataFrame:
        """(state_bin, state, name, environment, bin, is_interior)."""
        return spark.createDataFrame(
            [(k, int(s), self.names[s], self.observations[s].environment, int(b), bool(i)) for k, (s, b, i) in enumerate(zip(self.states, self.bins, self.inside, strict=True))],
            "state_bin int, state int, name string, environment string, bin int, is_interior boolean")

    def initial(self, prior: Sequence[float]) -> np.ndarray:
        """The prior of each discrete state, spread evenly over its interior bins."""
        p = probabilities("prior", prior)
        out = np.zeros(len(self.states))
        for k in range(len(p)):
            mine = (self.states == k) & self.inside
            out[mine] = p[k] / mine.sum()
        return out

    def continuous(self, blocks: Sequence[Sequence], samples: DataFrame | None = None) -> np.ndarray:
        """Block matrix of the transitions between positions; from one bin to many it is uniform, back it is 1."""
        n = len(self.names)
        out = np.zeros((len(self.states),) * 2)
        for i in range(n):
            for j in range(n):
                a, b = self.states == i, self.states == j
                if a.sum() == 1 and b.sum() == 1:
                    block = np.ones((1, 1))
                elif a.sum() == 1:
                    block = (self.inside[b] / self.inside[b].sum())[None, :]
                elif b.sum() == 1:
                    block = np.ones((a.sum(), 1))
                else:
                    rule = blocks[i][j]
                    if isinstance(rule, Discrete):
                        rule = Uniform(self.observations[i].environment, self.observations[j].environment)
                    here, there = self.observations[i].environment, self.observations[j].environment
                    if here != there and not isinstance(rule, Uniform):
                        raise ConfigurationError("only uniform transitions lead from one environment to another", "Uniform", type(rule).__name__)
                    if isinstance(rule, Uniform) and here != there:
                        rule = Uniform(here, there)
                    block = rule.matrix(self.environments, samples) if isinstance(rule, EmpiricalMovement) else rule.matrix(self.environments)
                out[np.ix_(a, b)] = block
        return out

    def joint(self, continuous: np.ndarray, discrete: np.ndarray) -> np.ndarray:
        """Transitions between state bins: the continuous ones times those of their discrete states."""
        return continuous * discrete[np.ix_(self.states, self.states)]


def matrix_rows(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """(i, j, p) of a matrix, zeros left out."""
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "i int, j int, p double")
