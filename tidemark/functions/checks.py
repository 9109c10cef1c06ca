"""Parameter and data checks with explanatory errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


class TidemarkError(Exception):
    """Base of all errors of this package; says what was expected, what came, and a hint."""

    def __init__(self, message: str, expected=None, got=None, hint: str | None = None, example: str | None = None):
        self.expected, self.got, self.hint, self.example = expected, got, hint, example
        extra = [f"{k}: {v}" for k, v in (("expected", expected), ("got", got), ("hint", hint), ("example", example)) if v is not None]
        super().__init__("\n  ".join([message, *extra]))


class ValidationError(TidemarkError, ValueError):
    """A value breaks its contract."""


class ConfigurationError(TidemarkError):
    """Options that do not go together, or a step out of order."""


class FittingError(TidemarkError):
    """A fit failed."""


class ConvergenceError(FittingError):
    """An iterative fit did not converge."""


class DataError(TidemarkError, ValueError):
    """Input rows break their contract."""


def positive(name: str, value: float, strict: bool = True) -> float:
    if not np.isscalar(value) or not math.isfinite(value) or value < 0 or strict and value == 0:
        raise ValidationError(f"{name} must be a {'positive' if strict else 'non-negative'} number", "a finite number", value)
    return float(value)


def in_range(name: str, value: float, low: float, high: float) -> float:
    if not math.isfinite(value) or not low <= value <= high:
        raise ValidationError(f"{name} is out of range", f"[{low}, {high}]", value)
    return float(value)


def finite(name: str, values) -> np.ndarray:
    x = np.asarray(values, float)
    if not np.isfinite(x).all():
        raise ValidationError(f"{name} must be finite", "no NaN or infinity", f"{int((~np.isfinite(x)).sum())} others")
    return x


def probabilities(name: str, values, tol: float = 1e-6) -> np.ndarray:
    p = finite(name, values)
    if p.ndim != 1 or (p < 0).any() or abs(p.sum() - 1) > tol:
        raise ValidationError(f"{name} must be a probability vector", "non-negative, sum 1", f"sum {p.sum():.6g}")
    return p


def stochastic(name: str, matrix, tol: float = 1e-6) -> np.ndarray:
    m = finite(name, matrix)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValidationError(f"{name} must be square", "(n, n)", m.shape)
    if (m < 0).any() or (np.abs(m.sum(axis=1) - 1) > tol).any():
        raise ValidationError(f"{name} must have rows that sum to 1", "row sums of 1", m.sum(axis=1).tolist())
    return m


def monotone(name: str, values, strict: bool = False) -> np.ndarray:
    x = finite(name, values)
    if x.ndim != 1 or (np.diff(x) < 0).any() or strict and (np.diff(x) == 0).any():
        raise ValidationError(f"{name} must {'strictly ' if strict else ''}increase")
    return x


def equal_lengths(**values: Sequence) -> None:
    sizes = {k: len(v) for k, v in values.items()}
    if len(set(sizes.values())) > 1:
        raise ValidationError("lengths differ", "equal lengths", sizes)


def track_graph(nodes: dict, edges: Sequence, edge_order: Sequence | None = None, edge_spacing=0.0) -> None:
    """Nodes have positions, edges join known nodes, the order names each edge once, spacing fits."""
    pairs = {frozenset((u, v)) for u, v, *_ in edges}
    if unknown := {n for e in edges for n in e[:2]} - set(nodes):
        raise ValidationError("an edge names an unknown node", sorted(nodes), sorted(unknown))
    if edge_order is not None:
        if any(frozenset(e) not in pairs for e in edge_order):
            raise ValidationError("edge_order names an unknown edge")
        if not np.isscalar(edge_spacing) and len(edge_spacing) != len(edge_order) - 1:
            raise ValidationError("edge_spacing has a wrong length", len(edge_order) - 1, len(edge_spacing))
        if (np.asarray(edge_spacing) < 0).any():
            raise ValidationError("edge_spacing must not be negative")


def clock_rows(df: DataFrame, t: str = "t", t_idx: str = "t_idx") -> None:
    """One pass: the clock is finite and does not run backwards."""
    order = Window.partitionBy(F.floor(F.col(t_idx) / 1_000_000)).orderBy(t_idx)
    bad = df.select(F.isnan(t).alias("nan"), (F.col(t) < F.lag(t).over(order)).alias("back")).agg(F.count_if("nan"), F.count_if("back")).first()
    if bad[0] or bad[1]:
        raise DataError("the clock must be finite and must not run backwards", got=f"{bad[0]} NaN, {bad[1]} steps back")


def position_rows(df: DataFrame, columns: Sequence[str]) -> None:
    bad = df.agg(*(F.count_if(F.isnan(c) | F.col(c).isNull()) for c in columns)).first()
    if any(bad):
        raise DataError("positions must be finite for a fit", got=dict(zip(columns, bad, strict=True)), hint="drop or interpolate them first")
