"""Likelihoods at the animal's own place: cells and tiles against plain sums."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import EPS
from tidemark.operators import kde


def k(x, y, std):
    return np.exp(-0.5 * (((x[:, None] - y[None]) / std) ** 2).sum(axis=2)) / np.prod(std * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("tile", [7, 20_000])
def test_sums_in_tiles(spark, tile):
    """One cell holds most rows; far groups, unknown places and targets without samples near."""
    r = np.random.default_rng(0)
    y = np.concatenate([r.normal(size=(60, 2)), r.normal(size=(10, 2)) + 500, [[-3000.0, 4.0]]])
    x = np.concatenate([r.normal(size=(40, 2)), r.normal(size=(5, 2)) + 495, [[9000.0, 9000.0], [np.nan, 0.0]]])
    unit = r.integers(0, 3, len(y))
    samples = spark.createDataFrame([(int(u), *map(float, p)) for u, p in zip(unit, y, strict=True)], "unit long, a double, b double")
    targets = spark.createDataFrame([(n, int(n % 3), *map(float, p)) for n, p in enumerate(x)], "n long, unit long, a double, b double")
    std = np.array([2.0, 3.0])
    want = k(x, y, std)
    got = {r["n"]: r["total"] for r in kde.sums_at(targets, "n", samples, ["a", "b"], std, tile=tile).collect()}
    assert set(got) >= set(range(45)) and 45 not in got and 46 not in got
    assert np.allclose([got[n] for n in range(45)], want[:45].sum(axis=1), rtol=1e-9)
    got = {(r["n"], r["unit"]): r["total"] for r in kde.sums_at(targets, "n", samples, ["a", "b"], std, by="unit", tile=tile).collect()}
    assert all(np.isclose(got.get((n, u), 0.0), want[n, unit == u].sum(), atol=1e-13) for n in range(45) for u in range(3))
    got = {r["n"]: r["total"] for r in kde.sums_at(targets, "n", samples, ["a", "b"], std, same="unit", grid=["a"], tile=tile).collect()}
    assert all(np.isclose(got.get(n, 0.0), want[n, unit == n % 3].sum(), atol=1e-13) for n in range(45))


def test_units_without_events_near(spark):
    """Sparse counts, a unit far away and one that never fires; the same as the sum over all units."""
    events = spark.createDataFrame([(u, float(p)) for u, p in ((0, 1), (0, 2), (1, 400), (1, 401))], "unit long, x double")
    samples = spark.createDataFrame([(float(p),) for p in (0, 1, 2, 3, 399, 400, 401, 402)], "x double")
    at = spark.createDataFrame([(0, 1.5), (1, 400.5), (2, 5000.0), (3, float("nan"))], "t_idx long, x double")
    counts = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (0, 2, 1)], "unit long, t_idx long, n long")
    units = spark.createDataFrame([(0,), (1,), (2,)], "unit long")
    got = {r["t_idx"]: r["ll"] for r in kde.local_loglik(counts, events, samples, at, ["x"], 3.0, units=units).collect()}
    n = np.zeros((4, 3))
    n[0, 0], n[0, 1], n[2, 0] = 2, 1, 1
    place, std = np.array([[1.5], [400.5], [5000.0]]), np.array([3.0])
    occ = k(place, np.array([[0], [1], [2], [3], [399], [400], [401], [402]], float), std).mean(axis=1)
    field = np.full((4, 3), EPS)
    for u, p in ((0, [[1.0], [2.0]]), (1, [[400.0], [401.0]])):
        dens = k(place, np.array(p), std).mean(axis=1)
        field[:3, u] = np.maximum(np.where(occ > 0, 0.25 * dens / np.where(occ > 0, occ, 1), EPS), EPS)
    want = (n * np.log(field) - field).sum(axis=1)
    assert np.allclose([got[t] for t in range(4)], want, rtol=1e-9)


def test_matrices_of_a_tile_are_bounded():
    """A tile of 6000 events a side stays far below its whole matrix (288 MB) and gives the plain sums."""
    r = np.random.default_rng(3)
    x, y, place, points = r.random((6000, 2)), r.random((6000, 2)), r.random((6000, 1)), np.array([[0.2], [0.8]])
    std, codes = np.array([0.1, 0.2]), r.integers(0, 3, 6000)
    tracemalloc.start()
    total = kde.kernel_sums(x, y, std, codes, 3)
    top, part = kde.mark_sums(x, y, place, points, std, std[:1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    for n in (0, 5999):
        near = k(x[n:n + 1], y, std)[0]
        assert np.allclose(total[n], [near[codes == c].sum() for c in range(3)])
        assert np.allclose(np.exp(top[n]) * part[n], k(points, place, std[:1]) @ near)
