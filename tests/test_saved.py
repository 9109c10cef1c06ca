"""Decoders that are saved and restored predict what they did; environments and results come back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.operators.geometry import Environment, Track
from tidemark.operators.transitions import NonStationary
from tidemark.plans import models, saved
from tidemark.sources import io


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    t = np.arange(160) / 4.0
    x = 50 + 45 * np.sin(t / 3)
    samples = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, x, strict=True)], "t double, x double")
    events = [(k, int(u), float(s), float(np.interp(s, t, x) + r.normal() * 3), float(r.normal())) for k, (u, s) in enumerate(zip(r.integers(0, 3, 240), r.random(240) * 39, strict=True))]
    clock = spark.range(12).select(F.col("id").alias("t_idx"), (F.col("id") * 0.5 + 3).alias("t"))
    return samples, spark.createDataFrame(events, "event_id long, unit int, t double, m0 double, m1 double"), clock


def env(**options):
    return Environment(**{"name": "", "bin_size": 20.0, "ranges": [(0.0, 100.0)], "infer_interior": False} | options)


@pytest.mark.parametrize("kind", ["kde", "glm", "marks", "gmm", "local", "covariates"])
def test_predict_after_restore(spark, rows, tmp_path, kind):
    samples, events, clock = rows
    marked = {"marks": ("m0", "m1"), "mark_std": 6.0}
    options = {"kde": {}, "glm": {"algorithm": "glm"}, "marks": marked, "gmm": marked | {"algorithm": "gmm"}, "covariates": {"discrete": NonStationary.diagonal([0.9, 0.8])}}
    make = models.non_local if kind == "local" else models.continuous_fragmented
    model = make(environments=[env()], position_std=8.0, **options.get(kind, {}))
    x = clock.select("t_idx", F.array(F.lit(1.0), F.sin("t")).alias("x")) if kind == "covariates" else None
    model.fit(samples, events)
    if kind == "covariates":
        model.coefficients = model.discrete.coefficients(2) + 0.3
    model.save(str(tmp_path / "m"))
    again = models.Decoder.restore(spark, str(tmp_path / "m"))
    at = samples if kind == "local" else None
    before, after = (m.predict(events, clock, at, covariates=x).orderBy("t_idx", "state_bin").toPandas() for m in (model, again))
    assert len(before) == len(after) > 100 and np.allclose(before.acausal, after.acausal, atol=1e-12) and list(before.name) == list(after.name)
    assert again.names == list(model.names) and np.allclose(again.transition, model.transition)


def test_environments(spark, rows, tmp_path):
    samples, _, _ = rows
    plane = samples.withColumn("y", F.cos("t") * 20)
    track = Track({0: (0.0, 0.0), 1: (10.0, 0.0), 2: (10.0, 10.0)}, [(0, 1), (1, 2)], spacing=2.0)
    for k, e in enumerate((env(infer_interior=True, ranges=None).fit(samples), env(bin_size=10.0, infer_interior=True, ranges=None, fill=True).fit(plane, ["x", "y"]), env(track=track, bin_size=2.5).fit())):
        saved.save_environment(e, str(tmp_path / f"e{k}"), spark)
        back = saved.load_environment(spark, str(tmp_path / f"e{k}"))
        assert np.array_equal(back.interior, e.interior) and all(np.array_equal(a, b) for a, b in zip(back.edges, e.edges, strict=True))
        assert np.allclose(back.distance, e.distance) and back.columns == e.columns


def test_results(spark, rows, tmp_path):
    _, events, clock = rows
    io.save_results(events, str(tmp_path / "r"), ["unit"])
    back = io.load_results(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, back.select(events.columns).collect())) == sorted(map(tuple, events.collect()))
    io.save_results(clock, str(tmp_path / "c"))
    assert io.load_results(spark, str(tmp_path / "c")).count() == 12


def test_other_versions(spark, rows, tmp_path):
    io.save_tables(str(tmp_path / "old"), {}, {"names": ["a"]}, spark)
    with pytest.raises(checks.DataError):
        models.Decoder.restore(spark, str(tmp_path / "old"))
