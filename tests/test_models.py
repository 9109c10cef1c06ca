"""Decoders end to end on simulated recordings, saving, the streaming filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks
from tidemark.operators.geometry import Environment
from tidemark.operators.transitions import NonStationary
from tidemark.plans import models
from tidemark.sources import simulate
from tidemark.streaming import filter as streaming


@pytest.fixture(scope="module")
def recording(spark):
    """A run along 100 units with 12 place units, 20 Hz."""
    run = simulate.run_back_and_forth(simulate.times(spark, 1200, 20.0), 100.0, 10.0).cache()
    counts = simulate.neuron_counts(run, list(np.linspace(4, 96, 12)), 8.0, 15.0, 20.0, seed=3)
    return run, simulate.event_train(counts, 20.0, seed=4).cache()


def env():
    return Environment("", bin_size=5.0, ranges=[(0.0, 100.0)], infer_interior=False)


@pytest.mark.parametrize("algorithm", ["kde", "glm"])
def test_position_is_decoded(spark, recording, algorithm):
    run, events = recording
    model = models.single(environments=[env()], position_std=5.0, algorithm=algorithm)
    clock = run.select("t_idx", "t").where("t_idx < 400")
    out = model.fit(run, events).predict(events, clock, run, outputs="all")
    rows = out.groupBy("t_idx").agg(F.sum("acausal").alias("p"), F.sum("causal").alias("c"), F.max_by("bin", "acausal").alias("bin")).join(run, "t_idx").toPandas()
    assert np.allclose(rows.p, 1) and np.allclose(rows.c, 1)
    assert np.median(np.abs(rows.bin * 5 + 2.5 - rows.x)) < 6
    assert {"predictive", "log_likelihood", "name", "environment"} <= set(out.columns)


def test_non_local_states(spark, recording):
    run, events = recording
    model = models.non_local(environments=[env()], position_std=5.0, penalty=2.0, penalty_std=10.0)
    clock = run.select("t_idx", "t").where("t_idx < 200")
    out = model.fit(run, events).predict(events, clock, run)
    share = out.groupBy("name").agg(F.sum("acausal").alias("p")).toPandas().set_index("name").p
    assert set(share.index) == set(model.names) and np.isclose(share.sum(), 200)
    assert share["Local"] > 100
    path = model.most_likely_sequence(events, clock, run)
    assert path.count() == 200 and path.where("name = 'Local'").count() > 100


def test_local_kernel_states(spark, recording):
    run, events = recording
    model = models.non_local(environments=[env()], position_std=5.0, local_std=5.0)
    clock = run.select("t_idx", "t").where("t_idx < 60")
    out = model.fit(run, events).predict(events, clock, run)
    assert np.isclose(out.agg(F.sum("acausal")).first()[0], 60) and out.where("name = 'Local'").select("bin").distinct().count() == 20


def test_estimate_parameters(spark, recording):
    run, events = recording
    model = models.no_event_continuous_fragmented(environments=[env()], position_std=5.0)
    clock = run.select("t_idx", "t").where("t_idx < 120")
    out = model.estimate_parameters(run, events, clock, iterations=3)
    assert len(out["log_likelihoods"]) >= 2 and np.allclose(model.transition.sum(axis=1), 1)
    assert np.isclose(out["posterior"].agg(F.sum("acausal")).first()[0], 120)


@pytest.mark.parametrize("algorithm", ["kde", "gmm"])
def test_marked_events(spark, recording, algorithm):
    run, _ = recording
    centers, means = [[10.0, 60.0], [35.0, 85.0]], [[[0.0, 0.0], [80.0, 80.0]], [[0.0, 80.0], [80.0, 0.0]]]
    events = simulate.marked_events(run, centers, means, 8.0, 15.0, 20.0, 8.0)
    model = models.continuous_fragmented(environments=[env()], position_std=5.0, marks=("m0", "m1"), mark_std=12.0, algorithm=algorithm)
    clock = run.select("t_idx", "t").where("t_idx < 200")
    ev = events.select("event_id", "unit", "t", "m0", "m1")
    out = model.fit(run, ev).predict(ev, clock, run)
    rows = out.groupBy("t_idx", "bin").agg(F.sum("acausal").alias("p")).groupBy("t_idx").agg(F.sum("p").alias("s"), F.max_by("bin", "p").alias("bin")).join(run, "t_idx").toPandas()
    assert np.allclose(rows.s, 1) and np.median(np.abs(rows.bin * 5 + 2.5 - rows.x)) < 12


def test_covariates_and_environments(spark, recording):
    run, events = recording
    model = models.continuous_fragmented(environments=[env()], position_std=5.0, discrete=NonStationary.diagonal([0.98, 0.98]))
    clock = run.select("t_idx", "t").where("t_idx < 50")
    plain = models.continuous_fragmented(environments=[env()], position_std=5.0).fit(run, events).predict(events, clock)
    x = clock.select("t_idx", F.array(F.lit(1.0), F.col("t")).alias("x"))
    got = model.fit(run, events).predict(events, clock, covariates=x)
    a = plain.orderBy("t_idx", "state_bin").toPandas().acausal
    b = got.orderBy("t_idx", "state_bin").toPandas().acausal
    assert np.allclose(a, b, atol=1e-6)
    two = models.multi_environment(environments=[Environment("env1", 10.0, ranges=[(0.0, 100.0)], infer_interior=False), Environment("env2", 10.0, ranges=[(0.0, 100.0)], infer_interior=False)], position_std=5.0)
    samples = run.withColumn("place", F.when(F.col("t_idx") < 600, "env1").otherwise("env2"))
    out = two.fit(samples, events, environment="place").predict(events, clock)
    assert np.isclose(out.agg(F.sum("acausal")).first()[0], 50)


def test_options_and_saving(spark, recording, tmp_path):
    run, events = recording
    with pytest.raises(checks.ValidationError):
        models.single(algorithm="gmm")
    with pytest.raises(checks.ConfigurationError):
        models.Decoder(names=("a", "b"))
    model = models.single(environments=[env()], position_std=5.0).fit(run, events)
    with pytest.raises(checks.ValidationError):
        model.predict(events, run.select("t_idx", "t"), outputs="other")
    model.save(str(tmp_path / "model"))
    tables, params = models.Decoder.load(spark, str(tmp_path / "model"))
    assert params["names"] == ["Continuous"] and tables["fields_0"].count() == 12 * 20


def test_streaming_filter(spark, tmp_path):
    r = np.random.default_rng(0)
    ll = r.normal(size=(2, 30, 2))
    rows = [(f"s{s}", t, ll[s, t].tolist()) for s in range(2) for t in range(30)]
    schema = "session string, t_idx long, ll array<double>"
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 10 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    a = [[0.9, 0.1], [0.2, 0.8]]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.streaming_filter(stream, [0.5, 0.5], a, "session").writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    from tidemark.operators.hmm import filter_array

    got = spark.table("filtered").orderBy("session", "t_idx").toPandas()
    assert len(got) == 60
    for s in range(2):
        assert np.allclose(np.stack(got[got.session == f"s{s}"].filtered), filter_array(np.array([0.5, 0.5]), ll[s], np.array(a))[0])
