"""Sessions and covariates in the decoder, and the covariate step of the estimation, against plain NumPy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import em, hmm, transitions
from tidemark.operators.geometry import Environment
from tidemark.operators.transitions import NonStationary
from tidemark.plans import catalogue, models
from tidemark.sources import simulate


@pytest.fixture(scope="module")
def recordings(spark):
    """Two sessions with overlapping times, the second one shorter and with other events."""
    run = simulate.run_back_and_forth(simulate.times(spark, 300, 20.0), 100.0, 10.0)
    events = simulate.event_train(simulate.neuron_counts(run, list(np.linspace(4, 96, 6)), 8.0, 15.0, 20.0, seed=3), 20.0, seed=4)
    both = lambda df: df.withColumn("s", F.lit("a")).unionByName(df.where("t < 9").withColumn("s", F.lit("b")))
    samples = both(run.select("t_idx", "t", "x")).withColumn("x", F.when(F.col("s") == "b", 100 - F.col("x")).otherwise(F.col("x")))
    return spark.createDataFrame(samples.toPandas()), spark.createDataFrame(both(events).where("s = 'a' OR pmod(hash(t), 3) > 0").toPandas())


def decoder(**options):
    return models.continuous_fragmented(environments=[Environment("", bin_size=10.0, ranges=[(0.0, 100.0)], infer_interior=False)], position_std=5.0, **options)


def test_sessions_as_separate_decodes(spark, recordings):
    samples, events = recordings
    clock = samples.where("t_idx < 60 AND (s = 'a' OR t_idx < 35)").select("s", "t_idx", "t")
    model = decoder().fit(samples, events, keys=["s"])
    got = model.predict(events, clock, samples, outputs="all").orderBy("s", "t_idx", "state_bin").toPandas()
    ll = model.compute_log_likelihood(events, clock).toPandas()
    assert len(got) == (60 + 35) * 20 and sorted(ll.columns) == ["ll", "s", "t_idx"]
    path = model.most_likely_sequence(events, clock).toPandas()
    pi, joint = model._inner()
    for s, own in got.groupby("s"):
        mine = np.stack(ll[ll.s == s].sort_values("t_idx").ll)
        f = hmm.filter_array(pi, mine, joint)[0]
        assert np.allclose(own.acausal.to_numpy().reshape(-1, 20), hmm.smooth_array(f, joint))
        assert np.allclose(own.causal.to_numpy().reshape(-1, 20), f)
        assert path[path.s == s].sort_values("t_idx").state_bin.tolist() == hmm.viterbi_array(pi, mine, joint).tolist()
    alone = model.predict(events.where("s = 'b'"), clock.where("s = 'b'"), samples).orderBy("t_idx", "state_bin").toPandas()
    assert np.allclose(alone.acausal, got[got.s == "b"].acausal)


def test_estimation_over_sessions(spark, recordings):
    samples, events = recordings
    clock = samples.where("t_idx < 50").select("s", "t_idx", "t")
    model = decoder()
    out = model.estimate_parameters(samples, events, clock, iterations=2, tolerance=0.0, keys=["s"])
    assert len(out["log_likelihoods"]) == 2 and out["posterior"].select("s", "t_idx").distinct().count() == 100
    plain = decoder().fit(samples, events, keys=["s"])
    pi, joint = plain._inner()
    ll = plain.compute_log_likelihood(events, clock).toPandas()
    total, counts, start = 0.0, np.zeros((2, 2)), np.zeros(20)
    for _, own in ll.groupby("s"):
        mine = np.stack(own.sort_values("t_idx").ll)
        f, p, norms = hmm.filter_array(pi, mine, joint)
        g = hmm.smooth_array(f, joint)
        fs, ps, gs = (x.reshape(len(x), 2, 10).sum(axis=2) for x in (f, p, g))
        counts += plain.transition * np.einsum("ta,tb->ab", fs[:-1], gs[1:] / ps[1:])
        start += g[0] / 2
        total += norms.sum()
    assert np.isclose(out["log_likelihoods"][0], total)
    first = decoder()
    first.estimate_parameters(samples, events, clock, iterations=1, keys=["s"])
    assert np.allclose(first.transition, em.update_transitions(counts, first.concentration, first.stickiness)) and np.allclose(first.initial, start)


def test_covariates_are_estimated(spark, recordings):
    samples, events = recordings
    clock = samples.where("t_idx < 40").select("s", "t_idx", "t")
    x = clock.select("s", "t_idx", F.array(F.lit(1.0), F.sin("t")).alias("x"))
    model = decoder(discrete=NonStationary.diagonal([0.9, 0.9]), concentration=1.0)
    out = model.estimate_parameters(samples, events, clock, iterations=3, tolerance=0.0, covariates=x, keys=["s"])
    assert np.all(np.diff(out["log_likelihoods"]) > -1e-6) and model.coefficients.shape == (2, 2, 1) and np.abs(model.coefficients[1]).max() > 1e-6


def newton(x, xi, beta, l2):
    """Each state's row by plain gradient and Hessian over dense arrays."""
    n_x, n, m = beta.shape
    out = beta.copy()
    for s in range(n):
        b = out[:, s].copy()
        for _ in range(100):
            z = np.c_[x @ b, np.zeros(len(x))]
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            y = xi[:, s]
            grad = x.T @ (y[:, :m] - y.sum(axis=1, keepdims=True) * p[:, :m]) / len(x)
            pen = np.r_[np.zeros((1, m)), np.full((n_x - 1, m), 2 * l2)]
            h = np.zeros((n_x, m, n_x, m))
            for t in range(len(x)):
                h += y[t].sum() * np.einsum("a,kq,b->akbq", x[t], np.diag(p[t, :m]) - np.outer(p[t, :m], p[t, :m]), x[t]) / len(x)
            b += np.linalg.solve(h.reshape(n_x * m, -1) + np.diag(pen.ravel()), (grad - pen * b).ravel()).reshape(n_x, m)
        out[:, s] = b
    return out


@pytest.mark.parametrize("n", [2, 3])
def test_covariate_step_as_dense(spark, n):
    r = np.random.default_rng(n)
    x = np.c_[np.ones(80), r.normal(size=(80, 2))]
    xi = r.random((80, n, n))
    rows = spark.createDataFrame([(a.tolist(), b.ravel().tolist()) for a, b in zip(x, xi, strict=True)], "x array<double>, xi array<double>").repartition(3)
    start = np.zeros((3, n, n - 1))
    got = em.update_covariate_transitions(rows, start, l2=1e-2)
    assert np.allclose(got, newton(x, xi, start, 1e-2), atol=1e-6)


def test_splines_on_stored_knots(spark):
    df = spark.createDataFrame([(float(k), k % 7.0) for k in range(50)], "t double, v double")
    design = transitions.Design.over(df, ["v"], {"t": 2})
    rows = np.array(design.rows(df.unionByName(df.withColumn("t", F.lit(99.0)))).toPandas().x.to_list())
    assert rows.shape == (100, 2 + 2 + 3) and len(design.knots["t"]) == 4
    assert (rows[:, 2:] >= 0).all() and (rows[:, 2:].sum(axis=1) <= 1 + 1e-12).all() and np.allclose(rows[50:, -1], 1.0)


def test_covariate_query_as_dense(spark):
    d = "/root/testdata/sf0.001"
    coef, trace = catalogue.covariate_rounds(spark, d, 2)
    rows = catalogue.daily_design(spark, d).orderBy("unit", "t_idx").toPandas()
    x = np.array(rows.x.to_list())
    beta, want = NonStationary(catalogue.A).coefficients(x.shape[1]), []
    for _ in range(2):
        xs, xis, total = [], [], 0.0
        for _, own in rows.groupby("unit"):
            design, ll = np.array(own.x.to_list()), np.array(own.ll.to_list())
            z = np.einsum("ti,isk->tsk", design, beta)
            e = np.exp(np.concatenate([z, np.zeros((len(z), 2, 1))], axis=2))
            a = e / e.sum(axis=2, keepdims=True)
            f, p, norms = hmm.filter_array(np.array([0.5, 0.5]), ll, a)
            g = hmm.smooth_array(f, a)
            xis.append(a[:-1] * f[:-1, :, None] * (g[1:] / p[1:])[:, None, :])
            xs.append(design[:-1])
            total += norms.sum()
        want.append(total)
        beta = newton(np.concatenate(xs), np.concatenate(xis), beta, 1e-3)
    assert np.allclose(trace, want) and np.allclose(coef, beta, atol=1e-5)


def test_events_keep_their_own_places(spark):
    """Two events at one time lie at different places; each unit's field is high at its own."""
    rows = [(2 * k + u, u, float(k), 75.0 + 350.0 * u) for k in range(40) for u in (0, 1)]
    events = spark.createDataFrame(rows, "event_id long, unit long, t double, x double")
    model = catalogue._two_states().fit(events.select("t", "x"), events)
    fields = {(r["unit"], r["bin"]): r["field"] for e in model.encoding.values() for r in e["fields"].collect()}
    assert all(fields[u, b] > 100 * fields[1 - u, b] for u, b in ((0, 1), (1, 8)))
