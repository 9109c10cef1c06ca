"""Transitions in blocks: discrete matrices by time and shared blocks between positions, against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hmm
from tidemark.operators.geometry import Environment
from tidemark.operators.transitions import NonStationary
from tidemark.plans import catalogue, models
from tidemark.sources import simulate


def problem(sizes, n_times, seed, sparse=False):
    r = np.random.default_rng(seed)
    states = np.repeat(np.arange(len(sizes)), sizes)
    c = np.empty((len(states),) * 2)
    for a in range(len(sizes)):
        for b in range(len(sizes)):
            part = r.random((sizes[a], sizes[b])) if (a + b) % 2 == 0 else np.tile(r.random(sizes[b]), (sizes[a], 1))
            c[np.ix_(states == a, states == b)] = part / part.sum(axis=1, keepdims=True)
    d = r.dirichlet(np.ones(len(sizes)), (n_times, len(sizes)))
    if sparse:
        d[:, 0] = np.eye(len(sizes))[0]
    ll = r.normal(size=(n_times, len(states))) * 2
    return hmm.Blocks(c, states), c, d, ll, r.dirichlet(np.ones(len(states)))


def dense(c, d, states):
    return c[None] * d[:, states][:, :, states]


@pytest.mark.parametrize("sizes", [(1, 3, 2), (4, 4), (40, 1, 30)])
@pytest.mark.parametrize("sparse", [False, True])
def test_step_is_its_matrix(sizes, sparse):
    blocks, c, d, ll, pi = problem(sizes, 3, 1, sparse)
    m, step = dense(c, d, blocks.states)[1], blocks.step(d[1])
    assert np.allclose(pi @ step, pi @ m) and np.allclose(step @ pi, m @ pi) and np.allclose(ll @ step, ll @ m)
    assert np.allclose(step.sum(axis=1), m.sum(axis=1)) and np.allclose(step[[0, 2]], m[[0, 2]]) and np.allclose(step[1], m[1])
    with np.errstate(divide="ignore"):
        assert np.allclose(step.best(ll[0]), (np.log(m) + ll[0]).max(axis=1))


def rows(spark, ll, d=None, session="a"):
    return spark.createDataFrame([(session, k, [float(x) for x in ll[k]], None if d is None else [float(x) for x in d[k].ravel()]) for k in range(len(ll))], "s string, t_idx long, ll array<double>, d array<double>")


@pytest.mark.parametrize(("sizes", "chunk"), [((2, 3), 4), ((30, 1, 25), 5), ((30, 25), 1000)])
def test_decoding_as_dense(spark, sizes, chunk):
    blocks, c, d, ll, pi = problem(sizes, 23, 2)
    f, p, norms = hmm.filter_array(pi, ll, dense(c, d, blocks.states))
    smooth = hmm.smooth_array(f, dense(c, d, blocks.states))
    out = hmm.decode(rows(spark, ll, d), pi, blocks, ["s"], "d", chunk).orderBy("t_idx").toPandas()
    assert np.allclose(np.stack(out.filtered), f) and np.allclose(np.stack(out.predicted), p) and np.allclose(np.stack(out.smoothed), smooth) and np.allclose(out.log_norm, norms)
    path = hmm.viterbi(rows(spark, ll, d), pi, blocks, ["s"], "d", chunk).orderBy("t_idx").toPandas()
    assert path.state.tolist() == hmm.viterbi_array(pi, ll, dense(c, d, blocks.states)).tolist()
    fixed = hmm.Blocks(c, blocks.states, d[0])
    m = dense(c, d, blocks.states)[0]
    out = hmm.decode(rows(spark, ll), pi, fixed, [], None, chunk).orderBy("t_idx").toPandas()
    assert np.allclose(np.stack(out.smoothed), hmm.smooth_array(hmm.filter_array(pi, ll, m)[0], m))
    path = hmm.viterbi(rows(spark, ll), pi, fixed, [], None, chunk).orderBy("t_idx").toPandas()
    assert path.state.tolist() == hmm.viterbi_array(pi, ll, m).tolist()


def test_covariate_query_as_dense(spark):
    """400 levels and two states, every hour a discrete matrix of its own."""
    d = "/root/testdata/sf0.001"
    got = catalogue.covariate_decode(spark, d).orderBy("t_idx").toPandas()
    source = catalogue.value_levels(spark, d).orderBy("t_idx").toPandas()
    ll, by_time = np.stack(source.ll), np.stack(source.trans).reshape(-1, 2, 2)
    assert by_time[:, 0, 0].std() > 0.001 and ll.shape[1] == 800 and max(map(len, source.trans)) == 4
    blocks = catalogue.level_blocks()
    f, p = np.empty_like(ll), np.full(800, 1 / 800)
    norms, each = [], lambda k: blocks.continuous * by_time[k][blocks.states][:, blocks.states]
    for k in range(len(ll)):
        u = p * np.exp(ll[k] - ll[k].max())
        norms.append(np.log(u.sum()) + ll[k].max())
        f[k] = u / u.sum()
        p = f[k] @ each(k)
    smooth = f.copy()
    for k in range(len(ll) - 2, -1, -1):
        smooth[k] = f[k] * (each(k) @ (smooth[k + 1] / (f[k] @ each(k))))
    assert np.allclose(got.p_drift, smooth[:, :400].sum(axis=1), atol=2e-6)
    assert np.allclose(got.level, (smooth[:, :400] + smooth[:, 400:]) @ (np.arange(400) * 1.25 + 0.625), atol=2e-3)
    assert np.allclose(got.log_norm, norms, atol=2e-5)


def test_decoder_with_covariates(spark):
    """predict and the best path of a decoder follow covariates; a constant covariate is the fixed matrix."""
    run = simulate.run_back_and_forth(simulate.times(spark, 400, 20.0), 100.0, 10.0).cache()
    events = simulate.event_train(simulate.neuron_counts(run, list(np.linspace(4, 96, 8)), 8.0, 15.0, 20.0, seed=3), 20.0, seed=4).cache()
    env = lambda: Environment("", bin_size=5.0, ranges=[(0.0, 100.0)], infer_interior=False)
    clock = run.select("t_idx", "t").where("t_idx < 80")
    fixed = models.continuous_fragmented(environments=[env()], position_std=5.0).fit(run, events)
    moving = models.continuous_fragmented(environments=[env()], position_std=5.0, discrete=NonStationary.diagonal([0.98, 0.98])).fit(run, events)
    x = clock.select("t_idx", F.array(F.lit(1.0), F.sin("t")).alias("x"))
    ll = fixed.compute_log_likelihood(events, clock)
    a = fixed.predict(events, clock, ll=ll).orderBy("t_idx", "state_bin").toPandas()
    b = moving.predict(events, clock, covariates=x, ll=ll).orderBy("t_idx", "state_bin").toPandas()
    assert len(a) == 80 * 40 and np.allclose(a.acausal, b.acausal, atol=1e-6)
    path = [m.most_likely_sequence(events, clock, covariates=v).orderBy("t_idx").toPandas().state_bin.tolist() for m, v in ((fixed, None), (moving, x))]
    assert path[0] == path[1]
