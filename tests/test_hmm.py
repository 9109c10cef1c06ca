"""Recursions against enumeration of all paths, invariants, chunks."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.operators import em, hmm


def model(seed, n=3, steps=5):
    r = np.random.default_rng(seed)
    return r.dirichlet(np.ones(n)), r.dirichlet(np.ones(n), size=n), r.normal(size=(steps, n)) * 2


def enumerate_paths(pi, a, ll):
    """Log evidence, marginals, expected transitions and best path from all paths."""
    steps, n = ll.shape
    weights, paths = [], list(itertools.product(range(n), repeat=steps))
    for p in paths:
        w = np.log(pi[p[0]]) + ll[0, p[0]]
        for t in range(1, steps):
            w += np.log(a[p[t - 1], p[t]]) + ll[t, p[t]]
        weights.append(w)
    w = np.exp(np.array(weights) - max(weights))
    total = w.sum()
    marg, xi = np.zeros((steps, n)), np.zeros((n, n))
    for p, x in zip(paths, w / total, strict=True):
        for t in range(steps):
            marg[t, p[t]] += x
            if t:
                xi[p[t - 1], p[t]] += x
    return np.log(total) + max(weights), marg, xi, paths[int(np.argmax(weights))]


@pytest.mark.parametrize("seed", range(20))
def test_against_all_paths(seed):
    pi, a, ll = model(seed)
    f, p, norm = hmm.filter_array(pi, ll, a)
    s = hmm.smooth_array(f, a)
    evidence, marg, _, best = enumerate_paths(pi, a, ll)
    assert np.isclose(norm.sum(), evidence, atol=1e-9) and np.allclose(s, marg, atol=1e-9)
    assert tuple(hmm.viterbi_array(pi, ll, a)) == best
    assert np.allclose(f.sum(axis=1), 1) and np.allclose(p.sum(axis=1), 1) and np.allclose(s[-1], f[-1])


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 5]), st.integers(1, 12))
def test_invariants(seed, n, steps):
    pi, a, ll = model(seed, n, steps)
    f, p, _ = hmm.filter_array(pi, ll, a)
    s = hmm.smooth_array(f, a)
    assert np.allclose(f.sum(axis=1), 1) and np.allclose(s.sum(axis=1), 1) and (s >= 0).all()
    flat, prior, _ = hmm.filter_array(pi, np.zeros_like(ll), a)
    assert np.allclose(flat, prior)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
@pytest.mark.parametrize("varying", [False, True])
@pytest.mark.parametrize("scan", [32, 2])
def test_chunks_change_nothing(spark, monkeypatch, chunk, varying, scan):
    monkeypatch.setattr(hmm, "SCAN_STATES", scan)  # 2: the plan for many states
    r = np.random.default_rng(1)
    n, steps = 3, 20
    pi, a, _ = model(5, n)
    ll = r.normal(size=(2, steps, n)) * 3
    tr = r.dirichlet(np.ones(n), size=(2, steps, n))
    df = spark.createDataFrame([(s, t, ll[s, t].tolist(), tr[s, t].ravel().tolist()) for s in range(2) for t in range(steps)], "s int, t_idx long, ll array<double>, tr array<double>")
    out = hmm.decode(df, pi, None if varying else a, ["s"], "tr" if varying else None, chunk).orderBy("s", "t_idx").toPandas()
    path = hmm.viterbi(df, pi, None if varying else a, ["s"], "tr" if varying else None, chunk).orderBy("s", "t_idx").toPandas()
    for s in range(2):
        m = tr[s] if varying else a
        f, p, norm = hmm.filter_array(pi, ll[s], m)
        mine = out[out.s == s]
        assert np.allclose(np.stack(mine.filtered), f) and np.allclose(np.stack(mine.predicted), p)
        assert np.allclose(np.stack(mine.smoothed), hmm.smooth_array(f, m)) and np.allclose(mine.log_norm, norm)
        assert (path[path.s == s].state.to_numpy() == hmm.viterbi_array(pi, ll[s], m)).all()


def test_many_states_and_no_session(spark):
    pi, a, ll = model(3, 40, 15)
    df = spark.createDataFrame([(t, ll[t].tolist()) for t in range(15)], "t_idx long, ll array<double>")
    out = hmm.decode(df, pi, a).orderBy("t_idx").toPandas()
    f, _, _ = hmm.filter_array(pi, ll, a)
    assert np.allclose(np.stack(out.smoothed), hmm.smooth_array(f, a))
    small = hmm.decode(df.selectExpr("t_idx", "slice(ll, 1, 2) ll"), [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], chunk=4).count()
    assert small == 15


def test_impossible_rows():
    pi, a = np.array([1.0, 0.0]), np.array([[1.0, 0.0], [0.0, 1.0]])
    ll = np.array([[0.0, 0.0], [-np.inf, -np.inf], [0.0, 0.0]])
    f, _, _ = hmm.filter_array(pi, ll, a)
    assert np.isfinite(f).all()


@pytest.mark.parametrize("seed", range(3))
def test_expected_transitions(spark, seed):
    pi, a, ll = model(seed, 2, 6)
    df = spark.createDataFrame([(t, ll[t].tolist()) for t in range(6)], "t_idx long, ll array<double>")
    got = em.matrix_of(em.expected_transitions(hmm.decode(df, pi, a), a), 2)
    assert np.allclose(got, enumerate_paths(pi, a, ll)[2], atol=1e-7)


def test_m_step():
    n = np.array([[8.0, 2.0], [0.0, 0.0]])
    assert np.allclose(em.update_transitions(n), [[0.8, 0.2], [0.5, 0.5]])
    sticky = em.update_transitions(n, 1.0, [10.0, 3.0])
    assert np.allclose(sticky[0], [18 / 20, 2 / 20]) and np.allclose(sticky[1], [0, 1])
    assert np.allclose(em.update_transitions(n, frozen=[0], before=np.eye(2))[0], [1, 0])
    assert np.allclose(em.update_transitions(n * 100, 1.0, 5.0, 0.5)[0], em.update_transitions(n, 1.0, 5.0, 0.5)[0])
    with pytest.raises(Exception, match="negative"):
        em.update_transitions(n, weight=-1.0)


def test_em_raises_the_likelihood(spark):
    r = np.random.default_rng(0)
    states = np.repeat([0, 1, 0, 1], 40)
    ll = np.where(states[:, None] == np.arange(2)[None], 0.0, -1.5) + r.normal(size=(160, 2)) * 0.3
    df = spark.createDataFrame([(t, x.tolist()) for t, x in enumerate(ll)], "t_idx long, ll array<double>")
    out = em.fit(lambda posterior: df, [0.5, 0.5], [[0.6, 0.4], [0.4, 0.6]], iterations=6, cut=lambda d: d.persist())
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(out["log_likelihoods"]))
    assert out["transition"][0, 0] > 0.9


def test_covariate_transitions(spark):
    """Newton steps find the coefficients that made the responses."""
    r = np.random.default_rng(2)
    x = np.c_[np.ones(400), r.normal(size=400)]
    true = np.array([[[0.5], [-1.0]], [[1.0], [0.3]]])
    p = 1 / (1 + np.exp(-np.einsum("na,ask->ns", x, true)))
    xi = np.stack([p[:, 0], 1 - p[:, 0], p[:, 1], 1 - p[:, 1]], axis=1)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, xi, strict=True)], "x array<double>, xi array<double>")
    assert np.allclose(em.update_covariate_transitions(df, np.zeros((2, 2, 1))), true, atol=1e-4)
