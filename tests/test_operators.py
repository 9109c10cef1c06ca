"""Binning, interpolation, windows, geometry, transitions, densities against NumPy."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions import checks, exprs
from tidemark.operators import analysis, asof, binning, geometry, glm, gmm, gof, kde, likelihood, transitions, windows
from tidemark.sources import clock, io, simulate


def test_count_edges(spark):
    """The last entry never has events, the bin before it is closed on the right, events outside are left out."""
    c = spark.createDataFrame([(k, float(t)) for k, t in enumerate([0, 1, 2.5, 4])], "t_idx long, t double")
    e = spark.createDataFrame([("a", t) for t in (-0.1, 0.0, 1.0, 0.999, 2.5, 3.9, 4.0, 4.1)] + [("b", 9.0)], "unit string, t double")
    units = e.select("unit").distinct()
    for bucket in (None, 1.0, 2.0):
        got = {(r["unit"], r["t_idx"]): r["n"] for r in binning.counts(e, c, units, bucket=bucket).collect()}
        assert got == {("a", 0): 2, ("a", 1): 1, ("a", 2): 3, ("a", 3): 0, ("b", 0): 0, ("b", 1): 0, ("b", 2): 0, ("b", 3): 0}


def test_runs(spark):
    s = spark.createDataFrame([(float(t), v) for t, v in enumerate([1, 1, 0, 1, None, 1])], "t double, v int")
    assert sorted(tuple(r) for r in binning.runs(s, "v = 1").collect()) == [(1, 0.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 5.0)]
    e = spark.createDataFrame([(t,) for t in (-1.0, 1.5, 2.0, 4.0, 6.1)], "t double")
    inside = binning.events_in_runs(e, binning.runs(s, "v = 1"), 1.0, bucket=2.0)
    assert sorted((r["t"], r["run"]) for r in inside.collect()) == [(-1.0, 1), (1.5, 1), (2.0, 1), (2.0, 2), (4.0, 2), (4.0, 3)]


@pytest.mark.parametrize("extrapolate", [True, False])
def test_interpolation(spark, extrapolate):
    xs, ys = np.array([0.0, 1.0, 3.0, 7.0]), np.array([2.0, 4.0, -2.0, 0.0])
    at = np.array([-2.0, 0.0, 0.5, 1.0, 2.0, 6.9, 7.0, 9.0])
    s = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys, strict=True)], "t double, v double")
    t = spark.createDataFrame([(float(a), k) for k, a in enumerate(at)], "t double, k int")
    got = {r["k"]: r["v"] for r in asof.interpolate(t, s, ["v"], extrapolate=extrapolate).collect()}
    want = np.interp(at, xs, ys)
    if extrapolate:
        want[0], want[-1] = 2 + 2 * -2, 0 + 0.5 * 2
    assert np.allclose([got[k] for k in range(len(at))], want)
    one = asof.interpolate(t, s.limit(1), ["v"], extrapolate=extrapolate).collect()
    assert {r["v"] for r in one} == {2.0}


def test_windows(spark):
    r = np.random.default_rng(0)
    x, t = r.normal(size=30), np.cumsum(r.uniform(0.1, 1, size=30))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, t, strict=True))], "t_idx long, x double, t double")
    col = lambda d, c: np.array([v[c] for v in d.orderBy("t_idx").collect()])
    assert np.allclose(col(windows.gradient(df, "x", "g"), "g"), np.gradient(x))
    assert np.allclose(col(windows.gradient(df, "x", "g", "t"), "g"), np.gradient(x, t))
    w = np.array(windows.gaussian_weights(1.5))
    assert np.allclose(col(windows.gaussian_smooth(df, "x", "s", 1.5), "s"), np.convolve(x, w, "full")[len(w) // 2:][:30])
    assert np.allclose(col(windows.cumulative_trapezoid(df, "x", "a"), "a"), np.r_[0, np.cumsum((x[1:] + x[:-1]) / 2)])
    assert np.isclose(windows.movement_variance(df, ["x"]).first()[0], np.var(np.diff(x), ddof=1))
    assert np.allclose(col(windows.lagged(df, "x", "l"), "l"), np.r_[0, x[:-1]])


def test_grid():
    assert len(geometry.grid_edges(np.array([[0.0, 10.0]]), 3.0)[0]) == 5
    assert [len(e) for e in geometry.grid_edges(np.array([[0.0, 10.0], [0.0, 5.0]]), 5.0)] == [5, 4]
    ring = np.ones((7, 7), bool)
    ring[3, 3] = False
    assert geometry.fill_holes(ring).all()
    assert geometry.interior_of(np.array([0, 2, 3, 1]), 1).tolist() == [False, True, True, False]
    assert (geometry.boundary_of(np.pad(np.ones((1, 1), bool), 1)).sum()) == 4


def test_bins_and_snapping(spark, monkeypatch):
    env = geometry.Environment("e", 1.0)
    env.columns, env.edges, env.interior = ("x",), [np.arange(7.0)], np.array([True, True, False, False, True, True])
    pts = [-3.0, 0.0, 1.0, 2.2, 3.4, 3.6, 5.0, 5.5, 99.0]
    got = [r["bin"] for r in env.bin_of(spark.createDataFrame([(x,) for x in pts], "x double")).collect()]
    assert got == [0, 0, 1, 1, 4, 4, 4, 5, 5]
    monkeypatch.setattr(geometry, "BROADCAST_BINS", 3)  # the plan for many bins
    assert [r["bin"] for r in env.bin_of(spark.createDataFrame([(x,) for x in pts], "x double")).collect()] == got
    assert np.isinf(env.distance[0, 5]) and env.distance[4, 5] == 1.0


@pytest.mark.parametrize("bucket", [None, 0.7, 2.5])
def test_bins_of_sessions(spark, bucket):
    r = np.random.default_rng(4)
    clocks = {"a": np.arange(0, 6, 0.5), "b": np.array([3.0, 3.1, 5.0, 9.0]), "c": np.array([1.0, 2.0])}
    rows = [(s, float(t)) for s in ("a", "b", "d") for t in r.uniform(-1, 10, 80)] + [("a", 5.5), ("b", 3.0), ("b", 9.0), (None, 3.5)]
    events = spark.createDataFrame(rows, "s string, t double").withColumn("unit", F.lit(1))
    clock = spark.createDataFrame([(s, k, float(t)) for s, ts in clocks.items() for k, t in enumerate(ts)], "s string, t_idx long, t double")
    got = sorted((x["s"], x["t"], x["t_idx"]) for x in binning.bin_events(events, clock, ["s"], bucket=bucket).collect())
    want = sorted((s, t, min(int(np.searchsorted(clocks[s], t, side="right")) - 1, len(clocks[s]) - 2)) for s, t in rows if s in clocks and clocks[s][0] <= t <= clocks[s][-1])
    assert got == want
    n = binning.counts(events, clock, events.select("unit").distinct(), bucket=bucket, keys=["s"])
    assert n.count() == 18 and n.agg(F.sum("n")).first()[0] == len(want)


def test_long_clocks_get_buckets(spark, monkeypatch):
    monkeypatch.setattr(binning, "BUCKET_BINS", 7)
    t = np.sort(np.random.default_rng(2).uniform(0, 50, 60))
    clock = spark.createDataFrame([(k, float(x)) for k, x in enumerate(t)], "t_idx long, t double")
    e = np.random.default_rng(3).uniform(0, 50, 200)
    got = {(x["t"], x["t_idx"]) for x in binning.bin_events(spark.createDataFrame([(float(x),) for x in e], "t double"), clock).collect()}
    assert got == {(x, min(int(np.searchsorted(t, x, side="right")) - 1, 58)) for x in e.tolist() if t[0] <= x <= t[-1]}


def test_environment_over_a_plane(spark):
    r = np.random.default_rng(0)
    xy = r.uniform(0, 20, size=(2000, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double")
    env = geometry.Environment("p", 5.0).fit(df, ["x", "y"])
    h, _ = np.histogramdd(xy, bins=env.edges)
    got = np.zeros(h.size)
    for row in env.occupancy(df).collect():
        got[row["bin"]] = row["n"]
    assert np.allclose(got.reshape(h.shape), h) and env.interior.sum() == 16
    d = env.distance
    inside = env.interior_bins
    assert np.isfinite(d[np.ix_(inside, inside)]).all() and np.allclose(d, d.T)


def test_shortest_paths_against_floyd():
    r = np.random.default_rng(1)
    n = 12
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, n, 18), r.integers(0, n, 18), r.uniform(1, 5, 18), strict=True)]
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        if a != b:
            d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    assert np.allclose(geometry.shortest_paths(n, edges), d)


def test_linear_track(spark):
    track = geometry.Track({0: (0.0, 0.0), 1: (10.0, 0.0), 2: (10.0, 10.0)}, [(0, 1), (1, 2)], spacing=2.0)
    df = spark.createDataFrame([(3.0, 1.0), (9.0, 5.0), (float("nan"), 0.0)], "x double, y double")
    out = geometry.linearize(df, track, ["x", "y"], []).collect()
    assert (out[0]["linear_position"], out[0]["edge_id"]) == (3.0, 0) and (out[1]["linear_position"], out[1]["edge_id"]) == (17.0, 1)
    assert math.isnan(out[2]["linear_position"]) and out[2]["edge_id"] is None
    edges, gap, _ = track.bin_edges(5.0)
    assert gap.tolist() == [False, False, True, False, False] and edges[-1] == 22.0
    d = track.bin_distances(5.0)
    assert np.isclose(d[0, 3], 10.0) and np.isinf(d[0, 2])
    with pytest.raises(checks.ValidationError):
        geometry.Track({0: (0.0,)}, [(0, 1)])


def test_transitions(spark):
    env = geometry.Environment("e", 1.0, ranges=[(0.0, 6.0)], infer_interior=False).fit(None, ["x"])
    for kind in (transitions.RandomWalk("e", 2.0), transitions.Uniform("e"), transitions.Identity("e"), transitions.ForwardWalk("e"), transitions.BackwardWalk("e"), transitions.RandomWalk("e", 2.0, along_graph=True), transitions.RandomWalk("e", 2.0, direction="inward")):
        assert np.allclose(kind.matrix([env]).sum(axis=1), 1)
    assert np.allclose(transitions.from_diagonal([0.9, 0.8, 0.7]).sum(axis=1), 1)
    space = transitions.StateSpace(["L", "C", "F"], [transitions.Observation("e", local=True), transitions.Observation("e"), transitions.Observation("e")], [env])
    walk, any_ = transitions.RandomWalk("e"), transitions.Uniform("e")
    c = space.continuous([[transitions.Discrete()] * 3, [transitions.Discrete(), walk, any_], [transitions.Discrete(), any_, any_]])
    joint = space.joint(c, transitions.from_diagonal([0.9, 0.8, 0.7]))
    assert joint.shape == (13, 13) and np.allclose(joint.sum(axis=1), 1) and np.isclose(space.initial([0.5, 0.25, 0.25]).sum(), 1)
    knots = [0.0, 1.0, 2.0]
    basis = spark.range(21).select((F.col("id") / 10).alias("x")).select(*transitions.bspline_columns(F.col("x"), knots)).collect()
    total = np.array(basis, float).sum(axis=1)
    assert (total <= 1 + 1e-12).all() and np.isclose(total[-1], 1)


def test_densities(spark):
    r = np.random.default_rng(0)
    s, w, pts = r.normal(size=(200, 2)), r.uniform(size=200), r.normal(size=(7, 2))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(s, w, strict=True)], "x double, y double, w double")
    std = np.array([0.5, 0.8])
    k = np.exp(-0.5 * (((pts[:, None] - s[None]) / std) ** 2).sum(axis=2)) / (2 * np.pi * std.prod())
    want = (k * w).sum(axis=1) / w.sum()
    for log in (False, True):
        got = {r_["bin"]: r_["density"] for r_ in kde.kde(df, ["x", "y"], pts, std, "w", log=log).collect()}
        got = np.array([got[i] for i in range(7)])
        assert np.allclose(np.exp(got) if log else got, want)
    far = kde.kde(df, ["x", "y"], pts + 500, std, log=True).collect()
    assert all(np.isfinite(x["density"]) for x in far)
    none = kde.kde(df.withColumn("w", F.lit(0.0)), ["x", "y"], pts, std, "w").collect()
    assert {x["density"] for x in none} == {0.0}


@pytest.mark.parametrize("tile", [10_000, 13])
def test_mark_intensity(spark, tile):
    r = np.random.default_rng(0)
    enc = [(int(u), *map(float, r.normal(size=3))) for u in r.integers(0, 2, 60)]
    dec = [(k, int(u), *map(float, r.normal(size=2))) for k, u in enumerate(r.integers(0, 2, 20))]
    e = spark.createDataFrame(enc, "unit int, m0 double, m1 double, x double")
    d = spark.createDataFrame(dec, "event_id long, unit int, m0 double, m1 double")
    rates = spark.createDataFrame([(0, 0.3), (1, 0.6)], "unit int, rate double")
    pts, occ = np.linspace(-2, 2, 5)[:, None], np.array([0.1, 0.2, 0.0, 0.2, 0.1])
    got = {x["event_id"]: x["ll"] for x in kde.mark_intensity(d, e, rates, occ, pts, ["m0", "m1"], ["x"], 0.7, 0.5, tile=tile).collect()}
    for k, u, a, b in dec:
        mine = np.array([x[1:] for x in enc if x[0] == u])
        km = np.exp(-0.5 * (((mine[:, :2] - [a, b]) / 0.7) ** 2).sum(axis=1)) / (2 * np.pi * 0.49)
        kp = np.exp(-0.5 * ((pts - mine[:, 2][None]) / 0.5) ** 2) / (0.5 * np.sqrt(2 * np.pi))
        with np.errstate(divide="ignore"):
            want = np.maximum(np.log([0.3, 0.6][u] * (kp @ km) / len(mine) / np.where(occ > 0, occ, np.inf)), exprs.LOG_EPS)
        assert np.allclose(got[k], want)


def test_poisson_paths_agree(spark, monkeypatch):
    f = spark.createDataFrame([(u, b, 0.1 + u + b) for u in range(3) for b in range(4)], "unit int, bin long, field double")
    n = spark.createDataFrame([(u, t, (u * t) % 3) for u in range(3) for t in range(5)], "unit int, t_idx long, n long")
    a = {r["t_idx"]: r["ll"] for r in kde.poisson_loglik(n, f, 4).collect()}
    monkeypatch.setattr(kde, "BROADCAST_NUMBERS", 0)
    b = {r["t_idx"]: r["ll"] for r in kde.poisson_loglik(n, f, 4).collect()}
    assert set(a) == set(b) and all(np.allclose(a[t], b[t]) for t in a)


def test_mixture(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal([0, 0], 0.5, size=(300, 2)), r.normal([4, 4], 0.5, size=(300, 2))])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    for kind in gmm.KINDS:
        m = gmm.fit_mixture(df, ["a", "b"], 2, kind)
        assert sorted(np.round(m.means[:, 0]).tolist()) == [0, 4] and np.isclose(m.weights.sum(), 1)
        got = np.array([v["log_density"] for v in gmm.score(df.limit(20), ["a", "b"], m).collect()])
        assert np.allclose(got, m.log_prob(np.array(df.limit(20).collect())))
        assert np.allclose(m.responsibilities(x).sum(axis=1), 1)
    with pytest.raises(checks.ValidationError):
        gmm.fit_mixture(df, ["a", "b"], 2, "other")


def test_poisson_regression(spark):
    r = np.random.default_rng(0)
    x = r.uniform(0, 10, 3000)
    n = r.poisson(np.exp(np.sin(x)))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, n, strict=True)], "x double, n long")
    design = glm.Design.over(df, ["x"], 2.0)
    beta = glm.fit_poisson(df, design, ["x"])
    at = np.linspace(1, 9, 17)[:, None]
    assert np.abs(design(at) @ beta - np.sin(at[:, 0])).max() < 0.35
    s = glm.NaturalSpline(np.array([0.0, 1.0, 3.0, 4.0]))
    grid = np.linspace(-1, 5, 61)
    assert np.allclose(s(grid).sum(axis=1), 1) and np.allclose(np.diff(s(np.linspace(4, 6, 5)) @ [1, 2, 0, 5], 2), 0)
    assert np.allclose(s(s.knots), np.eye(4))


def test_goodness_of_fit(spark):
    r = np.random.default_rng(0)
    lam, spk = r.uniform(0.05, 0.3, 200), r.uniform(size=200) < 0.2
    df = spark.createDataFrame([(k, float(a), bool(b)) for k, (a, b) in enumerate(zip(lam, spk, strict=True))], "t_idx long, intensity double, is_spike boolean")
    area = np.r_[0, np.cumsum((lam[1:] + lam[:-1]) / 2)]
    isi = np.diff(np.r_[0, area[spk]])
    u = (1 - np.exp(-isi)) / (1 - np.exp(-(area[-1] - area[spk] + isi)))
    got = gof.rescaled_intervals(df)
    assert np.allclose([x["u"] for x in got.orderBy("t_idx").collect()], u)
    ks = np.abs(np.sort(u) - (np.arange(len(u)) + 0.5) / len(u)).max()
    assert np.isclose(gof.ks_statistic(got).first()["ks"], ks)
    c = {x["lag"]: x["c"] for x in gof.interval_autocorrelation(got, 3).collect()}
    from statistics import NormalDist
    z = np.array([NormalDist().inv_cdf(min(max(v, 2.2e-16), 1 - 2.2e-16)) for v in u])
    assert np.isclose(c[0], 1) and np.isclose(c[2], (z[2:] * z[:-2]).sum() / (z * z).sum(), atol=1e-6)


def test_normal_quantiles(spark):
    from statistics import NormalDist
    ps = [1e-12, 1e-6, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(exprs.normal_ppf("p")).collect()
    assert np.allclose([r[0] for r in got], [NormalDist().inv_cdf(p) for p in ps], atol=1e-6)


def test_kernels(spark):
    env = geometry.Environment("e", 1.0, ranges=[(0.0, 5.0)], infer_interior=False).fit(None, ["x"])
    df = spark.createDataFrame([(0, 0.5), (1, 3.2), (2, float("nan"))], "t_idx long, x double")
    for std in (0.0, 1.5):
        for r in likelihood.local_kernel(df, env, std).collect():
            assert np.isclose(np.exp(r["kernel"]).sum(), 5)
    p = {r["t_idx"]: r["penalty"] for r in likelihood.non_local_penalty(df, env, 2.0, 1.0).collect()}
    assert np.isclose(p[0][0], -2) and np.isclose(p[0][2], -2 * np.exp(-2)) and set(p[2]) == {0.0}


def test_credible_regions(spark):
    r = np.random.default_rng(0)
    p = r.dirichlet(np.ones(8), size=6)
    df = spark.createDataFrame([(t, b, float(p[t, b])) for t in range(6) for b in range(8)], "t_idx long, bin long, p double")
    got = {x["t_idx"]: x["threshold"] for x in analysis.hpd_threshold(df, 0.8).collect()}
    for t in range(6):
        s = np.sort(p[t])[::-1]
        assert np.isclose(got[t], s[np.argmax(np.cumsum(s) >= 0.8)])
    assert all(np.isclose(x["kl"], 0) for x in analysis.kl_divergence(df, df).collect())
    assert all(x["overlap"] == 1 for x in analysis.hpd_overlap(df, df).collect())
    assert {x["t_idx"]: x["bin"] for x in analysis.map_estimate(df).collect()} == {t: int(p[t].argmax()) for t in range(6)}
    drawn = analysis.sample_posterior(df, 400).groupBy("t_idx", "bin").count().collect()
    share = {(x["t_idx"], x["bin"]): x["count"] / 400 for x in drawn}
    assert max(abs(share.get((t, b), 0) - p[t, b]) for t in range(6) for b in range(8)) < 0.1


def test_clock_io_and_checks(spark, tmp_path):
    c = clock.time_bins(spark, 1.0, 2.05, 10.0)
    assert c.count() == 11
    io.save_tables(str(tmp_path / "m"), {"clock": c}, {"rate": 10.0}, spark)
    tables, params = io.load_tables(spark, str(tmp_path / "m"))
    assert tables["clock"].count() == 11 and params == {"rate": 10.0}
    checks.clock_rows(c)
    with pytest.raises(checks.DataError):
        checks.clock_rows(spark.createDataFrame([(0, 1.0), (1, 0.5)], "t_idx long, t double"))
    for call in (lambda: checks.positive("x", -1), lambda: checks.probabilities("p", [0.5, 0.4]), lambda: checks.stochastic("a", [[0.5, 0.4], [0, 1]]), lambda: checks.monotone("t", [1, 0])):
        with pytest.raises(checks.ValidationError):
            call()


def test_simulators(spark):
    run = simulate.run_with_pauses(spark, 500, 50.0, 100.0, 50.0, 1.0)
    x = np.array([r["x"] for r in run.orderBy("t_idx").collect()])
    assert x.min() >= -1e-9 and x.max() <= 100 + 1e-9
    n = simulate.neuron_counts(run, [20.0, 80.0], 8.0, 20.0, 50.0)
    again = simulate.neuron_counts(run.repartition(3), [20.0, 80.0], 8.0, 20.0, 50.0)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, again.collect()))
    p = spark.range(4000).select(simulate.poisson(F.lit(2.5), 1, "id").alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(p[0] - 2.5) < 0.15 and abs(p[1] - 2.5) < 0.3
    marks = simulate.marked_events(run, [[20.0, 60.0]], [[[0.0, 0.0], [9.0, 9.0]]], 8.0, 30.0, 50.0, 0.5)
    assert marks.columns == ["event_id", "unit", "t_idx", "t", "m0", "m1"] and marks.count() > 20
    assert simulate.joined_replays([simulate.hover_replay(spark, 1, 3), simulate.continuous_replay(spark, 4), simulate.fragmented_replay(spark, 4)], 0.1).count() == 11


def test_gradient_of_rows_at_one_time(spark):
    """Steps of no time divide as floating-point numbers do, in the middle and at the ends."""
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 1.0, 5.0), (2, 1.0, 7.0), (3, 2.0, 9.0), (4, 3.0, 9.0), (5, 3.0, 8.0)], "k long, t double, v double").withColumn("one", F.lit(1))
    got = [r["g"] for r in windows.gradient(df, "v", "g", "t", "k", ["one"]).orderBy("k").collect()]
    assert all(math.isnan(got[k]) for k in (0, 1)) and got[2] == math.inf and got[3] == 1.0 and got[4] == -math.inf and got[5] == -math.inf
    assert [r["speed"] for r in windows.speed(df, ["v"], t="t", order="k", keys=["one"]).orderBy("k").collect()][2:] == [math.inf, 1.0, math.inf, math.inf]


def test_local_kernels_are_read_from_a_row_a_bin(spark):
    """The plan holds no functions over the other bins: the optimizer puts those in each other, so that bins are gone through again for each bin."""
    env = geometry.Environment("", bin_size=25.0, ranges=[(0.0, 500.0)], infer_interior=False).fit(None, ["x"])
    df = spark.createDataFrame([(3.0,), (480.0,), (None,)], "x double")
    for std in (0.0, 40.0):
        out = likelihood.local_kernel(df, env, std, ["x"])
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        rows = [r["kernel"] for r in out.collect()]
        assert sorted(np.isclose(np.exp(r).sum(), 20) for r in rows) == [True] * 3 and rows.count([0.0] * 20) == 1


@pytest.mark.parametrize("log", [False, True])
@pytest.mark.parametrize("held", [8, 1_000_000])
def test_densities_of_many_groups(spark, monkeypatch, held, log):
    """A hundred units and a null one in batches of 50 rows: plain sums, with room for two groups and for all."""
    monkeypatch.setattr(kde, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        r = np.random.default_rng(4)
        unit, x, pts = r.integers(0, 101, 1500), r.normal(size=1500), np.array([[-1.0], [0.0], [0.5], [60.0]])
        df = spark.createDataFrame([(None if u == 100 else int(u), float(v)) for u, v in zip(unit, x, strict=True)], "unit long, x double")
        k = np.exp(-0.5 * ((pts - x[None]) / 0.5) ** 2) / (0.5 * np.sqrt(2 * np.pi))
        for many in (False, True):
            rows = kde.kde(df.repartition(3), ["x"], pts, 0.5, by=["unit"], log=log, many=many).collect()
            got = {(r_["unit"], r_["bin"]): (np.exp(r_["density"]) if log else r_["density"], r_["mass"]) for r_ in rows}
            assert len(rows) == len(got) == 101 * 4
            assert all(np.allclose(got[None if u == 100 else u, b], (k[b, unit == u].mean(), (unit == u).sum()), atol=1e-300) for u in range(101) for b in range(4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
