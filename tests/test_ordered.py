"""Operators over one long recording without keys: the same as the windows in one task, without that task."""

import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import analysis, asof, binning, gof, ordered, windows
from tidemark.plans import catalogue
from tidemark.sources import testdata


def rows_of(spark, n=700, seed=0, ties=True):
    r = random.Random(seed)
    ts = sorted(r.choice(range(n // 2)) if ties else k * 1.5 + r.random() for k in range(n))
    return spark.createDataFrame([(float(t), r.choice([0.0, 1.5, -2.0, r.random()]), k) for k, t in enumerate(ts)], "t double, v double, id long").repartition(5)


def single_tasks(df):
    """Exchanges of the plan that bring data rows to one task: all but those over block summaries."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window" in line and "[], [" in line.replace(" ", "")]


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_positions_and_scan(spark, blocks):
    df = rows_of(spark)
    got = sorted((r["__pos"], r["t"]) for r in ordered.positions(df, ["t"], blocks=blocks).collect())
    assert [p for p, _ in got] == list(range(700)) and [t for _, t in got] == sorted(t for _, t in got)
    out = ordered.scan(df, "v", "s", ["t", "id"], blocks=blocks).orderBy("t", "id").toPandas()
    assert np.allclose(out.s, out.v.cumsum())


def test_scan_with_sessions_and_null_keys(spark):
    df = rows_of(spark).withColumn("k", F.when(F.col("id") % 7 > 2, F.lit("hot")).when(F.col("id") % 7 == 1, F.lit("b")))
    got = ordered.scan(df, "v", "s", ["t", "id"], ["k"], blocks=9).toPandas().sort_values(["t", "id"])
    assert len(got) == 700
    for _, own in got.groupby("k", dropna=False):
        assert np.allclose(own.s, own.v.cumsum())


@pytest.mark.parametrize("rows", [1, 7, 64])
def test_halo_operators(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered.with_halo, "__defaults__", (rows, ordered.POSITION))
    monkeypatch.setattr(ordered.windowed, "__defaults__", ((), rows))
    df = rows_of(spark, 150, ties=False).withColumn("one", F.lit(1))
    for f in (
        lambda d, k: windows.gradient(d, "v", "out", order="t", keys=k), lambda d, k: windows.gradient(d, "v", "out", "t", "t", k),
        lambda d, k: windows.gaussian_smooth(d, "v", "out", 1.5, "t", k), lambda d, k: windows.cumulative_trapezoid(d, "v", "out", "t", k, 0.5),
        lambda d, k: windows.running_sum(d, "v", "out", "t", k), lambda d, k: windows.difference(d, "v", "out", "t", k, 3.0),
        lambda d, k: windows.lagged(d, "v", "out", "t", k, -1.0), lambda d, k: windows.speed(d, ["v"], "out", "t", "t", k, 1.0),
    ):
        want, got = (f(df, k).orderBy("t").toPandas() for k in (["one"], None))
        assert np.allclose(want.out.to_numpy(float), got.out.to_numpy(float)) and len(got) == 150
        assert sorted(got.columns) == sorted(want.columns)
    want, got = (windows.trajectory_direction(df, "v", order="t", keys=k).orderBy("t").toPandas() for k in (["one"], None))
    assert list(want.direction) == list(got.direction)
    want, got = (windows.movement_variance(df, ["v"], "t", k).first()["cov_v_v"] for k in (["one"], None))
    assert np.isclose(want, got)


@pytest.mark.parametrize("extrapolate", [True, False])
@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_interpolation(spark, n, extrapolate):
    r = random.Random(n)
    at = np.sort([r.random() * 100 for _ in range(n)])
    samples = spark.createDataFrame([(float(t), float(k % 5)) for k, t in enumerate(at)], "t double, v double").repartition(3)
    targets = spark.createDataFrame([(float(t), {"a": k}) for k, t in enumerate(np.linspace(-30, 140, 97))], "t double, m map<string,int>").repartition(4)
    out = asof.interpolate(targets, samples, ["v"], extrapolate=extrapolate).orderBy("t").toPandas()
    if n == 1:
        want = np.zeros(97)
    else:
        k = np.clip(np.searchsorted(at, out.t, side="right"), 1, n - 1)
        share = (out.t - at[k - 1]) / (at[k] - at[k - 1])
        want = (k - 1) % 5 + (share if extrapolate else np.clip(share, 0, 1)) * (k % 5 - (k - 1) % 5)
    assert len(out) == 97 and np.allclose(out.v, want)


def test_ranks_and_distributions(spark):
    df = rows_of(spark)
    want = df.withColumn("u", F.cume_dist().over(Window.orderBy("v"))).orderBy("id").toPandas()
    got = gof.rosenblatt(df, ["v"]).orderBy("id").toPandas()
    assert np.allclose(want.u, got.u_v)
    cdf = gof.empirical_cdf(df, "v").orderBy("v").toPandas()
    assert np.allclose(cdf.cdf, [(want.v <= x).mean() for x in cdf.v])
    u = df.select(F.rand(4).alias("u"))
    u = spark.createDataFrame(u.toPandas())
    a, b = gof.ks_statistic(u).first(), gof.ks_statistic(u.withColumn("k", F.lit(1)), ["k"]).first()
    assert a["n"] == b["n"] == 700 and np.isclose(a["ks"], b["ks"])
    q = gof.qq_points(u).orderBy("model").toPandas()
    assert np.allclose(q.model, (np.arange(700) + 0.5) / 700) and q.empirical.is_monotonic_increasing


def test_runs(spark):
    df = rows_of(spark, 300, ties=False).withColumn("one", F.lit(1))
    want, got = (sorted(tuple(r) for r in binning.runs(df, "v > 0.3", k).select("run", "start", "end").collect()) for k in (["one"], None))
    assert want == got and len(got) > 20
    assert binning.runs(df, "v > 99").count() == 0


@pytest.mark.parametrize("per", [3, 50])
def test_bins_without_keys(spark, per, monkeypatch):
    """A clock beyond the bound is cut in buckets of time, with and without sessions; events on ends included."""
    df = rows_of(spark, 400).withColumn("s", F.col("id") % 3)
    clock = spark.range(0, 41).select(F.col("id").alias("t_idx"), (F.col("id") * 5.0).alias("t"))
    keyed = clock.crossJoin(spark.range(3).withColumnRenamed("id", "s"))
    monkeypatch.setattr(binning, "BUCKET_BINS", per)
    for out in (binning.bin_events(df, clock), binning.bin_events(df, keyed, ["s"])):
        got = {r["id"]: r["t_idx"] for r in out.collect()}
        assert got == {r["id"]: min(int(r["t"] // 5), 39) for r in df.collect() if r["t"] <= 200}


def test_rescaled_at_events_by_session(spark):
    clock = spark.range(50).select(F.col("id").cast("double").alias("t"), F.lit(0.2).alias("intensity"))
    events = spark.createDataFrame([(3.5,), (10.0,), (40.25,)], "t double")
    out = gof.rescaled_at_events(clock, events).orderBy("t").toPandas()
    assert np.allclose(out.isi, [0.7, 1.3, 6.05]) and np.allclose(out.u, 1 - np.exp(-out.isi))


def test_no_row_goes_to_one_task(spark):
    """In the plans of the queries without keys one task orders block summaries only."""
    d = "/root/testdata/sf0.001"
    for name in ("multiunit_rate", "rosenblatt", "long_interpolation", "long_runs", "long_integral"):
        plan = catalogue.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        lone = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
        windows_ = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(" in line]
        assert len(lone) <= 4 and not any("windowspecdefinition(t" in line for line in windows_), (name, lone)
    ev = testdata.events(spark, d)
    assert analysis.multiunit_rate(ev, catalogue.hours(ev), ev.select("unit").distinct(), 1 / 3600, 7200).count() > 100


@pytest.mark.parametrize("block", [4, 32_768])
def test_all_lags_as_numpy(spark, block):
    """Sessions of one and of many blocks, one of a single interval."""
    r = np.random.default_rng(1)
    rows = [(s, float(k), float(x)) for s, n in (("a", 23), ("b", 9), ("c", 1)) for k, x in enumerate(r.random(n))]
    df = spark.createDataFrame(rows, "s string, t double, u double").repartition(3)
    z = {s: np.array([NormalDist().inv_cdf(x) for q, _, x in rows if q == s]) for s in "abc"}
    want = {(s, k): float((v[:len(v) - k] * v[k:]).sum() / (v * v).sum()) for s, v in z.items() for k in range(len(v))}
    got = {(x["s"], x["lag"]): x["c"] for x in gof.full_autocorrelation(df, ["s"], order="t", block=block).collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], atol=1e-7) for k in want)
    got = {(x["s"], x["lag"]): x["c"] for x in gof.full_autocorrelation(df, ["s"], order="t", max_lag=6, block=block).collect()}
    assert set(got) == {k for k in want if k[1] <= 6} and all(np.isclose(got[k], want[k], atol=1e-7) for k in got)


def test_lags_returned_are_those_reached():
    """Short sessions in a block of any size return as many lags as they have intervals, however the rows come in batches."""
    rows = pd.DataFrame([(s, 0, 0, side, i, float(i - side)) for s in range(3) for side in (0, 1) for i in range(5)], columns=["s", "__first", "__second", "__side", "__i", "__z"])
    for size in (3, 10, 100):
        out = pd.concat(gof.lag_products((rows[k:k + size] for k in range(0, len(rows), size)), ["s"], gof.BLOCK, None))
        assert len(out) == 15 and sorted(out.lag) == sorted([*range(5)] * 3)
        x, y = np.arange(5.0), np.arange(5.0) - 1
        assert np.allclose(out[out.s == 1]["__part"], [(x[:5 - k] * y[k:]).sum() for k in range(5)])


def test_blocks_become_more_with_the_rows(spark, monkeypatch):
    """Twenty times as many rows as a block should have: blocks stay small, and so do the tasks that order them."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 35)
    df = rows_of(spark)
    sizes = [r["count"] for r in ordered.in_blocks(df, ["t"]).groupBy(ordered.BLOCK).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 100
    placed = ordered.positions(df, ["t"])
    assert sorted(r["__pos"] for r in placed.collect()) == list(range(700)) and placed.rdd.getNumPartitions() == 20
    samples, targets = rows_of(spark, ties=False), spark.range(900).select((F.col("id") - 50.0).alias("t"))
    want = np.interp(np.arange(900) - 50.0, *samples.orderBy("t").toPandas()[["t", "v"]].to_numpy().T)
    out = asof.interpolate(targets, samples, ["v"], extrapolate=False)
    assert out.rdd.getNumPartitions() == 46 and np.allclose(out.orderBy("t").toPandas().v, want)


@pytest.mark.parametrize("extrapolate", [True, False])
def test_a_key_of_many_samples_is_cut(spark, monkeypatch, extrapolate):
    """One key with most rows, a null key, one of a single sample; blocks of targets alone, before, between and behind the samples."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 40)
    r = random.Random(4)
    at = {"hot": sorted({round(r.random() * 1000, 3) for _ in range(900)} | {4000.0, 5000.0, 5001.0}), None: [2.0, 3.0, 9.0], "one": [5.0], "none": []}
    samples = spark.createDataFrame([(k, t, float(i % 7)) for k, ts in at.items() for i, t in enumerate(ts)], "k string, t double, v double").repartition(5)
    times = [float(t) for t in (*range(-300, 0), *range(2000, 2300), *range(7000, 7300), *range(0, 1000, 9), *at["hot"][::50])]
    targets = spark.createDataFrame([(k, t) for k in at for t in times], "k string, t double").repartition(3)
    out = asof.interpolate(targets, samples, ["v"], ["k"], extrapolate=extrapolate)
    sizes = out.groupBy("k", F.spark_partition_id().alias("task")).count().where("k = 'hot'").collect()
    assert len(sizes) > 10 and max(s["count"] for s in sizes) < 200
    got = {(x["k"], x["t"]): x["v"] for x in out.collect()}
    assert len(got) == len({*times}) * 4 and all(got["none", t] is None and got["one", t] == 0 for t in times)
    for k in ("hot", None):
        ts, vs = np.array(at[k]), np.arange(len(at[k])) % 7.0
        i = np.clip(np.searchsorted(ts, times, side="right"), 1, len(ts) - 1)
        share = (np.array(times) - ts[i - 1]) / (ts[i] - ts[i - 1])
        want = vs[i - 1] + (share if extrapolate else np.clip(share, 0, 1)) * (vs[i] - vs[i - 1])
        assert np.allclose([got[k, t] for t in times], want)
