"""The queries over whole tables against brute force on a small fixture."""

import numpy as np
import pytest

from tidemark.plans import catalogue

N = 60
C = catalogue.POINTS[:, 0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = np.random.default_rng(8)
    t = 1704067200 + np.sort(r.choice(np.arange(0, 40 * 3600, 7), N, replace=False)) + 0.5
    ev = {"unit": np.array(["click", "signup", "view"])[np.arange(N) % 3], "t": t, "value": np.round(r.uniform(1, 499, N), 3)}
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(k, str(ev["unit"][k]), 1, float(t[k]), float(ev["value"][k])) for k in range(N)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, s double, value double")
    df.selectExpr("event_id", "event_type", "user_id", "cast(timestamp_micros(cast(s * 1e6 as long)) as timestamp_ntz) as ts", "value").write.parquet(f"{path}/events.parquet")
    emb = r.normal(0, 0.3, (N, 3)).astype(np.float32)
    spark.createDataFrame([(k, f"u{k % 2}", emb[k].tolist()) for k in range(N)], "vec_id long, label string, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, ev, emb.astype(float)


def found(spark, tables, name, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in catalogue.QUERIES[name](spark, tables[0]).collect()}


def same(got, want, digits):
    assert set(got) == set(want) and want
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2 * 10.0**-digits), k


def kernel(d, s):
    return np.exp(-0.5 * (d / s) ** 2) / (s * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("clamp", [False, True])
def test_interpolation_of_each_unit(spark, tables, clamp):
    _, ev, _ = tables
    want = {}
    for u in set(ev["unit"]):
        t, v = ev["t"][ev["unit"] == u], ev["value"][ev["unit"] == u]
        for i in range(1460):
            x = 1704060000.0 + 1800.0 * i
            k = min(max(int((t <= x).sum()), 1), len(t) - 1) - 1
            f = (x - t[k]) / (t[k + 1] - t[k])
            f = min(max(f, 0), 1) if clamp else f
            want[u, i] = v[k] + f * (v[k + 1] - v[k])
    same(found(spark, tables, "asof_lerp_clamp" if clamp else "asof_lerp", "unit", "t_idx", "value"), want, 4)


def test_speed_of_each_unit(spark, tables):
    _, ev, _ = tables
    want = {}
    for u in set(ev["unit"]):
        at = np.flatnonzero(ev["unit"] == u)
        want |= {(int(k),): abs(g) for k, g in zip(at, np.gradient(ev["value"][at], ev["t"][at]), strict=True)}
    same(found(spark, tables, "speed", "event_id", "speed"), want, 5)


def fields(ev):
    k = kernel(C[None] - ev["value"][:, None], catalogue.STD)
    occ = k.mean(axis=0)
    out = {}
    for u in set(ev["unit"]):
        mine = ev["unit"] == u
        out[u] = mine.mean(), np.maximum(mine.mean() * k[mine].mean(axis=0) / occ, 1e-15)
    return out


def test_densities_and_fields_of_all_bins(spark, tables):
    _, ev, _ = tables
    k = kernel(C[None] - ev["value"][:, None], catalogue.STD)
    same(found(spark, tables, "kde_log_density", "unit", "bin", "density"), {(u, b): np.log(k[ev["unit"] == u].mean(axis=0)[b]) for u in set(ev["unit"]) for b in range(20)}, 6)
    want = fields(ev)
    same(found(spark, tables, "place_fields", "unit", "bin", "field"), {(u, b): f[b] for u, (_, f) in want.items() for b in range(20)}, 6)
    ll = {}
    hour = np.floor(ev["t"] / 3600).astype(int)
    for i, h in enumerate(range(hour.min(), hour.max() + 2)):
        for b in range(20):
            ll[i, b] = sum((n * np.log(f[b]) if (n := ((hour == h) & (ev["unit"] == u)).sum()) else 0) - f[b] for u, (_, f) in want.items())
    same(found(spark, tables, "poisson_loglik", "t_idx", "bin", "ll"), ll, 4)


def test_all_marked_events_are_decoded(spark, tables):
    e = tables[2]
    unit, x, m = np.arange(N) % 2, e[:, 0] * 500 + 250, e[:, 1:] * 100
    k = kernel(C[None] - x[:, None], 30.0)
    occ = k.mean(axis=0)
    ll = np.empty((N, 20))
    for i in range(N):
        mine = unit == unit[i]
        w = kernel(m[mine] - m[i], 24.0).prod(axis=1)
        ll[i] = np.maximum(np.log(mine.mean() * (w[:, None] * k[mine]).mean(axis=0) / occ), np.log(1e-15))
    same(found(spark, tables, "mark_intensity", "vec_id", "bin", "ll"), {(i, b): ll[i, b] for i in range(N) for b in range(20)}, 5)
    ground = sum(np.maximum((unit == u).mean() * k[unit == u].mean(axis=0) / occ, 1e-15) for u in (0, 1))
    sums = {(i, b): ll[(np.arange(N) // 5) % 40 == i, b].sum() - ground[b] for i in range(40) for b in range(20)}
    same(found(spark, tables, "marked_loglik", "t_idx", "bin", "ll"), sums, 4)


def test_local_states_of_all_events(spark, tables):
    _, ev, _ = tables
    b = np.minimum(np.floor(ev["value"] / 25), 19)
    d = np.abs(b[:, None] - np.arange(20)) * 25.0
    cells = [(i, j) for i in range(N) for j in range(20)]
    same(found(spark, tables, "local_penalty", "event_id", "bin", "penalty"), {c: -3 * np.exp(-0.5 * d[c] ** 2 / 2500) for c in cells}, 6)
    g = -0.5 * d**2 / 1600
    g = g - np.log(np.exp(g).sum(axis=1, keepdims=True)) + np.log(20)
    same(found(spark, tables, "local_kernel", "event_id", "bin", "kernel"), {c: g[c] for c in cells}, 6)
    same(found(spark, tables, "local_delta_kernel", "event_id", "bin", "kernel"), {(i, j): np.log(20) if b[i] == j else -np.inf for i, j in cells}, 6)


def test_glm_fields_of_all_units(spark, tables):
    """All units in the same passes against each on its own."""
    from tidemark.operators import glm
    from tidemark.sources.testdata import events as event_rows

    out = found(spark, tables, "glm_fields", "unit", "bin", "field")
    ev = event_rows(spark, tables[0])
    assert sorted(out) == sorted((u, k) for u in ("click", "signup", "view") for k in range(20))
    design = glm.Design.over(ev, ["value"], 100.0)
    rows = ev.selectExpr("value", "cast(unit = 'view' as int) as n")
    beta = glm.fit_poisson(rows, design, ["value"])
    same({(k,): out["view", k] for k in range(20)}, {(k,): v for k, v in enumerate(np.exp(design(catalogue.POINTS) @ beta))}, 5)
