"""Posterior analytics: best estimates, credible regions, agreement, distances and directions on the track."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .geometry import Environment
from .windows import gradient


def map_estimate(posterior: DataFrame, keys: Sequence[str] = ("t_idx",), p: str = "p", bin: str = "bin", keep: Sequence[str] = ()) -> DataFrame:
    """The most probable bin of each time; ties go to the lowest, NaN never wins. One aggregation, no sort."""
    good = posterior.where(~F.isnan(p) & F.col(p).isNotNull())
    best = F.max_by(F.struct(bin, p, *keep), F.struct(F.col(p), -F.col(bin))).alias("b")
    return good.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{bin}").alias(bin), F.col(f"b.{p}").alias(p), *(F.col(f"b.{c}").alias(c) for c in keep))


def hpd_threshold(posterior: DataFrame, coverage: float = 0.95, keys: Sequence[str] = ("t_idx",), p: str = "p") -> DataFrame:
    """(keys, threshold): the probability at which the bins, largest first, reach the coverage."""
    w = Window.partitionBy(*keys).orderBy(F.desc(p), "bin")
    total = Window.partitionBy(*keys)
    run = posterior.where(~F.isnan(p)).withColumn("__c", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(p).over(total))
    hit = run.where(F.col("__c") >= coverage)
    return hit.groupBy(*keys).agg(F.max(p).alias("threshold"))


def spatial_coverage(posterior: DataFrame, sizes: DataFrame | None = None, coverage: float = 0.95, keys: Sequence[str] = ("t_idx",), p: str = "p") -> DataFrame:
    """(keys, size): total size (or number) of the bins in the credible region; sizes: (bin, size)."""
    inside = posterior.join(hpd_threshold(posterior, coverage, keys, p), list(keys)).where(F.col(p) >= F.col("threshold"))
    if sizes is not None:
        return inside.join(F.broadcast(sizes), "bin").groupBy(*keys).agg(F.sum("size").alias("size"))
    return inside.groupBy(*keys).agg(F.count("*").cast("double").alias("size"))


def kl_divergence(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("t_idx",), p: str = "p", eps: float = 1e-10) -> DataFrame:
    """(keys, kl) of a from b, both normalised in each group."""
    def normal(df, name):
        w = Window.partitionBy(*keys)
        return df.select(*keys, "bin", (F.col(p) / F.sum(p).over(w)).alias(name))

    both = normal(a, "pa").join(normal(b, "pb"), [*keys, "bin"])
    term = F.when(F.col("pa") <= 0, 0.0).otherwise(F.col("pa") * F.log(F.greatest("pa", F.lit(eps)) / F.greatest("pb", F.lit(eps))))
    return both.groupBy(*keys).agg(F.sum(term).alias("kl"))


def hpd_overlap(a: DataFrame, b: DataFrame, coverage: float = 0.95, keys: Sequence[str] = ("t_idx",), p: str = "p") -> DataFrame:
    """(keys, overlap): bins in both credible regions over the smaller region's number."""
    def region(df, name):
        return df.join(hpd_threshold(df, coverage, keys, p), list(keys)).select(*keys, "bin", (F.col(p) >= F.col("threshold")).cast("int").alias(name))

    both = region(a, "ina").join(region(b, "inb"), [*keys, "bin"], "full").fillna(0, ["ina", "inb"])
    return both.groupBy(*keys).agg((F.sum(F.col("ina") * F.col("inb")) / F.greatest(F.least(F.sum("ina"), F.sum("inb")), F.lit(1))).alias("overlap"))


def sample_posterior(posterior: DataFrame, n: int, keys: Sequence[str] = ("t_idx",), p: str = "p", seed: int = 0) -> DataFrame:
    """n bins per time drawn with their probabilities, by the inverse of the running sum."""
    w = Window.partitionBy(*keys).orderBy("bin")
    total = Window.partitionBy(*keys)
    run = posterior.withColumn("__hi", F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(p).over(total)).withColumn("__lo", F.coalesce(F.lag("__hi").over(w), F.lit(0.0)))
    draw = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    drawn = run.withColumn("draw", draw)
    u = (F.pmod(F.xxhash64(*keys, "draw", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return drawn.where((u > F.col("__lo")) & (u <= F.col("__hi"))).select(*keys, "draw", "bin")


def bin_distance(pairs: DataFrame, env: Environment, a: str, b: str, out: str = "distance") -> DataFrame:
    """Path length between two bin columns."""
    return env.manifold_distance(pairs, a, b, out)


def next_hops(env: Environment) -> np.ndarray:
    """hop[i, j]: the neighbour of bin i on a shortest path to j (i itself at the goal or without a path)."""
    from .geometry import neighbour_edges

    d, n = env.distance, len(env.points)
    hop = np.tile(np.arange(n)[:, None], (1, n))
    if env.track is not None:
        touching = [(i, i + 1, d[i, i + 1]) for i in range(n - 1) if np.isfinite(d[i, i + 1])]
    else:
        touching = neighbour_edges(env.shape, env.interior, env.points)
    best = np.full((n, n), np.inf)
    for u, v, w in touching:
        for x, y in ((u, v), (v, u)):
            through = w + d[y]
            better = (through < best[x]) & np.isfinite(through) & (np.arange(n) != x)
            best[x][better], hop[x][better] = through[better], y
    return hop


def ahead_behind(pairs: DataFrame, env: Environment, animal: str, mental: str, heading: str, out: str = "ahead_behind") -> DataFrame:
    """Signed path length from the animal's bin to the decoded one: positive in the direction of its heading (radians)."""
    hop, pts, d = next_hops(env), env.points, env.distance
    rows = []
    for i in env.interior_bins:
        step = pts[hop[i]] - pts[i]
        rows.append((int(i), d[i].tolist(), np.arctan2(step[:, 1] if pts.shape[1] > 1 else 0.0, step[:, 0]).tolist()))
    table = pairs.sparkSession.createDataFrame(rows, "__a long, __d array<double>, __h array<double>")
    at = (F.col(mental) + 1).cast("int")
    joined = pairs.join(F.broadcast(table), F.col(animal) == F.col("__a"), "left")
    side = F.signum(F.cos(F.col(heading) - F.element_at("__h", at)))
    return joined.withColumn(out, F.element_at("__d", at) * F.when(side == 0, 1.0).otherwise(side)).drop("__a", "__d", "__h")


def map_speed(estimates: DataFrame, env: Environment, rate: float, bin: str = "bin", order: str = "t_idx", keys: Sequence[str] = (), out: str = "speed") -> DataFrame:
    """Speed of the best estimate along the track: path lengths between neighbours in time, central inside."""
    w = Window.partitionBy(*keys).orderBy(order)
    moved = estimates.withColumn("__n", F.lead(bin).over(w))
    stepped = env.manifold_distance(moved, bin, "__n", "__step")
    before = F.lag("__step").over(w)
    value = F.when(F.col("__n").isNull(), before).when(before.isNull(), F.col("__step")).otherwise((F.col("__step") + before) / 2)
    return stepped.withColumn(out, value * float(rate)).drop("__n", "__step")


def heading(df: DataFrame, x: str, y: str, t: str = "t", order: str = "t_idx", keys: list[str] | None = None, out: str = "heading") -> DataFrame:
    """Direction of movement in radians."""
    moved = gradient(gradient(df, x, "__vx", t, order, keys), y, "__vy", t, order, keys)
    return moved.withColumn(out, F.atan2("__vy", "__vx")).drop("__vx", "__vy")


def heading_similarity(df: DataFrame, heading_column: str, from_xy: tuple[str, str], to_xy: tuple[str, str], out: str = "similarity") -> DataFrame:
    """Cosine between the heading and the direction from one point to another."""
    way = F.atan2(F.col(to_xy[1]) - F.col(from_xy[1]), F.col(to_xy[0]) - F.col(from_xy[0]))
    return df.withColumn(out, F.cos(F.col(heading_column) - way))


def state_probability(posterior: DataFrame, keys: Sequence[str] = ("t_idx",), state: str = "state", p: str = "p") -> DataFrame:
    return posterior.groupBy(*keys, state).agg(F.sum(p).alias(p))


def conditional_non_local(posterior: DataFrame, local_states: Sequence[str], keys: Sequence[str] = ("t_idx",), state: str = "state", p: str = "p") -> DataFrame:
    """Posterior given that the state is none of the local ones."""
    rest = posterior.where(~F.col(state).isin(list(local_states)))
    total = F.sum(p).over(Window.partitionBy(*keys))
    return rest.withColumn(p, F.when(total == 0, 0.0).otherwise(F.col(p) / total))


def quantized(posterior: DataFrame, keys: Sequence[str] = ("t_idx",), p: str = "p") -> DataFrame:
    """Probabilities as 0..255, zeros left out, for display."""
    return posterior.select(*keys, "bin", F.floor(F.col(p) * 255).cast("int").alias("level")).where("level > 0")


def multiunit_rate(events: DataFrame, clock: DataFrame, units: DataFrame, rate: float, sigma: float, unit: str = "unit") -> DataFrame:
    """(t_idx, rate): all units' events per second, Gaussian smoothed (sigma in seconds)."""
    from .binning import counts
    from .windows import gaussian_smooth

    total = counts(events, clock, units, unit).groupBy("t_idx").agg((F.sum("n") * float(rate)).alias("x"))
    return gaussian_smooth(total, "x", "rate", sigma * rate).select("t_idx", "rate")
