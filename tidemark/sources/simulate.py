"""Synthetic recordings: trajectories, event trains and marked events as tables.

Randomness comes from keyed hashes of row numbers, so a table is the same however it is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def uniform(seed: int, *columns) -> Column:
    """A number in (0, 1) for each row, fixed by the columns and the seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def normal(seed: int, *columns) -> Column:
    """A standard normal number for each row (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *columns))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *columns))


def poisson(rate: Column, seed: int, *columns, most: int = 40) -> Column:
    """A Poisson number by the inverse of its distribution, up to ``most``."""
    u = uniform(seed, *columns)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("n")),
        lambda a, k: F.struct((a["p"] * rate / k).alias("p"), (a["c"] + a["p"] * rate / k).alias("c"), F.when(u > a["c"], k).otherwise(a["n"]).alias("n")),
        lambda a: a["n"],
    )
    return step


def times(spark: SparkSession, n: int, rate: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("t_idx"), (F.col("id") / F.lit(float(rate))).alias("t"))


def run_back_and_forth(clock: DataFrame, height: float, speed: float, out: str = "x") -> DataFrame:
    """Sinusoid between 0 and height at the given running speed."""
    f = 1 / (2 * height / speed)
    return clock.withColumn(out, height / 2 * F.sin(2 * math.pi * f * F.col("t") - math.pi / 2) + height / 2)


def run_with_period(clock: DataFrame, height: float, period: float, out: str = "x") -> DataFrame:
    """The same with the period given."""
    return clock.withColumn(out, height / 2 * F.sin(2 * math.pi * F.col("t") / period - math.pi / 2) + height / 2)


def run_with_pauses(spark: SparkSession, n: int, rate: float, height: float, speed: float, pause: float, out: str = "x") -> DataFrame:
    """Back and forth with a rest of ``pause`` seconds at each far end; cut to n samples."""
    half = height / speed  # seconds from one end to the other
    cycle = 2 * half + pause
    clock = times(spark, n, rate)
    at = F.pmod(F.col("t"), F.lit(cycle))
    moving = F.when(at < half, at).when(at < half + pause, F.lit(half)).otherwise(at - pause)
    return clock.withColumn(out, height / 2 * F.sin(math.pi * moving / half - math.pi / 2) + height / 2)


def place_rate(x: str | Column, center: float, std: float, peak: float, base: float = 0.001) -> Column:
    """Gaussian field of the given peak on a small base rate."""
    x = F.col(x) if isinstance(x, str) else x
    return F.lit(float(peak)) * F.exp(-0.5 * ((x - float(center)) / float(std)) ** 2) + F.lit(float(base))


def neuron_counts(position: DataFrame, centers: Sequence[float], std: float, peak: float, rate: float, seed: int = 0, x: str = "x") -> DataFrame:
    """(unit, t_idx, n): Poisson counts of units with Gaussian fields."""
    units = F.explode(F.array(*(F.struct(F.lit(k).alias("unit"), F.lit(float(c)).alias("center")) for k, c in enumerate(centers)))).alias("u")
    rows = position.select("t_idx", F.col(x).alias("x"), units).select("t_idx", "u.unit", F.exp(-0.5 * ((F.col("x") - F.col("u.center")) / float(std)) ** 2).alias("g"))
    return rows.select("unit", "t_idx", poisson(F.col("g") * (peak / rate) + 0.001 / rate, seed, "unit", "t_idx").cast("long").alias("n"))


def event_train(counts: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """(event_id, unit, t): counts spread over their bins."""
    rows = counts.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(F.xxhash64("unit", "t_idx", "k").alias("event_id"), "unit", (F.col("t_idx") / rate + uniform(seed, "unit", "t_idx", "k") / rate).alias("t"))


def marked_events(position: DataFrame, centers: Sequence[Sequence[float]], mark_means: Sequence[Sequence[Sequence[float]]], std: float, peak: float, rate: float, mark_std: float, seed: int = 0, x: str = "x") -> DataFrame:
    """(event_id, unit, t_idx, t, m0, m1, ...): events of several neurons per unit with marks around their means.

    centers[unit][neuron] and mark_means[unit][neuron][feature]; where two neurons of a unit fire in one bin
    the later one's mark stands.
    """
    cells = [F.struct(F.lit(u).alias("unit"), F.lit(k).alias("cell"), F.lit(float(c)).alias("center"), F.array(*(F.lit(float(m)) for m in mark_means[u][k])).alias("mean")) for u, row in enumerate(centers) for k, c in enumerate(row)]
    rows = position.select("t_idx", "t", F.col(x).alias("x"), F.explode(F.array(*cells)).alias("c")).select("t_idx", "t", "x", "c.*")
    chance = F.exp(-0.5 * ((F.col("x") - F.col("center")) / float(std)) ** 2) * (peak / rate)
    fired = rows.where(uniform(seed, "unit", "cell", "t_idx") < chance)
    last = fired.groupBy("unit", "t_idx").agg(F.max_by(F.struct("t", "mean", "cell"), "cell").alias("f")).select("unit", "t_idx", "f.*")
    n = len(mark_means[0][0])
    return last.select(F.xxhash64("unit", "t_idx").alias("event_id"), "unit", "t_idx", "t", *((F.element_at("mean", k + 1) + float(mark_std) * normal(seed + 10 + k, "unit", "t_idx")).alias(f"m{k}") for k in range(n)))


def scripted_replay(spark: SparkSession, order: Sequence[int], start: float, step: float) -> DataFrame:
    """(event_id, unit, t): one event each in the given order of units (a continuous or a fragmented replay)."""
    return spark.createDataFrame([(k, int(u), start + k * step) for k, u in enumerate(order)], "event_id long, unit int, t double")


def continuous_replay(spark: SparkSession, n_units: int, start: float = 0.0, step: float = 0.004) -> DataFrame:
    """Units fire in the order of their fields."""
    return scripted_replay(spark, range(n_units), start, step)


def fragmented_replay(spark: SparkSession, n_units: int, start: float = 0.0, step: float = 0.004, jump: int = 7) -> DataFrame:
    """Neighbouring events come from distant units."""
    return scripted_replay(spark, [(k * jump) % n_units for k in range(n_units)], start, step)


def hover_replay(spark: SparkSession, unit: int, n: int, start: float = 0.0, step: float = 0.004) -> DataFrame:
    """One unit fires again and again."""
    return scripted_replay(spark, [unit] * n, start, step)


def joined_replays(parts: Sequence[DataFrame], gap: float) -> DataFrame:
    """Replays one after another (hover-continuous-hover and the like)."""
    out, shift = None, 0.0
    for p in parts:
        moved = p.withColumn("t", F.col("t") + shift)
        out = moved if out is None else out.unionByName(moved)
        shift += (p.agg(F.max("t")).first()[0] or 0.0) + gap
    return out
