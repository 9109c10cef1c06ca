"""Clocks: tables (t_idx, t) of time bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import positive


def time_bins(spark: SparkSession, start: float, end: float, rate: float) -> DataFrame:
    """ceil((end - start) * rate) bins at start + i / rate."""
    n = math.ceil((end - start) * positive("rate", rate))
    return spark.range(max(n, 0)).select(F.col("id").alias("t_idx"), (F.lit(float(start)) + F.col("id") / F.lit(float(rate))).alias("t"))


def clock_of(events: DataFrame, step: float, t: str = "t", keys: list[str] | None = None) -> DataFrame:
    """(keys, t_idx, t): bins of ``step`` seconds, aligned to it, that cover the events of each key."""
    keys = keys or []
    ends = events.groupBy(*keys).agg(F.floor(F.min(t) / step).alias("a"), F.floor(F.max(t) / step).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias("k"), "a").select(*keys, (F.col("k") - F.col("a")).alias("t_idx"), (F.col("k") * F.lit(float(step))).alias("t"))
