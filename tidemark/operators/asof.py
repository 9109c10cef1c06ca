"""Linear interpolation of a sampled covariate at other times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import ordered as long_rows


def _with_neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the samples of others that their targets may need; those are samples (kind 0), so they are no result."""
    near = long_rows.near_rows(rows, F.col("__kind") == 0, ["__at", "__kind"], F.col("__s"), keys).withColumnRenamed("row", "__s")
    return long_rows.spread(rows.unionByName(near.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType))), rows)


def interpolate(targets: DataFrame, samples: DataFrame, values: list[str], keys: list[str] | None = None, t: str = "t", extrapolate: bool = True) -> DataFrame:
    """``targets`` with each value column interpolated at ``t``.

    Samples and targets are sorted together by time within the keys and each target takes the two samples
    before and after it; no join and no pair of rows is made.  Beyond the samples the nearest segment goes
    on (``extrapolate``) or the end value holds.  With one sample only, its value holds everywhere.

    The rows are range-partitioned by keys and time, so that a key of any size is cut in blocks; each block also
    gets the last two samples of its keys before it and the first two behind it.
    """
    keys = keys or []
    row = F.struct(*targets.columns)
    point = F.struct(F.col(t).alias("t"), *(F.col(v).cast("double").alias(v) for v in values))
    left = samples.select(*keys, F.col(t).alias("__at"), F.lit(0).alias("__kind"), point.alias("__s"))
    right = targets.select(*keys, F.col(t).alias("__at"), F.lit(1).alias("__kind"), row.alias("__row"))
    both = left.withColumn("__row", F.lit(None).cast(right.schema["__row"].dataType)).unionByName(right.withColumn("__s", F.lit(None).cast(left.schema["__s"].dataType)))
    both = _with_neighbours(long_rows.in_blocks(both, ["__at", "__kind"], keys), keys)
    groups, order = Window.partitionBy(*keys, long_rows.BLOCK), ["__at", "__kind", "__tie"]
    # What follows is looked at in reverse order: a frame that grows is summed up once, one that shrinks is not.
    # Each sample also knows its neighbour, which serves beyond the ends.
    for side, by in (("__before", order), ("__after", [F.desc(c) for c in order])):
        passed = groups.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("__far", F.last("__s", ignorenulls=True).over(passed))
        pair = F.when(F.col("__kind") == 0, F.struct(F.col("__s").alias("s"), F.col("__far").alias("far")))
        both = both.withColumn(side, F.last(pair, ignorenulls=True).over(passed)).drop("__far")
    hit = both.where("__kind = 1")
    a = F.coalesce(F.when(F.col("__after").isNull(), F.coalesce(F.col("__before.far"), F.col("__before.s"))).otherwise(F.col("__before.s")), F.col("__after.s"))
    b = F.when(F.col("__after").isNull(), F.col("__before.s")).when(F.col("__before").isNull(), F.coalesce(F.col("__after.far"), F.col("__after.s"))).otherwise(F.col("__after.s"))
    hit = hit.withColumn("__a", a).withColumn("__b", b)
    width = F.col("__b.t") - F.col("__a.t")
    share = F.when(width == 0, F.lit(0.0)).otherwise((F.col("__at") - F.col("__a.t")) / width)
    if not extrapolate:
        share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    hit = hit.withColumn("__share", share)
    kept = [c for c in targets.columns if c not in values]
    out = [(F.col(f"__a.{v}") + F.col("__share") * (F.col(f"__b.{v}") - F.col(f"__a.{v}"))).alias(v) for v in values]
    return hit.select(*(F.col(f"__row.{c}").alias(c) for c in kept), *out)
