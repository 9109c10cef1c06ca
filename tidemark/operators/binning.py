"""Events in time bins, runs of a condition, and events inside runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import windows

#: A clock of more bins is sorted in buckets of time of about so many.
BUCKET_BINS = 65_536


def uniform_bin(t: str, start: float, rate: float):
    """Index of the bin of a uniform clock."""
    return F.floor((F.col(t) - F.lit(float(start))) * F.lit(float(rate))).cast("long")


def in_bounds(events: DataFrame, clock: DataFrame, t: str = "t") -> DataFrame:
    """Events inside the clock, both ends included."""
    ends = clock.agg(F.min("t").alias("__t0"), F.max("t").alias("__t1"))
    return events.join(F.broadcast(ends), F.col(t).between(F.col("__t0"), F.col("__t1"))).drop("__t0", "__t1")


def bin_events(events: DataFrame, clock: DataFrame, keys: list[str] | None = None, t: str = "t", bucket: float | None = None) -> DataFrame:
    """Events inside the clock with ``t_idx``: the last bin that starts at or before the event.

    The last clock entry is an end, not a bin: what falls on it goes to the bin before (that bin is closed
    on the right).  One clock of at most BUCKET_BINS bins is broadcast and searched.  Otherwise it is an as-of step
    without a join: bins and events are sorted together and each event takes the last bin seen.  That is done
    in buckets of time of about BUCKET_BINS bins (or of ``bucket`` seconds), each of which also gets the last bin
    before it, so that a long clock is sorted by many tasks.

    With ``keys`` (sessions) events and clock have these columns, and each session has its own clock and buckets,
    the end included; events of a session without a clock (or with a null key) go.
    """
    keys = keys or []
    span = F.max("t_idx").alias("__n"), F.count("*").alias("__c"), F.min("t").alias("__t0"), F.max("t").alias("__t1")
    if keys:
        width = F.lit(float(bucket)) if bucket else F.when((F.col("__c") > BUCKET_BINS) & (F.col("__t1") > F.col("__t0")), (F.col("__t1") - F.col("__t0")) * BUCKET_BINS / F.col("__c"))
        ends = clock.groupBy(*keys).agg(*span).withColumn("__w", width)
        inner = events.join(ends, keys).where(F.col(t).between(F.col("__t0"), F.col("__t1")))
        bins = clock.select(*keys, "t_idx", "t").join(ends, keys).where(F.col("t_idx") < F.col("__n"))
    else:
        last = clock.agg(*span).first()
        if last["__n"] is None:
            return events.withColumn("t_idx", F.lit(None).cast("long")).limit(0)
        if bucket is None and last["__c"] <= BUCKET_BINS + 1:
            return _searched(events, clock, t)
        if bucket is None and last["__t1"] > last["__t0"]:
            bucket = (last["__t1"] - last["__t0"]) * BUCKET_BINS / last["__c"]
        given = {"__t0": F.lit(last["__t0"]), "__t1": F.lit(last["__t1"]), "__w": F.lit(bucket).cast("double")}
        inner = events.where(F.col(t).between(last["__t0"], last["__t1"])).withColumns(given)
        bins = clock.where(F.col("t_idx") < last["__n"]).withColumns(given)
    slot = F.coalesce(F.floor((F.col("__at") - F.col("__t0")) / F.col("__w")).cast("long"), F.lit(0).cast("long"))
    left = bins.select(*keys, F.col("t").alias("__at"), F.col("t_idx").alias("__bin"), F.lit(0).alias("__kind"), "__t0", "__t1", "__w").withColumn("__slot", slot)
    starts = Window.partitionBy(*(keys or [F.col("__w")])).orderBy("__slot")
    firsts = left.groupBy(*keys, "__slot").agg(F.max_by("__bin", "__at").alias("__bin"), *(F.max(c).alias(c) for c in ("__at", "__t0", "__t1", "__w"))).withColumn("__next", F.lead("__slot").over(starts))  # one row a bucket
    final = F.floor((F.col("__t1") - F.col("__t0")) / F.col("__w")).cast("long")
    carried = firsts.where("__w IS NOT NULL").select(*keys, "__at", "__bin", F.lit(0).alias("__kind"), F.explode(F.sequence(F.col("__slot") + 1, F.greatest(F.coalesce("__next", final), F.col("__slot") + 1))).alias("__slot"))
    left = left.drop("__t0", "__t1", "__w").unionByName(carried)
    right = inner.select(*keys, F.col(t).alias("__at"), F.lit(None).cast("long").alias("__bin"), F.lit(1).alias("__kind"), F.struct(*events.columns).alias("__row"), "__t0", "__w").withColumn("__slot", slot).drop("__t0", "__w")
    both = left.withColumn("__row", F.lit(None).cast(right.schema["__row"].dataType)).unionByName(right)
    order = Window.partitionBy(*keys, "__slot").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("t_idx", F.last("__bin", ignorenulls=True).over(order)).where("__kind = 1").select("__row.*", "t_idx")


def _searched(events: DataFrame, clock: DataFrame, t: str) -> DataFrame:
    """bin_events() on a clock of bounded size: no shuffle."""
    rows = sorted((r["t"], r["t_idx"]) for r in clock.select("t", "t_idx").collect())
    times, index = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    end, bins = times[-1], index < index.max()
    times, index = times[bins], index[bins]
    held = events.sparkSession.sparkContext.broadcast((times, index))
    at = events.columns.index(t)

    def run(batches):
        times, index = held.value
        for batch in batches:
            x = batch.column(at).cast("float64").fill_null(np.nan).to_numpy(zero_copy_only=False)
            seat = np.searchsorted(times, x, side="right") - 1
            inside = (seat >= 0) & (x <= end)
            found = pa.array(index[np.maximum(seat, 0)]) if len(index) else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "t_idx"]).filter(pa.array(inside))

    return events.mapInArrow(run, T.StructType([*events.schema.fields, T.StructField("t_idx", T.LongType())]))


def sparse_counts(events: DataFrame, clock: DataFrame, unit: str = "unit", keys: list[str] | None = None, bucket: float | None = None) -> DataFrame:
    """(keys, unit, t_idx, n) where there are events; no unit x clock grid."""
    return bin_events(events, clock, keys, bucket=bucket).groupBy(*(keys or []), unit, "t_idx").agg(F.count("*").alias("n"))


def counts(events: DataFrame, clock: DataFrame, units: DataFrame, unit: str = "unit", bucket: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, unit, t_idx, n) for every unit and clock entry, zero-filled; only events are aggregated.

    The last clock entry never has events.  ``units`` lists the units (one row each).
    """
    keys = keys or []
    found = bin_events(events, clock, keys, bucket=bucket).groupBy(*keys, unit, "t_idx").agg(F.count("*").alias("n"))
    grid = units.select(unit).crossJoin(clock.select(*keys, "t_idx"))
    return grid.join(found, [*keys, unit, "t_idx"], "left").select(*keys, unit, "t_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def segment_sum(rows: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Sums of per-event values by time bin (and further keys)."""
    return rows.groupBy(*by).agg(*(F.sum(v).alias(v) for v in values))


def runs(samples: DataFrame, condition: str, keys: list[str] | None = None, t: str = "t") -> DataFrame:
    """(keys, run, start, end): maximal runs of consecutive samples for which ``condition`` holds."""
    keys = keys or []
    marked = samples.withColumn("__on", F.coalesce(F.expr(condition), F.lit(False)))
    if not keys:  # one long recording: the number of runs that began so far is a prefix scan
        begins = windows.lagged(marked.select("__on", t), "__on", "__was", t, first=False).where("__on")
        islands = windows.running_sum(begins, F.when(F.col("__was"), 0).otherwise(1), "run", t)
        return islands.groupBy(F.col("run").cast("long").alias("run")).agg(F.min(t).alias("start"), F.max(t).alias("end"))
    order = Window.partitionBy(*keys).orderBy(t)
    inside = Window.partitionBy(*keys, "__on").orderBy(t)
    marked = marked.withColumn("__island", F.row_number().over(order) - F.row_number().over(inside)).where("__on")
    out = marked.groupBy(*keys, "__island").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return out.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("start")).cast("long").alias("run"), "start", "end")


def events_in_runs(events: DataFrame, spans: DataFrame, margin: float, keys: list[str] | None = None, t: str = "t", bucket: float = 3600.0) -> DataFrame:
    """Events in [start - margin, end + margin] of each run, with ``run``; near runs may both get an event.

    A range join by buckets of time: each span is listed under the buckets it touches, so the join is an
    equality on (keys, bucket) with a filter.
    """
    keys = keys or []
    low, high = F.col("start") - margin, F.col("end") + margin
    listed = spans.select(*keys, "run", low.alias("__low"), high.alias("__high"), F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))).alias("__b"))
    joined = events.withColumn("__b", F.floor(F.col(t) / bucket)).join(listed, [*keys, "__b"])
    return joined.where(F.col(t).between(F.col("__low"), F.col("__high"))).drop("__low", "__high", "__b")
