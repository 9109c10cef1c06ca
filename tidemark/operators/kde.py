"""Kernel density estimates and the encoding models and likelihoods built on them.

Samples times bins is never materialised: each task multiplies its samples' kernels with the bins as matrices and
returns one partial sum per bin, and the partial sums are added by an ordinary aggregation.  Marked events meet
the encoding events of their unit in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.exprs import EPS, LOG_EPS
from ..sources.store import stored
from . import ordered

#: Rows of a matrix block, events of one side of a tile, and of one side of a matrix of events by events (8 MB).
BLOCK = 4096
TILE = 20_000
SIDE = 1024
#: Sums of groups that a task holds before it returns them (8 MB).
HELD = 1_000_000
#: More groups than this are brought together before their sums, and their fields are joined, not broadcast.
GROUPS = 1000
#: Standard deviations beyond which a kernel at a single place counts as 0: less than 1.3e-14 of its height.
CUT = 8.0
#: Fields of more numbers than this are joined too (64 MB).
BROADCAST_NUMBERS = 8_000_000
_LOG_SQRT_TAU = 0.5 * np.log(2 * np.pi)
_ARRAY = T.ArrayType(T.DoubleType(), False)


def kernel(points: np.ndarray, samples: np.ndarray, std: np.ndarray) -> np.ndarray:
    """(points, samples) product of normal densities."""
    return np.exp(log_kernel(points, samples, std))


def log_kernel(points: np.ndarray, samples: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Its logarithm, by |a|^2 + |b|^2 - 2ab on scaled coordinates, floored at distance 0."""
    a, b = points / std, samples / std
    d2 = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)
    return -0.5 * d2 - np.log(std).sum() - len(std) * _LOG_SQRT_TAU


def _std(std, n: int) -> np.ndarray:
    return np.broadcast_to(np.asarray(std, float), (n,)).copy()


def group_sums(points: np.ndarray, x: np.ndarray, w: np.ndarray, codes: np.ndarray, n: int, std: np.ndarray, log: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(top, part, mass) of n groups whose rows lie in the order of their ``codes``: by point the weighted kernel sums (relative to exp(top) with ``log``)."""
    top, part = np.full((n, len(points)), -np.inf if log else 0.0), np.zeros((n, len(points)))
    for a in range(0, len(x), BLOCK):
        own, heavy = codes[a:a + BLOCK], w[a:a + BLOCK]
        seats, first = np.unique(own, return_index=True)
        if not log:
            k = kernel(points, x[a:a + BLOCK], std)
            part[seats] += (k @ heavy)[None, :] if len(seats) == 1 else np.add.reduceat(k * heavy, first, axis=1).T
            continue
        with np.errstate(divide="ignore"):
            lk = log_kernel(points, x[a:a + BLOCK], std) + np.log(np.where(np.abs(heavy) < EPS, EPS, heavy))[None, :]
        new = np.maximum(top[seats], np.maximum.reduceat(lk, first, axis=1).T)
        ok = np.where(np.isfinite(new), new, 0.0)
        terms = np.exp(lk - ok[np.searchsorted(seats, own)].T)
        part[seats] = part[seats] * np.exp(top[seats] - ok) + np.add.reduceat(terms, first, axis=1).T
        top[seats] = new
    return top, part, np.bincount(codes, w, n)


def kde(samples: DataFrame, columns: Sequence[str], points: np.ndarray, std, weight: str | None = None, by: Sequence[str] = (), log: bool = False, many: bool = False) -> DataFrame:
    """(by, bin, density, mass): weighted kernel density of the samples of each group at each point.

    density is sum(w K) / sum(w), 0 for a group without weight; with ``log`` it is the logarithm, from
    the largest term and the sum relative to it, so that nothing underflows.

    A task adds up what it sees of each group, HELD numbers at a time.  ``many`` groups are brought together first, in
    ranges of group and place, so that few tasks return sums of the same group; a large group is cut in ranges too.
    """
    columns, by = list(columns), list(by)
    points, width = np.atleast_2d(np.asarray(points, float)), _std(std, len(columns))
    schema = T.StructType([*(samples.schema[k] for k in by), *(T.StructField(n, T.LongType() if n == "bin" else T.DoubleType()) for n in ("bin", "top", "part", "mass"))])
    room = max(1, HELD // len(points))

    def partial(frames):
        seats: dict = {}
        top, part, mass = np.empty((room, len(points))), np.empty((room, len(points))), np.empty(room)

        def held() -> pd.DataFrame:
            n, keys = len(seats), {k: pd.Series(list(v)).repeat(len(points)).to_numpy() for k, v in zip(by, zip(*seats, strict=True), strict=True)}
            return pd.DataFrame({**keys, "bin": np.tile(np.arange(len(points)), n), "top": top[:n].ravel(), "part": part[:n].ravel(), "mass": np.repeat(mass[:n], len(points))})

        for pdf in frames:
            codes, kinds = np.zeros(len(pdf), int), [()]
            if by:
                codes = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
                order = np.argsort(codes, kind="stable")
                codes, pdf = codes[order], pdf.iloc[order]
                first = pdf[by].iloc[np.unique(codes, return_index=True)[1]]
                kinds = list(zip(*(first[k].tolist() for k in by), strict=True))
            w, x = pdf["__w"].to_numpy(float), pdf[columns].to_numpy(float)
            for a in range(0, len(kinds), room):
                some = kinds[a:a + room]
                mine = slice(*np.searchsorted(codes, [a, a + len(some)]))
                if seats and len(seats) + sum(k not in seats for k in some) > room:
                    yield held()
                    seats.clear()
                known = len(seats)
                at = np.array([seats.setdefault(k, len(seats)) for k in some])
                top[known:len(seats)], part[known:len(seats)], mass[known:len(seats)] = -np.inf if log else 0.0, 0.0, 0.0
                tops, parts, masses = group_sums(points, x[mine], w[mine], codes[mine] - a, len(some), width, log)
                if log:
                    new = np.maximum(top[at], tops)
                    ok = np.where(np.isfinite(new), new, 0.0)
                    part[at] = part[at] * np.exp(top[at] - ok) + parts * np.exp(tops - ok)
                    top[at] = new
                else:
                    part[at] += parts
                mass[at] += masses
        if seats:
            yield held()

    clean = samples.select(*by, *(F.col(c).cast("double").alias(c) for c in columns), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    for c in columns:
        clean = clean.where(~F.isnan(c) & F.col(c).isNotNull())
    if many:
        clean = clean.repartitionByRange(*by, *columns)
    parts = clean.mapInPandas(partial, schema)
    if not log:
        out = parts.groupBy(*by, "bin").agg(F.sum("part").alias("s"), F.sum("mass").alias("mass"))
        return out.select(*by, "bin", F.when(F.col("mass") == 0, F.lit(0.0)).otherwise(F.col("s") / F.col("mass")).alias("density"), "mass")
    # One row a batch and bin: the largest exponent, then the sums relative to it.
    out = parts.groupBy(*by, "bin").agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "part")).alias("p"), F.sum("mass").alias("mass"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"] * F.exp(x["top"] - F.col("m")))
    return out.select(*by, "bin", (F.col("m") + F.log(total) - F.log("mass")).alias("density"), "mass")


def as_array(df: DataFrame, value: str, by: Sequence[str], n: int, fill: float = 0.0) -> DataFrame:
    """(by, value array): bins as one array of length n per group, missing ones filled."""
    listed = df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", value))).alias("m"))
    return listed.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(fill))).alias(value))


# --- events without marks ---------------------------------------------------------------------

def mean_rates(events: DataFrame, samples: DataFrame, unit: str = "unit", event_weight: str | None = None, sample_weight: str | None = None) -> DataFrame:
    """(unit, rate): weight at events over weight of all samples; 0 without weight."""
    w = F.sum(F.col(event_weight) if event_weight else F.lit(1.0)).alias("w")
    total = samples.agg(F.sum(F.col(sample_weight) if sample_weight else F.lit(1.0)).alias("total"))
    return events.groupBy(unit).agg(w).crossJoin(F.broadcast(total)).select(unit, F.when(F.coalesce("total", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("w") / F.col("total")).alias("rate"))


def place_fields(events: DataFrame, samples: DataFrame, columns: Sequence[str], points: np.ndarray, std, unit: str = "unit", event_weight: str | None = None, sample_weight: str | None = None, units: DataFrame | None = None) -> DataFrame:
    """(unit, bin, rate, field): rate of each unit by position.

    field = max(EPS, rate * density at events / density of samples), and max(EPS, EPS * rate) where no
    sample comes near.  events carry the position at their time in ``columns``.
    """
    occ = kde(samples, columns, points, std, sample_weight).select("bin", F.col("density").alias("occ"))
    many = units is not None and units.count() > GROUPS
    marginal = kde(events, columns, points, std, event_weight, [unit], many=many).select(unit, "bin", "density")
    rate = mean_rates(events, samples, unit, event_weight, sample_weight)
    if units is not None:
        rate = units.select(unit).join(rate, unit, "left").select(unit, F.coalesce("rate", F.lit(0.0)).alias("rate"))
    grid = rate.crossJoin(F.broadcast(occ))
    full = grid.join(marginal, [unit, "bin"], "left")
    raw = F.when(F.col("occ") > 0, F.col("rate") * F.coalesce("density", F.lit(0.0)) / F.col("occ")).otherwise(F.col("rate") * EPS)
    return full.select(unit, "bin", "rate", F.greatest(raw, F.lit(EPS)).alias("field"))


def poisson_loglik(counts: DataFrame, fields: DataFrame, n_bins: int, clock: DataFrame | None = None, unit: str = "unit") -> DataFrame:
    """(t_idx, ll array): sum over units of n log(field) - field.

    Only non-zero counts take part; what no event adds is the same for all times.  Counts are gathered by
    time (a row a unit at most) and multiplied with the logarithms of the fields, which are broadcast up to
    BROADCAST_NUMBERS numbers of at most GROUPS units and joined beyond.
    """
    some = counts.where("n > 0")
    times = (clock or counts).select("t_idx").distinct()
    n_units = fields.select(unit).distinct().count()
    silent = fields.groupBy("bin").agg(F.sum("field").alias("s"))
    if n_units > GROUPS or n_units * n_bins > BROADCAST_NUMBERS:
        base = silent.select("bin", (-F.col("s")).alias("base"))
        hit = some.join(fields, unit).groupBy("t_idx", "bin").agg(F.sum(F.col("n") * F.log("field")).alias("hit"))
        long = times.crossJoin(F.broadcast(base)).join(hit, ["t_idx", "bin"], "left").select("t_idx", "bin", (F.coalesce("hit", F.lit(0.0)) + F.col("base")).alias("ll"))
        return as_array(long, "ll", ["t_idx"], n_bins)
    spark = counts.sparkSession
    table = fields.select(F.col(unit).cast("string").alias("u"), "bin", "field").toPandas()  # checked size
    wide = table.pivot(index="u", columns="bin", values="field").sort_index()
    sent = spark.sparkContext.broadcast(({u: k for k, u in enumerate(wide.index)}, np.log(wide.to_numpy()), wide.to_numpy().sum(axis=0)))
    rows = times.join(some.groupBy("t_idx").agg(F.collect_list(F.struct(F.col(unit).cast("string").alias("u"), F.col("n").cast("double").alias("n"))).alias("c")), "t_idx", "left")

    def run(frames):
        seat, logs, total = sent.value
        for pdf in frames:
            out = np.tile(-total, (len(pdf), 1))
            for k, c in enumerate(pdf["c"]):
                for x in () if c is None else c:
                    if x["u"] in seat:
                        out[k] += x["n"] * logs[seat[x["u"]]]
            yield pd.DataFrame({"t_idx": pdf["t_idx"], "ll": list(out)})

    return rows.mapInPandas(run, T.StructType([times.schema["t_idx"], T.StructField("ll", _ARRAY)]))


def kernel_sums(x: np.ndarray, y: np.ndarray, std: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """(x, n): sums of the kernels of the samples y of each of n codes; no matrix is larger than SIDE x SIDE or SIDE x n."""
    total = np.zeros((len(x), n))
    for j in range(0, len(y), SIDE):
        share = np.eye(n)[codes[j:j + SIDE]]
        for i in range(0, len(x), SIDE):
            total[i:i + SIDE] += kernel(x[i:i + SIDE], y[j:j + SIDE], std) @ share
    return total


def mark_sums(own: np.ndarray, marks: np.ndarray, places: np.ndarray, points: np.ndarray, mark_std: np.ndarray, position_std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each event's ``own`` marks: the largest log kernel of the ``marks``, and by point the sum over samples relative to it.

    No matrix is larger than SIDE x SIDE or SIDE x points.
    """
    top, part = np.full(len(own), -np.inf), np.zeros((len(own), len(points)))
    for j in range(0, len(marks), SIDE):
        position = kernel(points, places[j:j + SIDE], position_std).T
        for k in range(0, len(own), SIDE):
            lk = log_kernel(own[k:k + SIDE], marks[j:j + SIDE], mark_std)
            new = np.maximum(top[k:k + SIDE], lk.max(axis=1))
            part[k:k + SIDE] = part[k:k + SIDE] * np.exp(top[k:k + SIDE] - new)[:, None] + np.exp(lk - new[:, None]) @ position
            top[k:k + SIDE] = new
    return top, part


def sums_at(targets: DataFrame, key: str, samples: DataFrame, columns: Sequence[str], std, same: str | None = None, by: str | None = None, grid: Sequence[str] | None = None, cut: float = CUT, tile: int = TILE) -> DataFrame:
    """(key[, by], total): sums over samples of the kernel at each target's own place; targets without a sample near go.

    Both sides lie in cells of ``cut`` standard deviations in the ``grid`` columns (all unless told), and a target meets
    the samples of its own and the neighbouring cells: what is left out is less than exp(-cut^2 / 2) of a kernel's
    height a sample.  Cells with many rows are cut in tiles of ``tile`` rows of either side.  ``same`` must be equal on
    both sides; ``by``, a column of the samples, parts the sums.  Rows with unknown places take no part.
    """
    columns, grid = list(columns), list(grid or columns)
    width = _std(std, len(columns))
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)
    cell = [f"__c{k}" for k in range(len(grid))]
    seat = [F.floor(F.col(c) / float(cut * width[columns.index(c)])).cast("long") for c in grid]
    on = [*cell, *(["__same"] if same else [])]
    own = [F.col(same).alias("__same")] if same else []
    right = samples.where(known).select(*own, *([F.col(by).alias("__by")] if by else []), *(F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(columns)), *(x.alias(c) for x, c in zip(seat, cell, strict=True)))
    left = targets.where(known).select(F.col(key).alias("__key"), *own, *(F.col(c).cast("double").alias(c) for c in columns), *(F.explode(F.array(x - 1, x, x + 1)).alias(c) if k == 0 else x.alias(c) for k, (x, c) in enumerate(zip(seat, cell, strict=True))))
    for c in cell[1:]:
        left = left.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    n_right = right.groupBy(*on).agg(F.count("*").alias("n_right"))
    n_left = left.groupBy(*on).agg(F.count("*").alias("n_left"))
    shape = stored(n_right.join(n_left, on).withColumn("eb", F.ceil(F.col("n_right") / tile)).withColumn("db", F.ceil(F.col("n_left") / tile)))
    b = ordered.join_counted(right, shape, on, "n_right").withColumn("__e", F.pmod(F.xxhash64(*(f"__{k}" for k in range(len(columns)))), F.col("eb"))).withColumn("__d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("db") - 1))).drop("n_right", "n_left", "eb", "db")
    a = ordered.join_counted(left, shape, on, "n_left").withColumn("__d", F.pmod(F.xxhash64("__key"), F.col("db"))).withColumn("__e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("eb") - 1))).drop("n_right", "n_left", "eb", "db")
    keyed = T.StructField("__key", targets.schema[key].dataType)
    schema = T.StructType([keyed, *([T.StructField("__by", samples.schema[by].dataType)] if by else []), T.StructField("part", T.DoubleType())])
    names = [f"__{k}" for k in range(len(columns))]

    def run(_, at: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(at) or not len(near):
            return pd.DataFrame({f.name: [] for f in schema})
        codes, kinds = pd.factorize(near["__by"]) if by else (np.zeros(len(near), int), [None])
        total = kernel_sums(at[columns].to_numpy(float), near[names].to_numpy(float), width, codes, len(kinds))
        out = {"__key": np.repeat(at["__key"].to_numpy(), len(kinds)), "part": total.ravel()}
        if by:
            out["__by"] = np.tile(np.asarray(kinds), len(at))
        return pd.DataFrame(out)[[f.name for f in schema]]

    parts = a.groupBy(*on, "__e", "__d").cogroup(b.groupBy(*on, "__e", "__d")).applyInPandas(run, schema)
    return parts.groupBy(F.col("__key").alias(key), *([F.col("__by").alias(by)] if by else [])).agg(F.sum("part").alias("total"))


def _density_at(targets: DataFrame, key: str, samples: DataFrame, columns: Sequence[str], std, by: str | None = None) -> DataFrame:
    """(key[, by], density): kernel density of the samples (of each group) at the targets near them."""
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)
    mass = samples.where(known).groupBy(*([by] if by else [])).agg(F.count("*").alias("__n"))
    sums = sums_at(targets, key, samples, columns, std, by=by)
    joined = sums.join(mass, by) if by else sums.crossJoin(F.broadcast(mass))  # a row a group; one row
    return joined.select(key, *([by] if by else []), (F.col("total") / F.col("__n")).alias("density"))


def _fields_at(positions: DataFrame, events: DataFrame, samples: DataFrame, columns: Sequence[str], std, unit: str) -> DataFrame:
    """(t_idx, unit, field): rates at the clock's places of the units with events near; elsewhere a field is EPS."""
    rates = mean_rates(events, samples, unit)
    occ = _density_at(positions, "t_idx", samples, columns, std).withColumnRenamed("density", "occ")
    near = _density_at(positions, "t_idx", events, columns, std, unit)
    field = F.when(F.col("occ") > 0, F.col("rate") * F.col("density") / F.col("occ")).otherwise(F.col("rate") * EPS)
    return near.join(rates, unit).join(occ, "t_idx", "left").select("t_idx", unit, F.greatest(field, F.lit(EPS)).alias("field"))


def local_loglik(counts: DataFrame, events: DataFrame, samples: DataFrame, positions: DataFrame, columns: Sequence[str], std, unit: str = "unit", units: DataFrame | None = None) -> DataFrame:
    """(t_idx, ll): the likelihood of being where the animal is; positions: (t_idx, columns) on the clock.

    counts may leave out units without events; ``units`` lists the units (those of the events unless told).
    """
    near = _fields_at(positions, events, samples, columns, std, unit)
    some = counts.where("n > 0").select("t_idx", unit, "n")
    both = near.join(some, ["t_idx", unit], "full")
    f = F.coalesce("field", F.lit(EPS))
    term = F.coalesce(F.col("n") * F.log(f), F.lit(0.0)) - f
    sums = both.groupBy("t_idx").agg(F.sum(term).alias("x"), F.count("*").alias("k"))
    all_units = (units if units is not None else events.select(unit).distinct()).agg(F.count("*").alias("u"))
    rest = (F.col("u") - F.coalesce("k", F.lit(0))) * EPS
    return positions.select("t_idx").join(sums, "t_idx", "left").crossJoin(F.broadcast(all_units)).select("t_idx", (F.coalesce("x", F.lit(0.0)) - rest).alias("ll"))


def no_event_loglik(counts: DataFrame, step: float, rate: float = 1e-10, clock: DataFrame | None = None, n_units: int | None = None) -> DataFrame:
    """(t_idx, ll): Poisson likelihood at a tiny rate for every unit; step is the clock's median step.

    With ``clock`` and ``n_units`` the counts may leave out units without events.
    """
    r = rate * step
    if clock is None:
        return counts.groupBy("t_idx").agg(F.sum(F.when(F.col("n") == 0, 0.0).otherwise(F.col("n") * float(np.log(r))) - r).alias("ll"))
    hits = counts.groupBy("t_idx").agg(F.sum("n").alias("__n"))
    return clock.select("t_idx").join(hits, "t_idx", "left").select("t_idx", (F.coalesce("__n", F.lit(0)) * float(np.log(r)) - n_units * r).alias("ll"))


# --- marked events ----------------------------------------------------------------------------

def ground_intensity(events: DataFrame, samples: DataFrame, columns: Sequence[str], points: np.ndarray, std, unit: str = "unit") -> DataFrame:
    """(bin, intensity): sum over units of max(EPS, rate * density at events / density of samples)."""
    fields = place_fields(events, samples, columns, points, std, unit)
    return fields.groupBy("bin").agg(F.sum("field").alias("intensity"))


def mark_intensity(decode: DataFrame, encode: DataFrame, rates: DataFrame, occupancy: np.ndarray, points: np.ndarray, marks: Sequence[str], columns: Sequence[str], mark_std, position_std, unit: str = "unit", event: str = "event_id", tile: int = TILE) -> DataFrame:
    """(unit, event, ll array): log joint intensity of each decoded event at each point.

    log(rate * mean over the unit's encoding events of K_mark K_position / occupancy), not under LOG_EPS;
    a point without occupancy has LOG_EPS.  Kernels are kept as (largest exponent, sum relative to it), so
    the tiles of a unit with many encoding events add up exactly.
    """
    marks, columns = list(marks), list(columns)
    ms, ps = _std(mark_std, len(marks)), _std(position_std, len(columns))
    points = np.atleast_2d(np.asarray(points, float))
    totals = encode.select(unit, F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(decode.select(unit, F.lit(0).alias("e"), F.lit(1).alias("d")))
    shape = totals.groupBy(F.col(unit).alias("__unit")).agg(F.sum("e").alias("n_enc"), F.sum("d").alias("n_dec")).where("n_enc > 0 AND n_dec > 0").withColumn("eb", F.ceil(F.col("n_enc") / tile)).withColumn("db", F.ceil(F.col("n_dec") / tile))
    enc = encode.select(unit, *marks, *columns).join(shape, F.col(unit) == F.col("__unit")).withColumn("e", F.pmod(F.xxhash64(*marks, *columns), F.col("eb"))).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("db") - 1))).select(F.col(unit).alias("__u"), F.col("e").alias("__e"), F.col("d").alias("__d"), *(F.col(c).alias(f"__{c}") for c in (*marks, *columns)))
    dec = decode.select(unit, event, *marks).join(shape, F.col(unit) == F.col("__unit")).withColumn("d", F.pmod(F.xxhash64(event), F.col("db"))).withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("eb") - 1))).select(unit, "e", "d", event, *marks)
    schema = T.StructType([decode.schema[unit], decode.schema[event], T.StructField("top", T.DoubleType()), T.StructField("part", _ARRAY)])

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """a: decoded events, b: encoding events of the tile."""
        if not len(a) or not len(b):
            return pd.DataFrame({unit: [], event: [], "top": [], "part": []})
        top, part = mark_sums(a[marks].to_numpy(float), b[[f"__{c}" for c in marks]].to_numpy(float), b[[f"__{c}" for c in columns]].to_numpy(float), points, ms, ps)
        return pd.DataFrame({unit: a[unit], event: a[event], "top": top, "part": list(part)})

    tiles = dec.groupBy(unit, "e", "d").cogroup(enc.groupBy("__u", "__e", "__d")).applyInPandas(run, schema)
    grouped = tiles.groupBy(unit, event).agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "part")).alias("p"))  # a row a tile of the unit
    zero = F.array_repeat(F.lit(0.0), len(points))
    total = F.aggregate("p", zero, lambda acc, x: F.zip_with(acc, x["part"], lambda s, y: s + y * F.exp(x["top"] - F.col("m"))))
    occ = F.array(*(F.lit(float(o)) for o in occupancy))
    per_unit = rates.select(F.col(unit).alias("__rated"), "rate").join(shape.select("__unit", "n_enc"), F.col("__rated") == F.col("__unit"))
    joined = grouped.join(F.broadcast(per_unit), F.col(unit) == F.col("__unit"))
    base = F.col("m") + F.log("rate") - F.log("n_enc")
    ll = F.zip_with(total, occ, lambda s, o: F.when((o <= 0) | (s <= 0) | (F.col("rate") <= 0), F.lit(LOG_EPS)).otherwise(F.greatest(F.lit(LOG_EPS), base + F.log(s) - F.log(o))))
    return joined.select(unit, event, ll.alias("ll"))


def marked_loglik(intensity: DataFrame, when: DataFrame, ground: DataFrame, clock: DataFrame, n_bins: int, event: str = "event_id") -> DataFrame:
    """(t_idx, ll array): events' log intensities summed by time bin, less the ground intensity; when: (event, t_idx)."""
    hits = intensity.join(when.select(event, "t_idx"), event).select("t_idx", F.posexplode("ll").alias("bin", "x")).groupBy("t_idx", "bin").agg(F.sum("x").alias("x"))
    base = ground.select("bin", F.col("intensity"))
    grid = clock.select("t_idx").crossJoin(F.broadcast(base))
    return as_array(grid.join(hits, ["t_idx", "bin"], "left").select("t_idx", "bin", (F.coalesce("x", F.lit(0.0)) - F.col("intensity")).alias("ll")), "ll", ["t_idx"], n_bins)


def marked_local_loglik(decode: DataFrame, encode: DataFrame, samples: DataFrame, rates: DataFrame, positions: DataFrame, marks: Sequence[str], columns: Sequence[str], mark_std, position_std, unit: str = "unit", event: str = "event_id") -> DataFrame:
    """(t_idx, ll): marked likelihood at the animal's own place.

    decode carries t_idx, marks and the position at the event; positions (t_idx, columns) the clock's.
    Sum over events of log(rate * mean K_mark K_position / occupancy at the event), less the sum over units
    of rate * density at events / occupancy at the time.
    """
    marks, columns = list(marks), list(columns)
    ps = _std(position_std, len(columns))
    std = np.concatenate([_std(mark_std, len(marks)), ps])
    mass = encode.groupBy(F.col(unit).alias("__u")).agg(F.count("*").alias("__n"))
    joint = sums_at(decode, event, encode, [*marks, *columns], std, same=unit, grid=columns)
    occ_event = _density_at(decode.select(event, *columns), event, samples, columns, ps).withColumnRenamed("density", "occ")
    per_unit = rates.join(mass, F.col(unit) == F.col("__u"))
    hits = decode.select(event, "t_idx", unit).join(joint, event, "left").join(occ_event, event, "left").join(per_unit.drop("__u"), unit)
    near = F.coalesce("total", F.lit(0.0)) / F.col("__n")
    hits = hits.select("t_idx", F.log(F.greatest(F.col("rate") * near / F.greatest(F.coalesce("occ", F.lit(0.0)), F.lit(EPS)), F.lit(EPS))).alias("x")).groupBy("t_idx").agg(F.sum("x").alias("x"))
    occ_time = _density_at(positions, "t_idx", samples, columns, ps).withColumnRenamed("density", "occ")
    by_unit = _density_at(positions, "t_idx", encode, columns, ps, unit)
    term = F.greatest(F.col("rate") * F.col("density") / F.greatest(F.coalesce("occ", F.lit(0.0)), F.lit(EPS)), F.lit(EPS))
    ground = by_unit.join(rates, unit).join(occ_time, "t_idx", "left").groupBy("t_idx").agg(F.sum(term).alias("g"), F.count("*").alias("k"))
    all_units = rates.agg(F.count("*").alias("u"))
    out = positions.select("t_idx").join(hits, "t_idx", "left").join(ground, "t_idx", "left").crossJoin(F.broadcast(all_units))
    rest = (F.col("u") - F.coalesce("k", F.lit(0))) * EPS  # units without events near
    return out.select("t_idx", (F.coalesce("x", F.lit(0.0)) - F.coalesce("g", F.lit(0.0)) - rest).alias("ll"))


def points_table(spark: SparkSession, points: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(np.atleast_2d(points))], "bin long, center array<double>")
