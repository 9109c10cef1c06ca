"""Spatial grids, track interiors, bin graphs and linearised tracks.

Grids are small (bins, not samples), so their geometry is worked out on the driver with NumPy and joined to the
samples as a broadcast table; the samples themselves are only aggregated (extent, occupancy) and projected.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.checks import ConfigurationError, positive, track_graph
from .windows import gaussian_smooth, gradient

#: A distance table of so many bins at most is broadcast; beyond it is joined, and points are snapped in Arrow batches.
BROADCAST_BINS = 2000


def centers(edges: np.ndarray) -> np.ndarray:
    return edges[:-1] + np.diff(edges) / 2


def extent(samples: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """(dimension, 2) least and largest values, NaN left out."""
    good = [F.when(~F.isnan(c), F.col(c)) for c in columns]
    row = samples.agg(*(f(g) for g in good for f in (F.min, F.max))).first()
    return np.array(row, float).reshape(-1, 2)


def grid_edges(ranges: np.ndarray, bin_size: float | Sequence[float], padding: bool | None = None) -> list[np.ndarray]:
    """Edges of ceil(extent / size) equal bins per dimension; several dimensions get one more bin on each side."""
    sizes = np.broadcast_to(np.asarray(bin_size, float), (len(ranges),))
    padding = len(ranges) > 1 if padding is None else padding
    out = []
    for (low, high), size in zip(ranges, sizes, strict=True):
        n = max(int(np.ceil((high - low) / positive("bin_size", size))), 1)
        e = np.linspace(low, high, n + 1)
        if padding:
            step = e[1] - e[0]
            e = np.concatenate([[e[0] - step], e, [e[-1] + step]])
        out.append(e)
    return out


def mesh_centers(edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin centers in row-major order, (bins, dimensions)."""
    return np.stack([m.ravel() for m in np.meshgrid(*(centers(e) for e in edges), indexing="ij")], axis=1)


def place(value: Column, edges: np.ndarray) -> Column:
    """Bin along one dimension: inner edges at or below the value, values on the last inner edge to the left; outliers at the ends."""
    inner = edges[1:-1]
    if len(inner) == 0:
        return F.lit(0)
    steps = np.diff(edges)
    if np.allclose(steps, steps[0], rtol=1e-9):  # arithmetic place, then one step of repair against rounding
        guess = F.least(F.greatest(F.floor((value - F.lit(float(edges[0]))) / F.lit(float(steps[0]))), F.lit(0)), F.lit(len(inner))).cast("int")
        table = F.array(*(F.lit(float(e)) for e in inner))
        low = F.when((guess > 0) & (value < F.element_at(table, F.greatest(guess, F.lit(1)))), guess - 1).otherwise(guess)
        at = F.when((low < len(inner)) & (value >= F.element_at(table, F.least(low + 1, F.lit(len(inner))))), low + 1).otherwise(low)
    else:
        at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in inner)), lambda e: e <= value))
    return F.when(value == float(inner[-1]), at - 1).otherwise(at)


def flat_index(values: Sequence[Column], edges: Sequence[np.ndarray]) -> Column:
    """Row-major bin of a point."""
    out = F.lit(0)
    for v, e in zip(values, edges, strict=True):
        out = out * (len(e) - 1) + place(v, e)
    return out.cast("long")


def _shifted(mask: np.ndarray, fill: bool) -> list[np.ndarray]:
    """The mask moved one step along each axis, both ways."""
    out = []
    for axis, step in itertools.product(range(mask.ndim), (1, -1)):
        moved = np.full_like(mask, fill)
        src, dst = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
        src[axis], dst[axis] = (slice(None, -1), slice(1, None)) if step == 1 else (slice(1, None), slice(None, -1))
        moved[tuple(dst)] = mask[tuple(src)]
        out.append(moved)
    return out


def dilate(mask: np.ndarray) -> np.ndarray:
    """Cross-shaped dilation."""
    return np.logical_or.reduce([mask, *_shifted(mask, False)])


def erode(mask: np.ndarray) -> np.ndarray:
    """Cross-shaped erosion; outside counts as empty."""
    return np.logical_and.reduce([mask, *_shifted(mask, False)])


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Fill what is not reached from the border."""
    outside = np.zeros_like(mask)
    border = np.ones_like(mask)
    border[(slice(1, -1),) * mask.ndim] = False
    outside = border & ~mask
    while True:
        grown = dilate(outside) & ~mask
        if (grown == outside).all():
            return ~outside
        outside = grown


def interior_of(counts: np.ndarray, threshold: int = 0, fill: bool = False, inflate: bool = False) -> np.ndarray:
    """Bins with more than ``threshold`` samples; several dimensions are closed, and their last bins are off."""
    mask = counts > threshold
    if mask.ndim > 1:
        mask = erode(dilate(mask))
        if fill:
            mask = fill_holes(mask)
        if inflate:
            mask = dilate(mask)
        for axis in range(mask.ndim):
            last = [slice(None)] * mask.ndim
            last[axis] = -1
            mask[tuple(last)] = False
    return mask


def boundary_of(mask: np.ndarray) -> np.ndarray:
    """Bins just outside the interior."""
    return dilate(mask) ^ mask


def boundary_order(points: np.ndarray) -> np.ndarray:
    """Boundary points in walking order: from the first on, always to the nearest one left."""
    left, out = list(range(1, len(points))), [0] if len(points) else []
    while left:
        d = np.linalg.norm(points[left] - points[out[-1]], axis=1)
        out.append(left.pop(int(np.argmin(d))))
    return points[out]


def shortest_paths(n: int, edges: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """All-pairs distances of an undirected graph; infinity between parts."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    out = np.full((n, n), np.inf)
    for s in range(n):
        row, heap = out[s], [(0.0, s)]
        row[s] = 0.0
        while heap:
            d, u = heapq.heappop(heap)
            if d > row[u]:
                continue
            for v, w in near[u]:
                if d + w < row[v]:
                    row[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return out


def neighbour_edges(shape: Sequence[int], mask: np.ndarray, points: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges between interior bins that touch, corners included, by their centers' distance."""
    flat, out = mask.ravel(), []
    strides = np.array([int(np.prod(shape[k + 1:])) for k in range(len(shape))])
    inside = np.argwhere(mask)
    for step in itertools.product((-1, 0, 1), repeat=len(shape)):
        if step <= (0,) * len(shape):  # each pair once
            continue
        other = inside + np.array(step)
        ok = ((other >= 0) & (other < np.array(shape))).all(axis=1)
        a, b = inside[ok] @ strides, other[ok] @ strides
        both = flat[b]
        out += [(int(i), int(j), float(np.linalg.norm(points[i] - points[j]))) for i, j in zip(a[both], b[both], strict=True)]
    return out


def closeness_center(distance: np.ndarray, members: np.ndarray) -> int:
    """The member with the least mean distance to those it reaches, weighted by how many these are."""
    best, at = -1.0, int(members[0])
    n = len(members)
    for i in members:
        row = distance[i, members]
        reach = row[np.isfinite(row)]
        total = reach.sum()
        score = (len(reach) - 1) / total * (len(reach) - 1) / (n - 1) if total > 0 and n > 1 else 0.0
        if score > best:
            best, at = score, int(i)
    return at


@dataclass
class Track:
    """A graph of straight segments laid out on a line in the given order, with gaps between them."""

    nodes: dict[int, tuple[float, ...]]
    edges: list[tuple[int, int]]
    order: list[tuple[int, int]] = field(default_factory=list)
    spacing: float | Sequence[float] = 0.0

    def __post_init__(self):
        self.order = self.order or list(self.edges)
        track_graph(self.nodes, self.edges, self.order, self.spacing)
        self.gaps = np.broadcast_to(np.asarray(self.spacing, float), (max(len(self.order) - 1, 0),))
        ids = {frozenset(e): k for k, e in enumerate(self.edges)}
        self.length = {k: float(np.linalg.norm(np.subtract(self.nodes[u], self.nodes[v]))) for k, (u, v) in enumerate(self.edges)}
        self.start, self.first, at = {}, {}, 0.0
        for k, e in enumerate(self.order):
            edge_id = ids[frozenset(e)]
            self.start[edge_id], self.first[edge_id] = at, e[0]
            at += self.length[edge_id] + (float(self.gaps[k]) if k < len(self.gaps) else 0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a segment: ends, start of its stretch on the line, and the end the stretch begins at."""
        dims = len(next(iter(self.nodes.values())))
        rows = []
        for k, (u, v) in enumerate(self.edges):
            a, b, f = (np.asarray(self.nodes[n], float) for n in (u, v, self.first[k]))
            rows.append((k, *a.tolist(), *b.tolist(), *f.tolist(), self.start[k]))
        names = [f"{p}{d}" for p in ("a", "b", "f") for d in range(dims)]
        return spark.createDataFrame(rows, "edge_id int, " + ", ".join(f"{n} double" for n in names) + ", start double")

    def bin_edges(self, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, is_gap, edge_id) of bins along the line; each gap is one bin."""
        edges, gap, owner = [0.0], [], []
        ids = {frozenset(e): k for k, e in enumerate(self.edges)}
        for k, e in enumerate(self.order):
            edge_id = ids[frozenset(e)]
            n = max(int(np.ceil(self.length[edge_id] / size)), 1)
            edges += (self.start[edge_id] + np.arange(1, n + 1) * self.length[edge_id] / n).tolist()
            gap += [False] * n
            owner += [edge_id] * n
            if k < len(self.gaps) and self.gaps[k] > 0:
                edges.append(edges[-1] + float(self.gaps[k]))
                gap.append(True)
                owner.append(-1)
        return np.array(edges), np.array(gap), np.array(owner)

    def bin_distances(self, size: float) -> np.ndarray:
        """Distances along the track between bin centers; gap bins reach nothing."""
        edges, gap, owner = self.bin_edges(size)
        mid, names = centers(edges), sorted(self.nodes)
        seat = {n: len(mid) + k for k, n in enumerate(names)}
        links = []
        for k, (u, v) in enumerate(self.edges):
            mine = np.flatnonzero(owner == k)
            other = v if self.first[k] == u else u
            chain = [(seat[self.first[k]], 0.0), *((int(i), mid[i] - self.start[k]) for i in mine), (seat[other], self.length[k])]
            links += [(a, b, abs(y - x)) for (a, x), (b, y) in itertools.pairwise(chain)]
        out = shortest_paths(len(mid) + len(names), links)[:len(mid), :len(mid)]
        return out


def linearize(samples: DataFrame, track: Track, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``samples`` with linear_position, edge_id and the projected point: the nearest segment of the track.

    Each sample looks at all segments in one expression (a broadcast table folded into an array), so no rows
    are multiplied.  NaN positions give NaN.
    """
    rows = track.table(samples.sparkSession).orderBy("edge_id").collect()
    dims = range(len(columns))

    def candidate(r):
        a, b, f = ([float(r[f"{p}{d}"]) for d in dims] for p in ("a", "b", "f"))
        length2 = sum((y - x) ** 2 for x, y in zip(a, b, strict=True))
        share = sum(((F.col(columns[d]) - a[d]) * (b[d] - a[d]) for d in dims), F.lit(0.0)) / (length2 or 1.0)
        share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        point = [F.lit(a[d]) + share * (b[d] - a[d]) for d in dims]
        off = F.sqrt(sum(((F.col(columns[d]) - point[d]) * (F.col(columns[d]) - point[d]) for d in dims), F.lit(0.0)))
        along = F.lit(float(r["start"])) + F.sqrt(sum(((point[d] - f[d]) * (point[d] - f[d]) for d in dims), F.lit(0.0)))
        return F.struct(off.alias("off"), F.lit(int(r["edge_id"])).alias("edge_id"), along.alias("linear"), *(point[d].alias(f"p{d}") for d in dims))

    best = F.array_min(F.array(*map(candidate, rows)))
    lost = F.lit(False)
    for c in columns:
        lost = lost | F.isnan(c) | F.col(c).isNull()
    out = samples.withColumn("__best", best)
    nan = F.lit(float("nan"))
    return out.select(*samples.columns, F.when(lost, nan).otherwise(F.col("__best.linear")).alias("linear_position"), F.when(lost, F.lit(None)).otherwise(F.col("__best.edge_id")).alias("edge_id"), *(F.when(lost, nan).otherwise(F.col(f"__best.p{d}")).alias(f"projected_{c}") for d, c in enumerate(columns)))


@dataclass
class Environment:
    """A named place grid: edges, interior, distances between bins."""

    name: str = ""
    bin_size: float | Sequence[float] = 2.0
    track: Track | None = None
    ranges: Sequence[tuple[float, float]] | None = None
    infer_interior: bool = True
    fill: bool = False
    inflate: bool = False
    threshold: int = 0

    edges: list[np.ndarray] | None = None
    interior: np.ndarray | None = None
    _distance: np.ndarray | None = None

    def fit(self, samples: DataFrame | None = None, columns: Sequence[str] = ("x",)) -> "Environment":
        """Lay the grid over the samples' extent (or the given ranges) and mark the bins they visit."""
        self.columns = tuple(columns)
        if self.track is not None:
            e, gap, _ = self.track.bin_edges(float(self.bin_size))
            self.edges, self.interior = [e], ~gap
            return self
        ranges = np.asarray(self.ranges, float) if self.ranges is not None else extent(samples, columns)
        self.edges = grid_edges(ranges, self.bin_size)
        shape = [len(e) - 1 for e in self.edges]
        if not self.infer_interior:
            self.interior = np.ones(shape, bool)
            return self
        occupied = self.occupancy(samples)
        counts = np.zeros(int(np.prod(shape)), np.int64)
        for r in occupied.collect():  # one row a bin
            counts[r["bin"]] = r["n"]
        self.interior = interior_of(counts.reshape(shape), self.threshold, self.fill, self.inflate)
        return self

    def _fitted(self):
        if self.edges is None:
            raise ConfigurationError("the environment has no grid yet", hint="call fit() first")

    def occupancy(self, samples: DataFrame) -> DataFrame:
        """(bin, n): samples inside the grid by bin; the last edge belongs to the last bin."""
        self._fitted()
        inside = samples
        for c, e in zip(self.columns, self.edges, strict=True):
            inside = inside.where(F.col(c).between(float(e[0]), float(e[-1])))
        cells = F.lit(0)
        for c, e in zip(self.columns, self.edges, strict=True):
            n = len(e) - 1
            at = place(F.col(c), e)
            # a histogram puts a value on an inner edge to its right, the last inner one too
            at = F.when(F.col(c) == float(e[-2]), F.lit(n - 1)).otherwise(at) if n > 1 else at
            cells = cells * n + at
        return inside.groupBy(cells.cast("long").alias("bin")).agg(F.count("*").alias("n"))

    @property
    def shape(self) -> tuple[int, ...]:
        self._fitted()
        return tuple(len(e) - 1 for e in self.edges)

    @property
    def points(self) -> np.ndarray:
        self._fitted()
        return mesh_centers(self.edges)

    @property
    def interior_bins(self) -> np.ndarray:
        self._fitted()
        return np.flatnonzero(self.interior.ravel())

    @property
    def boundary(self) -> np.ndarray:
        return boundary_of(self.interior)

    @property
    def distance(self) -> np.ndarray:
        """Shortest paths between bins (infinity where there is none); worked out once."""
        if self._distance is None:
            if self.track is not None:
                self._distance = self.track.bin_distances(float(self.bin_size))
            else:
                self._distance = shortest_paths(len(self.points), neighbour_edges(self.shape, self.interior, self.points))
        return self._distance

    def bins(self, spark: SparkSession) -> DataFrame:
        """(bin, center array, is_interior, is_boundary)."""
        edge = self.boundary.ravel()
        return spark.createDataFrame([(int(k), p.tolist(), bool(i), bool(b)) for k, (p, i, b) in enumerate(zip(self.points, self.interior.ravel(), edge, strict=True))], "bin long, center array<double>, is_interior boolean, is_boundary boolean")

    def distance_rows(self, spark: SparkSession) -> DataFrame:
        """(bin, distances): a row of distances to the interior bins, in order."""
        return spark.createDataFrame([(int(k), row.tolist()) for k, row in enumerate(self.distance[:, self.interior_bins])], "bin long, distances array<double>")

    def bin_of(self, samples: DataFrame, columns: Sequence[str] | None = None, out: str = "bin") -> DataFrame:
        """``samples`` with the bin of each point; points of bins off the track go to the nearest interior center."""
        columns = list(columns or self.columns)
        raw = samples.withColumn(out, flat_index([F.col(c) for c in columns], self.edges))
        mask = self.interior.ravel()
        if mask.all() or not mask.any():
            return raw
        if len(self.interior_bins) > BROADCAST_BINS:
            return raw.withColumn(out, snapper(self.points, mask)(F.struct(F.col(out).cast("long").alias("bin"), *(F.col(c).cast("double").alias(f"c{d}") for d, c in enumerate(columns)))))
        here = F.array(*(F.struct(*(F.lit(float(x)).alias(f"c{d}") for d, x in enumerate(self.points[k])), F.lit(int(k)).alias("bin")) for k in self.interior_bins))
        inside = F.array(*(F.lit(int(k)) for k in self.interior_bins))
        far = lambda b: sum(((F.col(c) - b[f"c{d}"]) * (F.col(c) - b[f"c{d}"]) for d, c in enumerate(columns)), F.lit(0.0))
        snapped = F.array_min(F.transform(here, lambda b: F.struct(far(b).alias("d"), b["bin"].alias("bin"))))["bin"]
        return raw.withColumn(out, F.when(F.array_contains(inside, F.col(out).cast("int")), F.col(out)).otherwise(snapped.cast("long")))

    def manifold_distance(self, pairs: DataFrame, a: str, b: str, out: str = "distance") -> DataFrame:
        """Path length between the bins in columns a and b."""
        spark = pairs.sparkSession
        flat = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(self.distance)], "__a long, __row array<double>")
        flat = F.broadcast(flat) if len(self.points) <= BROADCAST_BINS else flat
        return pairs.join(flat, F.col(a) == F.col("__a"), "left").withColumn(out, F.element_at("__row", (F.col(b) + 1).cast("int"))).drop("__a", "__row")

    def distances_to_interior(self, samples: DataFrame, columns: Sequence[str] | None = None, out: str = "distances") -> DataFrame:
        """``samples`` with the array of distances from the point's bin to every interior bin."""
        return self.with_bin_rows(samples, self.distance[:, self.interior_bins], columns, out)

    def with_bin_rows(self, samples: DataFrame, table: np.ndarray, columns: Sequence[str] | None = None, out: str = "row") -> DataFrame:
        """``samples`` with the array that ``table`` (bins, any) has for the point's bin; null where the point is unknown."""
        rows = samples.sparkSession.createDataFrame([(int(k), row.tolist()) for k, row in enumerate(table)], f"__bin long, {out} array<double>")
        rows = F.broadcast(rows) if len(self.points) <= BROADCAST_BINS else rows
        return self.bin_of(samples, columns, "__b").join(rows, F.col("__b") == F.col("__bin"), "left").drop("__b", "__bin")

    def direction(self, samples: DataFrame, columns: Sequence[str] | None = None, sigma: float | None = None, threshold: float = 0.1, order: str = "t_idx", keys: list[str] | None = None, t: str = "t") -> DataFrame:
        """inward, outward or stop: the smoothed gradient of the distance to the track's center."""
        hub = closeness_center(self.distance, self.interior_bins)
        table = samples.sparkSession.createDataFrame([(k, float(d)) for k, d in enumerate(self.distance[hub])], "__bin long, __hub double")
        near = self.bin_of(samples, columns, "__b").join(F.broadcast(table), F.col("__b") == F.col("__bin"), "left")
        moved = gradient(near, "__hub", "__slope", t, order, keys)
        if sigma:
            moved = gaussian_smooth(moved, "__slope", "__smooth", sigma, order, keys).drop("__slope").withColumnRenamed("__smooth", "__slope")
        label = F.when(F.abs("__slope") < threshold, "stop").when(F.col("__slope") < 0, "inward").otherwise("outward")
        return moved.withColumn("direction", label).drop("__b", "__bin", "__hub", "__slope")


def snapper(points: np.ndarray, interior: np.ndarray):
    """From (bin, coordinates) to the bin, or to the nearest interior one (the lowest on a tie) off the track."""
    here = np.flatnonzero(interior)

    @F.pandas_udf("long")
    def snap(rows: pd.DataFrame) -> pd.Series:
        out = rows["bin"].to_numpy(dtype=float, na_value=np.nan)
        off = np.flatnonzero(np.isnan(out) | ~interior[np.nan_to_num(out).astype(int)])
        at = rows.drop(columns="bin").to_numpy(dtype=float, na_value=np.nan)
        for k in range(0, len(off), 256):
            some = off[k:k + 256]
            d = sum((at[some, c][:, None] - points[here, c]) ** 2 for c in range(at.shape[1]))
            out[some] = here[np.where(np.isnan(d), np.inf, d).argmin(axis=1)]
        return pd.Series(out.astype(np.int64))

    return snap


def edge_sorted_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by their edge's mean linear position, then their own."""
    mean = F.avg("linear_position").over(Window.partitionBy("edge_id"))
    return nodes.withColumn("edge_mean", mean).orderBy("edge_mean", "linear_position")
