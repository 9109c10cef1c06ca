"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import exprs as X
from ..operators import analysis, asof, binning, em, geometry, glm, gmm, gof, hmm, kde, likelihood, transitions, windows
from ..sources import clock as clocks, simulate
from ..sources.store import stored
from ..sources.testdata import events as event_rows, marks as mark_rows, seconds, table
from . import models

HOUR = 3600.0
GRID = geometry.Environment("grid", bin_size=25.0, ranges=[(0.0, 500.0)], infer_interior=False)
POINTS = np.arange(20)[:, None] * 25.0 + 12.5
STD = 20.0

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_EV = "ev AS (SELECT event_id, event_type AS unit, user_id, epoch_us(ts) / 1e6 AS t, value FROM events)"
_HOURS = f"ends AS (SELECT floor(min(t) / {HOUR})::BIGINT AS a, floor(max(t) / {HOUR})::BIGINT + 1 AS b FROM ev), hours AS (SELECT k - a AS t_idx, k * {HOUR} AS t FROM (SELECT a, unnest(range(a, b + 1)) AS k FROM ends))"
_COUNTS = f"{_EV}, {_HOURS}, units AS (SELECT DISTINCT unit FROM ev), counts AS (SELECT u.unit, h.t_idx, count(e.unit) AS n FROM units u CROSS JOIN hours h LEFT JOIN ev e ON e.unit = u.unit AND floor(e.t / {HOUR})::BIGINT - (SELECT a FROM ends) = h.t_idx GROUP BY u.unit, h.t_idx)"
_POINTS = "pts AS (SELECT i AS bin, i * 25.0 + 12.5 AS c FROM range(20) r(i))"
_K = f"exp(-0.5 * power((c - value) / {STD}, 2)) / ({STD} * sqrt(2 * pi()))"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column) if isinstance(column, str) else column


def hours(ev: DataFrame, step: float = HOUR) -> DataFrame:
    """Hourly bins (or those of another step) that cover the events, and the end of the last one."""
    ends = ev.agg(F.floor(F.min("t") / step).alias("a"), (F.floor(F.max("t") / step) + 1).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("k"), "a").select((F.col("k") - F.col("a")).alias("t_idx"), (F.col("k") * F.lit(step)).alias("t"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    ev = event_rows(spark, d)
    return binning.counts(ev, hours(ev), ev.select("unit").distinct(), bucket=86_400.0)


# --- clocks, bins, runs -----------------------------------------------------------------------

@query("SELECT i AS t_idx, round(i / 30.0, 6) AS t FROM range(302) r(i)")
def time_bins(spark, d):
    return clocks.time_bins(spark, 0.0, 10.05, 30.0).select("t_idx", _r("t"))


@query(f"WITH {_COUNTS} SELECT unit, t_idx, n FROM counts")
def bin_counts(spark, d):
    return hourly(spark, d)


@query(f"""WITH {_EV}, edges AS (SELECT i AS t_idx, 1704067200.0 + 200.0 * i * i AS t FROM range(101) r(i)),
inside AS (SELECT ev.unit, (SELECT count(*) FROM edges WHERE t_idx BETWEEN 1 AND 99 AND edges.t <= ev.t) AS t_idx FROM ev WHERE ev.t BETWEEN 1704067200.0 AND 1706067200.0)
SELECT u.unit, e.t_idx, count(i.unit) AS n FROM (SELECT DISTINCT unit FROM ev) u CROSS JOIN edges e LEFT JOIN inside i ON i.unit = u.unit AND i.t_idx = e.t_idx GROUP BY u.unit, e.t_idx""")
def bin_counts_edge(spark, d):
    ev = event_rows(spark, d)
    clock = spark.range(101).select(F.col("id").alias("t_idx"), (F.lit(1704067200.0) + 200.0 * F.col("id") * F.col("id")).alias("t"))
    return binning.counts(ev, clock, ev.select("unit").distinct())


@query(f"""WITH {_EV}, m AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) - row_number() OVER (PARTITION BY unit, value > 60 ORDER BY t) AS island FROM ev),
runs AS (SELECT unit, min(t) AS s, max(t) AS e FROM m WHERE value > 60 GROUP BY unit, island),
numbered AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s) AS run FROM runs)
SELECT r.unit, r.run, count(*) AS n, round(sum(ev.value), 4) AS total FROM numbered r JOIN ev ON ev.unit = r.unit AND ev.t BETWEEN r.s - 60 AND r.e + 60 GROUP BY r.unit, r.run""")
def runs_select(spark, d):
    ev = event_rows(spark, d)
    spans = binning.runs(ev, "value > 60", ["unit"])
    inside = binning.events_in_runs(ev, spans, 60.0, ["unit"])
    return inside.groupBy("unit", "run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _lerp_sql(clamp: bool) -> str:
    share = "(h.t - a.t) / (b.t - a.t)"
    share = f"least(greatest({share}, 0), 1)" if clamp else share
    return f"""WITH {_EV}, s AS (SELECT unit, t, value, row_number() OVER (PARTITION BY unit ORDER BY t) AS k FROM ev),
n AS (SELECT unit, count(*) AS n FROM s GROUP BY unit),
h AS (SELECT unit, n, i AS t_idx, 1704067200.0 - 7200 + 1800.0 * i AS t FROM range(1460) r(i), n),
c AS (SELECT h.unit, h.t_idx, count(*) AS c FROM h JOIN s ON s.unit = h.unit AND s.t <= h.t GROUP BY h.unit, h.t_idx),
p AS (SELECT h.unit, h.t_idx, h.t, least(greatest(coalesce(c, 0), 1), n - 1) AS k FROM h LEFT JOIN c USING (unit, t_idx))
SELECT h.unit, h.t_idx, round(a.value + {share} * (b.value - a.value), 5) AS value FROM p h JOIN s a ON a.unit = h.unit AND a.k = h.k JOIN s b ON b.unit = h.unit AND b.k = h.k + 1"""


def _half_hours(spark):
    return spark.range(1460).select(F.col("id").alias("t_idx"), (F.lit(1704060000.0) + 1800.0 * F.col("id")).alias("t"))


def _lerp(spark, d, extrapolate: bool):
    """Each unit's values at each half hour."""
    ev = event_rows(spark, d)
    units = ev.select("unit").distinct()
    targets = units.crossJoin(F.broadcast(_half_hours(spark)))  # 1,460 rows
    return asof.interpolate(targets, ev.select("unit", "t", "value"), ["value"], ["unit"], extrapolate=extrapolate).select("unit", "t_idx", _r("value", 5))


@query(_lerp_sql(False))
def asof_lerp(spark, d):
    return _lerp(spark, d, True)


@query(_lerp_sql(True))
def asof_lerp_clamp(spark, d):
    return _lerp(spark, d, False)


# --- grids ------------------------------------------------------------------------------------

@query("""WITH m AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, ceil((max(x) - min(x)) / 0.1) AS nx, ceil((max(y) - min(y)) / 0.1) AS ny FROM m),
c AS (SELECT CASE WHEN x = x1 THEN nx + 1 ELSE floor((x - x0) / ((x1 - x0) / nx)) + 1 END AS i, CASE WHEN y = y1 THEN ny + 1 ELSE floor((y - y0) / ((y1 - y0) / ny)) + 1 END AS j, ny FROM m, e)
SELECT (i * (ny + 2) + j)::BIGINT AS bin, count(*) AS n FROM c GROUP BY 1""")
def grid_occupancy(spark, d):
    m = mark_rows(spark, d, 2)
    env = geometry.Environment("marks", bin_size=0.1).fit(m, ["m0", "m1"])
    return env.occupancy(m)


@query("SELECT event_id, CASE WHEN value = 475 THEN 18 ELSE least(greatest(floor(value / 25), 0), 19) END::BIGINT AS bin FROM events")
def bin_index(spark, d):
    return GRID.fit(None, ["value"]).bin_of(event_rows(spark, d), ["value"]).select("event_id", "bin")


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 40 + 5 AS x, embedding[2]::DOUBLE * 40 + 5 AS y FROM embeddings),
s AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 10.0, 0.0, 0.0), (1, 10.0, 0.0, 10.0, 10.0, 12.0)) v(id, ax, ay, bx, by_, start)),
c AS (SELECT vec_id, id, ax, ay, start, x, y, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / 100.0, 0), 1) AS f, bx, by_ FROM p, s),
q AS (SELECT vec_id, id, start, ax + f * (bx - ax) AS px, ay + f * (by_ - ay) AS py, ax, ay, x, y FROM c),
b AS (SELECT vec_id, arg_min({'l': start + sqrt(power(px - ax, 2) + power(py - ay, 2)), 'id': id}, {'d': sqrt(power(x - px, 2) + power(y - py, 2)), 'id': id}) AS r FROM q GROUP BY vec_id)
SELECT vec_id, r.id AS edge_id, round(r.l, 6) AS linear_position FROM b""")
def linear_position(spark, d):
    track = geometry.Track({0: (0.0, 0.0), 1: (10.0, 0.0), 2: (10.0, 10.0)}, [(0, 1), (1, 2)], spacing=2.0)
    p = mark_rows(spark, d, 2).select("vec_id", (F.col("m0") * 40 + 5).alias("x"), (F.col("m1") * 40 + 5).alias("y"))
    return geometry.linearize(p, track, ["x", "y"], ["vec_id"]).select("vec_id", "edge_id", _r("linear_position"))


@query("""WITH RECURSIVE b AS (SELECT i FROM range(20) r(i)),
e AS (SELECT a.i AS u, c.i AS v, 25.0 AS w FROM b a JOIN b c ON abs(a.i - c.i) = 1),
p(i, j, d, hops) AS (SELECT i, i, 0.0::DOUBLE, 0 FROM b UNION ALL SELECT p.i, e.v, p.d + e.w, hops + 1 FROM p JOIN e ON e.u = p.j WHERE hops < 19 AND (e.v - p.i) * (e.v - p.j) >= 0 AND e.v <> p.i)
SELECT i, j, min(d) AS distance FROM p GROUP BY i, j""")
def track_distance(spark, d):
    env = GRID.fit(None, ["value"])
    pairs = spark.range(20).select(F.col("id").alias("i")).crossJoin(spark.range(20).select(F.col("id").alias("j")))
    return env.manifold_distance(pairs, "i", "j")


# --- scalar functions -------------------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount) < 1e-15 THEN ln(1e-15) ELSE ln(l_discount) END, 6) AS safe_log,
round(CASE WHEN abs(l_tax) < 1e-15 THEN 1e-15 ELSE l_discount / l_tax END, 6) AS safe_divide,
round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 6) AS or_zero,
round(l_quantity * ln(l_extendedprice), 5) AS xlogy, round(-0.5 * power((l_quantity - 25) / 7, 2) - ln(7 * sqrt(2 * pi())), 6) AS logpdf FROM lineitem""")
def scalar_functions(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(
        "l_orderkey", "l_linenumber", F.round(X.safe_log("l_discount"), 6).alias("safe_log"), F.round(X.safe_divide("l_discount", "l_tax"), 6).alias("safe_divide"),
        F.round(X.divide_or_zero("l_discount", "l_tax"), 6).alias("or_zero"), F.round(X.xlogy("l_quantity", "l_extendedprice"), 5).alias("xlogy"), F.round(X.normal_logpdf("l_quantity", 25.0, 7.0), 6).alias("logpdf"))


# --- encoding ---------------------------------------------------------------------------------

@query(f"WITH {_EV}, {_POINTS} SELECT unit, bin, round(avg({_K}), 9) AS density FROM ev, pts GROUP BY unit, bin")
def kde_density(spark, d):
    out = kde.kde(event_rows(spark, d), ["value"], POINTS, STD, by=["unit"])
    return out.select("unit", "bin", _r("density", 9))


@query(f"WITH l AS (SELECT l_quantity * 10 AS value, l_extendedprice / 1000 AS w FROM lineitem), {_POINTS} SELECT bin, round(sum(w * {_K}) / sum(w), 9) AS density FROM l, pts GROUP BY bin")
def kde_weighted(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") * 10).alias("value"), (F.col("l_extendedprice") / 1000).alias("w"))
    return kde.kde(rows, ["value"], POINTS, STD, "w").select("bin", _r("density", 9))


@query(f"WITH {_EV}, {_POINTS} SELECT unit, bin, round(ln(avg({_K})), 6) AS density FROM ev, pts GROUP BY unit, bin")
def kde_log_density(spark, d):
    out = kde.kde(event_rows(spark, d), ["value"], POINTS, STD, by=["unit"], log=True)
    return out.select("unit", "bin", _r("density"))


_FIELDS = f"""occ AS (SELECT bin, avg({_K}) AS occ FROM ev, pts GROUP BY bin), mg AS (SELECT unit, bin, avg({_K}) AS m FROM ev, pts GROUP BY unit, bin),
rt AS (SELECT unit, count(*) / (SELECT count(*) FROM ev)::DOUBLE AS rate FROM ev GROUP BY unit),
fields AS (SELECT mg.unit, mg.bin, rate, greatest(CASE WHEN occ > 0 THEN rate * m / occ ELSE rate * 1e-15 END, 1e-15) AS field FROM mg JOIN occ USING (bin) JOIN rt USING (unit))"""


def _fields(spark, d):
    ev = event_rows(spark, d)
    return kde.place_fields(ev, ev, ["value"], POINTS, STD)


@query(f"WITH {_EV}, {_POINTS}, {_FIELDS} SELECT unit, bin, round(rate, 6) AS rate, round(field, 6) AS field FROM fields")
def place_fields(spark, d):
    return _fields(spark, d).select("unit", "bin", _r("rate"), _r("field"))


@query(f"""WITH {_COUNTS}, {_POINTS}, {_FIELDS}
SELECT t_idx, bin, round(sum(CASE WHEN n = 0 THEN 0 ELSE n * ln(field) END - field), 4) AS ll FROM counts JOIN fields USING (unit) GROUP BY t_idx, bin""")
def poisson_loglik(spark, d):
    ev = event_rows(spark, d)
    clock = hours(ev)
    ll = kde.poisson_loglik(binning.sparse_counts(ev, clock, bucket=86_400.0), _fields(spark, d), len(POINTS), clock)
    return ll.select("t_idx", F.posexplode("ll").alias("pos", "ll")).select("t_idx", F.col("pos").cast("long").alias("bin"), _r("ll", 4))


@query(f"WITH {_COUNTS} SELECT t_idx, round(sum(CASE WHEN n = 0 THEN 0 ELSE n * ln(1e-10 * 3600) END - 1e-10 * 3600), 6) AS ll FROM counts GROUP BY t_idx")
def no_event_loglik(spark, d):
    return kde.no_event_loglik(hourly(spark, d), HOUR).select("t_idx", _r("ll"))


_MARK_SQL = """v AS (SELECT vec_id, label AS unit, embedding[1]::DOUBLE * 500 + 250 AS x, embedding[2]::DOUBLE * 100 AS m0, embedding[3]::DOUBLE * 100 AS m1 FROM embeddings),
en AS (SELECT * FROM v), de AS (SELECT * FROM v), pts AS (SELECT i AS bin, i * 25.0 + 12.5 AS c FROM range(20) r(i)),
occ AS (SELECT bin, avg(exp(-0.5 * power((c - x) / 30.0, 2)) / (30.0 * sqrt(2 * pi()))) AS occ FROM en, pts GROUP BY bin),
rt AS (SELECT unit, count(*) / (SELECT count(*) FROM en)::DOUBLE AS rate FROM en GROUP BY unit),
inten AS (SELECT de.vec_id, bin, greatest(ln(rate * avg(exp(-0.5 * (power((de.m0 - en.m0) / 24.0, 2) + power((de.m1 - en.m1) / 24.0, 2)) - 0.5 * power((c - en.x) / 30.0, 2)) / (24.0 * 24.0 * 30.0 * power(2 * pi(), 1.5))) / occ), ln(1e-15)) AS x
FROM de JOIN en USING (unit) CROSS JOIN pts JOIN occ USING (bin) JOIN rt USING (unit) GROUP BY de.vec_id, bin, rate, occ)"""


def _marked(spark, d):
    """All events, decoded with all of them."""
    v = mark_rows(spark, d, 3).select(F.col("vec_id").alias("event_id"), "unit", (F.col("m0") * 500 + 250).alias("x"), (F.col("m1") * 100).alias("m0"), (F.col("m2") * 100).alias("m1"))
    occ = np.array([r["density"] for r in kde.kde(v, ["x"], POINTS, 30.0).orderBy("bin").collect()])
    return v, v, kde.mark_intensity(v, v, kde.mean_rates(v, v), occ, POINTS, ["m0", "m1"], ["x"], 24.0, 30.0)


@query(f"WITH {_MARK_SQL} SELECT vec_id, bin, round(x, 5) AS ll FROM inten")
def mark_intensity(spark, d):
    ll = _marked(spark, d)[2]
    return ll.select(F.col("event_id").alias("vec_id"), F.posexplode("ll").alias("bin", "ll")).select("vec_id", F.col("bin").cast("long").alias("bin"), _r("ll", 5))


@query(f"""WITH {_MARK_SQL}, mg AS (SELECT unit, bin, avg(exp(-0.5 * power((c - x) / 30.0, 2)) / (30.0 * sqrt(2 * pi()))) AS m FROM en, pts GROUP BY unit, bin),
g AS (SELECT bin, sum(greatest(rate * m / occ, 1e-15)) AS g FROM mg JOIN occ USING (bin) JOIN rt USING (unit) GROUP BY bin)
SELECT t_idx, bin, round(coalesce(s, 0) - g, 4) AS ll FROM (SELECT i AS t_idx FROM range(40) r(i)) c CROSS JOIN g
LEFT JOIN (SELECT (vec_id // 5) % 40 AS t_idx, bin, sum(x) AS s FROM inten GROUP BY 1, 2) h USING (t_idx, bin)""")
def marked_loglik(spark, d):
    en, de, ll = _marked(spark, d)
    when = de.select("event_id", F.pmod(F.floor(F.col("event_id") / 5), F.lit(40)).alias("t_idx"))
    ground = kde.ground_intensity(en, en, ["x"], POINTS, 30.0).withColumn("bin", F.col("bin").cast("int"))
    out = kde.marked_loglik(ll, when, ground, spark.range(40).withColumnRenamed("id", "t_idx"), len(POINTS))
    return out.select("t_idx", F.posexplode("ll").alias("bin", "ll")).select("t_idx", F.col("bin").cast("long").alias("bin"), _r("ll", 4))


@query("""WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, round(ln(0.3 * exp(-0.5 * (power(x - 0.1, 2) / 0.01 + power(y + 0.1, 2) / 0.02)) / (2 * pi() * sqrt(0.01 * 0.02)) + 0.7 * exp(-0.5 * (power(x + 0.05, 2) / 0.04 + power(y, 2) / 0.03)) / (2 * pi() * sqrt(0.04 * 0.03))), 6) AS log_density FROM m""")
def gmm_score(spark, d):
    model = gmm.Mixture(np.array([0.3, 0.7]), np.array([[0.1, -0.1], [-0.05, 0.0]]), np.array([[0.01, 0.02], [0.04, 0.03]]), "diag")
    return gmm.score(mark_rows(spark, d, 2), ["m0", "m1"], model).select("vec_id", _r("log_density"))


@query()
def gmm_fit(spark, d):
    model = gmm.fit_mixture(mark_rows(spark, d, 2), ["m0", "m1"], 3, "full", iterations=20)
    return spark.createDataFrame([(k, float(round(w, 6)), float(round(m[0], 6)), float(round(m[1], 6))) for k, (w, m) in enumerate(zip(model.weights, model.means, strict=True))], "component int, weight double, m0 double, m1 double")


@query()
def glm_fields(spark, d):
    """A regression for each kind of event, all in the same passes."""
    ev = event_rows(spark, d)
    design = glm.Design.over(ev, ["value"], 100.0)
    counted = ev.select("value", "unit", F.lit(1).alias("n"))
    return glm.fields(design, glm.fit_units(ev, counted, design, ["value"]), POINTS, spark).withColumn("field", F.round("field", 6))


# --- transitions ------------------------------------------------------------------------------

_WALK = "b AS (SELECT i, i * 25.0 + 12.5 AS c FROM range(20) r(i)), w AS (SELECT x.i AS i, y.i AS j, exp(-0.5 * power(x.c - y.c, 2) / 900.0) AS k FROM b x, b y {where})"


def _walk_sql(where: str = "") -> str:
    return f"WITH {_WALK.format(where=where)}, n AS (SELECT i, j, k / sum(k) OVER (PARTITION BY i) AS p FROM w) SELECT i::INTEGER AS i, j::INTEGER AS j, round(p, 9) AS p FROM n WHERE p > 1e-9"


def _rows(spark, m):
    return transitions.matrix_rows(spark, np.where(m > 1e-9, m, 0.0)).withColumn("p", F.round("p", 9))


@query(_walk_sql())
def random_walk(spark, d):
    return _rows(spark, transitions.RandomWalk("grid", 900.0).matrix([GRID.fit(None, ["value"])]))


@query(_walk_sql("WHERE y.i >= x.i"))
def forward_walk(spark, d):
    return _rows(spark, transitions.ForwardWalk("grid", 900.0).matrix([GRID.fit(None, ["value"])]))


@query(_walk_sql("WHERE y.i <= x.i"))
def backward_walk(spark, d):
    return _rows(spark, transitions.BackwardWalk("grid", 900.0).matrix([GRID.fit(None, ["value"])]))


@query("SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, 0.05::DOUBLE AS p FROM range(20) a(i), range(20) b(i)")
def uniform_transition(spark, d):
    return _rows(spark, transitions.Uniform("grid").matrix([GRID.fit(None, ["value"])]))


@query("SELECT i::INTEGER AS i, i::INTEGER AS j, 1.0::DOUBLE AS p FROM range(20) r(i)")
def identity_transition(spark, d):
    return _rows(spark, transitions.Identity("grid").matrix([GRID.fit(None, ["value"])]))


@query(f"""WITH {_EV}, b AS (SELECT user_id, t, CASE WHEN value = 475 THEN 18 ELSE least(greatest(floor(value / 25), 0), 19) END::BIGINT AS bin FROM ev),
s AS (SELECT bin AS i, lead(bin) OVER (PARTITION BY user_id ORDER BY t) AS j FROM b), c AS (SELECT i, j, count(*) AS n FROM s WHERE j IS NOT NULL GROUP BY i, j)
SELECT i, j, n, round(n / sum(n) OVER (PARTITION BY i), 9) AS p FROM c""")
def empirical_movement(spark, d):
    env = GRID.fit(None, ["value"])
    steps = transitions.EmpiricalMovement("grid").counts(event_rows(spark, d), [env], "t", ["user_id"])
    return steps.select("i", "j", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("i")), 9).alias("p"))


@query("SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = j THEN [0.9, 0.95, 0.8][i + 1] ELSE round((1 - [0.9, 0.95, 0.8][i + 1]) / 2, 9) END::DOUBLE AS p FROM range(3) a(i), range(3) b(j)")
def discrete_diagonal(spark, d):
    return _rows(spark, transitions.StationaryDiagonal([0.9, 0.95, 0.8]).make())


@query(f"""WITH {_EV}, z AS (SELECT event_id, -0.5 + 0.01 * value AS a, 1.0 - 0.02 * value AS b FROM ev)
SELECT event_id, round(exp(a) / (exp(a) + 1), 6) AS p00, round(1 / (exp(b) + 1), 6) AS p11 FROM z""")
def covariate_transition(spark, d):
    coef = np.array([[[-0.5], [1.0]], [[0.01], [-0.02]]])
    x = event_rows(spark, d).select("event_id", F.array(F.lit(1.0), F.col("value")).alias("x"))
    out = transitions.predict_transitions(x, coef)
    return out.select("event_id", F.round(F.element_at("trans", 1), 6).alias("p00"), F.round(F.element_at("trans", 4), 6).alias("p11"))


# --- hidden Markov model ----------------------------------------------------------------------

A = [[0.95, 0.05], [0.1, 0.9]]
_LL = f"""{_COUNTS}, mu AS (SELECT unit, avg(n) AS m FROM counts GROUP BY unit),
l AS (SELECT unit AS s, t_idx AS i, CASE WHEN n = 0 THEN 0 ELSE n * ln(0.8 * m) END - 0.8 * m AS l0, CASE WHEN n = 0 THEN 0 ELSE n * ln(1.3 * m) END - 1.3 * m AS l1 FROM counts JOIN mu USING (unit)),
e AS (SELECT s, i, exp(l0 - greatest(l0, l1)) AS e0, exp(l1 - greatest(l0, l1)) AS e1, greatest(l0, l1) AS top, l0, l1 FROM l)"""
_FILTER = f"""{_LL},
f(s, i, a, b, z) AS (
  SELECT s, i, 0.5 * e0 / (0.5 * e0 + 0.5 * e1), 0.5 * e1 / (0.5 * e0 + 0.5 * e1), ln(0.5 * e0 + 0.5 * e1) + top FROM e WHERE i = 0
  UNION ALL SELECT s, i, x / (x + y), y / (x + y), ln(x + y) + top FROM (
    SELECT e.s, e.i, (0.95 * a + 0.1 * b) * e0 AS x, (0.05 * a + 0.9 * b) * e1 AS y, top FROM f JOIN e ON e.s = f.s AND e.i = f.i + 1))"""
_SMOOTH = f"""{_FILTER}, n AS (SELECT max(i) AS n FROM f),
g(s, i, a, b) AS (
  SELECT s, i, a, b FROM f WHERE i = (SELECT n FROM n)
  UNION ALL SELECT s, i, x / (x + y), y / (x + y) FROM (
    SELECT f.s, f.i, f.a * (0.95 * g.a / (0.95 * f.a + 0.1 * f.b) + 0.05 * g.b / (0.05 * f.a + 0.9 * f.b)) AS x,
           f.b * (0.1 * g.a / (0.95 * f.a + 0.1 * f.b) + 0.9 * g.b / (0.05 * f.a + 0.9 * f.b)) AS y FROM g JOIN f ON f.s = g.s AND f.i = g.i - 1))"""


def intensity_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of each kind of event as likelihoods of a slow and a fast state."""
    c = hourly(spark, d)
    m = F.avg("n").over(Window.partitionBy("unit"))
    return c.withColumn("m", m).select("unit", "t_idx", F.array(X.poisson_loglik("n", 0.8 * F.col("m")), X.poisson_loglik("n", 1.3 * F.col("m"))).alias("ll"))


@query(f"WITH RECURSIVE {_FILTER} SELECT s AS unit, i AS t_idx, round(a, 6) AS p_slow, round(b, 6) AS p_fast FROM f")
def hmm_filter(spark, d):
    out = hmm.decode(intensity_loglik(spark, d), [0.5, 0.5], A, ["unit"], chunk=256)
    return out.select("unit", "t_idx", F.round(F.element_at("filtered", 1), 6).alias("p_slow"), F.round(F.element_at("filtered", 2), 6).alias("p_fast"))


@query(f"WITH RECURSIVE {_SMOOTH} SELECT s AS unit, i AS t_idx, round(a, 6) AS p_slow FROM g")
def hmm_smoother(spark, d):
    out = hmm.decode(intensity_loglik(spark, d), [0.5, 0.5], A, ["unit"], chunk=256)
    return out.select("unit", "t_idx", F.round(F.element_at("smoothed", 1), 6).alias("p_slow"))


@query(f"WITH RECURSIVE {_FILTER} SELECT s AS unit, round(sum(z), 4) AS log_likelihood FROM f GROUP BY s")
def hmm_log_likelihood(spark, d):
    out = hmm.decode(intensity_loglik(spark, d), [0.5, 0.5], A, ["unit"], chunk=256)
    return hmm.log_likelihood(out, ["unit"]).select("unit", _r("log_likelihood", 4))


@query(f"""WITH RECURSIVE {_LL}, n AS (SELECT max(i) AS n FROM e),
v(s, i, b0, b1, n0, n1) AS (
  SELECT DISTINCT s, (SELECT n FROM n), 0::DOUBLE, 0::DOUBLE, NULL::BIGINT, NULL::BIGINT FROM e
  UNION ALL SELECT v.s, v.i - 1, greatest(ln(.95) + b0 + l0, ln(.05) + b1 + l1), greatest(ln(.1) + b0 + l0, ln(.9) + b1 + l1),
    CASE WHEN ln(.95) + b0 + l0 >= ln(.05) + b1 + l1 THEN 0 ELSE 1 END, CASE WHEN ln(.1) + b0 + l0 >= ln(.9) + b1 + l1 THEN 0 ELSE 1 END
    FROM v JOIN e ON e.s = v.s AND e.i = v.i WHERE v.i > 0),
p(s, i, x) AS (
  SELECT v.s, 0::BIGINT, CASE WHEN l0 + b0 >= l1 + b1 THEN 0 ELSE 1 END::BIGINT FROM v JOIN e ON e.s = v.s AND e.i = v.i WHERE v.i = 0
  UNION ALL SELECT p.s, p.i + 1, CASE WHEN p.x = 0 THEN v.n0 ELSE v.n1 END FROM p JOIN v ON v.s = p.s AND v.i = p.i WHERE p.i < (SELECT n FROM n))
SELECT s AS unit, i AS t_idx, x AS state FROM p""")
def viterbi(spark, d):
    return hmm.viterbi(intensity_loglik(spark, d), [0.5, 0.5], A, ["unit"], chunk=256)


@query(f"""WITH RECURSIVE {_LL}, q AS (SELECT *, 0.9 + 0.05 * (i % 2) AS st FROM e),
f(s, i, a, b) AS (
  SELECT s, i, 0.5 * e0 / (0.5 * e0 + 0.5 * e1), 0.5 * e1 / (0.5 * e0 + 0.5 * e1) FROM q WHERE i = 0
  UNION ALL SELECT s, i, x / (x + y), y / (x + y) FROM (
    SELECT q.s, q.i, ((0.9 + 0.05 * (f.i % 2)) * a + (0.1 - 0.05 * (f.i % 2)) * b) * e0 AS x, ((0.1 - 0.05 * (f.i % 2)) * a + (0.9 + 0.05 * (f.i % 2)) * b) * e1 AS y FROM f JOIN q ON q.s = f.s AND q.i = f.i + 1))
SELECT s AS unit, i AS t_idx, round(a, 6) AS p_slow FROM f""")
def hmm_time_varying(spark, d):
    stay = 0.9 + 0.05 * F.pmod("t_idx", F.lit(2))
    ll = intensity_loglik(spark, d).withColumn("a", F.array(stay, 1 - stay, 1 - stay, stay))
    out = hmm.decode(ll, [0.5, 0.5], None, ["unit"], "a", chunk=256)
    return out.select("unit", "t_idx", F.round(F.element_at("filtered", 1), 6).alias("p_slow"))


@query(f"""WITH RECURSIVE {_SMOOTH}, x AS (SELECT f.s, 0.95 * f.a * g.a / (0.95 * f.a + 0.1 * f.b) AS x00, 0.05 * f.a * g.b / (0.05 * f.a + 0.9 * f.b) AS x01,
  0.1 * f.b * g.a / (0.95 * f.a + 0.1 * f.b) AS x10, 0.9 * f.b * g.b / (0.05 * f.a + 0.9 * f.b) AS x11 FROM f JOIN g ON g.s = f.s AND g.i = f.i + 1)
SELECT u.i::BIGINT AS i, u.j::BIGINT AS j, round(u.n, 4) AS n FROM (SELECT unnest([{{'i': 0, 'j': 0, 'n': sum(x00)}}, {{'i': 0, 'j': 1, 'n': sum(x01)}}, {{'i': 1, 'j': 0, 'n': sum(x10)}}, {{'i': 1, 'j': 1, 'n': sum(x11)}}]) AS u FROM x)""")
def em_expected_transitions(spark, d):
    out = hmm.decode(intensity_loglik(spark, d), [0.5, 0.5], A, ["unit"], chunk=256)
    return em.expected_transitions(out, np.array(A), ["unit"]).select("i", "j", _r("n", 4))


@query()
def em_fit(spark, d):
    ll = intensity_loglik(spark, d).persist()
    out = em.fit(lambda posterior: ll, np.array([0.5, 0.5]), np.array(A), ["unit"], iterations=5, cut=lambda df: df.persist())
    return spark.createDataFrame([(k, float(round(v, 4))) for k, v in enumerate(out["log_likelihoods"])], "iteration int, log_likelihood double")


@query()
def covariate_decode(spark, d):
    """The level of the events' values by hour, on 400 levels: drifting, or anywhere, the more so the more events."""
    hourly_rows = value_levels(spark, d)
    out = hmm.decode(hourly_rows, LEVEL_START, level_blocks(), trans="trans")
    state = F.transform(F.array(F.slice("smoothed", 1, 400), F.slice("smoothed", 401, 400)), lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x))
    level = F.zip_with(F.slice("smoothed", 1, 400), F.slice("smoothed", 401, 400), lambda a, b: a + b)
    mean = F.aggregate(F.transform(level, lambda p, k: p * (k * 1.25 + 0.625)), F.lit(0.0), lambda a, x: a + x)
    return out.select("t_idx", F.round(F.element_at(state, 1), 6).alias("p_drift"), F.round(mean, 4).alias("level"), F.round("log_norm", 5).alias("log_norm"))


LEVEL_START = np.full(800, 1 / 800)


def level_blocks() -> hmm.Blocks:
    """Two states of 400 levels: a random walk of 20 units, and jumps to anywhere."""
    c = np.arange(400) * 1.25 + 0.625
    walk = np.exp(-0.5 * ((c[:, None] - c[None, :]) / 20.0) ** 2)
    walk, jump = walk / walk.sum(axis=1, keepdims=True), np.full((400, 400), 1 / 400)
    return hmm.Blocks(np.block([[walk, jump], [jump, jump]]), np.repeat([0, 1], 400))


def value_levels(spark, d) -> DataFrame:
    """(t_idx, ll, trans): each hour's mean value as a normal likelihood of the levels, and the transition of the two states that its number of events gives."""
    ev = event_rows(spark, d)
    clock = hours(ev)
    by_hour = binning.bin_events(ev, clock).groupBy("t_idx").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    rows = clock.join(by_hour, "t_idx", "left").select("t_idx", "m", F.coalesce("n", F.lit(0)).alias("n"))
    at = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: k * 1.25 + 0.625)
    near = F.when(F.col("m").isNotNull(), F.transform(at, lambda c: -0.5 * F.pow((F.col("m") - c) / (60.0 / F.sqrt("n")), 2))).otherwise(F.array_repeat(F.lit(0.0), 400))
    coef = np.array([[[3.0], [-1.0]], [[-0.05], [0.02]]])  # of 1 and n; from each state to the first
    both = rows.select("t_idx", near.alias("near"), F.array(F.lit(1.0), F.col("n").cast("double")).alias("x"))
    return transitions.predict_transitions(both, coef).select("t_idx", F.concat("near", "near").alias("ll"), "trans")


# --- posteriors -------------------------------------------------------------------------------

_POST = f"{_EV}, pc AS (SELECT floor(t / {HOUR})::BIGINT % 24 AS t_idx, least(floor(value / 25), 19)::BIGINT AS bin, count(*) AS n FROM ev {{where}} GROUP BY 1, 2), post AS (SELECT t_idx, bin, n / sum(n) OVER (PARTITION BY t_idx) AS p FROM pc)"
_POST_ALL = _POST.format(where="")


def posterior(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Share of each value bin by hour of the day, in the form of a posterior."""
    rows = event_rows(spark, d).where(where).select(F.pmod(F.floor(F.col("t") / HOUR), F.lit(24)).alias("t_idx"), F.least(F.floor(F.col("value") / 25), F.lit(19)).cast("long").alias("bin"))
    c = rows.groupBy("t_idx", "bin").agg(F.count("*").alias("n"))
    return c.select("t_idx", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("t_idx"))).alias("p"))


_HPD = "run AS (SELECT *, sum(p) OVER (PARTITION BY t_idx ORDER BY p DESC, bin ROWS UNBOUNDED PRECEDING) AS c FROM {post}), thr AS (SELECT t_idx, max(p) AS threshold FROM run WHERE c >= 0.9473 GROUP BY t_idx)"


@query(f"WITH {_POST_ALL} SELECT t_idx, min(bin) AS bin, round(any_value(p), 6) AS p FROM post q WHERE p = (SELECT max(p) FROM post x WHERE x.t_idx = q.t_idx) GROUP BY t_idx")
def map_estimate(spark, d):
    return analysis.map_estimate(posterior(spark, d)).select("t_idx", "bin", _r("p"))


@query(f"WITH {_POST_ALL}, {_HPD.format(post='post')} SELECT t_idx, round(threshold, 6) AS threshold FROM thr")
def hpd_threshold(spark, d):
    return analysis.hpd_threshold(posterior(spark, d), 0.9473).select("t_idx", _r("threshold"))


@query(f"WITH {_POST_ALL}, {_HPD.format(post='post')} SELECT t_idx, count(*)::DOUBLE AS size FROM post JOIN thr USING (t_idx) WHERE p >= threshold GROUP BY t_idx")
def hpd_coverage(spark, d):
    return analysis.spatial_coverage(posterior(spark, d), None, 0.9473)


@query(f"""WITH {_EV}, b AS (SELECT floor(t / {HOUR})::BIGINT % 24 AS t_idx, least(floor(value / 25), 19)::BIGINT AS bin, unit FROM ev),
ca AS (SELECT t_idx, bin, count(*) AS n FROM b WHERE unit = 'click' GROUP BY 1, 2), cb AS (SELECT t_idx, bin, count(*) AS n FROM b WHERE unit <> 'click' GROUP BY 1, 2),
a AS (SELECT t_idx, bin, n / sum(n) OVER (PARTITION BY t_idx) AS pa FROM ca), o AS (SELECT t_idx, bin, n / sum(n) OVER (PARTITION BY t_idx) AS pb FROM cb)
SELECT t_idx, round(sum(pa * ln(greatest(pa, 1e-10) / greatest(pb, 1e-10))), 6) AS kl FROM a JOIN o USING (t_idx, bin) GROUP BY t_idx""")
def kl_divergence(spark, d):
    return analysis.kl_divergence(posterior(spark, d, "unit = 'click'"), posterior(spark, d, "unit <> 'click'")).select("t_idx", _r("kl"))


@query(f"""WITH {_EV}, b AS (SELECT floor(t / {HOUR})::BIGINT % 24 AS t_idx, least(floor(value / 25), 19)::BIGINT AS bin, unit FROM ev),
ca AS (SELECT t_idx, bin, count(*) AS n FROM b WHERE unit = 'click' GROUP BY 1, 2), cb AS (SELECT t_idx, bin, count(*) AS n FROM b WHERE unit <> 'click' GROUP BY 1, 2),
pa AS (SELECT t_idx, bin, n / sum(n) OVER (PARTITION BY t_idx) AS p FROM ca), pb AS (SELECT t_idx, bin, n / sum(n) OVER (PARTITION BY t_idx) AS p FROM cb),
ra AS (SELECT *, sum(p) OVER (PARTITION BY t_idx ORDER BY p DESC, bin ROWS UNBOUNDED PRECEDING) AS c FROM pa), rb AS (SELECT *, sum(p) OVER (PARTITION BY t_idx ORDER BY p DESC, bin ROWS UNBOUNDED PRECEDING) AS c FROM pb),
ta AS (SELECT t_idx, max(p) AS h FROM ra WHERE c >= 0.9473 GROUP BY t_idx), tb AS (SELECT t_idx, max(p) AS h FROM rb WHERE c >= 0.9473 GROUP BY t_idx),
ia AS (SELECT t_idx, bin, (p >= h)::INT AS i FROM pa JOIN ta USING (t_idx)), ib AS (SELECT t_idx, bin, (p >= h)::INT AS j FROM pb JOIN tb USING (t_idx))
SELECT t_idx, round(sum(coalesce(i, 0) * coalesce(j, 0)) / greatest(least(sum(coalesce(i, 0)), sum(coalesce(j, 0))), 1), 6) AS overlap FROM ia FULL JOIN ib USING (t_idx, bin) GROUP BY t_idx""")
def hpd_overlap(spark, d):
    return analysis.hpd_overlap(posterior(spark, d, "unit = 'click'"), posterior(spark, d, "unit <> 'click'"), 0.9473).select("t_idx", _r("overlap"))


@query(f"WITH {_POST_ALL} SELECT t_idx, (bin // 5) AS state, round(sum(p), 6) AS p FROM post GROUP BY 1, 2")
def state_probability(spark, d):
    rows = posterior(spark, d).withColumn("state", F.floor(F.col("bin") / 5))
    return analysis.state_probability(rows).select("t_idx", "state", _r("p"))


@query(f"WITH {_POST_ALL} SELECT t_idx, bin, round(p / sum(p) OVER (PARTITION BY t_idx), 6) AS p FROM post WHERE bin >= 2")
def conditional_posterior(spark, d):
    rows = posterior(spark, d).withColumn("state", F.when(F.col("bin") < 2, "Local").otherwise("Far"))
    return analysis.conditional_non_local(rows, ["Local"]).select("t_idx", "bin", _r("p"))


@query(f"WITH {_POST_ALL} SELECT t_idx, bin, floor(p * 255)::INTEGER AS level FROM post WHERE floor(p * 255) > 0")
def quantized_posterior(spark, d):
    return analysis.quantized(posterior(spark, d))


# --- goodness of fit --------------------------------------------------------------------------

_SPIKES = f"{_COUNTS}, sp AS (SELECT unit, t_idx, n > avg(n) OVER (PARTITION BY unit) AS is_spike, n / (2 * avg(n) OVER (PARTITION BY unit)) AS intensity FROM counts)"
_AREA = f"""{_SPIKES}, st AS (SELECT *, coalesce((intensity + lag(intensity) OVER (PARTITION BY unit ORDER BY t_idx)) / 2, 0) AS step FROM sp),
ar AS (SELECT *, sum(step) OVER (PARTITION BY unit ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS area FROM st), en AS (SELECT *, max(area) OVER (PARTITION BY unit) AS fin FROM ar),
iv AS (SELECT unit, t_idx, area, fin, area - coalesce(lag(area) OVER (PARTITION BY unit ORDER BY t_idx), 0) AS isi FROM en WHERE is_spike),
u AS (SELECT unit, t_idx, isi, (1 - exp(-isi)) / (1 - exp(-(fin - area + isi))) AS u FROM iv)"""


def spikes(spark: SparkSession, d: str) -> DataFrame:
    m = F.avg("n").over(Window.partitionBy("unit"))
    return hourly(spark, d).select("unit", "t_idx", (F.col("n") > m).alias("is_spike"), (F.col("n") / (2 * m)).alias("intensity"), F.col("n"))


@query(f"WITH {_AREA} SELECT unit, t_idx, round(isi, 6) AS isi, round(u, 6) AS u FROM u")
def time_rescaling(spark, d):
    return gof.rescaled_intervals(spikes(spark, d), keys=["unit"]).select("unit", "t_idx", _r("isi"), _r("u"))


@query(f"WITH {_AREA}, k AS (SELECT unit, u, row_number() OVER (PARTITION BY unit ORDER BY u) AS k, count(*) OVER (PARTITION BY unit) AS n FROM u) SELECT unit, max(n) AS n, round(max(abs(u - (k - 0.5) / n)), 6) AS ks FROM k GROUP BY unit")
def ks_statistic(spark, d):
    return gof.ks_statistic(gof.rescaled_intervals(spikes(spark, d), keys=["unit"]), ["unit"]).select("unit", "n", _r("ks"))


@query(f"WITH {_SPIKES} SELECT unit, t_idx, round(sum(is_spike::INT - intensity) OVER (PARTITION BY unit ORDER BY t_idx ROWS UNBOUNDED PRECEDING), 6) AS residual FROM sp")
def point_residuals(spark, d):
    rows = spikes(spark, d).withColumn("n", F.col("is_spike").cast("int"))
    return gof.residuals(rows, keys=["unit"]).select("unit", "t_idx", _r("residual"))


@query()
def interval_autocorrelation(spark, d):
    u = gof.rescaled_intervals(spikes(spark, d), keys=["unit"])
    return gof.interval_autocorrelation(u, 10, ["unit"]).select("unit", "lag", _r("c"))


@query()
def full_autocorrelation(spark, d):
    """Each user's gaps between events, against a constant rate, at all lags."""
    return gof.full_autocorrelation(user_gaps(spark, d), ["user_id"], order="t").select("user_id", "lag", _r("c"))


def user_gaps(spark, d) -> DataFrame:
    ev = event_rows(spark, d)
    w = Window.partitionBy("user_id")
    gap = F.col("t") - F.lag("t").over(w.orderBy("t", "event_id"))
    rows = ev.select("user_id", "t", gap.alias("gap"), ((F.max("t").over(w) - F.min("t").over(w)) / (F.count("*").over(w) - 1)).alias("mean"))
    return rows.where("gap IS NOT NULL AND mean > 0").select("user_id", "t", (1 - F.exp(-F.col("gap") / F.col("mean"))).alias("u"))


@query("WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_quantity, round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY l_returnflag), 9) AS cdf FROM c")
def empirical_cdf(spark, d):
    return gof.empirical_cdf(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "l_quantity", _r("cdf", 9))


@query("SELECT vec_id, round(cume_dist() OVER (ORDER BY embedding[1]), 9) AS u_m0, round(cume_dist() OVER (ORDER BY embedding[2]), 9) AS u_m1 FROM embeddings")
def rosenblatt(spark, d):
    return gof.rosenblatt(mark_rows(spark, d, 2), ["m0", "m1"]).select("vec_id", _r("u_m0", 9), _r("u_m1", 9))


# --- ordered operators ------------------------------------------------------------------------

_W8 = windows.gaussian_weights(2.0)


@query(f"""WITH {_COUNTS}, w AS (SELECT i - {len(_W8) // 2} AS k, exp(-0.5 * power((i - {len(_W8) // 2}) / 2.0, 2)) AS g FROM range({len(_W8)}) r(i)), wn AS (SELECT k, g / sum(g) OVER () AS g FROM w)
SELECT c.unit, c.t_idx, round(sum(coalesce(o.n, 0) * g), 6) AS smooth FROM counts c CROSS JOIN wn LEFT JOIN counts o ON o.unit = c.unit AND o.t_idx = c.t_idx + k GROUP BY c.unit, c.t_idx""")
def gaussian_smooth(spark, d):
    return windows.gaussian_smooth(hourly(spark, d), "n", "smooth", 2.0, keys=["unit"]).select("unit", "t_idx", _r("smooth"))


@query(f"""WITH {_EV}, w AS (SELECT user_id, event_id, value, t, lag(value) OVER o AS p, lead(value) OVER o AS q, t - lag(t) OVER o AS a, lead(t) OVER o - t AS b FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(CASE WHEN p IS NULL THEN (q - value) / b WHEN q IS NULL THEN (value - p) / a ELSE (a * a * q + (b * b - a * a) * value - b * b * p) / (a * b * (a + b)) END, 6) AS slope FROM w""")
def gradient(spark, d):
    return windows.gradient(event_rows(spark, d), "value", "slope", "t", ["t", "event_id"], ["user_id"]).select("event_id", _r("slope"))


@query(f"""WITH {_EV}, w AS (SELECT event_id, value, t, lag(value) OVER o AS p, lead(value) OVER o AS q, t - lag(t) OVER o AS a, lead(t) OVER o - t AS b FROM ev WINDOW o AS (PARTITION BY unit ORDER BY t))
SELECT event_id, round(abs(CASE WHEN p IS NULL THEN (q - value) / b WHEN q IS NULL THEN (value - p) / a ELSE (a * a * q + (b * b - a * a) * value - b * b * p) / (a * b * (a + b)) END), 5) AS speed FROM w""")
def speed(spark, d):
    return windows.speed(event_rows(spark, d), ["value"], t="t", order=["t", "event_id"], keys=["unit"]).select("event_id", _r("speed", 5))


@query(f"WITH {_EV} SELECT event_id, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY t) THEN 'Inbound' ELSE 'Outbound' END AS direction FROM ev")
def trajectory_direction(spark, d):
    return windows.trajectory_direction(event_rows(spark, d), "value", order="t", keys=["user_id"]).select("event_id", "direction")


@query(f"WITH {_COUNTS}, s AS (SELECT unit, t_idx, coalesce((n + lag(n) OVER (PARTITION BY unit ORDER BY t_idx)) / 2, 0) AS s FROM counts) SELECT unit, t_idx, round(sum(s) OVER (PARTITION BY unit ORDER BY t_idx ROWS UNBOUNDED PRECEDING), 6) AS area FROM s")
def cumulative_trapezoid(spark, d):
    return windows.cumulative_trapezoid(hourly(spark, d), "n", "area", keys=["unit"]).select("unit", "t_idx", _r("area"))


@query(f"WITH {_EV}, s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS v FROM ev) SELECT user_id, round(covar_samp(v, v), 4) AS cov_value_value FROM s WHERE v IS NOT NULL GROUP BY user_id")
def movement_variance(spark, d):
    out = windows.movement_variance(event_rows(spark, d), ["value"], "t", ["user_id"])
    return out.select("user_id", _r("cov_value_value", 4))


@query(f"WITH {_EV}, s AS (SELECT unit, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS g FROM ev) SELECT unit, round(median(g), 4) AS median_step FROM s WHERE g IS NOT NULL GROUP BY unit")
def median_step(spark, d):
    return windows.median_step(event_rows(spark, d).withColumn("t_idx", F.col("t")), ["unit"]).select("unit", _r("median_step", 4))


@query("SELECT l_returnflag AS unit, round(sum(l_quantity), 2) AS mass, round(power(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 4) AS ess FROM lineitem GROUP BY 1")
def effective_size(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("w"))
    return em.effective_size(rows, keys=["unit"]).select("unit", F.round("mass", 2).alias("mass"), _r("ess", 4))


@query("SELECT l_returnflag AS unit, round(sum(l_quantity) / (SELECT sum(o_totalprice) FROM orders), 9) AS rate FROM lineitem GROUP BY 1")
def weighted_mean_rate(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("unit"), "l_quantity")
    return kde.mean_rates(rows, table(spark, d, "orders"), "unit", "l_quantity", "o_totalprice").select("unit", _r("rate", 9))


@query(f"""WITH {_COUNTS}, x AS (SELECT t_idx, sum(n) / 3600.0 AS x FROM counts GROUP BY t_idx), w AS (SELECT i - 16 AS k, exp(-0.5 * power((i - 16) / 2.0, 2)) AS g FROM range(33) r(i)), wn AS (SELECT k, g / sum(g) OVER () AS g FROM w)
SELECT c.t_idx, round(sum(coalesce(o.x, 0) * g), 9) AS rate FROM x c CROSS JOIN wn LEFT JOIN x o ON o.t_idx = c.t_idx + k GROUP BY c.t_idx""")
def multiunit_rate(spark, d):
    ev = event_rows(spark, d)
    return analysis.multiunit_rate(ev, hours(ev), ev.select("unit").distinct(), 1 / HOUR, 2 * HOUR).select("t_idx", _r("rate", 9))


# --- one long recording, no keys --------------------------------------------------------------

_LINES = "li AS (SELECT epoch_us(l_shipdate) / 1e6 + l_orderkey AS t, sum(l_quantity) AS v FROM lineitem GROUP BY 1)"


def line_times(spark, d):
    """Line items as one recording of (t, v): the quantities at the shipping date, parted by the order's key."""
    rows = table(spark, d, "lineitem").select((seconds("l_shipdate") + F.col("l_orderkey")).alias("t"), F.col("l_quantity").alias("v"))
    return rows.groupBy("t").agg(F.sum("v").alias("v"))


@query(f"""WITH {_EV}, {_LINES}, s AS (SELECT t, avg(value) AS value FROM ev GROUP BY t), n AS (SELECT t, value, lag(t) OVER o AS pt, lag(value) OVER o AS pv, lead(t) OVER o AS nt, lead(value) OVER o AS nv FROM s WINDOW o AS (ORDER BY t)),
a AS (SELECT li.t, n.t AS ta, value, pt, pv, nt, nv FROM li ASOF JOIN n ON li.t >= n.t),
b AS (SELECT t, CASE WHEN nt IS NULL THEN pv + (t - pt) / (ta - pt) * (value - pv) ELSE value + (t - ta) / (nt - ta) * (nv - value) END AS x FROM a),
f AS (SELECT * FROM n WHERE pt IS NULL), c AS (SELECT li.t, f.value + (li.t - f.t) / (f.nt - f.t) * (f.nv - f.value) AS x FROM li, f WHERE li.t < f.t)
SELECT t, round(x / 1e3, 2) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM c)""")
def long_interpolation(spark, d):
    """The events' value at each line item's time, by lines between neighbours in time."""
    samples = event_rows(spark, d).groupBy("t").agg(F.avg("value").alias("x"))
    out = asof.interpolate(line_times(spark, d).select("t"), samples, ["x"])
    return out.select("t", F.round(F.col("x") / 1e3, 2).alias("x"))


@query(f"""WITH {_LINES}, m AS (SELECT t, v > 20 AS on_, row_number() OVER (ORDER BY t) - row_number() OVER (PARTITION BY v > 20 ORDER BY t) AS island FROM li)
SELECT row_number() OVER (ORDER BY s) AS run, round(s, 3) AS s, round(e, 3) AS e FROM (SELECT min(t) AS s, max(t) AS e FROM m WHERE on_ GROUP BY island)""")
def long_runs(spark, d):
    return binning.runs(line_times(spark, d), "v > 20").select("run", F.round("start", 3).alias("s"), F.round("end", 3).alias("e"))


@query(f"""WITH {_LINES}, s AS (SELECT t, v, coalesce((v + lag(v) OVER (ORDER BY t)) / 2, 0) AS step FROM li)
SELECT t, round(sum(step) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 2) AS area, round(sum(v) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 2) AS total FROM s""")
def long_integral(spark, d):
    """Running integral and running sum of the quantities."""
    rows = windows.cumulative_trapezoid(line_times(spark, d), "v", "area", "t")
    return windows.running_sum(rows, "v", "total", "t").select("t", F.round("area", 2).alias("area"), F.round("total", 2).alias("total"))


# --- local states -----------------------------------------------------------------------------

_LOCAL = f"{_EV}, p AS (SELECT event_id, CASE WHEN value = 475 THEN 18 ELSE least(greatest(floor(value / 25), 0), 19) END AS b FROM ev), g AS (SELECT event_id, j AS bin, abs(b - j) * 25.0 AS dist, b FROM p, range(20) r(j))"


def _explode(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.select("event_id", F.posexplode(column).alias("bin", column)).select("event_id", F.col("bin").cast("long").alias("bin"), _r(column, digits))


@query(f"WITH {_LOCAL} SELECT event_id, bin, round(-3 * exp(-0.5 * dist * dist / 2500.0), 6) + 0.0 AS penalty FROM g")
def local_penalty(spark, d):
    env = GRID.fit(None, ["value"])
    return _explode(likelihood.non_local_penalty(event_rows(spark, d), env, 3.0, 50.0, ["value"]), "penalty").withColumn("penalty", F.col("penalty") + 0.0)


@query(f"WITH {_LOCAL}, k AS (SELECT event_id, bin, -0.5 * dist * dist / 1600.0 AS k FROM g) SELECT event_id, bin, round(k - ln(sum(exp(k)) OVER (PARTITION BY event_id)) + ln(20), 6) AS kernel FROM k")
def local_kernel(spark, d):
    env = GRID.fit(None, ["value"])
    return _explode(likelihood.local_kernel(event_rows(spark, d), env, 40.0, ["value"]), "kernel")


@query(f"WITH {_LOCAL} SELECT event_id, bin, CASE WHEN b = bin THEN round(ln(20), 6) ELSE '-infinity'::DOUBLE END AS kernel FROM g")
def local_delta_kernel(spark, d):
    env = GRID.fit(None, ["value"])
    out = likelihood.local_kernel(event_rows(spark, d), env, 0.0, ["value"])
    return _explode(out, "kernel")


@query(f"""WITH {_COUNTS}, pos AS (SELECT floor(t / {HOUR})::BIGINT - (SELECT a FROM ends) AS t_idx, avg(value) AS c FROM ev GROUP BY 1),
ks AS (SELECT t_idx, unit, {_K} AS k FROM pos, ev), occ AS (SELECT t_idx, avg(k) AS occ FROM ks GROUP BY 1), mg AS (SELECT t_idx, unit, avg(k) AS m FROM ks GROUP BY 1, 2),
rt AS (SELECT unit, count(*) / (SELECT count(*) FROM ev)::DOUBLE AS rate FROM ev GROUP BY unit),
f AS (SELECT t_idx, unit, greatest(CASE WHEN occ > 0 THEN rate * m / occ ELSE rate * 1e-15 END, 1e-15) AS f FROM mg JOIN occ USING (t_idx) JOIN rt USING (unit))
SELECT t_idx, round(sum(CASE WHEN n = 0 THEN 0 ELSE n * ln(f) END - f), 5) AS ll FROM f JOIN counts USING (t_idx, unit) GROUP BY t_idx""")
def local_place_loglik(spark, d):
    """Each hour's events under the rates at the hour's own mean value."""
    ev = event_rows(spark, d)
    clock = hours(ev)
    binned = stored(binning.bin_events(ev, clock))
    at = binned.groupBy("t_idx").agg(F.avg("value").alias("value"))
    counted = binned.groupBy("unit", "t_idx").agg(F.count("*").alias("n"))
    return kde.local_loglik(counted, ev, ev, at, ["value"], STD).select("t_idx", _r("ll", 5))


@query("""WITH v AS (SELECT vec_id, label AS unit, (vec_id // 5) % 40 AS t_idx, embedding[1]::DOUBLE * 500 + 250 AS x, embedding[2]::DOUBLE * 100 AS m0, embedding[3]::DOUBLE * 100 AS m1 FROM embeddings),
pos AS (SELECT t_idx, avg(x) AS x FROM v GROUP BY 1), rt AS (SELECT unit, count(*) / (SELECT count(*) FROM v)::DOUBLE AS rate FROM v GROUP BY unit),
j AS (SELECT a.vec_id, a.t_idx, a.unit, avg(exp(-0.5 * (power((a.m0 - b.m0) / 24.0, 2) + power((a.m1 - b.m1) / 24.0, 2) + power((a.x - b.x) / 30.0, 2))) / (24.0 * 24.0 * 30.0 * power(2 * pi(), 1.5))) AS j FROM v a JOIN v b USING (unit) GROUP BY 1, 2, 3),
oe AS (SELECT a.vec_id, avg(exp(-0.5 * power((a.x - b.x) / 30.0, 2)) / (30.0 * sqrt(2 * pi()))) AS o FROM v a, v b GROUP BY 1),
h AS (SELECT t_idx, sum(ln(greatest(rate * j / greatest(o, 1e-15), 1e-15))) AS x FROM j JOIN oe USING (vec_id) JOIN rt USING (unit) GROUP BY 1),
kt AS (SELECT pos.t_idx, b.unit, exp(-0.5 * power((pos.x - b.x) / 30.0, 2)) / (30.0 * sqrt(2 * pi())) AS k FROM pos, v b), ot AS (SELECT t_idx, avg(k) AS o FROM kt GROUP BY 1), mt AS (SELECT t_idx, unit, avg(k) AS m FROM kt GROUP BY 1, 2),
g AS (SELECT t_idx, sum(greatest(rate * m / greatest(o, 1e-15), 1e-15)) AS g FROM mt JOIN ot USING (t_idx) JOIN rt USING (unit) GROUP BY 1)
SELECT t_idx, round(x - g, 5) AS ll FROM h JOIN g USING (t_idx)""")
def local_mark_loglik(spark, d):
    """Marked events under the intensities at their own place, by bins of events."""
    v = mark_rows(spark, d, 3).select(F.col("vec_id").alias("event_id"), "unit", F.pmod(F.floor(F.col("vec_id") / 5), F.lit(40)).alias("t_idx"), (F.col("m0") * 500 + 250).alias("x"), (F.col("m1") * 100).alias("m0"), (F.col("m2") * 100).alias("m1"))
    at = v.groupBy("t_idx").agg(F.avg("x").alias("x"))
    out = kde.marked_local_loglik(v, v, v, kde.mean_rates(v, v), at, ["m0", "m1"], ["x"], 24.0, 30.0)
    return out.select("t_idx", _r("ll", 5))


# --- simulators, decoders ---------------------------------------------------------------------

@query("SELECT i AS t_idx, round(i / 100.0, 6) AS t, round(50 * sin(2 * pi() * (1 / (2 * 100.0 / 20.0)) * (i / 100.0) - pi() / 2) + 50, 6) AS x FROM range(5000) r(i)")
def simulate_run(spark, d):
    return simulate.run_back_and_forth(simulate.times(spark, 5000, 100.0), 100.0, 20.0).select("t_idx", _r("t"), _r("x"))


@query("SELECT i AS t_idx, round(50 * sin(2 * pi() * (i / 100.0) / 8.0 - pi() / 2) + 50, 6) AS x, round(12.0 * exp(-0.5 * power((50 * sin(2 * pi() * (i / 100.0) / 8.0 - pi() / 2) + 50 - 40) / 6.0, 2)) + 0.001, 6) AS rate FROM range(5000) r(i)")
def simulate_field(spark, d):
    run = simulate.run_with_period(simulate.times(spark, 5000, 100.0), 100.0, 8.0)
    return run.select("t_idx", _r("x"), F.round(simulate.place_rate("x", 40.0, 6.0, 12.0), 6).alias("rate"))


def _decode_sql(unit: str, kind: str, out: str, step: float = HOUR) -> str:
    """Rates by value, likelihoods of ten bins by time step, and filter and smoother over the bins of two states, for each kind of recording."""
    k = f"exp(-0.5 * power((c - value) / {STD}, 2)) / ({STD} * sqrt(2 * pi()))"
    scaled = "list_transform(u, lambda y: y / list_sum(u))"
    return f"""WITH RECURSIVE ev AS (SELECT epoch_us(ts) / 1e6 AS t, value, {unit} AS unit, {kind} AS kind FROM events),
{_HOURS.replace(str(HOUR), str(step))}, pts AS (SELECT i AS bin, i * 50.0 + 25.0 AS c FROM range(10) r(i)),
occ AS (SELECT bin, avg({k}) AS occ FROM ev, pts GROUP BY bin), mg AS (SELECT unit, bin, avg({k}) AS m FROM ev, pts GROUP BY unit, bin),
rt AS (SELECT unit, count(*) / (SELECT count(*) FROM ev)::DOUBLE AS rate FROM ev GROUP BY unit),
fields AS (SELECT unit, bin, greatest(CASE WHEN occ > 0 THEN rate * m / occ ELSE rate * 1e-15 END, 1e-15) AS field FROM mg JOIN occ USING (bin) JOIN rt USING (unit)),
silent AS (SELECT bin, sum(field) AS f FROM fields GROUP BY bin),
cnt AS (SELECT kind, floor(t / {step})::BIGINT - (SELECT a FROM ends) AS i, unit, count(*) AS n FROM ev GROUP BY ALL),
hit AS (SELECT kind, i, bin, sum(n * ln(field)) AS x FROM cnt JOIN fields USING (unit) GROUP BY ALL),
ll AS (SELECT k.kind, h.t_idx AS i, s.bin, coalesce(x, 0) - f AS l FROM (SELECT DISTINCT kind FROM ev) k CROSS JOIN hours h CROSS JOIN silent s LEFT JOIN hit ON hit.kind = k.kind AND hit.i = h.t_idx AND hit.bin = s.bin),
es AS (SELECT kind, i, list_transform(l || l, lambda x: exp(x - list_max(l))) AS e FROM (SELECT kind, i, list(l ORDER BY bin) AS l FROM ll GROUP BY ALL)),
w AS (SELECT x.bin AS i, y.bin AS j, exp(-0.5 * power(x.c - y.c, 2) / 6.0) AS w FROM pts x, pts y), wn AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w),
st AS (SELECT x.s * 10 + wn.i AS i, y.s * 10 + wn.j AS j, CASE WHEN x.s = y.s THEN 0.98 ELSE 0.02 END * CASE WHEN x.s + y.s = 0 THEN w ELSE 0.1 END AS a FROM wn, (SELECT unnest([0, 1]) AS s) x, (SELECT unnest([0, 1]) AS s) y),
m AS (SELECT (SELECT list(r ORDER BY i) FROM (SELECT i, list(a::DOUBLE ORDER BY j) AS r FROM st GROUP BY i)) AS rows_, (SELECT list(r ORDER BY j) FROM (SELECT j, list(a::DOUBLE ORDER BY i) AS r FROM st GROUP BY j)) AS columns_),
f(kind, i, p, q) AS (
  SELECT kind, i, {scaled}, q FROM (SELECT kind, i, list_transform(e, lambda x: 0.05 * x) AS u, list_transform(e, lambda x: 0.05::DOUBLE) AS q FROM es WHERE i = 0)
  UNION ALL SELECT kind, i, {scaled}, q FROM (SELECT kind, i, q, list_transform(range(1, 21), lambda j: q[j] * e[j]) AS u FROM (
    SELECT f.kind, es.i, e, list_transform(columns_, lambda c: list_dot_product(c, p)) AS q FROM f JOIN es ON es.kind = f.kind AND es.i = f.i + 1, m))),
g(kind, i, g) AS (
  SELECT kind, i, p FROM f WHERE i = (SELECT max(i) FROM f)
  UNION ALL SELECT kind, i, {scaled} FROM (SELECT kind, i, list_transform(range(1, 21), lambda k: p[k] * list_dot_product(rows_[k], r)) AS u FROM (
    SELECT f.kind, f.i, f.p, rows_, list_transform(range(1, 21), lambda j: CASE WHEN n.q[j] = 0 THEN 0 ELSE g.g[j] / n.q[j] END) AS r
    FROM g JOIN f n ON n.kind = g.kind AND n.i = g.i JOIN f ON f.kind = g.kind AND f.i = g.i - 1, m)))
SELECT {out}i AS t_idx, CASE WHEN k < 10 THEN 'Continuous' ELSE 'Fragmented' END AS name, (k % 10)::INTEGER AS bin, round(g[k + 1], 6) AS acausal FROM (SELECT kind, i, g, unnest(range(20)) AS k FROM g)"""


def _two_states() -> models.Decoder:
    return models.continuous_fragmented(environments=[geometry.Environment("", bin_size=50.0, ranges=[(0.0, 500.0)], infer_interior=False)], position_std=STD)


@query(_decode_sql("event_type", "0", ""))
def decode_position(spark, d):
    """Fit a continuous / fragmented decoder on the events' values and decode hourly."""
    ev = event_rows(spark, d)
    placed = ev.select("event_id", "unit", "t", F.col("value").alias("x"))
    out = _two_states().fit(placed.select("t", "x"), placed).predict(placed.drop("x"), hours(ev))
    return out.select("t_idx", "name", "bin", _r("acausal"))


@query(_decode_sql("user_id", "event_type", "kind, ", 6 * HOUR))
def decode_sessions(spark, d):
    """The same with users as units (each with rates of its own), each kind of event as a recording of its own, in one plan, and steps of six hours."""
    ev = event_rows(spark, d).select("event_id", F.col("unit").alias("kind"), F.col("user_id").alias("unit"), "t", "value")
    clock = hours(ev, 6 * HOUR).crossJoin(F.broadcast(ev.select("kind").distinct()))
    placed = ev.withColumnRenamed("value", "x")
    model = _two_states().fit(placed.select("kind", "t", "x"), placed, keys=["kind"])
    out = model.predict(ev.drop("value"), clock)
    return out.select("kind", "t_idx", "name", "bin", _r("acausal"))


@query()
def em_covariates(spark, d):
    """Slow and fast states of the hourly counts, whose transitions follow the hour of the day; three rounds."""
    coef, trace = covariate_rounds(spark, d, 3)
    rows = [(f"log likelihood {k}", float(round(v, 3))) for k, v in enumerate(trace)] + [(f"coefficient {i} {s}", float(round(coef[i, s, 0], 4))) for i in range(coef.shape[0]) for s in range(2)]
    return spark.createDataFrame(rows, "what string, value double")


def daily_design(spark, d) -> DataFrame:
    """(unit, t_idx, ll, x): likelihoods of intensity_loglik() and a spline of the hour of the day with its knots at quantiles."""
    rows = intensity_loglik(spark, d).withColumn("hour", F.pmod("t_idx", F.lit(24)).cast("double"))
    return transitions.Design.over(rows, splines={"hour": 1}, degree=2).rows(rows).select("unit", "t_idx", "ll", "x")


def covariate_rounds(spark, d, rounds: int) -> tuple[np.ndarray, list[float]]:
    rows = stored(daily_design(spark, d))
    coef, trace = transitions.NonStationary(A).coefficients(len(rows.select("x").first()["x"])), []
    for _ in range(rounds):
        by_time = transitions.predict_transitions(rows, coef).select("unit", "t_idx", "ll", "x", "trans")
        out = stored(hmm.decode(by_time, [0.5, 0.5], None, ["unit"], "trans", chunk=256))
        trace.append(out.agg(F.sum("log_norm")).first()[0])
        xi = em.transition_responses(out.join(by_time.select("unit", "t_idx", "trans"), ["unit", "t_idx"]), "trans", ["unit"])
        coef = em.update_covariate_transitions(stored(xi.join(rows.select("unit", "t_idx", "x"), ["unit", "t_idx"]).select("x", "xi")), coef, l2=1e-3)
    return coef, trace


assert math.isfinite(X.LOG_EPS)
