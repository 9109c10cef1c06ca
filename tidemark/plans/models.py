"""Decoders: the presets, fit, predict, parameter estimation, most likely sequence, saving and loading.

A decoder ties the operators together: geometry and state space, encoding model, likelihood of each state,
hidden Markov recursion.  All of it is a lazy plan but for the small model parts (grids, matrices).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import ConfigurationError, ValidationError, position_rows, positive, probabilities
from ..operators import binning, em, glm, gmm, hmm, kde, likelihood, ordered
from ..operators.asof import interpolate
from ..operators.geometry import Environment
from ..operators.transitions import Discrete, NonStationary, Observation, RandomWalk, StateSpace, StationaryCustom, StationaryDiagonal, Uniform, predict_transitions
from ..operators.windows import typical_step
from ..sources import io
from ..sources.store import forget, stored

OUTPUTS = ("filter", "predictive", "predictive_posterior", "log_likelihood", "all")
SORTED = ("kde", "glm")
MARKED = ("kde", "log_kde", "gmm")


@dataclass
class Decoder:
    """State-space decoder of events with (marks) or without (units) marks."""

    names: Sequence[str] = ("Continuous",)
    observations: Sequence[Observation] = (Observation(),)
    environments: Sequence[Environment] = field(default_factory=lambda: [Environment()])
    blocks: Sequence[Sequence] = field(default_factory=lambda: [[RandomWalk()]])
    prior: Sequence[float] = (1.0,)
    discrete: object = field(default_factory=lambda: StationaryDiagonal([1.0]))
    stickiness: object = 0.0
    concentration: float = 1.1
    weight: object = 0.0
    frozen: Sequence[int] = ()
    marks: Sequence[str] = ()
    algorithm: str = "kde"
    position_std: float = 6.0
    mark_std: float = 24.0
    no_event_rate: float = 1e-10
    local_std: float | None = None
    penalty: float = 0.0
    penalty_std: float = 10.0
    occupancy: str = "all"
    rate: float = 500.0

    def __post_init__(self):
        n = len(self.names)
        if not len(self.observations) == len(self.prior) == len(self.blocks) == n:
            raise ConfigurationError("states, observations, priors and blocks differ in number")
        probabilities("prior", self.prior)
        allowed = MARKED if self.marks else SORTED
        if self.algorithm not in allowed:
            raise ValidationError("unknown algorithm", allowed, self.algorithm)
        positive("position_std", self.position_std)
        positive("penalty", self.penalty, strict=False)
        positive("penalty_std", self.penalty_std)
        positive("concentration", self.concentration)

    # --- fit ---

    def fit(self, samples: DataFrame, events: DataFrame, columns: Sequence[str] = ("x",), unit: str = "unit", group: str | None = None, environment: str | None = None, training: str = "true", weight: str | None = None, keys: Sequence[str] = ()) -> "Decoder":
        """samples: (t, columns) and optional group, environment and training columns; events: (event_id, unit, t, marks).

        Events that have all position columns keep their own places (two events at one time may differ in them); others
        are placed by interpolation of the samples.

        ``keys`` name sessions: recordings with times of their own, of which samples, events and clocks have the
        columns.  One model is fitted to all of them; each is decoded from its own start.
        """
        self.columns, self.unit, self.keys = list(columns), unit, list(keys)
        position_rows(samples, self.columns)
        for e in self.environments:
            if e.edges is None:
                mine = samples if environment is None or not e.name else samples.where(F.col(environment) == e.name)
                e.fit(mine, self.columns)
        self.space = StateSpace(self.names, self.observations, self.environments, self.local_std is not None)
        self.initial = self.space.initial(self.prior)
        if isinstance(self.discrete, NonStationary):
            self.coefficients, self.transition = getattr(self.discrete, "fitted", None), np.asarray(self.discrete.matrix, float)
        else:
            self.coefficients, self.transition = None, self.discrete.make()
        self.continuous = self.space.continuous(self.blocks, samples)
        self.samples, self.events, self.how = samples, events, (group, environment, training, weight)
        self._encode()
        return self

    def _mine(self, key: tuple) -> DataFrame:
        """Samples of an observation model: training rows of its environment and group, positions known."""
        group, environment, training, _ = self.how
        out = self.samples.where(training)
        if environment is not None and key[0]:
            out = out.where(F.col(environment) == key[0])
        if group is not None:
            out = out.where(F.col(group) == key[1])
        for c in self.columns:
            out = out.where(~F.isnan(c))
        return out

    def _encode(self) -> None:
        spark, columns = self.samples.sparkSession, self.columns
        group, environment, training, weight = self.how
        self.encoding = {}
        self.units = stored(self.events.select(self.unit).distinct())
        for o in self.observations:
            if o.key in self.encoding or o.no_event:
                continue
            env = next(e for e in self.environments if e.name == o.environment)
            points = env.points[env.interior_bins]
            mine = self._mine(o.key)
            if training == "true" and group is None and (environment is None or not o.environment):  # one run
                spans = self.samples.groupBy(*self.keys).agg(F.lit(1).cast("long").alias("run"), F.min("t").alias("start"), F.max("t").alias("end"))
            else:
                spans = binning.runs(self.samples.withColumn("__in", self._flag(o.key)), "__in", self.keys)
            near = binning.events_in_runs(self.events, spans, typical_step(self.samples, self.keys), self.keys)
            wanted = [*([] if set(columns) <= set(near.columns) else columns), *([weight] if weight else [])]
            placed = stored(interpolate(near, self.samples, wanted, self.keys) if wanted else near)
            # Without marks all samples count as visited unless told otherwise; with marks only the group's do.
            visited = mine if self.marks or self.occupancy == "group" or weight else self.samples
            model = {"points": points, "placed": placed, "visited": visited}
            if not self.marks and self.algorithm == "kde":
                model["fields"] = stored(kde.place_fields(placed, visited, columns, points, self.position_std, self.unit, weight, weight, self.units))
            elif not self.marks:
                model["fields"] = self._glm_fields(placed, visited, points, spark, weight)
            else:
                model["rates"] = kde.mean_rates(placed, visited, self.unit)
                if self.algorithm == "gmm":
                    model |= self._mixtures(placed, visited, points)
                else:
                    model["ground"] = kde.ground_intensity(placed, visited, columns, points, self.position_std, self.unit)
                    occ = kde.kde(visited, columns, points, self.position_std).orderBy("bin").collect()  # bins only
                    model["occupancy"] = np.array([r["density"] for r in occ])
            self.encoding[o.key] = model

    def _flag(self, key: tuple):
        group, environment, training, _ = self.how
        flag = F.expr(training)
        if environment is not None and key[0]:
            flag = flag & (F.col(environment) == key[0])
        if group is not None:
            flag = flag & (F.col(group) == key[1])
        return flag

    def _glm_fields(self, placed: DataFrame, visited: DataFrame, points: np.ndarray, spark: SparkSession, weight: str | None) -> DataFrame:
        """A Poisson regression per unit of the events per sample at the sample's position."""
        design = glm.Design.over(visited, self.columns, 2 * self.position_std)
        clock = stored(ordered.positions(visited.select(*self.keys, "t").distinct(), [*self.keys, "t"], out="t_idx"))
        counted = binning.sparse_counts(placed, clock, self.unit, self.keys)
        rows = clock.join(visited, [*self.keys, "t"])
        found = glm.fit_units(rows, rows.join(counted, "t_idx"), design, self.columns, self.unit, "n", weight)
        for r in self.units.collect():  # a unit without events near samples has no rate
            found.setdefault(r[0], np.r_[np.log(kde.EPS), np.zeros(len(design(points[:1])[0]) - 1)])
        return glm.fields(design, found, points, spark)

    def _mixtures(self, placed: DataFrame, visited: DataFrame, points: np.ndarray) -> dict:
        k = lambda n, most: int(max(1, min(most, n // 20)))
        occ = gmm.fit_mixture(visited, self.columns, k(visited.count(), 32))
        joint, ground, rates = {}, np.zeros(len(points)), {}
        for r in kde.mean_rates(placed, visited, self.unit).collect():
            own = placed.where(F.col(self.unit) == r[self.unit])
            n = own.count()
            joint[r[self.unit]] = gmm.fit_mixture(own, [*self.columns, *self.marks], k(n, 64))
            marginal = gmm.fit_mixture(own, self.columns, k(n, 32))
            rates[r[self.unit]] = r["rate"]
            ground += np.maximum(r["rate"] * np.exp(marginal.log_prob(points) - occ.log_prob(points)), kde.EPS)
        return {"joint": joint, "occupancy_mixture": occ, "ground_values": ground, "rate_values": rates}

    # --- likelihood ---

    def _coded(self, clock: DataFrame, *others: DataFrame | None) -> list[DataFrame | None]:
        """Clock and further tables by time, with sessions told by the upper half of ``t_idx`` (its own value is ``__t``)."""
        if not self.keys:
            return [clock, *others]
        numbers = stored(ordered.positions(clock.select(*self.keys).distinct(), self.keys, out="__sid"))
        return [None if x is None else x.join(numbers, self.keys).withColumn("__t", F.col("t_idx")).withColumn("t_idx", F.col("__sid") * F.lit(1 << 32) + F.col("t_idx")).drop("__sid") for x in (clock, *others)]

    def _plain(self, rows: DataFrame, clock: DataFrame, *more: str) -> DataFrame:
        """Results with the sessions' columns and times (and ``more``) of the coded clock."""
        if not self.keys:
            return rows.join(clock.select("t_idx", *more), "t_idx") if more else rows
        back = rows.join(clock.select("t_idx", *self.keys, "__t", *more), "t_idx").drop("t_idx").withColumnRenamed("__t", "t_idx")
        return back.select(*self.keys, "t_idx", *(c for c in back.columns if c not in ("t_idx", *self.keys)))

    def _sessions(self, ll: DataFrame) -> tuple[DataFrame, list[str]]:
        return (ll.withColumn("__sid", F.shiftright("t_idx", 32)), ["__sid"]) if self.keys else (ll, [])

    def compute_log_likelihood(self, events: DataFrame, clock: DataFrame, samples: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
        """(keys, t_idx, ll array over the interior state bins)."""
        clock, missing = self._coded(clock, missing)
        return self._plain(self._likelihood(events, clock, samples, missing), clock)

    def _likelihood(self, events: DataFrame, clock: DataFrame, samples: DataFrame | None, missing: DataFrame | None) -> DataFrame:
        counted = stored(binning.sparse_counts(events, clock, self.unit, self.keys))
        parts, extra = {}, {}
        at = None
        if samples is not None:
            at = self._positions(clock, samples)
        for k, o in enumerate(self.observations):
            if o.no_event:
                key = ("no_event",)
                if key not in parts:
                    parts[key] = kde.no_event_loglik(counted, typical_step(clock, self.keys), self.no_event_rate, clock, self.units.count())
                continue
            model = self.encoding[o.key]
            env = next(e for e in self.environments if e.name == o.environment)
            n = len(env.interior_bins)
            if o.local and not self.space.local_bins:
                key = ("local", *o.key)
                if key not in parts:
                    if at is None:
                        raise ConfigurationError("local states need the position", hint="give samples")
                    parts[key] = self._local(model, counted, events, clock, at, samples)
                continue
            key = ("bins", *o.key)
            if key not in parts:
                parts[key] = self._bins(model, counted, events, clock, n)
            if o.local:
                extra[k] = likelihood.local_kernel(at, env, self.local_std, self.columns).select("t_idx", F.col("kernel").alias("value"))
            elif self.penalty > 0:
                extra[k] = likelihood.non_local_penalty(at, env, self.penalty, self.penalty_std, self.columns).select("t_idx", F.col("penalty").alias("value"))
        return likelihood.assemble(self.space, parts, clock, missing, extra)

    def _positions(self, clock: DataFrame, samples: DataFrame) -> DataFrame:
        """The clock with the position at each time."""
        bare = clock.select(*(c for c in clock.columns if c not in self.columns), *(F.lit(None).cast("double").alias(c) for c in self.columns))
        return interpolate(bare, samples, self.columns, self.keys)

    def _bins(self, model: dict, counted: DataFrame, events: DataFrame, clock: DataFrame, n: int) -> DataFrame:
        if not self.marks:
            return kde.poisson_loglik(counted, model["fields"], n, clock, self.unit)
        when = binning.bin_events(events, clock, self.keys)
        if self.algorithm == "gmm":
            ll = gmm.marked_intensity(events, model["joint"], model["rate_values"], model["occupancy_mixture"], model["points"], self.marks, self.unit)
            ground = events.sparkSession.createDataFrame([(k, float(g)) for k, g in enumerate(model["ground_values"])], "bin int, intensity double")
            return kde.marked_loglik(ll, when, ground, clock, n)
        ll = kde.mark_intensity(events, model["placed"], model["rates"], model["occupancy"], model["points"], self.marks, self.columns, self.mark_std, self.position_std, self.unit)
        return kde.marked_loglik(ll, when, model["ground"].withColumn("bin", F.col("bin").cast("int")), clock, n)

    def _local(self, model: dict, counted: DataFrame, events: DataFrame, clock: DataFrame, at: DataFrame, samples: DataFrame) -> DataFrame:
        if self.algorithm not in ("kde", "log_kde"):
            raise ConfigurationError("local states without bins have a kernel density likelihood only", "kde", self.algorithm, hint="give local_std: the local state then has the bins of this algorithm")
        if not self.marks:
            return kde.local_loglik(counted, model["placed"], model["visited"], at, self.columns, self.position_std, self.unit, self.units)
        decode = interpolate(binning.bin_events(events, clock, self.keys).select("*", *(F.lit(None).cast("double").alias(c) for c in self.columns)), samples, self.columns, self.keys)
        return kde.marked_local_loglik(decode, model["placed"], model["visited"], model["rates"], at, self.marks, self.columns, self.mark_std, self.position_std, self.unit)

    # --- decoding ---

    def _inner(self, by_time: bool = False) -> tuple[np.ndarray, np.ndarray | hmm.Blocks]:
        """Start and transitions of the interior state bins; of many, or where they change in time, as blocks."""
        inside = np.flatnonzero(self.space.inside)
        if by_time or len(inside) > hmm.SCAN_STATES:
            return self.initial[inside], hmm.Blocks(self.continuous[np.ix_(inside, inside)], self.space.states[inside], self.transition)
        joint = self.space.joint(self.continuous, self.transition)
        return self.initial[inside], joint[np.ix_(inside, inside)]

    def predict(self, events: DataFrame, clock: DataFrame, samples: DataFrame | None = None, missing: DataFrame | None = None, outputs: str | None = None, covariates: DataFrame | None = None, ll: DataFrame | None = None) -> DataFrame:
        """(keys, t_idx, t, state_bin, state, name, environment, bin, acausal[, causal, predictive, log_likelihood]); covariates: (keys, t_idx, x array)."""
        if outputs is not None and outputs not in OUTPUTS:
            raise ValidationError("unknown outputs", OUTPUTS, outputs)
        clock, missing, covariates, ll = self._coded(clock, missing, covariates, ll)
        ll = ll if ll is not None else self._likelihood(events, clock, samples, self._missing(clock, samples, missing))
        return self._rows(self._decoded(ll, covariates)[0], ll, clock, outputs)

    def _missing(self, clock: DataFrame, samples: DataFrame | None, missing: DataFrame | None) -> DataFrame | None:
        """Without word on it, times without a position are missing."""
        if missing is None and samples is not None:
            return likelihood.missing_rows(self._positions(clock, samples), self.columns)
        return missing

    def _decoded(self, ll: DataFrame, covariates: DataFrame | None) -> tuple[DataFrame, list[str]]:
        """The recursion of each session; and the column that tells sessions."""
        pi, joint = self._inner(covariates is not None)
        if covariates is not None:
            ll = self._covariate(ll, covariates)
        rows, sid = self._sessions(ll)
        return hmm.decode(rows, pi, joint, sid, "trans" if covariates is not None else None), sid

    def _covariate(self, ll: DataFrame, covariates: DataFrame) -> DataFrame:
        """Adds each time's transition matrix of the discrete states; covariates: (t_idx, x array)."""
        coef = self.coefficients if self.coefficients is not None else self.discrete.coefficients(len(covariates.select("x").first()["x"]))
        return ll.join(predict_transitions(covariates.select("t_idx", "x"), coef).select("t_idx", "trans"), "t_idx")

    def _rows(self, decoded: DataFrame, ll: DataFrame, clock: DataFrame, outputs: str | None) -> DataFrame:
        spark = decoded.sparkSession
        inside = self.space.table(spark).where("is_interior").drop("is_interior")
        order = {int(b): k for k, b in enumerate(np.flatnonzero(self.space.inside))}
        inside = inside.withColumn("k", F.element_at(F.create_map(*(x for b, k in order.items() for x in (F.lit(b), F.lit(k)))), F.col("state_bin")))
        wanted = {"acausal": "smoothed"}
        if outputs in ("filter", "all"):
            wanted["causal"] = "filtered"
        if outputs in ("predictive", "predictive_posterior", "all"):
            wanted["predictive"] = "predicted"
        if outputs in ("log_likelihood", "all"):
            decoded = decoded.join(ll.select("t_idx", "ll"), "t_idx")
            wanted["log_likelihood"] = "ll"
        zipped = F.arrays_zip(*(F.col(c).alias(n) for n, c in wanted.items()))
        rows = decoded.select("t_idx", F.posexplode(zipped).alias("k", "v")).select("t_idx", "k", *(F.col(f"v.{n}").alias(n) for n in wanted))
        return self._plain(rows.join(F.broadcast(inside), "k").drop("k"), clock, "t")

    def most_likely_sequence(self, events: DataFrame, clock: DataFrame, samples: DataFrame | None = None, missing: DataFrame | None = None, covariates: DataFrame | None = None) -> DataFrame:
        """(keys, t_idx, state, name, environment, bin) of the best path."""
        clock, missing, covariates = self._coded(clock, missing, covariates)
        ll = self._likelihood(events, clock, samples, missing)
        pi, joint = self._inner(covariates is not None)
        if covariates is not None:
            ll = self._covariate(ll, covariates)
        rows, sid = self._sessions(ll)
        path = hmm.viterbi(rows, pi, joint, sid, "trans" if covariates is not None else None)
        inside = [int(b) for b in np.flatnonzero(self.space.inside)]
        table = self.space.table(path.sparkSession).withColumnRenamed("state", "state_id")
        at = F.element_at(F.array(*map(F.lit, inside)), (F.col("state") + 1).cast("int"))
        named = path.select("t_idx", at.alias("state_bin")).join(F.broadcast(table), "state_bin").select("t_idx", "state_bin", F.col("state_id").alias("state"), "name", "environment", "bin")
        return self._plain(named, clock)

    def estimate_parameters(self, samples: DataFrame, events: DataFrame, clock: DataFrame, iterations: int = 20, tolerance: float = 1e-4, update_transitions: bool = True, update_start: bool = True, update_encoding: bool = False, damping: float = 1.0, covariates: DataFrame | None = None, **how) -> dict:
        """Fit, then alternate decoding and updates of transitions, start and (from the local state's share) encoding.

        With covariates, (keys, t_idx, x array), the coefficients of the transitions are updated instead of one matrix.
        """
        self.fit(samples, events, **how)
        if covariates is not None and not isinstance(self.discrete, NonStationary):
            raise ConfigurationError("covariates drive transitions that follow them only", "NonStationary", type(self.discrete).__name__)
        clock, covariates = self._coded(clock, covariates)
        clock = stored(clock)
        inside = np.flatnonzero(self.space.inside)
        owner = self.space.states[inside].tolist()
        if covariates is not None:
            covariates = stored(covariates.select("t_idx", "x"))
            if self.coefficients is None:
                self.coefficients = self.discrete.coefficients(len(covariates.select("x").first()["x"]))
        trace, posterior, ll, done = [], None, None, False
        for k in range(iterations):
            if ll is None or update_encoding and not self.marks:
                forget(ll)
                ll = stored(self._likelihood(events, clock, samples, None))
            forget(posterior)
            decoded, sid = self._decoded(ll, covariates)
            posterior = stored(decoded)
            trace.append(posterior.agg(F.sum("log_norm")).first()[0])
            states = stored(self._by_state(posterior, sid, owner))
            if update_encoding and not self.marks and "Local" in self.names:
                self._reweigh(states, clock, damping)
            if update_transitions and covariates is not None:
                by_time = states.join(predict_transitions(covariates, self.coefficients), "t_idx")
                responses = stored(em.transition_responses(by_time, "trans", sid).join(covariates, "t_idx").select("x", "xi"))
                flat = self.concentration == 1.0 and not np.any(self.stickiness)
                self.coefficients = em.update_covariate_transitions(responses, self.coefficients, alpha=None if flat else em.dirichlet(self.concentration, self.stickiness, len(self.names)))
                forget(responses)
            elif update_transitions:
                expected = em.matrix_of(em.expected_transitions(states, self.transition, sid), len(self.names))
                self.transition = em.update_transitions(expected, self.concentration, self.stickiness, self.weight, self.frozen, self.transition)
            if update_start:
                self.initial[inside] = em.update_initial(posterior, sid)
            forget(states)
            if k and (done := hmm.converged(trace[-1], trace[-2], tolerance)[0]):
                break
        return {"posterior": self._rows(posterior, ll, clock, None), "log_likelihoods": trace, "converged": done}

    def _by_state(self, posterior: DataFrame, sid: list[str], owner: list[int]) -> DataFrame:
        """Posterior with arrays over discrete states."""
        ends = np.searchsorted(owner, np.arange(len(self.names) + 1)).tolist()

        def summed(c: str):
            return F.array(*(F.aggregate(F.slice(c, a + 1, b - a), F.lit(0.0), lambda acc, x: acc + x) for a, b in zip(ends[:-1], ends[1:], strict=True))).alias(c)

        return posterior.select(*sid, "t_idx", *map(summed, ("filtered", "predicted", "smoothed")))

    def _reweigh(self, states: DataFrame, clock: DataFrame, damping: float) -> None:
        """Refit the fields with the samples weighted by the probability of the local state."""
        at = list(self.names).index("Local") + 1
        local = states.select("t_idx", F.element_at("smoothed", at).alias("w")).join(clock.select("t_idx", "t", *self.keys), "t_idx").select(*self.keys, "t", "w")
        samples = stored(interpolate(self.samples.withColumn("w", F.lit(None).cast("double")), local, ["w"], self.keys, extrapolate=False))
        size = em.effective_size(samples).first()
        if size["mass"] < 1 or size["ess"] < 1:
            return
        old = {k: m["fields"] for k, m in self.encoding.items()}
        keep, self.samples, self.how = self.samples, samples, (*self.how[:3], "w")
        self._encode()
        self.samples = keep.join(samples.select(*self.keys, "t", "w"), [*self.keys, "t"]) if "w" not in keep.columns else samples
        if damping < 1:
            for k, m in self.encoding.items():
                m["fields"] = em.damped(old[k], m["fields"], damping, (self.unit, "bin"))

    # --- saving ---

    def save(self, path: str) -> None:
        """Tables as Parquet, a manifest as JSON; restore() reads them back."""
        from . import saved

        saved.save(self, path)

    @staticmethod
    def restore(spark: SparkSession, path: str) -> "Decoder":
        """A decoder that predicts as the saved one."""
        from . import saved

        return saved.restore(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
        """The tables and the manifest, as they are."""
        return io.load_tables(spark, path)


# --- presets ----------------------------------------------------------------------------------

def single(**options) -> Decoder:
    """One state: a random walk in space."""
    return Decoder(**{"concentration": 1.1 if options.get("marks") else 1.0} | options)


def continuous_fragmented(**options) -> Decoder:
    """Continuous movement or jumps anywhere."""
    return Decoder(**{"names": ("Continuous", "Fragmented"), "observations": (Observation(), Observation()), "blocks": [[RandomWalk(), Uniform()], [Uniform(), Uniform()]], "prior": (0.5, 0.5), "discrete": StationaryDiagonal([0.98, 0.98])} | options)


def multi_environment(**options) -> Decoder:
    """Which of two environments the events speak of."""
    a, b = "env1", "env2"
    return Decoder(**{
        "names": (a, b), "observations": (Observation(a), Observation(b)), "environments": [Environment(a), Environment(b)],
        "blocks": [[RandomWalk(a), Uniform(a, b)], [Uniform(b, a), RandomWalk(b)]], "prior": (1.0, 0.0),
        "discrete": StationaryDiagonal([0.999, 0.98]), "stickiness": np.array([200.0, 30.0]),
    } | options)


def non_local(**options) -> Decoder:
    """Local, no event, non-local continuous and fragmented states; the no-event row is not re-estimated."""
    # The chances of staying and of changing state.
    matrix = [[0.99, 0.005, 0.0025, 0.0025], [0.02 / 3, 0.98, 0.02 / 3, 0.02 / 3], [0.0175, 0.005, 0.96, 0.0175], [0.0175, 0.005, 0.0175, 0.96]]
    lone = [Discrete(), Discrete(), Uniform(), Uniform()]
    return Decoder(**{
        "names": ("Local", "No-Spike", "Non-Local Continuous", "Non-Local Fragmented"),
        "observations": (Observation(local=True), Observation(no_event=True), Observation(), Observation()),
        "blocks": [lone, lone, [Discrete(), Discrete(), RandomWalk(), Uniform()], lone], "prior": (1.0, 0.0, 0.0, 0.0),
        "discrete": StationaryCustom(matrix), "stickiness": np.array([1e5, 1e5, 300.0, 300.0]), "concentration": 1.0, "frozen": (1,),
    } | options)


def no_event_continuous_fragmented(**options) -> Decoder:
    """No event, continuous, fragmented."""
    return Decoder(**{
        "names": ("No-Spike", "Continuous", "Fragmented"), "observations": (Observation(no_event=True), Observation(), Observation()),
        "blocks": [[Discrete(), Uniform(), Uniform()], [Discrete(), RandomWalk(), Uniform()], [Discrete(), Uniform(), Uniform()]],
        "prior": (1 / 3, 1 / 3, 1 / 3), "discrete": StationaryDiagonal([0.9, 0.98, 0.98]),
    } | options)
