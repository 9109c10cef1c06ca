"""Saving a fitted decoder and reading it back: a manifest of parameters, and tables that are read lazily.

Tables (Parquet): the transitions between state bins (``continuous``), the units, and for each encoding model its
parts, named ``<part>_<number>``: rates by bin (``fields``), placed events and visited samples where the likelihood needs
them, mean rates, ground intensities, and a row a component of the Gaussian mixtures.  The manifest (JSON) has
the decoder's options, environments with their grid, interior and track, transition rules, the transitions of the discrete
states with coefficients where they follow covariates, and the start.
"""

from __future__ import annotations

import dataclasses
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import DataError
from ..operators import transitions
from ..operators.geometry import Environment, Track
from ..operators.gmm import Mixture
from ..sources import io
from . import models

VERSION = 2
#: Options that are stored as they are.
_OPTIONS = ("marks", "algorithm", "position_std", "mark_std", "no_event_rate", "local_std", "penalty", "penalty_std", "occupancy", "rate", "concentration", "stickiness", "weight", "frozen", "prior")
_MIXTURES = "part string, unit string, component int, kind string, weight double, mean array<double>, covariance array<double>"


def _plain(x: Any) -> Any:
    """Numbers, lists and strings of arrays and tuples, for JSON."""
    if isinstance(x, np.ndarray):
        return x.tolist()
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def _rule(rule) -> dict:
    return {"type": type(rule).__name__, "fields": {f.name: _plain(getattr(rule, f.name)) for f in dataclasses.fields(rule)}}


def _made(record: dict):
    return getattr(transitions, record["type"])(**record["fields"])


def _environment(e: Environment) -> dict:
    track = None if e.track is None else {"nodes": [[k, list(map(float, v))] for k, v in e.track.nodes.items()], "edges": _plain(e.track.edges), "order": _plain(e.track.order), "spacing": _plain(e.track.spacing)}
    return {
        "name": e.name, "bin_size": _plain(e.bin_size), "track": track, "ranges": _plain(e.ranges), "infer_interior": e.infer_interior, "fill": e.fill, "inflate": e.inflate, "threshold": e.threshold,
        "columns": list(e.columns), "edges": _plain(e.edges), "interior": _plain(e.interior),
    }


def environment_from(record: dict) -> Environment:
    t = record["track"]
    track = None if t is None else Track({k: tuple(v) for k, v in t["nodes"]}, [tuple(x) for x in t["edges"]], [tuple(x) for x in t["order"]], t["spacing"])
    ranges = None if record["ranges"] is None else [tuple(r) for r in record["ranges"]]
    out = Environment(record["name"], record["bin_size"], track, ranges, record["infer_interior"], record["fill"], record["inflate"], record["threshold"])
    out.edges, out.interior, out.columns = [np.array(e) for e in record["edges"]], np.array(record["interior"], bool), tuple(record["columns"])
    return out


def save_environment(e: Environment, path: str, spark: SparkSession) -> None:
    """Grid, interior and track, with the table of bins."""
    io.save_tables(path, {"bins": e.bins(spark)}, {"version": VERSION, "environment": _environment(e)}, spark)


def load_environment(spark: SparkSession, path: str) -> Environment:
    return environment_from(io.load_tables(spark, path)[1]["environment"])


def _mixture_rows(part: str, unit, model: Mixture) -> list[tuple]:
    tied = model.kind == "tied"
    return [(part, None if unit is None else str(unit), k, model.kind, float(w), [float(x) for x in model.means[k]], [float(x) for x in np.ravel(model.covariances if tied else model.covariances[k])]) for k, w in enumerate(model.weights)]


def _mixture(rows: list) -> Mixture:
    rows = sorted(rows, key=lambda r: r["component"])
    kind, d = rows[0]["kind"], len(rows[0]["mean"])
    cov = [np.array(r["covariance"]) for r in rows]
    shaped = {"full": lambda: np.array([c.reshape(d, d) for c in cov]), "tied": lambda: cov[0].reshape(d, d), "diag": lambda: np.array(cov), "spherical": lambda: np.array([c[0] for c in cov])}[kind]()
    return Mixture(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]), shaped, kind)


def save(model: "models.Decoder", path: str) -> None:
    """Write a fitted decoder; what is there is replaced."""
    spark = model.samples.sparkSession
    tables: dict[str, DataFrame] = {
        "states": model.space.table(spark), "units": model.units,
        "continuous": spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(model.continuous)], "i int, p array<double>"),
    }
    for k, e in enumerate(model.environments):
        tables[f"bins_{k}"] = e.bins(spark)
    placeless = any(o.local for o in model.observations) and not model.space.local_bins
    parts, unit_type = [], model.units.schema[model.unit].dataType.simpleString()
    for k, (key, m) in enumerate(model.encoding.items()):
        wanted = [n for n in ("fields", "rates", "ground") if n in m]
        if placeless or model.marks and model.algorithm != "gmm":
            wanted += ["placed"]
        if placeless:
            wanted += ["visited"]
        tables |= {f"{n}_{k}": m[n] for n in wanted}
        record = {"key": list(key), "tables": wanted, "points": _plain(m["points"])}
        if "occupancy" in m:
            record["occupancy"] = _plain(m["occupancy"])
        if "joint" in m:
            rows = [r for u, g in m["joint"].items() for r in _mixture_rows("joint", u, g)] + _mixture_rows("occupancy", None, m["occupancy_mixture"])
            tables[f"mixtures_{k}"] = spark.createDataFrame(rows, _MIXTURES).withColumn("unit", F.col("unit").cast(unit_type))
            record |= {"ground_values": _plain(m["ground_values"]), "tables": [*wanted, "mixtures"]}
        parts.append(record)
    params = {
        "version": VERSION, "names": list(model.names), "columns": model.columns, "unit": model.unit, "keys": model.keys, "how": list(model.how), "options": {n: _plain(getattr(model, n)) for n in _OPTIONS},
        "observations": [dataclasses.asdict(o) for o in model.observations], "environments": [_environment(e) for e in model.environments],
        "blocks": [[_rule(b) for b in row] for row in model.blocks], "discrete": _rule(model.discrete), "transition": _plain(model.transition),
        "coefficients": _plain(model.coefficients), "initial": _plain(model.initial), "encoding": parts,
        # as in the first version
        "algorithm": model.algorithm, "position_std": model.position_std,
    }
    io.save_tables(path, tables, params, spark)


def restore(spark: SparkSession, path: str) -> "models.Decoder":
    """The decoder that save() wrote, ready to predict; its samples and events are not part of it, so an estimation fits anew."""
    tables, p = io.load_tables(spark, path)
    if p.get("version") != VERSION:
        raise DataError("not a decoder of this version", VERSION, p.get("version"), hint="load() reads the tables of any")
    o = p["options"]
    arrays = {n: np.array(o[n]) if isinstance(o[n], list) else o[n] for n in ("stickiness", "weight")}
    model = models.Decoder(**{
        **o, **arrays, "marks": tuple(o["marks"]), "frozen": tuple(o["frozen"]), "names": p["names"], "observations": [transitions.Observation(**x) for x in p["observations"]],
        "environments": [environment_from(e) for e in p["environments"]], "blocks": [[_made(b) for b in row] for row in p["blocks"]], "discrete": _made(p["discrete"]),
    })
    model.columns, model.unit, model.keys, model.how = p["columns"], p["unit"], p["keys"], tuple(p["how"])
    model.space = transitions.StateSpace(model.names, model.observations, model.environments, model.local_std is not None)
    model.initial, model.transition = np.array(p["initial"]), np.array(p["transition"])
    model.coefficients = None if p["coefficients"] is None else np.array(p["coefficients"])
    rows = tables["continuous"].orderBy("i").collect()  # bins x bins
    model.continuous = np.array([r["p"] for r in rows])
    model.units, model.encoding = tables["units"], {}
    for k, record in enumerate(p["encoding"]):
        m: dict[str, Any] = {n: tables[f"{n}_{k}"] for n in record["tables"] if n != "mixtures"} | {"points": np.array(record["points"])}
        if "occupancy" in record:
            m["occupancy"] = np.array(record["occupancy"])
        if "mixtures" in record["tables"]:
            joint: dict = {}
            for r in tables[f"mixtures_{k}"].collect():  # components only
                joint.setdefault((r["part"], r["unit"]), []).append(r)
            m["occupancy_mixture"] = _mixture(joint.pop(("occupancy", None)))
            m["joint"] = {u: _mixture(r) for (_, u), r in joint.items()}
            m["ground_values"] = np.array(record["ground_values"])
            m["rate_values"] = {r[model.unit]: r["rate"] for r in m["rates"].collect()}  # units only
        model.encoding[tuple(record["key"])] = m
    return model
