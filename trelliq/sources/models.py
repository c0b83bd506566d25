"""Models as records: a table of their parts, or JSON, from which each comes back equal.

A record names its format's version and the model's kind; its parts are named by where they stand (``emissions/0/mean``) and hold arrays with their
shapes, single numbers, texts or other models. Numbers are IEEE doubles in tables and the shortest text that reads back as the same double
in JSON. What a record of an older version lacks, ``UPGRADES`` adds; a field with a default may always be missing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import MISSING, fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.emissions import AutoRegressionEmission, BernoulliRegressionEmission, GaussianEmission, GaussianRegressionEmission, PoissonRegressionEmission
from ..operators.hmm import HiddenMarkovModel
from ..operators.kmeans import KMeansResult
from ..operators.lds import GaussianObservation, GaussianState, IWPrior, LinearDynamicalSystem, PoissonObservation
from ..operators.mixture import GaussianMixture, PoissonMixture
from ..operators.ppca import ProbabilisticPCA
from ..operators.slds import SLDS

VERSION = 2

KINDS = {
    c.__name__: c
    for c in (
        AutoRegressionEmission, BernoulliRegressionEmission, GaussianEmission, GaussianRegressionEmission, PoissonRegressionEmission, HiddenMarkovModel, KMeansResult, GaussianObservation, GaussianState,
        IWPrior, LinearDynamicalSystem, PoissonObservation, GaussianMixture, PoissonMixture, ProbabilisticPCA, SLDS,
    )
}


def register(kind: type) -> type:
    """Make a dataclass of the user's own (an emission, say) known to records, by its name."""
    KINDS[kind.__name__] = kind
    return kind


def _rates_of_version_1(record: dict) -> dict:
    """Version 1 had the rates of Poisson observations as ``d`` and not their logarithm."""

    def changed(node):
        if isinstance(node, list):
            return [changed(v) for v in node]
        if not isinstance(node, dict) or "kind" not in node:
            return node
        parts = {k: changed(v) for k, v in node["fields"].items()}
        if node["kind"] == "PoissonObservation" and "d" in parts:
            d = parts.pop("d")
            parts["log_d"] = d | {"values": [math.log(v) for v in d["values"]]}
        return {"kind": node["kind"], "fields": parts}

    return record | {"version": 2, "model": changed(record["model"])}


#: From a version to the next.
UPGRADES: dict[int, Callable[[dict], dict]] = {1: _rates_of_version_1}


def _encoded(value):
    if is_dataclass(value):
        if KINDS.get(type(value).__name__) is not type(value):
            raise TypeError(f"{type(value).__name__} is not registered")
        return {"kind": type(value).__name__, "fields": {f.name: _encoded(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, np.ndarray):
        return {"shape": list(value.shape), "values": [float(v) for v in value.ravel()]}
    if isinstance(value, tuple | list):
        return [_encoded(v) for v in value]
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, int | np.integer):
        return int(value)
    if isinstance(value, float | np.floating):
        return float(value)
    if value is None or isinstance(value, str):
        return value
    raise TypeError(f"{type(value).__name__} has no place in a record")


def _decoded(value):
    if isinstance(value, list):
        return tuple(_decoded(v) for v in value)
    if not isinstance(value, dict):
        return value
    if "kind" not in value:
        return np.array(value["values"], float).reshape(value["shape"])
    kind = KINDS.get(value["kind"])
    if kind is None:
        raise ValueError(f"unknown kind of model {value['kind']}")
    known = {f.name: f for f in fields(kind)}
    if unknown := set(value["fields"]) - set(known):
        raise ValueError(f"{value['kind']} has no {', '.join(sorted(unknown))}")
    if lacking := [n for n, f in known.items() if n not in value["fields"] and f.default is MISSING and f.default_factory is MISSING]:
        raise ValueError(f"{value['kind']} lacks {', '.join(lacking)}")
    return kind(**{n: _decoded(v) for n, v in value["fields"].items()})


def to_record(model) -> dict:
    return {"version": VERSION, "model": _encoded(model)}


def from_record(record: dict):
    version = record.get("version")
    if not isinstance(version, int) or not 1 <= version <= VERSION:
        raise ValueError(f"records of version {version} are not known")
    while record["version"] < VERSION:
        record = UPGRADES[record["version"]](record)
    return _decoded(record["model"])


def to_json(model) -> str:
    """Numbers that JSON does not have are written as NaN, Infinity and -Infinity."""
    return json.dumps(to_record(model))


def from_json(text: str):
    return from_record(json.loads(text))


# Tables

PARTS = "name string, version int, part string, kind string, shape array<int>, values array<double>, number long, text string"


def _rows(name: str, version: int, part: str, node) -> list[tuple]:
    row = lambda kind, shape=None, values=None, number=None, text=None: (name, version, part, kind, shape, values, number, text)
    at = lambda key: f"{part}/{key}" if part else str(key)
    if isinstance(node, dict) and "kind" in node:
        return [row("model", text=node["kind"]), *[r for k, v in node["fields"].items() for r in _rows(name, version, at(k), v)]]
    if isinstance(node, dict):
        return [row("array", node["shape"], node["values"])]
    if isinstance(node, list):
        return [row("list", number=len(node)), *[r for i, v in enumerate(node) for r in _rows(name, version, at(i), v)]]
    if node is None:
        return [row("none")]
    if isinstance(node, bool):
        return [row("flag", number=int(node))]
    if isinstance(node, int):
        return [row("whole", number=node)]
    return [row("text", text=node)] if isinstance(node, str) else [row("number", values=[node])]


def model_table(spark: SparkSession, models: dict[str, object]) -> DataFrame:
    """A row for each part of each model, by name; see PARTS. Parameters are small, and come from the driver."""
    rows = []
    for name, model in models.items():
        record = to_record(model)
        rows += _rows(name, record["version"], "", record["model"])
    return spark.createDataFrame(rows, PARTS)


def _node(rows: dict[str, object], part: str):
    r = rows[part]
    at = lambda key: f"{part}/{key}" if part else str(key)
    if r.kind == "model":
        head = f"{part}/" if part else ""
        inner = {p[len(head) :] for p in rows if p.startswith(head) and p != part and "/" not in p[len(head) :]}
        return {"kind": r.text, "fields": {k: _node(rows, at(k)) for k in inner}}
    if r.kind == "array":
        return {"shape": list(r.shape), "values": list(r.values)}
    if r.kind == "list":
        return [_node(rows, at(i)) for i in range(r.number)]
    return {"none": lambda: None, "flag": lambda: bool(r.number), "whole": lambda: r.number, "text": lambda: r.text, "number": lambda: r.values[0]}[r.kind]()


def models_of(table: DataFrame, *names: str) -> dict[str, object]:
    """The models of a table from ``model_table``, or those with some names; a part that stands twice is an error."""
    found: dict[str, dict[str, object]] = {}
    for r in (table.filter(table["name"].isin(*names)) if names else table).select(*[c.split()[0] for c in PARTS.split(", ")]).collect():
        if r.part in found.setdefault(r.name, {}):
            raise ValueError(f"{r.name} has {r.part or 'its model'} twice")
        found[r.name][r.part] = r
    if lacking := set(names) - set(found):
        raise ValueError(f"no model named {', '.join(sorted(lacking))}")
    return {name: from_record({"version": rows[""].version, "model": _node(rows, "")}) for name, rows in found.items()}
