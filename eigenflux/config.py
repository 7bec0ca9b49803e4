"""Declarative runs: JSON with comments, closed sets of keys, suites of cases and runs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from eigenflux import registry, sources
from eigenflux.dataset import Dataset

DATA_KEYS = {"kind", "path", "name", "params", "schema"}
CASE_KEYS = {
    "name", "case_type", "description", "data", "spatial_weight_type", "weights", "n_modes_save", "rank", "nfft", "overlap", "embedding_dim", "energy_fraction",
    "max_snapshots", "generate_plots",
}
RUN_KEYS = {"id", "method", "params", "enabled", "description"}
SUITE_KEYS = {"kind", "name", "description", "case", "runs", "configs"}


def strip_comments(text: str) -> str:
    """JSON without ``//`` and ``/* */`` comments; strings are left alone."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            quoted = c != '"'
        elif c == '"':
            out.append(c)
            quoted = True
            i += 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise ValueError("a comment is not closed")
            i = end + 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _closed(what: str, given: dict, known: set[str]) -> None:
    unknown = sorted(set(given) - known)
    if unknown:
        raise ValueError(f"{what} has unknown keys {unknown}; known: {sorted(known)}")


@dataclass(frozen=True)
class Case:
    """A field with the settings its runs share."""

    name: str
    data: dict[str, Any]
    settings: dict[str, Any] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> Dataset:
        d = self.data
        if d["kind"] == "generator":
            out = sources.generate(spark, d["name"], d.get("params"))
        else:
            out = sources.load(spark, os.path.expandvars(os.path.expanduser(d["path"])), kind=None if d["kind"] == "auto" else d["kind"], **(d.get("params") or {}))
        return out.first(self.settings.get("max_snapshots")).with_metric(self.settings.get("spatial_weight_type"), self.settings.get("weights"))


@dataclass(frozen=True)
class Run:
    """A method with its parameters."""

    id: str
    method: str
    params: dict[str, Any]


def case_of(spec: dict[str, Any]) -> Case:
    _closed("case", spec, CASE_KEYS)
    data = spec.get("data") or {}
    _closed("data", data, DATA_KEYS)
    if "kind" not in data or ("name" if data["kind"] == "generator" else "path") not in data:
        raise ValueError("data needs a kind and a name (generator) or a path")
    return Case(spec.get("name", "case"), data, {k: v for k, v in spec.items() if k not in ("name", "data", "description")})


def runs_of(specs: list[dict[str, Any]], case: Case) -> list[Run]:
    """Enabled runs with the case's settings where they give none of their own."""
    out = []
    for spec in specs:
        _closed("run", spec, RUN_KEYS)
        if spec.get("enabled", True) is False:
            continue
        m, params = registry.method(spec["method"]), dict(spec.get("params") or {})
        names = {"band_edges": "edges", "band_scale": "scale", "n_modes_save": "n_modes"}
        params = {names.get(k, k): v for k, v in params.items()}
        for key, name in (("n_modes_save", "n_modes"), ("rank", "rank"), ("nfft", "nfft"), ("overlap", "overlap"), ("embedding_dim", "delays"), ("energy_fraction", "energy_fraction")):
            if key in case.settings and name in m.params and name not in params and not (m.id == "dmd" and name == "delays") and not (m.kind == "evolution" and name == "n_modes"):
                params[name] = case.settings[key]
        out.append(Run(spec.get("id", m.id), m.id, params))
    return out


def read(path: str, seen: tuple[str, ...] = ()) -> list[tuple[Case, list[Run]]]:
    """Cases and runs of a suite file, and of the suites that it names; a cycle raises."""
    path = os.path.abspath(os.path.expanduser(path))
    if path in seen:
        raise ValueError(f"suites name each other in a circle: {[*seen, path]}")
    with open(path) as f:
        spec = json.loads(strip_comments(f.read()))
    _closed("suite", spec, SUITE_KEYS)
    out = []
    if "case" in spec:
        case = case_of(spec["case"])
        out.append((case, runs_of(spec.get("runs") or [], case)))
    for other in spec.get("configs") or []:
        out += read(os.path.join(os.path.dirname(path), other), (*seen, path))
    return out


def execute(spark: SparkSession, path: str, folder: str | None = None, *, dry: bool = False) -> DataFrame:
    """Run a suite; ``case, run, method, executed, saved, note`` of every run. One run's failure leaves the others."""
    rows = []
    for case, runs in read(path):
        data = None if dry else case.load(spark)
        if data is not None:
            data.long.persist()
        for r in runs:
            saved, note = None, "dry run" if dry else ""
            if not dry:
                try:
                    out = registry.run(r.method, data, **r.params)
                    if folder:
                        saved = out.save(f"{folder}/{case.name}/{r.id}")
                    else:
                        note = f"{out.eig.count()} rows"
                except (ValueError, RuntimeError) as e:
                    note = f"failed: {e}"
            rows.append((case.name, r.id, r.method, not dry and not note.startswith("failed"), saved, note))
        if data is not None:
            data.long.unpersist()
    return spark.createDataFrame(rows, "case string, run string, method string, executed boolean, saved string, note string")
