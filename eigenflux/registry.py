"""Methods by id, and analyzers with one interface over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from eigenflux.dataset import Dataset
from eigenflux.operators import lifts, modal
from eigenflux.results import Result, digest, file_name


@dataclass(frozen=True)
class Method:
    """A method's id, title, kind of problem, function and the parameters it takes."""

    id: str
    title: str
    kind: str
    run: Callable[..., Result]
    params: tuple[str, ...]
    defaults: dict[str, Any] = field(default_factory=dict)


_WELCH = ("nfft", "overlap", "window", "norm", "blockwise_mean")
METHODS = {
    m.id: m
    for m in (
        Method("pod", "Proper orthogonal decomposition", "variance", modal.pod, ("n_modes", "solver")),
        Method("mpod", "Multiscale decomposition", "variance", modal.mpod, ("edges", "scale", "n_modes", "kind")),
        Method("psd_pod", "Pooled Fourier decomposition", "variance", modal.psd_pod, (*_WELCH, "n_modes", "compat")),
        Method("spod", "Spectral decomposition", "variance", modal.spod, (*_WELCH, "normvar", "length", "speed", "n_modes", "weights")),
        Method("stpod", "Space-time decomposition", "variance", modal.stpod, ("delays", "n_modes"), {"delays": 10}),
        Method("dmd", "Dynamic modes", "evolution", modal.dmd, ("rank", "method", "delays", "energy_fraction", "n_modes")),
        Method("hodmd", "Higher-order dynamic modes", "evolution", modal.hodmd, ("rank", "delays", "energy_fraction", "n_modes"), {"method": "ls"}),
        Method("tls_hodmd", "Higher-order dynamic modes, total least squares", "evolution", modal.hodmd, ("rank", "delays", "energy_fraction", "n_modes"), {"method": "tls"}),
        Method("bsmd", "Bispectral modes", "triads", modal.bsmd, (*_WELCH, "normvar", "triad_list", "dynamic")),
    )
}


def register(new: Method, *, replace: bool = False) -> Method:
    """Make a method of one's own known to ``run``, run files and the command line."""
    if new.id != new.id.lower().replace("-", "_"):
        raise ValueError(f"id {new.id!r} must be lower case with underscores")
    if new.id in METHODS and not replace:
        raise ValueError(f"method {new.id!r} exists")
    METHODS[new.id] = new
    return new


def method(name: str) -> Method:
    """A method by id; dashes and case do not matter."""
    key = name.lower().replace("-", "_")
    if key not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {sorted(METHODS)}")
    return METHODS[key]


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.id, m.title, m.kind, ", ".join(m.params)) for m in METHODS.values()], "id string, title string, kind string, params string")


def run(name: str, data: Dataset, **params: Any) -> Result:
    """Run a method; parameters that it does not take raise."""
    m = method(name)
    unknown = sorted(set(params) - set(m.params) - set(m.defaults))
    if unknown:
        raise ValueError(f"{m.id} takes no {unknown}; it takes {sorted(m.params)}")
    out = m.run(data, **(m.defaults | params))
    out.attrs["method_id"] = m.id
    return out


class Analyzer:
    """Load, run, save: a field source with a method and its parameters."""

    method_id = ""

    def __init__(self, source: Dataset | Callable[[], Dataset], *, metric: Any = "uniform", weights: Any = None, max_snapshots: int | None = None, **params: Any):
        m = method(self.method_id)
        unknown = sorted(set(params) - set(m.params))
        if unknown:
            raise ValueError(f"{m.id} takes no {unknown}")
        if "rank" in m.params and params.get("rank") is None:
            raise ValueError(f"{m.id} needs a rank: a number, 'svht' or 'energy'")
        self.source, self.metric, self.weights, self.max_snapshots, self.params = source, metric, weights, max_snapshots, params
        self.data: Dataset | None = None
        self.result: Result | None = None

    def load(self) -> Dataset:
        data = self.source if isinstance(self.source, Dataset) else self.source()
        data = data.first(self.max_snapshots).with_metric(self.metric, self.weights)
        data.long.persist()
        self.data = data.check()
        return self.data

    def run(self) -> Result:
        self.result = run(self.method_id, self.data or self.load(), **self.params)
        return self.result

    def save(self, folder: str, root: str = "case") -> str:
        if self.result is None:
            raise RuntimeError("nothing to save; run first")
        a = self.result.attrs
        name = file_name(root, self.method_id, a["n_time"], nfft=a.get("nfft"), overlap=a.get("overlap"), delays=a.get("embedding_dim"))
        return self.result.save(f"{folder}/{name}")

    def release(self) -> None:
        if self.data is not None:
            self.data.long.unpersist()
        self.data = None


def _analyzer(name: str, id_: str) -> type[Analyzer]:
    return type(name, (Analyzer,), {"method_id": id_, "__doc__": f"{METHODS[id_].title} of a field."})


PODAnalyzer, MPODAnalyzer, PSDPODAnalyzer, SPODAnalyzer, STPODAnalyzer, DMDAnalyzer, HODMDAnalyzer, TLSHODMDAnalyzer, BSMDAnalyzer = (
    _analyzer(n, i)
    for n, i in (
        ("PODAnalyzer", "pod"), ("MPODAnalyzer", "mpod"), ("PSDPODAnalyzer", "psd_pod"), ("SPODAnalyzer", "spod"), ("STPODAnalyzer", "stpod"),
        ("DMDAnalyzer", "dmd"), ("HODMDAnalyzer", "hodmd"), ("TLSHODMDAnalyzer", "tls_hodmd"), ("BSMDAnalyzer", "bsmd"),
    )
)


def fourier_cache(data: Dataset, welch: lifts.Welch, folder: str) -> DataFrame:
    """Fourier blocks of a field, written once for each content and setting and read by every method that asks again."""
    import hashlib
    import json

    stamp = hashlib.sha256(json.dumps([digest(data.long), welch.attrs(), data.dt], sort_keys=True).encode()).hexdigest()[:24]
    path, spark = f"{folder.rstrip('/')}/stamp={stamp}", data.spark
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(p):
        lifts.fourier(data.series(), welch).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
