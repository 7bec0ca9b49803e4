"""Results of a method: tables, attributes, provenance; saved as Parquet folders."""

from __future__ import annotations

import hashlib
import json
import platform
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that a method's saved result must hold.
REQUIRED = {
    "pod": ("eig", "modes", "coef"), "mpod": ("eig", "modes", "coef"), "psd_pod": ("eig", "modes", "coef"), "spod": ("eig", "modes", "coef"),
    "stpod": ("eig", "modes", "coef"), "dmd": ("eig", "modes", "coef"), "bsmd": ("eig", "modes"),
}
#: Older names of tables.
ALIASES = {"eigenvalues": "eig", "lambda": "eig", "phi": "modes", "time_coefficients": "coef", "a": "coef"}


def plain(value: Any) -> Any:
    """A value as JSON can hold it; unknown kinds become strings."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return value.tolist() if value.size <= 64 else f"array{value.shape}"
    if isinstance(value, np.generic):
        return value.item()
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def provenance(spark: SparkSession, attrs: dict[str, Any]) -> dict[str, Any]:
    """Who made a result, of what."""
    from eigenflux import __version__

    text = json.dumps(plain(attrs), sort_keys=True)
    seed = next((attrs[k] for k in ("data_seed", "seed", "random_seed") if attrs.get(k) is not None), None)
    return {
        "prov_package": "eigenflux", "prov_version": __version__, "prov_spark": spark.version, "prov_numpy": np.__version__, "prov_python": platform.python_version(),
        "prov_platform": platform.platform(), "prov_created": datetime.now(UTC).isoformat(), "prov_run": uuid.uuid4().hex, "prov_seed": seed,
        "prov_config_sha256": hashlib.sha256(text.encode()).hexdigest(), "prov_fft": "numpy.fft", "prov_blas_threads": spark.conf.get("spark.executorEnv.OMP_NUM_THREADS", "1"),
    }


@dataclass
class Result:
    """Tables ``eig``, ``modes``, ``coef`` and others of one method, with attributes."""

    method: str
    tables: dict[str, DataFrame]
    attrs: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def save(self, path: str, mode: str = "overwrite") -> str:
        """Write each table to ``path/<name>`` and the attributes with provenance to ``path/attrs``."""
        spark = next(iter(self.tables.values())).sparkSession
        for name, table in self.tables.items():
            table.write.mode(mode).parquet(f"{path}/{name}")
        attrs = plain(self.attrs) | provenance(spark, self.attrs) | {"method": self.method}
        spark.createDataFrame([(k, json.dumps(v)) for k, v in attrs.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/attrs")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Result:
        """Read a saved result; required tables must exist, older table names are accepted."""
        names = _folders(spark, path)
        if "attrs" not in names:
            raise FileNotFoundError(f"{path} holds no saved result")
        attrs = {r["key"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/attrs").collect()}
        tables = {ALIASES.get(n, n): spark.read.parquet(f"{path}/{n}") for n in names if n != "attrs"}
        method = attrs.get("method", "")
        missing = [n for n in REQUIRED.get(method, ()) if n not in tables]
        if missing:
            raise KeyError(f"result of {method} at {path} lacks {missing}")
        return cls(method, tables, attrs)


def _folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def latest(spark: SparkSession, folder: str, contains: str = "") -> str | None:
    """The newest saved result below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().toString()) for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((f for f in found if contains in f[1]), default=(0, None))[1]


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``name, rows, columns`` of each table of a saved result."""
    rows = []
    for n in _folders(spark, path):
        table = spark.read.parquet(f"{path}/{n}")
        rows.append((n, table.count(), ", ".join(f"{c} {t}" for c, t in table.dtypes)))
    return spark.createDataFrame(rows, "name string, rows long, columns string")


def file_name(root: str, method: str, n_time: int, *, nfft: int | None = None, overlap: float | None = None, delays: int | None = None) -> str:
    """Folder name of a result, with what tells runs apart."""
    parts = [root]
    if nfft is not None:
        parts.append(f"Nfft{nfft}_ovlap{overlap}")
    parts.append(f"{n_time}snapshots_{method}")
    return "_".join(parts) + (f"_d{delays}" if delays else "")


def digest(long: DataFrame) -> str:
    """Content of a field, whatever its order: count and sum of hashes."""
    r = long.agg(F.count("*").alias("n"), F.sum(F.xxhash64("t", "s", "q").cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h']}"
