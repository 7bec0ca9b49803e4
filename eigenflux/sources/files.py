"""Array files: NPZ blocks that follow each other in time, MAT files (where h5py is installed), long Parquet tables."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eigenflux.dataset import Dataset, from_array, mesh, plain_grid, positive

FIELDS = ("p", "u", "v", "data", "field", "q")
_LOADERS: dict[str, Callable[..., Dataset]] = {}


def register_loader(name: str, loader: Callable[..., Dataset]) -> None:
    """Make ``load(spark, path, kind=name)`` call ``loader(spark, path, **options)``."""
    _LOADERS[name] = loader


def natural(path: str) -> list:
    """Sort key that reads runs of digits as numbers."""
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", path)]


def step_of(times: np.ndarray) -> float | None:
    """Mean of the non-zero absolute differences; ``None`` without any."""
    gaps = np.abs(np.diff(np.asarray(times, np.float64).reshape(-1)))
    gaps = gaps[gaps != 0]
    return float(gaps.mean()) if len(gaps) else None


def axis_of(values: np.ndarray, axis: int) -> np.ndarray:
    """A coordinate axis out of a vector or a mesh."""
    a = np.asarray(values, np.float64)
    return a.reshape(-1) if a.ndim <= 1 else np.take(np.moveaxis(a, axis, 0).reshape(a.shape[axis], -1), 0, axis=1)


def fit_axis(values: np.ndarray, n: int, name: str) -> np.ndarray:
    """An axis of ``n`` points: longer ones lose their end, shorter ones raise."""
    if len(values) < n:
        raise ValueError(f"axis {name} has {len(values)} points for {n}")
    return values[:n]


def time_axis(shape: tuple[int, int], n_coordinates: int) -> int:
    """Which axis of a matrix is time: the one whose other axis has as many entries as there are places, else the longer."""
    if n_coordinates > 1:
        if shape[1] == n_coordinates:
            return 0
        if shape[0] == n_coordinates:
            return 1
    return int(np.argmax(shape))


def load_npz(spark: SparkSession, path: str, *, field: str | None = None, times_key: str = "times", single: bool = False, reverse: str = "", first: int | None = None) -> Dataset:
    """Consolidated blocks: ``x``, ``y`` (``z``), ``times`` and a field ``(Nt, Nx, Ny[, Nz])`` a file, in natural order of names.

    ``path`` is a file, a glob or a folder; unless ``single``, a file stands for itself alone too. Values are read on executors.
    """
    pattern = path if single or path.endswith(".npz") or "*" in path else f"{path.rstrip('/')}/*.npz"
    try:
        raw = spark.read.format("binaryFile").load(pattern).select("path", "content")
    except AnalysisException as e:
        raise FileNotFoundError(f"no array file at {path}") from e

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if times_key not in z:
                        raise KeyError(f"{name} lacks {times_key!r}")
                    chosen = field or next((f for f in FIELDS if f in z), None)
                    if chosen is None or chosen not in z:
                        raise KeyError(f"{name} lacks field {field or FIELDS}; has {sorted(z.files)}")
                    axes = [axis_of(z[c], k).tolist() if c in z else [0.0] for k, c in enumerate("xyz")]
                    out.append((name, chosen, list(z[chosen].shape), np.asarray(z[times_key], np.float64).reshape(-1).tolist(), *axes))
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 4)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["path", "field", "shape", "times", "x", "y", "z"])

    kind = "path string, field string, shape array<long>, times array<double>, x array<double>, y array<double>, z array<double>"
    heads = sorted(raw.mapInArrow(head, kind).collect(), key=lambda r: natural(r["path"]))
    if not heads:
        raise FileNotFoundError(f"no array file at {path}")
    shape = tuple(heads[0]["shape"][1:])
    if len(shape) not in (2, 3):
        raise ValueError(f"field must have 3 or 4 axes, got {len(shape) + 1}")
    shape3 = (*shape, 1)[:3]
    start, begin = {}, 0
    for r in heads:
        start[r["path"]] = begin
        begin += r["shape"][0]
    dt = step_of(np.concatenate([np.array(r["times"]) for r in heads]))
    if dt is None:
        raise ValueError(f"times of {path} give no step")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    q = np.asarray(z[heads[0]["field"]], np.float64)
                for k, c in enumerate("xyz"):
                    if c in reverse:
                        q = np.flip(q, k + 1)
                q = q.reshape(len(q), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(start[name] + np.repeat(np.arange(len(q)), q.shape[1])), pa.array(np.tile(np.arange(q.shape[1]), len(q))), pa.array(np.ascontiguousarray(q).reshape(-1))],
                    names=["t", "s", "q"],
                )

    long = raw.mapInArrow(values, "t long, s long, q double")
    axes = [fit_axis(np.array(heads[0][c]), n, c) for c, n in zip("xyz", shape3)]
    axes = [a[::-1] if c in reverse else a for c, a in zip("xyz", axes)]
    return Dataset(long, mesh(spark, *axes), dt, begin, int(np.prod(shape)), shape3, {"name": os.path.basename(path)}).first(first)


def load_mat(spark: SparkSession, path: str, *, field: str | None = None, first: int | None = None, precision: str = "float64") -> Dataset:
    """HDF5-based MAT files; needs h5py, which is optional."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading MAT files needs h5py") from e
    with h5py.File(path, "r") as f:
        name = field or next((n for n in FIELDS if n in f), None)
        if name is None:
            raise KeyError(f"{path} lacks a field among {FIELDS}")
        q = np.asarray(f[name]).astype(precision).astype(np.float64)
        axes = {c: np.asarray(f[c], np.float64).reshape(-1) for c in "xyzr" if c in f}
        dt = positive("dt", np.asarray(f["dt"]).reshape(-1)[0], path) if "dt" in f else None
    places = int(np.prod([len(a) for a in axes.values()])) if axes else 0
    q = q if time_axis(q.shape, places) == 0 else q.T
    if dt is None:
        raise ValueError(f"{path} holds no dt")
    return from_array(spark, q, dt, x=axes.get("x"), y=axes.get("y", axes.get("r")), z=axes.get("z"), meta={"name": os.path.basename(path)}).first(first)


def load_parquet(spark: SparkSession, path: str, *, dt: float, first: int | None = None) -> Dataset:
    """A long table ``t, s, q``; a limit on time is pushed into the scan."""
    long = spark.read.schema("t long, s long, q double").parquet(path)
    size = long.agg(F.max("t").alias("t"), F.max("s").alias("s")).first()
    return Dataset(long, plain_grid(spark, size["s"] + 1), positive("dt", dt, path), size["t"] + 1, size["s"] + 1, (size["s"] + 1, 1, 1), {"name": os.path.basename(path)}).first(first)


def fields(path: str) -> list[str]:
    """Field names of one local array file."""
    with np.load(path, allow_pickle=False) as z:
        return [n for n in z.files if n not in ("x", "y", "z", "times")]


def load(spark: SparkSession, path: str, *, kind: str | None = None, **options: Any) -> Dataset:
    """A field by registered loader or by the ending of its path."""
    if kind in _LOADERS:
        return _LOADERS[kind](spark, path, **options)
    kind = kind or next((k for k in ("npz", "mat", "parquet") if path.rstrip("/").endswith(f".{k}")), "npz")
    if kind not in ("npz", "mat", "parquet"):
        raise ValueError(f"unknown kind {kind!r}; known: {sorted([*_LOADERS, 'npz', 'mat', 'parquet'])}")
    return {"npz": load_npz, "mat": load_mat, "parquet": load_parquet}[kind](spark, path, **options)


def nearest(axis: np.ndarray, value: float) -> int:
    """Index of the nearest point, the first of equals."""
    return int(np.argmin(np.abs(np.asarray(axis) - value)))
