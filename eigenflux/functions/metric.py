"""Diagonal spatial metrics."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("uniform", "polar", "prescribed")


def polar(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Trapezoid widths along x times annulus areas along r, x-major; meshes are read as their axes."""
    x, r = np.asarray(x, np.float64), np.asarray(r, np.float64)
    x = x[:, 0] if x.ndim > 1 else x
    r = r[0, :] if r.ndim > 1 else r
    edge = np.concatenate(([0.0], (r[1:] + r[:-1]) / 2, r[-1:]))
    area = np.pi * np.diff(edge**2)
    if len(x) == 1:
        width = np.ones(1)
    else:
        middle = np.concatenate((x[:1], (x[1:] + x[:-1]) / 2, x[-1:]))
        width = np.diff(middle)
    return np.outer(width, area).reshape(-1)


def diagonal(values: Any, n_space: int) -> np.ndarray:
    """Accepted shapes of a metric as a vector: 1-D, column, numerically diagonal square, flat table, stack of squares."""
    w = np.asarray(values)
    if w.ndim == 3:
        if w.shape[0] != w.shape[1]:
            raise ValueError("a stack of metrics needs square planes")
        planes = [w[:, :, i] for i in range(w.shape[2])]
        w = np.stack([_diagonal_of(p) for p in planes], axis=1)
    elif w.ndim == 2 and w.shape[0] == w.shape[1] and w.shape[1] != 1:
        w = _diagonal_of(w)
    w = w.reshape(-1)
    if w.size != n_space:
        raise ValueError(f"metric has {w.size} weights for {n_space} places")
    if np.iscomplexobj(w):
        raise ValueError("a complex metric is no inner product")
    w = w.astype(np.float64)
    if not np.isfinite(w).all() or (w < 0).any() or w.sum() <= 0:
        raise ValueError("metric weights must be finite, not negative and not all zero")
    return w


def _diagonal_of(plane: np.ndarray) -> np.ndarray:
    n = len(plane)
    d = np.diag(plane)
    off = np.abs(plane - np.diag(d)).astype(np.float64)
    scale = np.sqrt(np.outer(np.abs(d), np.abs(d)).astype(np.float64))
    eps = np.finfo(plane.dtype).eps if plane.dtype.kind in "fc" else np.finfo(np.float64).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(off == 0, 0.0, off / scale)
    if not (ratio <= 2 * n * eps).all():
        raise ValueError(f"metric of shape {plane.shape} couples places (largest {off.max()}); pass its diagonal if that is meant")
    return d


def apply(grid: DataFrame, n_space: int, kind: str | None, values: Any = None) -> DataFrame:
    """``grid`` with the weights of a kind in column ``w``."""
    kind = "uniform" if kind is None else kind
    if kind not in KINDS:
        raise ValueError(f"metric must be one of {KINDS}, got {kind!r}")
    if values is not None and kind != "prescribed":
        raise ValueError(f"a {kind} metric takes no values")
    if kind == "uniform":
        return grid.withColumn("w", F.lit(1.0))
    if kind == "prescribed":
        if values is None:
            raise ValueError("a prescribed metric needs values")
        w = diagonal(values, n_space)
    else:
        x = [r["x"] for r in grid.groupBy("ix").agg(F.min("x").alias("x")).orderBy("ix").collect()]
        y = [r["y"] for r in grid.groupBy("iy").agg(F.min("y").alias("y")).orderBy("iy").collect()]
        w = diagonal(polar(np.array(x), np.array(y)), n_space)
    spark = grid.sparkSession
    column = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "s long, w double")
    return grid.drop("w").join(column, "s")
