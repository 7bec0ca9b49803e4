"""Synthetic fields as column expressions over ranges of times and places."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenflux.dataset import Dataset, mesh


def _field(spark: SparkSession, x: np.ndarray, y: np.ndarray, t: np.ndarray, value, meta: dict[str, Any]) -> Dataset:
    """A field by an expression of columns ``x``, ``y`` and time ``tt``; the product of ranges is the field itself."""
    grid = mesh(spark, x, y)
    step = float(t[1] - t[0])
    times = spark.range(len(t)).select(F.col("id").alias("t"), (F.lit(float(t[0])) + F.col("id") * F.lit(step)).alias("tt"))
    rows = times.crossJoin(F.broadcast(grid.select("s", "x", "y"))) if len(x) * len(y) <= 1_000_000 else times.crossJoin(grid.select("s", "x", "y"))
    long = rows.select("t", "s", value(F.col("x"), F.col("y"), F.col("tt")).alias("q"))
    return Dataset(long, grid, step, len(t), len(x) * len(y), (len(x), len(y), 1), meta)


def double_gyre(spark: SparkSession, Nx: int = 80, Ny: int = 40, Nt: int = 200, A: float = 0.25, epsilon: float = 0.25, period: float = 10.0, t_max: float = 20.0) -> Dataset:
    """Streamwise velocity of the oscillating double gyre on [0, 2] x [0, 1]."""

    def value(x: Column, y: Column, t: Column) -> Column:
        swing = epsilon * F.sin(2 * np.pi / period * t)
        f = swing * x * x + (1 - 2 * swing) * x
        return -np.pi * A * F.sin(np.pi * f) * F.cos(np.pi * y)

    meta = {"name": "Double Gyre", "period": period, "expected_freq": 1 / period}
    return _field(spark, np.linspace(0, 2, Nx), np.linspace(0, 1, Ny), np.linspace(0, t_max, Nt), value, meta)


def taylor_green(spark: SparkSession, Nx: int = 64, Ny: int = 64, Nt: int = 100, nu: float = 0.01, U0: float = 1.0, L: float = 2 * np.pi) -> Dataset:
    """Decaying vortex: one mode, factor ``exp(-2 nu dt)`` a step."""
    t = np.linspace(0, 3 / (2 * nu), Nt)
    x, y = (np.linspace(0, L, n, endpoint=False) for n in (Nx, Ny))
    meta = {"name": "Taylor-Green Vortex", "decay_rate": 2 * nu, "dmd_eigenvalue": float(np.exp(-2 * nu * (t[1] - t[0])))}
    return _field(spark, x, y, t, lambda x, y, t: -U0 * F.cos(x) * F.sin(y) * F.exp(-2 * nu * t), meta)


def cylinder_wake(spark: SparkSession, Nx: int = 100, Ny: int = 50, Nt: int = 500, Re: float = 100.0, D: float = 1.0, U_inf: float = 1.0, seed: int = 42) -> Dataset:
    """Vortex street with noise of 2 %; the noise is one generator's stream, drawn on the driver a block of times at a time."""
    strouhal = 0.212 * (1 - 21.2 / Re)
    shed = strouhal * U_inf / D
    t = np.linspace(0, 10 / shed, Nt)
    x, y = np.linspace(0, 10, Nx), np.linspace(-2.5, 2.5, Ny)
    turn = 2 * np.pi * shed

    def value(x: Column, y: Column, t: Column) -> Column:
        behind = F.greatest(x - 1.0, F.lit(0.0))
        width, decay = D * (1 + 0.1 * F.sqrt(behind)), F.exp(-0.1 * behind)
        hump = F.exp(-(y * y) / (2 * width * width))
        wave = 0.3 * U_inf * decay * F.sin(turn * t - turn / (0.8 * U_inf) * (x - 1.0)) * hump * (y / width)
        return U_inf * (1 - 0.5 * decay * hump) + wave

    meta = {"name": "Cylinder Wake", "Re": Re, "St": strouhal, "f_shed": shed, "seed": seed}
    clean = _field(spark, x, y, t, value, meta)
    rng = np.random.default_rng(seed)
    noise: DataFrame | None = None
    block = max(1, 500_000 // (Nx * Ny))
    for first in range(0, Nt, block):
        draw = rng.standard_normal((min(block, Nt - first), Nx * Ny)) * 0.02 * U_inf
        part = spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(draw)], "t long, v array<double>")
        noise = part if noise is None else noise.union(part)
    flat = noise.select("t", F.posexplode("v").alias("s", "e"))
    long = clean.long.join(flat.select("t", F.col("s").cast("long").alias("s"), "e"), ["t", "s"]).select("t", "s", (F.col("q") + F.col("e")).alias("q"))
    return Dataset(long, clean.grid, clean.dt, clean.n_time, clean.n_space, clean.shape, meta)


def jet(spark: SparkSession, Nx: int = 30, Nr: int = 12, Nt: int = 200, dt: float = 0.01, seed: int = 0) -> Dataset:
    """Two travelling tones under a Gaussian profile with seeded noise, on an (x, r) grid."""
    x, r = np.linspace(0, 10, Nx), np.linspace(0, 2, Nr)

    def value(x: Column, r: Column, t: Column) -> Column:
        return F.exp(-r * r) * (F.sin(2 * np.pi * 5 * t - x) + 0.5 * F.sin(2 * np.pi * 12 * t - 2 * x))

    out = _field(spark, x, r, np.arange(Nt) * dt, value, {"name": "Jet", "seed": seed})
    noise = F.randn(seed) * 0.01
    return Dataset(out.long.withColumn("q", F.col("q") + noise), out.grid, dt, Nt, Nx * Nr, out.shape, out.meta)


GENERATORS = {"double_gyre": double_gyre, "taylor_green": taylor_green, "cylinder_wake": cylinder_wake, "jet": jet}


def generate(spark: SparkSession, name: str, params: dict[str, Any] | None = None) -> Dataset:
    """A synthetic field by name."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; known: {sorted(GENERATORS)}")
    return GENERATORS[name](spark, **(params or {}))
