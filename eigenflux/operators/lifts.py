"""Lifts of a field: shifted pairs, delays, bands, Welch blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eigenflux.functions import numeric
from eigenflux.operators import tall


def pairs(long: DataFrame) -> DataFrame:
    """``t, s, x1, x2``: each value with its successor in time."""
    by = Window.partitionBy("s").orderBy("t")
    return long.select("t", "s", F.col("q").alias("x1"), F.lead("q").over(by).alias("x2")).where("x2 is not null")


def check_delays(delays: int, n_time: int) -> int:
    if isinstance(delays, bool) or int(delays) != delays or not 1 <= delays < n_time:
        raise ValueError(f"delays must be a whole number from 1 to {n_time - 1}, got {delays!r}")
    return n_time - int(delays) + 1


def delayed(long: DataFrame, delays: int, n_time: int) -> DataFrame:
    """``t, d, s, q``: window ``t`` holds ``q`` of times ``t .. t + delays - 1``; each row goes to its windows."""
    m = check_delays(delays, n_time)
    rows = long.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(delays - 1))))
    return rows.select((F.col("t") - F.col("d")).alias("t"), F.col("d").cast("long").alias("d"), "s", "q").where((F.col("t") >= 0) & (F.col("t") < m))


def delayed_series(series: DataFrame, delays: int, n_time: int) -> DataFrame:
    """``d, s, w, v`` with the slices of each series; no shuffle."""
    m = check_delays(delays, n_time)
    rows = series.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(delays - 1))))
    return rows.select("d", "s", "w", F.slice("v", F.col("d") + 1, m).alias("v"))


def delayed_snapshots(snapshots: DataFrame, delays: int, n_time: int) -> DataFrame:
    """``t, v`` with the arrays of ``delays`` times put together, delay-major."""
    m = check_delays(delays, n_time)
    rows = snapshots.select(F.explode(F.sequence(F.lit(0), F.lit(delays - 1))).alias("d"), "t", "v").withColumn("t", F.col("t") - F.col("d"))
    rows = rows.where((F.col("t") >= 0) & (F.col("t") < m)).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("p"))
    return rows.select("t", F.flatten(F.transform("p", lambda x: x["v"])).alias("v"))


def band_edges(edges: list[float], scale: str, dt: float) -> list[tuple[float, float]]:
    """Bands in Hz between edges given in Hz or as parts of the Nyquist frequency."""
    top = 0.5 / dt
    e = np.asarray(edges, np.float64)
    if scale == "normalized_nyquist":
        e = e * top
    elif scale != "hz":
        raise ValueError(f"band scale must be 'hz' or 'normalized_nyquist', got {scale!r}")
    if e.ndim != 1 or len(e) < 2 or not (np.diff(e) > 0).all() or e[0] < 0 or e[-1] > top + 1e-12:
        raise ValueError(f"band edges must ascend from 0 or more to the Nyquist frequency {top}, got {edges!r}")
    return list(zip(e[:-1].tolist(), e[1:].tolist()))


def band_mask(bands: list[tuple[float, float]], which: int, n: int, dt: float) -> np.ndarray:
    """Bins of a real transform in a band: half open, the last closed."""
    f = np.fft.rfftfreq(n, dt)
    low, high = bands[which]
    return (f >= low) & ((f <= high) if which == len(bands) - 1 else (f < high))


def banded(series: DataFrame, mask: np.ndarray, n: int) -> DataFrame:
    """Brick-wall filter of each series; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = tall.matrix(b.column(2))
            y = np.fft.irfft(np.where(mask, np.fft.rfft(x, axis=1), 0), n, axis=1) if len(x) else np.zeros((0, n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tall.lists(y)], names=["s", "w", "v"])

    return series.select("s", "w", "v").mapInArrow(run, "s long, w double, v array<double>")


class Welch:
    """Blocks of a record: floor partition, hop ``nfft - int(overlap * nfft)``."""

    def __init__(self, n_time: int, dt: float, nfft: int = 128, overlap: float = 0.5, window: str = "hamming", norm: str = "power", *, blockwise_mean: bool = False, normvar: bool = False):
        if isinstance(nfft, bool) or int(nfft) != nfft or nfft < 1:
            raise ValueError(f"nfft must be a whole number above 0, got {nfft!r}")
        if not 0 <= overlap < 1:
            raise ValueError(f"overlap must lie in [0, 1), got {overlap!r}")
        self.n_time, self.dt, self.nfft, self.window, self.norm = n_time, dt, int(nfft), window, norm
        self.overlap, self.blockwise_mean, self.normvar = overlap, blockwise_mean, normvar
        shared = int(overlap * nfft)
        self.hop = self.nfft - shared
        self.blocks = (n_time - shared) // self.hop if n_time >= self.nfft else 0
        if self.blocks < 1:
            raise ValueError(f"a record of {n_time} samples holds no block of {nfft}")
        self.weights = numeric.window(window, self.nfft)
        self.factor = numeric.window_factor(self.weights, norm)
        self.freq = np.arange(self.nfft // 2 + 1) / (self.nfft * dt)

    def transform(self, x: np.ndarray) -> np.ndarray:
        """``(rows, frequencies, blocks)`` of series in rows."""
        at = np.arange(self.blocks)[:, None] * self.hop + np.arange(self.nfft)
        y = x[:, at]
        y = y - (y.mean(2, keepdims=True) if self.blockwise_mean else x.mean(1)[:, None, None])
        if self.normvar:
            var = x[:, at].var(2, ddof=1, keepdims=True)
            y = y / np.where(var < 4 * np.finfo(float).eps, 1.0, var)
        q = np.fft.rfft(y * self.weights, axis=2) * (self.factor / self.nfft)
        return q.transpose(0, 2, 1)

    def attrs(self) -> dict:
        return {"nfft": self.nfft, "overlap": self.overlap, "window": self.window, "window_norm": self.norm, "n_blocks": self.blocks, "blockwise_mean": self.blockwise_mean, "normvar": self.normvar}


def fourier(series: DataFrame, welch: Welch) -> DataFrame:
    """``f, s, b, re, im`` of all blocks; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = tall.matrix(b.column(1))
            if not len(x):
                continue
            q = welch.transform(x)
            n, nf, nb = q.shape
            s = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.repeat(np.arange(nf), nb), n)), pa.array(np.repeat(s, nf * nb)), pa.array(np.tile(np.arange(nb), n * nf)),
                    pa.array(q.real.reshape(-1)), pa.array(q.imag.reshape(-1)),
                ],
                names=["f", "s", "b", "re", "im"],
            )

    return series.select("s", "v").mapInArrow(run, "f long, s long, b long, re double, im double")
