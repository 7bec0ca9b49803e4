"""Modal decompositions of fields.

Sums over places or times run on the executors; what reaches the driver is the square of the smaller side (or of the number
of blocks). Each function returns a ``Result`` with ``eig``, ``modes`` and ``coef`` tables.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenflux.dataset import Dataset
from eigenflux.functions import numeric
from eigenflux.operators import lifts, tall
from eigenflux.operators.lifts import Welch
from eigenflux.results import Result


def _eig_table(spark: SparkSession, values: np.ndarray, total: float | None = None, extra: dict[str, np.ndarray] | None = None) -> DataFrame:
    values = np.asarray(values)
    extra = extra or {}
    total = total if total else float(np.abs(values).sum()) or 1.0
    rows = [
        (k, float(np.real(v)), float(np.imag(v)), float(np.real(v)) / total, *[float(a[k]) for a in extra.values()])
        for k, v in enumerate(values)
    ]
    names = "mode long, lambda_re double, lambda_im double, fraction double" + "".join(f", {n} double" for n in extra)
    return spark.createDataFrame(rows, names)


def _small(spark: SparkSession, matrix: np.ndarray, key: str) -> DataFrame:
    """``mode, key, re, im`` of a driver-side matrix with modes in columns."""
    m = np.asarray(matrix)
    both = np.concatenate((m.real, m.imag), 1) if m.shape[1] else np.zeros((len(m), 0))
    wide = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(both)], f"{key} long, m array<double>")
    return tall.exploded(wide, key, m.shape[1], complex_=True)


def _rayleigh(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of a Hermitian kernel, largest first, values as Rayleigh quotients, floored at numerical rank."""
    values, vectors = np.linalg.eigh((k + k.conj().T) / 2)
    vectors = vectors[:, ::-1]
    values = np.einsum("ij,ij->j", vectors.conj(), k @ vectors).real
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    keep = numeric.significant(values, len(k))
    return values[keep], vectors[:, keep]


def _weighted_series(series: DataFrame) -> DataFrame:
    return series.select("s", "w", F.transform("v", lambda q: q * F.sqrt("w")).alias("v"))


def _weighted_snapshots(data: Dataset, long: DataFrame) -> DataFrame:
    grid = data.grid.select("s", "w")
    rows = long.join(F.broadcast(grid) if data.n_space <= 1_000_000 else grid, "s").select("t", "s", (F.col("q") * F.sqrt("w")).alias("q"))
    pairs = F.array_sort(F.collect_list(F.struct("s", "q")))
    return rows.groupBy("t").agg(F.transform(pairs, lambda p: p["q"]).alias("v"))


def _centred_series(data: Dataset) -> DataFrame:
    """Each place's series less its own mean."""
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / data.n_time
    return data.series().withColumn("__mean", mean).select("s", "w", F.transform("v", lambda q: q - F.col("__mean")).alias("v"))


def _centring(data: Dataset) -> Callable[[np.ndarray], np.ndarray]:
    """What takes the means of places from a batch of snapshots and weights it; no place's record is gathered."""
    if data.has_stored:
        mean = data.stored[2]
    else:
        by = data.long.groupBy("s").agg(F.sum("q").alias("q")).orderBy("s").toPandas()
        mean = by["q"].to_numpy(np.float64) / data.n_time
    root = np.sqrt(data.weights())
    return lambda x: (x - mean) * root


def energy(data: Dataset) -> float:
    """Weighted variance ``sum(w q'^2) / n_time``: the sum of all eigenvalues, whatever is kept of them."""
    if data.has_stored:
        return float(data.weights() @ np.diag(data.stored[3])) / max(data.n_time, 1)
    moments = data.long.groupBy("s").agg(F.var_pop("q").alias("v"))
    return float(moments.join(data.grid.select("s", "w"), "s").agg(F.sum(F.col("w") * F.col("v"))).first()[0] or 0.0)


def _leading(rows: DataFrame, k: int, n: int, keep: int, solver: str, of: tall.Each = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``V^T V / n``: of the whole kernel, or of a randomized range where ``solver`` says so."""
    if solver != "randomized":
        return _rayleigh(tall.gram(rows, k, of) / n)
    sigma, vectors = tall.randomized(rows, k, keep, power=8, of=of)
    live = numeric.significant(sigma, k)
    return sigma[live] ** 2 / n, vectors[:, : len(live)][:, live]


def _second_order(series: DataFrame, data: Dataset, keep: int, solver: str = "eigh") -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Eigenvalues, modes by place and coefficients by time of centred series, by the smaller side."""
    spark, n, m = data.spark, data.n_time, data.n_space
    weighted = _weighted_series(series)
    if n < m:
        values, vectors = _leading(weighted, n, n, keep, solver)
        values, vectors = values[:keep], vectors[:, :keep]
        r = len(values)
        wide = tall.times(weighted, vectors / np.sqrt(np.maximum(values * n, np.finfo(float).tiny)), ["s"], scale="w")
        turn = numeric.phases(tall.pivots(wide, "s", r)).real
        modes = tall.exploded(wide, "s", r)
        signs = F.array(*[F.lit(float(x)) for x in turn]) if r else F.array().cast("array<double>")
        modes = modes.select("mode", "s", (F.col("re") * F.element_at(signs, F.col("mode") + 1)).alias("re"), "im")
        coef = _small(spark, vectors * np.sqrt(values * n) * turn, "t")
    else:
        long = series.select("s", F.posexplode("v").alias("t", "q")).select(F.col("t").cast("long").alias("t"), "s", "q")
        return _by_snapshots(_weighted_snapshots(data, long), data, keep, solver)
    return values, modes, coef


def _by_snapshots(rows: DataFrame, data: Dataset, keep: int, solver: str, of: tall.Each = None) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The same of snapshots that are centred and weighted, or come so out of ``of``."""
    w = data.weights()
    if of is not None and data.has_stored and solver == "eigh":  # the source told the kernel
        values, vectors = _rayleigh(data.stored[3] * np.sqrt(np.outer(w, w)) / data.n_time)
    else:
        values, vectors = _leading(rows, data.n_space, data.n_time, keep, solver, of)
    values, vectors = values[:keep], vectors[:, :keep]
    modes_ = np.where(w[:, None] > 0, vectors / np.sqrt(np.where(w > 0, w, 1))[:, None], 0.0)
    turn = numeric.canonical(modes_).real
    modes = _small(data.spark, modes_ * turn, "s")
    return values, modes, tall.exploded(tall.times(rows, vectors * turn, ["t"], of=of), "t", len(values))


def pod(data: Dataset, *, n_modes: int = 10, solver: str = "eigh") -> Result:
    """Proper orthogonal decomposition.

    ``solver="svd"`` factorises without squaring the data, ``"randomized"`` takes a random range of ``n_modes`` and ten more
    directions with eight power steps and needs no square of either side; ``"auto"`` is ``"eigh"`` up to ``tall.MOST`` and
    ``"randomized"`` beyond.
    """
    if data.n_time < 2:
        raise ValueError("the decomposition needs two snapshots or more")
    if solver not in ("eigh", "svd", "randomized", "auto"):
        raise ValueError(f"solver must be 'eigh', 'svd', 'randomized' or 'auto', got {solver!r}")
    if solver == "auto":
        solver = "eigh" if min(data.n_time, data.n_space) <= tall.MOST else "randomized"
    of = _centring(data) if data.n_time >= data.n_space and solver != "svd" else None
    total = energy(data)
    keep = min(n_modes, max(min(data.n_time - 1, data.n_space), 1))
    if solver == "svd":
        values, modes, coef = _by_svd(data, _centred_series(data), 1, keep)
        modes = modes.select("mode", "s", "re", "im")
    elif of is None:
        values, modes, coef = _second_order(_centred_series(data), data, keep, solver)
    else:  # a place's record is the long side: only snapshots are gathered
        values, modes, coef = _by_snapshots(data.snapshots(narrow=True), data, keep, solver, of)
    captured = float(values.sum() / total) if total else float("nan")
    attrs = {"n_modes_saved": len(values), "total_energy": total, "energy_captured_fraction": captured, "solver": solver, "dt": data.dt, "kernel": "temporal" if data.n_time < data.n_space else "spatial"}
    return Result("pod", {"eig": _eig_table(data.spark, values, total), "modes": modes, "coef": coef}, attrs | _about(data))


def _about(data: Dataset) -> dict:
    return {"n_time": data.n_time, "n_space": data.n_space, **{f"data_{k}": v for k, v in data.meta.items()}}


def mpod(data: Dataset, edges: list[float], *, scale: str = "hz", n_modes: int = 10, kind: str = "rectangular") -> Result:
    """One decomposition a frequency band, pooled by energy; a single full band is the plain decomposition."""
    if kind != "rectangular":
        raise ValueError(f"only rectangular filters exist, got {kind!r}")
    bands = lifts.band_edges(edges, scale, data.dt)
    n, full = data.n_time, len(bands) == 1 and lifts.band_mask(bands, 0, data.n_time, data.dt).all()
    if full:
        out = pod(data, n_modes=n_modes)
        eig = out.eig.withColumn("band", F.lit(0).cast("long"))
        return Result("mpod", {**out.tables, "eig": eig}, out.attrs | {"band_edges_hz": bands})
    series, total = _centred_series(data), energy(data)
    found = []
    for k in range(len(bands)):
        mask = lifts.band_mask(bands, k, n, data.dt)
        if mask.any():
            found.append((k, *_second_order(lifts.banded(series, mask, n), data, n_modes)))
    values = np.concatenate([v for _, v, _, _ in found]) if found else np.zeros(0)
    band = np.concatenate([np.full(len(v), k) for k, v, _, _ in found]) if found else np.zeros(0, int)
    inside = np.concatenate([np.arange(len(v)) for _, v, _, _ in found]) if found else np.zeros(0, int)
    order = numeric.pooled_order(values, band)
    spark = data.spark
    place = spark.createDataFrame([(int(band[o]), int(inside[o]), i) for i, o in enumerate(order)], "band long, old long, mode long")

    def pooled(which: int) -> DataFrame:
        parts = [f[which].withColumnRenamed("mode", "old").withColumn("band", F.lit(f[0]).cast("long")) for f in found]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        key = "s" if which == 2 else "t"
        return out.join(F.broadcast(place), ["band", "old"]).select("mode", key, "re", "im")

    eig = _eig_table(spark, values[order], total, {"band": band[order]}).withColumn("band", F.col("band").cast("long"))
    attrs = {"total_energy": total, "energy_captured_fraction": float(values.sum() / total) if total else float("nan"), "band_edges_hz": bands, "n_modes_saved": len(order), "dt": data.dt}
    return Result("mpod", {"eig": eig, "modes": pooled(2), "coef": pooled(3)}, attrs | _about(data))


def _by_svd(data: Dataset, series: DataFrame, delays: int, keep: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Delay-lifted factorisation by QR of the taller side: ``lambda = sigma^2 / m``."""
    spark = data.spark
    m = data.n_time - delays + 1
    size = delays * data.n_space
    weighted = _weighted_series(series)
    if m <= size:
        rows = lifts.delayed_series(weighted, delays, data.n_time).withColumn("k", F.col("d") * F.lit(data.n_space) + F.col("s"))
        r = tall.triangle(rows, m)
        _, sigma, vt = np.linalg.svd(r)
        sigma, right = sigma[: min(len(sigma), m)], vt.T
        live = numeric.significant(sigma, min(m, size))
        sigma = sigma[live][:keep]
        right = right[:, : len(live)][:, live][:, :keep]
        wide = tall.times(rows, right / sigma, ["k"], scale="w")
        n = len(sigma)
        turn = numeric.phases(tall.pivots(wide, "k", n)).real
        signs = F.array(*[F.lit(float(x)) for x in turn]) if n else F.array().cast("array<double>")
        modes = tall.exploded(wide, "k", n).select("mode", "k", (F.col("re") * F.element_at(signs, F.col("mode") + 1)).alias("re"), "im")
        coef = _small(spark, right * sigma * turn, "t")
    else:
        long = weighted.select("s", F.posexplode("v").alias("t", "q")).select(F.col("t").cast("long").alias("t"), "s", "q")
        pairs = F.array_sort(F.collect_list(F.struct("s", "q")))
        rows = lifts.delayed_snapshots(long.groupBy("t").agg(F.transform(pairs, lambda p: p["q"]).alias("v")), delays, data.n_time)
        _, sigma, vt = np.linalg.svd(tall.triangle(rows, size))
        live = numeric.significant(sigma, min(m, size))
        sigma, right = sigma[live][:keep], vt.T[:, : len(live)][:, live][:, :keep]
        w = np.tile(data.weights(), delays)
        phi = np.where(w[:, None] > 0, right / np.sqrt(np.where(w > 0, w, 1))[:, None], 0.0)
        turn = numeric.canonical(phi).real
        modes = _small(spark, phi * turn, "k")
        coef = tall.exploded(tall.times(rows, right * turn, ["t"]), "t", len(sigma))
    where = modes.select("mode", F.floor(F.col("k") / data.n_space).cast("long").alias("d"), (F.col("k") % data.n_space).alias("s"), "re", "im")
    return sigma**2 / m, where, coef


def stpod(data: Dataset, *, delays: int = 10, n_modes: int = 10) -> Result:
    """Delay-embedded (space-time) decomposition."""
    if delays < 2:
        raise ValueError("delay embedding needs two delays or more")
    m = lifts.check_delays(delays, data.n_time)
    series = _centred_series(data)
    keep = min(n_modes, m, delays * data.n_space)
    values, modes, coef = _by_svd(data, series, delays, keep)
    power = F.transform("v", lambda q: q * q)
    lifted = lifts.delayed_series(series, delays, data.n_time).select((F.col("w") * F.aggregate(power, F.lit(0.0), lambda a, x: a + x)).alias("e"))
    total = float(lifted.agg(F.sum("e")).first()[0] or 0.0) / m
    attrs = {"embedding_dim": delays, "total_energy": total, "energy_captured_fraction": float(values.sum() / total) if total else float("nan"), "n_modes_saved": len(values), "dt": data.dt}
    return Result("stpod", {"eig": _eig_table(data.spark, values, total), "modes": modes, "coef": coef}, attrs | _about(data))


def delay_slice(result: Result, mode: int, delay: int) -> DataFrame:
    """The spatial part of a space-time mode at one delay."""
    return result.modes.where((F.col("mode") == mode) & (F.col("d") == delay)).select("s", "re")


#: Bytes that the kernels of all frequencies (or triads) may take in one task and on the driver.
KERNEL_BYTES = 2 << 30


def _fits(count: int, blocks: int) -> None:
    if count * blocks**2 * 16 > KERNEL_BYTES:
        raise ValueError(f"{count} kernels of {blocks} x {blocks} pass {KERNEL_BYTES} bytes; take longer blocks or less overlap")


def _unit(data: Dataset, length: float, speed: float) -> tuple[float, float]:
    from eigenflux.dataset import positive

    return positive("L", length, "parameters"), positive("U", speed, "parameters")


def spod(data: Dataset, *, nfft: int = 128, overlap: float = 0.5, window: str = "hamming", norm: str = "power", blockwise_mean: bool = False, normvar: bool = False, length: float = 1.0, speed: float = 1.0, n_modes: int | None = None, weights: np.ndarray | None = None) -> Result:
    """Spectral decomposition: one eigenproblem of the block cross-spectrum a frequency, solved beside its sum.

    ``weights`` stand in for the field's own metric in this call.
    """
    length, speed = _unit(data, length, speed)
    data = data if weights is None else data.with_metric("prescribed", weights)
    welch = Welch(data.n_time, data.dt, nfft, overlap, window, norm, blockwise_mean=blockwise_mean, normvar=normvar)
    spark, nb, nf = data.spark, welch.blocks, len(welch.freq)
    _fits(nf, nb)
    step = (welch.freq[1] - welch.freq[0]) * length / speed if nf > 1 else 1.0
    series = data.series()
    keep = nb if n_modes is None else min(n_modes, nb)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((nf, nb, nb), np.complex128)
        for b in batches:
            x = tall.matrix(b.column(1))
            if len(x):
                q = welch.transform(x)
                total += np.einsum("sfb,s,sfc->fbc", q.conj(), np.asarray(b.column(0)), q, optimize=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(nf)), pa.array([m.tobytes() for m in total], pa.binary())], names=["f", "data"])

    def solve(parts):
        f, total = parts.column(0)[0].as_py(), np.zeros((nb, nb), np.complex128)
        for piece in parts.column(1).to_pylist():
            total = total + np.frombuffer(piece, np.complex128).reshape(nb, nb)
        values, vectors = np.linalg.eigh(total / (nb * step))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        return pa.table(
            [pa.array([f], pa.int64()), pa.array([values.tolist()], pa.list_(pa.float64())), pa.array([vectors.tobytes()], pa.binary())], names=["f", "values", "psi"]
        )

    sums = series.select("w", "v").mapInArrow(cross, "f long, data binary")
    solved = sums.groupBy("f").applyInArrow(solve, "f long, values array<double>, psi binary").toPandas().set_index("f").sort_index()
    lam = np.stack(solved["values"].to_numpy())
    psi = np.stack([np.frombuffer(p, np.complex128).reshape(nb, nb) for p in solved["psi"]])
    live = np.stack([v > numeric.floor_of(nb, v.max()) if v.max() > 0 else np.zeros(nb, bool) for v in lam])
    back = np.where(live[:, None, :], psi / np.sqrt(np.where(live, lam, 1))[:, None, :], 0)[:, :, :keep] / np.sqrt(nb * step)
    shared = spark.sparkContext.broadcast(back)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = tall.matrix(b.column(1))
            if len(x):
                y = np.einsum("sfb,fbk->sfk", welch.transform(x), shared.value, optimize=True).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), tall.lists(np.concatenate((y.real, y.imag), 1))], names=["s", "m"])

    wide = series.select("s", "v").mapInArrow(shapes, "s long, m array<double>")
    turn = numeric.phases(tall.pivots(wide, "s", nf * keep, complex_=True))
    turned = spark.sparkContext.broadcast(turn)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = tall.matrix(b.column(1))
            if len(x):
                y = (x[:, : nf * keep] + 1j * x[:, nf * keep :]) * turned.value
                yield pa.RecordBatch.from_arrays([b.column(0), tall.lists(np.concatenate((y.real, y.imag), 1))], names=["s", "m"])

    both = tall.exploded(wide.mapInArrow(rotate, "s long, m array<double>"), "s", nf * keep, complex_=True)
    modes = both.select(F.floor(F.col("mode") / keep).cast("long").alias("f"), (F.col("mode") % keep).cast("long").alias("mode"), "s", "re", "im")
    coef_ = psi[:, :, :keep] * turn.reshape(nf, 1, keep)
    coef = spark.createDataFrame(
        [(f, k, b, float(coef_[f, b, k].real), float(coef_[f, b, k].imag)) for f in range(nf) for b in range(nb) for k in range(keep)], "f long, mode long, b long, re double, im double"
    )
    eig = spark.createDataFrame(
        [(f, float(welch.freq[f]), float(welch.freq[f] * length / speed), k, float(lam[f, k])) for f in range(nf) for k in range(keep)],
        "f long, freq double, st double, mode long, lambda_re double",
    )
    return Result("spod", {"eig": eig, "modes": modes, "coef": coef}, welch.attrs() | {"dst": float(step), "L": length, "U": speed, "dt": data.dt} | _about(data))


def psd_pod(data: Dataset, *, nfft: int = 128, overlap: float = 0.5, window: str = "hamming", norm: str = "power", blockwise_mean: bool = False, n_modes: int = 10, compat: bool = False) -> Result:
    """Decomposition of all Fourier realizations pooled.

    ``coef`` projects the realizations on the modes, so they rebuild the ensemble; ``compat`` conjugates the realizations first.
    """
    welch = Welch(data.n_time, data.dt, nfft, overlap, window, norm, blockwise_mean=blockwise_mean)
    spark, nf, nb = data.spark, len(welch.freq), welch.blocks
    size = nf * nb
    if size < 2:
        raise ValueError("pooling needs two realizations or more")
    series = data.series()
    tall._guard(size)

    def each(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((size, size), np.complex128)
        for b in batches:
            x = tall.matrix(b.column(1))
            if len(x):
                e = welch.transform(x).reshape(len(x), size)
                total += (e * np.asarray(b.column(0))[:, None]).T @ e.conj()
        return {0: total}

    values, vectors = _rayleigh(tall.reduce_sum(series.select("w", "v"), each)[0] / size)
    values, vectors = values[:n_modes], vectors[:, :n_modes]
    r = len(values)
    shared = spark.sparkContext.broadcast(vectors / np.sqrt(values * size))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = tall.matrix(b.column(1))
            if len(x):
                y = welch.transform(x).reshape(len(x), size).conj() @ shared.value
                yield pa.RecordBatch.from_arrays([b.column(0), tall.lists(np.concatenate((y.real, y.imag), 1))], names=["s", "m"])

    wide = series.select("s", "v").mapInArrow(shapes, "s long, m array<double>")
    turn = numeric.phases(tall.pivots(wide, "s", r, complex_=True))
    raw = tall.exploded(wide, "s", r, complex_=True)
    cos, sin = (F.array(*[F.lit(float(x)) for x in part]) for part in (turn.real, turn.imag))
    c, d = F.element_at(cos, F.col("mode") + 1), F.element_at(sin, F.col("mode") + 1)
    modes = raw.select("mode", "s", (F.col("re") * c - F.col("im") * d).alias("re"), (F.col("re") * d + F.col("im") * c).alias("im"))
    coef = vectors * np.sqrt(values * size) * turn
    if compat:
        shared_turn = spark.sparkContext.broadcast((vectors / np.sqrt(values * size)) * turn)

        def project(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            total = np.zeros((size, r), np.complex128)
            for b in batches:
                x = tall.matrix(b.column(1))
                if len(x):
                    e = welch.transform(x).reshape(len(x), size)
                    total += (e * np.asarray(b.column(0))[:, None]).conj().T @ (e.conj() @ shared_turn.value)
            return {0: total}

        coef = tall.reduce_sum(series.select("w", "v"), project)[0]
    table = _small(spark, coef, "i").select("mode", F.floor(F.col("i") / nb).cast("long").alias("f"), (F.col("i") % nb).cast("long").alias("b"), "re", "im")
    total = float(values.sum())
    return Result("psd_pod", {"eig": _eig_table(spark, values, total), "modes": modes, "coef": table}, welch.attrs() | {"n_realizations": size, "dt": data.dt} | _about(data))


def _pair_factors(data: Dataset, delays: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """``X1`` and ``X2`` up to an orthonormal factor, by QR of the taller side; with rows if places are the taller side."""
    m = data.n_time - delays + 1
    size = delays * data.n_space
    if m <= size:
        rows = lifts.delayed_series(data.series(), delays, data.n_time)
        r = tall.triangle(rows, m)
        return r[:, :-1], r[:, 1:], rows
    rows = lifts.delayed_snapshots(data.snapshots(), delays, data.n_time)
    ahead = rows.select((F.col("t") - 1).alias("t"), F.col("v").alias("next"))
    both = rows.join(ahead, "t").select(F.concat("v", "next").alias("v"))
    r = tall.triangle(both, 2 * size)
    return r[:, :size].T, r[:, size:].T, None


def dmd(data: Dataset, *, rank: int | str, method: str = "ls", delays: int = 1, energy_fraction: float = 0.999, n_modes: int | None = None, name: str = "dmd") -> Result:
    """Dynamic mode decomposition of shifted pairs, least squares (``ls``) or total least squares (``tls``), with delays."""
    if rank is None:
        raise ValueError("the rank must be given: a number, 'svht' or 'energy'")
    if method not in ("ls", "tls"):
        raise ValueError(f"method must be 'ls' or 'tls', got {method!r}")
    if delays > data.n_time - 2:
        raise ValueError(f"{delays} delays leave no pair of {data.n_time} snapshots")
    if delays >= max(2, data.n_time // 2):
        warnings.warn(f"{delays} delays are half the record or more", RuntimeWarning, stacklevel=2)
    spark, size = data.spark, delays * data.n_space
    x1, x2, rows = _pair_factors(data, delays)
    u, s, vt = np.linalg.svd(x1, full_matrices=False)
    shape = (size, data.n_time - delays)
    r = numeric.rank_of(s, shape, rank, energy_fraction)
    if r == 0:
        warnings.warn("the field has no significant direction", RuntimeWarning, stacklevel=2)
    u, s, v = u[:, :r], s[:r], vt[:r].T
    if method == "ls":
        small = (u.T @ x2 @ v) / s if r else np.zeros((0, 0))
    else:
        z = np.linalg.svd(np.concatenate((x1, x2)), full_matrices=False)[0][:, :r]
        small = (u.T @ z[len(x1) :]) @ np.linalg.pinv(u.T @ z[: len(x1)]) if r else np.zeros((0, 0))
    values, w = np.linalg.eig(small) if r else (np.zeros(0, complex), np.zeros((0, 0), complex))
    order = numeric.spectrum_order(values)
    order = order if n_modes is None else order[:n_modes]
    values, w = values[order], w[:, order]
    inner = x2 @ (v / s) @ w if r else np.zeros((len(x1), 0), complex)
    k = len(values)
    if rows is None:
        turn = numeric.canonical(inner) if k else np.ones(0)
        modes = _small(spark, inner * turn, "i")
        start = _first_column(data, delays)
        basis = inner * turn
        amplitude = np.linalg.pinv(basis) @ start if k else np.zeros(0)
    else:
        n = x1.shape[1]
        factor = np.zeros((n + 1, k), complex)
        factor[1:] = (v / s) @ w if r else 0
        keyed = rows.withColumn("i", F.col("d") * F.lit(data.n_space) + F.col("s"))
        wide = tall.times(keyed, factor.astype(complex), ["i"])
        turn = numeric.phases(tall.pivots(wide, "i", k, complex_=True)) if k else np.ones(0)
        wide = tall.times(keyed, factor * turn, ["i"])
        modes = tall.exploded(wide, "i", k, complex_=True)
        amplitude = np.linalg.pinv(inner * turn) @ x1[:, 0] if k else np.zeros(0)  # the orthonormal factor cancels
    modes = modes.select("mode", F.floor(F.col("i") / data.n_space).cast("long").alias("d"), (F.col("i") % data.n_space).alias("s"), "re", "im")
    safe = np.where(values == 0, np.finfo(float).tiny, values)
    omega = np.log(safe.astype(complex)) / data.dt
    eig = _eig_table(spark, values, None, {"abs": np.abs(values), "phase": np.angle(values), "omega_re": omega.real, "omega_im": omega.imag, "freq": np.angle(values) / (2 * np.pi * data.dt), "growth": omega.real, "amplitude_re": amplitude.real, "amplitude_im": amplitude.imag})
    coef = _small(spark, amplitude[None, :] * np.power(values[None, :], np.arange(data.n_time)[:, None]), "t")
    attrs = {"rank": r, "method": method, "delays": delays, "dt": data.dt, "singular_values": s[:64]}
    return Result(name if name in ("dmd",) else "dmd", {"eig": eig, "modes": modes, "coef": coef}, attrs | {"variant": name} | _about(data))


def _first_column(data: Dataset, delays: int) -> np.ndarray:
    early = data.snapshots().where(F.col("t") <= delays)
    rows = lifts.delayed_snapshots(early, delays, delays + 1) if delays > 1 else early
    return np.array(rows.where("t = 0").first()["v"], np.float64)


def hodmd(data: Dataset, *, rank: int | str, delays: int, method: str = "ls", **options) -> Result:
    """Dynamic modes of the delay-embedded field; two delays or more."""
    if delays < 2:
        raise ValueError("a higher-order variant needs two delays or more")
    return dmd(data, rank=rank, delays=delays, method=method, name="hodmd" if method == "ls" else "tls_hodmd", **options)


def triads(limit: int = 8) -> list[tuple[int, int, int]]:
    """Signed bins with ``p1 + p2 = p3``, ``p1 >= p2``, ``p1 >= 0`` and all magnitudes up to the limit."""
    return [(a, b, a + b) for b in range(-limit, limit + 1) for a in range(abs(b), limit + 1) if a + b <= limit]


def admitted(asked: list[tuple[int, int, int]] | None, nfft: int, limit: int = 8) -> list[tuple[int, int, int]]:
    """Triads inside the one-sided spectrum; a list of one's own must fit, the default one is filtered with a warning."""
    top = nfft // 2
    chosen = triads(limit) if asked is None else [tuple(int(p) for p in t) for t in asked]
    bad = [t for t in chosen if max(map(abs, t)) > top]
    if bad and asked is not None:
        raise ValueError(f"triads beyond bin {top}: {bad}")
    if bad:
        warnings.warn(f"{len(bad)} default triads lie beyond bin {top}", RuntimeWarning, stacklevel=2)
    return [t for t in chosen if t not in bad]


def bsmd(data: Dataset, *, nfft: int = 128, overlap: float = 0.5, window: str = "hamming", norm: str = "power", blockwise_mean: bool = False, normvar: bool = False, triad_list: list[tuple[int, int, int]] | None = None, dynamic: bool = False) -> Result:
    """Bispectral modes: the dominant eigenpair of each triad's cross-bispectral matrix, solved beside its sum."""
    if dynamic:
        raise NotImplementedError("dynamic triads are not defined")
    welch = Welch(data.n_time, data.dt, nfft, overlap, window, norm, blockwise_mean=blockwise_mean, normvar=normvar)
    chosen = admitted(triad_list, welch.nfft)
    spark, nb = data.spark, welch.blocks
    _fits(len(chosen), nb)
    p = np.array(chosen, np.int64).reshape(-1, 3)
    valid = p[:, 0] + p[:, 1] == p[:, 2]
    series = data.series()

    def bins(q: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = q[:, np.abs(k), :]
        return np.where(k[None, :, None] < 0, x.conj(), x)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(p), nb, nb), np.complex128)
        for b in batches:
            x = tall.matrix(b.column(1))
            if len(x):
                q, w = welch.transform(x), np.asarray(b.column(0))
                total += np.einsum("stb,s,stc->tbc", bins(q, p[:, 2]).conj(), w, bins(q, p[:, 0]) * bins(q, p[:, 1]), optimize=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p))), pa.array([m.tobytes() for m in total], pa.binary())], names=["triad", "data"])

    def solve(parts):
        k, total = parts.column(0)[0].as_py(), np.zeros((nb, nb), np.complex128)
        for piece in parts.column(1).to_pylist():
            total = total + np.frombuffer(piece, np.complex128).reshape(nb, nb)
        try:
            values, vectors = np.linalg.eig(total / nb)
            top = int(np.argmax(np.abs(values)))
            value, a = complex(values[top]), vectors[:, top]
            a = a * numeric.canonical(a[:, None])[0]
        except np.linalg.LinAlgError:
            value, a = complex(np.nan, np.nan), np.full(nb, np.nan + 0j)
        if not valid[k]:
            value, a = complex(np.nan, np.nan), np.full(nb, np.nan + 0j)
        return pa.table([pa.array([k], pa.int64()), pa.array([value.real]), pa.array([value.imag]), pa.array([a.tobytes()], pa.binary())], names=["triad", "re", "im", "a"])

    got = series.select("w", "v").mapInArrow(cross, "triad long, data binary").groupBy("triad").applyInArrow(solve, "triad long, re double, im double, a binary").toPandas().sort_values("triad")
    vectors = np.stack([np.frombuffer(a, np.complex128) for a in got["a"]])
    shared = spark.sparkContext.broadcast(vectors)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = tall.matrix(b.column(1))
            if not len(x):
                continue
            q = welch.transform(x)
            one = np.einsum("stb,tb->st", bins(q, p[:, 2]), shared.value)
            two = np.einsum("stb,tb->st", bins(q, p[:, 0]) * bins(q, p[:, 1]), shared.value)
            s = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(len(p)), len(s))), pa.array(np.repeat(s, len(p))), *[pa.array(np.ascontiguousarray(y).reshape(-1)) for y in (one.real, one.imag, two.real, two.imag)]],
                names=["triad", "s", "re1", "im1", "re2", "im2"],
            )

    modes = series.select("s", "v").mapInArrow(shapes, "triad long, s long, re1 double, im1 double, re2 double, im2 double")
    rows = [(int(t), *map(int, p[int(t)]), float(re), float(im), float(np.hypot(re, im))) for t, re, im in zip(got["triad"], got["re"], got["im"])]
    eig = spark.createDataFrame(rows, "triad long, p1 long, p2 long, p3 long, lambda_re double, lambda_im double, modulus double")
    return Result("bsmd", {"eig": eig, "modes": modes}, welch.attrs() | {"n_triads": len(p), "dt": data.dt} | _about(data))
