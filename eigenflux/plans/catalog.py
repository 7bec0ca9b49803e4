"""Registry of the field queries over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenflux.dataset import Dataset, mesh, plain_grid
from eigenflux.functions import metric
from eigenflux.operators import lifts, modal, reports, tall
from eigenflux.plans import sql
from eigenflux.results import Result, file_name, latest
from eigenflux.sources import generators, tables
from eigenflux.sources.files import nearest

PAIR = ["click", "purchase"]
WELCH = {"nfft": 24, "overlap": 0.5, "window": "hamming"}


def rounded(column: str | Column, name: str, digits: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def hours(spark: SparkSession, d: str) -> Dataset:
    return tables.hourly_events(spark, d)


def two(spark: SparkSession, d: str) -> Dataset:
    return tables.hourly_events(spark, d, PAIR)


def one(spark: SparkSession, d: str) -> Dataset:
    return tables.hourly_events(spark, d, PAIR[:1])


def _long(df: DataFrame) -> DataFrame:
    return df.select("t", "s", rounded("q", "q"))


def _gram(left: DataFrame, right: DataFrame, on: str, over: float, digits: int = 6) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    pairs = a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}")).where("a.k <= b.k")
    return pairs.groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(rounded(F.sum(F.col("a.q") * F.col("b.q")) / over, "k", digits))


def _matrix(spark: SparkSession, k: np.ndarray, digits: int = 6) -> DataFrame:
    rows = [(i, j, float(k[i, j])) for i in range(len(k)) for j in range(i, len(k))]
    return spark.createDataFrame(rows, "i long, j long, v double").select("i", "j", rounded("v", "k", digits))


def gram_spatial_h(spark, d):
    data = hours(spark, d)
    rows = modal._weighted_snapshots(data, data.centred())
    return _matrix(spark, tall.gram(rows, data.n_space) / data.n_time)


def gram_temporal_d(spark, d):
    data = tables.daily_events(spark, d)
    series = modal._weighted_series(modal._centred_series(data))
    return _matrix(spark, tall.gram(series, data.n_time) / data.n_time)


def gram_e(spark, d):
    data = tables.vectors(spark, d)
    rows = modal._weighted_snapshots(data, data.centred())
    return _matrix(spark, tall.gram(rows, data.n_space) / data.n_time, 9)


def _pod2(spark, d):
    return modal.pod(two(spark, d))


def _pod5(spark, d):
    return modal.pod(hours(spark, d))


def _ij(df: DataFrame, *values: Column) -> DataFrame:
    return df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *values)


def weighted_energy(spark, d):
    data = hours(spark, d)
    data = data.with_metric("prescribed", np.arange(1, data.n_space + 1))
    return spark.createDataFrame([(modal.energy(data),)], "e double").select(rounded("e", "energy"))


def pod_sums(kind: str):
    def run(spark, d):
        eig = modal.pod(hours(spark, d)).eig
        value = F.sum("lambda_re") if kind == "trace" else F.sum(F.col("lambda_re") ** 2)
        return eig.agg(rounded(value, "trace") if kind == "trace" else F.round(value, 1).alias("squares"))

    return run


def weights_polar(spark, d):
    grid = mesh(spark, np.arange(6) * 2.0 / 5, 0.1 + np.arange(4) * 0.3)
    return metric.apply(grid, 24, "polar").select("s", rounded("w", "w"))


def infer_dt(spark, d):
    from pyspark.sql import Window

    events = spark.read.parquet(f"{d}/events.parquet").select(F.expr(f"timestampdiff(HOUR, {tables.EPOCH}, ts)").alias("t")).distinct()
    gap = events.select(F.abs(F.col("t") - F.lag("t").over(Window.orderBy("t"))).alias("d")).where("d <> 0")  # one row an hour
    return gap.agg(rounded(F.avg("d"), "dt"))


def stpod_gram(spark, d):
    data = hours(spark, d)
    rows = lifts.delayed(data.centred(), 2, data.n_time).select("t", (F.col("d") * data.n_space + F.col("s")).alias("k"), "q")
    return _gram(rows, rows, "t", data.n_time - 1)


def stpod_energy(spark, d):
    return spark.createDataFrame([(modal.stpod(hours(spark, d), delays=4).attrs["total_energy"],)], "e double").select(rounded("e", "energy"))


def dmd_operator(data: Dataset) -> DataFrame:
    x1, x2, _ = modal._pair_factors(data, 1)
    a = x2 @ np.linalg.pinv(x1)
    rows = [(i, j, float(a[i, j])) for i in range(len(a)) for j in range(len(a))]
    return data.spark.createDataFrame(rows, "i long, j long, v double").select("i", "j", rounded("v", "a"))


def reductions(spark, d):
    data = hours(spark, d)
    parts = [data.reduced(kind).select(F.lit(k).cast("long").alias("kind"), rounded("v", "v")) for k, kind in enumerate(("min", "max", "mean"))]
    return parts[0].union(parts[1]).union(parts[2])


def centredness(spark, d):
    data = hours(spark, d)
    raw, done = data.centredness(), replace(data, long=data.centred()).centredness()
    return raw.select(F.lit(0).cast("long").alias("centred"), rounded("ratio", "ratio")).union(done.select(F.lit(1).cast("long").alias("centred"), rounded("ratio", "ratio")))


def modes_for(spark, d):
    result = _pod2(spark, d)
    return spark.createDataFrame([(x, reports.modes_for(result, x)) for x in (50, 90, 99)], "threshold long, n long")


def energy_ranks(spark, d):
    data = two(spark, d)
    return spark.createDataFrame([(x, int(modal.dmd(data, rank="energy", energy_fraction=x / 1000).attrs["rank"])) for x in (500, 900, 999)], "permille long, r long")


def saved(spark, d):
    """A result written to the shared folder, found as the newest one and read again."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/results-{uuid.uuid4().hex}"
    _pod2(spark, d).save(f"{folder}/{file_name('case', 'pod', 720)}")
    return Result.load(spark, latest(spark, folder, "pod")).eig


def user_triads(spark, d):
    eig = modal.bsmd(two(spark, d), **WELCH, triad_list=[(1, 1, 2), (1, 1, 3), (3, -2, 1)]).eig
    return eig.select("p1", "p2", "p3", rounded(F.when(F.isnan("modulus"), -1.0).otherwise(F.col("modulus")), "modulus", 4))


def _gyre(spark):
    """The first snapshot of the small double gyre as a mode, and its grid."""
    data = generators.double_gyre(spark, 20, 10, 30)
    return data.long.where("t = 0").select(F.lit(0).cast("long").alias("mode"), "s", F.col("q").alias("re"), F.lit(0.0).alias("im")), data.grid


def masked(spark, d):
    return reports.masked(*_gyre(spark), radius=0.8).select("s", F.isnan("re").alias("hidden"), rounded(F.when(F.isnan("re"), 0.0).otherwise(F.col("re")), "re"))


def volume_crop(spark, d):
    return reports.volume(*_gyre(spark), xlim=(0.5, 1.5), ylim=(0.0, 0.5)).select("s", rounded("re", "re"))


def track_crop(spark, d):
    track = spark.createDataFrame([(0.4,), (0.9,), (0.6,)], "v double")
    return _long(generators.double_gyre(spark, 20, 10, 30).along_track(track, "mean", offset=0.1, y_max=0.6).long)


def phases(spark, d):
    q = qhat(hours(spark, d), "hamming").where("f between 1 and 11")
    return reports.unwrapped(q, ["f", "s"], "b").select("f", "s", "b", rounded("phase", "phase"))


def trace_of(result_of) -> Callable:
    return lambda spark, d: result_of(spark, d).eig.agg(rounded(F.sum("lambda_re"), "trace"))


def _limits(method: str):
    return lambda s, d: reports.limits(hours(s, d).long, "q", method).select(rounded("low", "low"), rounded("high", "high"))


def _eig(df: DataFrame) -> DataFrame:
    return df.select("mode", rounded("lambda_re", "lambda_re"), rounded("lambda_im", "lambda_im"))


def welch_blocks(spark, d):
    data = hours(spark, d)
    w = lifts.Welch(data.n_time, data.dt, 24, 0.5)
    first = F.greatest(F.ceil((F.col("t") - 23) / 12), F.lit(0))
    last = F.least(F.floor(F.col("t") / 12), F.lit(w.blocks - 1))
    rows = data.long.withColumn("first", first).withColumn("last", last).where("first <= last")
    rows = rows.withColumn("b", F.explode(F.sequence("first", "last")))
    return rows.select(F.col("b").cast("long").alias("b"), (F.col("t") - F.col("b") * 12).cast("long").alias("n"), "s", "q")


def qhat(data: Dataset, window: str) -> DataFrame:
    return lifts.fourier(data.series(), lifts.Welch(data.n_time, data.dt, 24, 0.5, window))


def mpod_bands(spark, d):
    data = hours(spark, d)
    eig = modal.mpod(data, [0.0, 0.05, 0.2, 0.5]).eig
    return eig.groupBy("band").agg(rounded(F.sum("lambda_re"), "energy"))


def triad_frame(spark: SparkSession, chosen) -> DataFrame:
    return spark.createDataFrame(chosen, "p1 long, p2 long, p3 long")


def _bsmd(data: Dataset):
    return modal.bsmd(data, **WELCH)


def bispectrum(spark, d):
    eig = _bispectrum(one(spark, d))
    return eig.select("p1", "p2", "p3", rounded("re", "re"), rounded("im", "im"))


def _bispectrum(data: Dataset) -> DataFrame:
    """Mean triple product of each place's blocks, as joins of its transform."""
    spark = data.spark
    q = qhat(data, "hamming").select("f", "s", "b", "re", "im")
    span = spark.range(-8, 9).withColumnRenamed("id", "p")
    x = q.join(F.broadcast(span), q["f"] == F.abs("p")).select("p", "s", "b", "re", F.when(F.col("p") < 0, -F.col("im")).otherwise(F.col("im")).alias("im"))
    t = F.broadcast(triad_frame(spark, modal.triads()))

    def side(n: int) -> DataFrame:
        return x.select(F.col("p").alias(f"p{n}"), "s", "b", F.col("re").alias(f"r{n}"), F.col("im").alias(f"i{n}"))

    rows = side(1).join(t, "p1").join(side(2), ["p2", "s", "b"]).join(side(3), ["p3", "s", "b"])
    re, im = F.expr("r1 * r2 - i1 * i2"), F.expr("r1 * i2 + i1 * r2")
    rows = rows.select("p1", "p2", "p3", "s", re.alias("re"), im.alias("im"), "r3", "i3")
    mean = lambda e: F.avg(F.expr(e))
    return rows.groupBy("p1", "p2", "p3", "s").agg(mean("re * r3 + im * i3").alias("re"), mean("im * r3 - re * i3").alias("im"))


def nearest_index(spark, d):
    axis = np.linspace(0, 2, 80)
    return spark.createDataFrame([(k, nearest(axis, k * 0.13)) for k in range(16)], "k long, ix long")


def rows_only(result_of) -> Callable:
    return lambda spark, d: result_of(spark, d).eig


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "snapshot_long_H": lambda s, d: _long(hours(s, d).long),
    "snapshot_M": lambda s, d: tables.monthly_orders(s, d).long.select("t", "s", F.round("q", 2).alias("q")),
    "temporal_mean_H": lambda s, d: hours(s, d).long.groupBy("s").agg(rounded(F.avg("q"), "q_mean")),
    "centered_H": lambda s, d: _long(hours(s, d).centred()),
    "max_snapshots": lambda s, d: _long(hours(s, d).first(100).long),
    "time_stride": lambda s, d: _long(hours(s, d).strided(5, 500, 7).long),
    "space_stride": lambda s, d: _long(hours(s, d).crop(F.lit(True), (2, 1, 1)).long),
    "nearest_index": nearest_index,
    "infer_dt": infer_dt,
    "weights_uniform": lambda s, d: metric.apply(plain_grid(s, 12), 12, "uniform").select("s", "w"),
    "weights_polar": weights_polar,
    "weighted_energy": weighted_energy,
    "gram_spatial_H": gram_spatial_h,
    "gram_temporal_D": gram_temporal_d,
    "gram_E": gram_e,
    "pod_total_energy_H": lambda s, d: s.createDataFrame([(modal.energy(hours(s, d)),)], "e double").select(rounded("e", "energy")),
    "pod_trace_check_H": pod_sums("trace"),
    "pod_frobenius_check_H": pod_sums("squares"),
    "pod_eig_H2": lambda s, d: _pod2(s, d).eig.select("mode", rounded("lambda_re", "lambda"), rounded("fraction", "fraction")),
    "pod_modes_H2": lambda s, d: _pod2(s, d).modes.select(F.col("mode").cast("long").alias("mode"), "s", rounded("re", "phi")),
    "pod_coeffs_H2": lambda s, d: _pod2(s, d).coef.select(F.col("mode").cast("long").alias("mode"), "t", rounded("re", "a")),
    "pod_cumulative_H2": lambda s, d: reports.cumulative(_pod2(s, d)).select("mode", rounded("pct", "pct"), rounded("cum_pct", "cum_pct")),
    "pod_recon_error_H2": lambda s, d: reports.reconstruction(two(s, d), _pod2(s, d), [1]).select("k", rounded("error_pct", "error_pct")),
    "pod_orthogonality_H2": lambda s, d: reports.orthogonality(two(s, d), _pod2(s, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), rounded("inner", "inner_product")),
    "mode_pair_corr_H2": lambda s, d: reports.pair_correlation(_pod2(s, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), rounded("r", "r")),
    "delay_embed_H": lambda s, d: lifts.delayed(hours(s, d).long, 4, 720).select("t", "d", "s", rounded("q", "q")),
    "stpod_energy_H": stpod_energy,
    "stpod_gram_d2": stpod_gram,
    "stpod_eig_1dof_d2": lambda s, d: modal.stpod(one(s, d), delays=2).eig.select("mode", rounded("lambda_re", "lambda")),
    "shifted_pairs_H2": lambda s, d: lifts.pairs(two(s, d).long).select("t", "s", rounded("x1", "x1"), rounded("x2", "x2")),
    "dmd_operator_H2": lambda s, d: dmd_operator(two(s, d)),
    "dmd_eig_H2": lambda s, d: _eig(modal.dmd(two(s, d), rank=2).eig),
    "dmd_omega_H2": lambda s, d: modal.dmd(two(s, d), rank=2).eig.select("mode", rounded("growth", "growth"), rounded("freq", "freq")),
    "hodmd_eig_1dof_d2": lambda s, d: _eig(modal.hodmd(one(s, d), rank=2, delays=2).eig),
    "welch_blocks_H": lambda s, d: welch_blocks(s, d).select("b", "n", "s", rounded("q", "q")),
    "welch_qhat_H2": lambda s, d: qhat(two(s, d), "hamming").select("f", "s", "b", rounded("re", "re"), rounded("im", "im")),
    "welch_psd_H": lambda s, d: qhat(hours(s, d), "boxcar").groupBy("f", "s").agg(rounded(F.avg(F.expr("re * re + im * im")), "psd")),
    "blockwise_mean_H": lambda s, d: welch_blocks(s, d).groupBy("b", "s").agg(rounded(F.avg("q"), "m")),
    "normvar_H": lambda s, d: welch_blocks(s, d).groupBy("b", "s").agg(F.round(F.var_samp("q"), 3).alias("v")),
    "spod_trace_H": lambda s, d: modal.spod(hours(s, d), **WELCH).eig.groupBy("f").agg(rounded(F.sum("lambda_re"), "trace")),
    "spod_eig_H2": lambda s, d: modal.spod(two(s, d), **WELCH).eig.where("mode < 2").select("f", "mode", rounded("lambda_re", "lambda")),
    "spod_peak_H2": lambda s, d: reports.peak(modal.spod(two(s, d), **WELCH)).select("f", rounded("lambda", "lambda")),
    "psdpod_trace_H2": lambda s, d: modal.psd_pod(two(s, d), **WELCH).eig.agg(rounded(F.sum("lambda_re"), "trace")),
    "psdpod_eig_H2": lambda s, d: modal.psd_pod(two(s, d), **WELCH).eig.select("mode", rounded("lambda_re", "lambda")),
    "mpod_band_energy_H": mpod_bands,
    "mpod_eig_H2": lambda s, d: modal.mpod(two(s, d), [0.0, 0.05, 0.2, 0.5]).eig.select("mode", "band", rounded("lambda_re", "lambda")),
    "triads_static": lambda s, d: triad_frame(s, modal.triads()),
    "triads_filtered": lambda s, d: triad_frame(s, [t for t in modal.triads() if max(map(abs, t)) <= 6]),
    "bispectrum_1dof": bispectrum,
    "bsmd_eig_H2": lambda s, d: _bsmd(two(s, d)).eig.select(*[F.col(p).cast("long").alias(p) for p in ("p1", "p2", "p3")], rounded("modulus", "modulus", 4)),
    "bsmd_energy_map": lambda s, d: reports.energy_map(_bsmd(two(s, d)), 8).select("p1", "p2", rounded(F.when(F.isnan("modulus"), -1.0).otherwise(F.col("modulus")), "modulus", 4)),
    "robust_clim_H": lambda s, d: reports.limits(hours(s, d).long, "q").select(rounded("low", "low"), rounded("high", "high")),
    "limits_minmax_H": _limits("minmax"),
    "limits_sigma_H": _limits("sigma"),
    "reductions_H": reductions,
    "centredness_H": centredness,
    "time_axis_H": lambda s, d: hours(s, d).axis().select("t", rounded("time", "time")),
    "mpod_band_counts_H2": lambda s, d: reports.band_counts(modal.mpod(two(s, d), [0.0, 0.05, 0.2, 0.5])),
    "missing_bins": lambda s, d: reports.missing_bins(modal.triads(), s.range(4).withColumnRenamed("id", "f")),
    "top_triads_H2": lambda s, d: reports.top_triads(_bsmd(two(s, d)), 5).select(*[F.col(p).cast("long").alias(p) for p in ("p1", "p2", "p3")], rounded("modulus", "modulus", 4)),
    "pod_modes_for_H2": modes_for,
    "pod_capped_H2": lambda s, d: modal.pod(two(s, d), n_modes=1).eig.select("mode", rounded("lambda_re", "lambda"), rounded("fraction", "fraction")),
    "pod_svd_H2": lambda s, d: modal.pod(two(s, d), solver="svd").eig.select("mode", rounded("lambda_re", "lambda"), rounded("fraction", "fraction")),
    "pod_randomized_H2": lambda s, d: modal.pod(two(s, d), solver="randomized").eig.select("mode", rounded("lambda_re", "lambda"), rounded("fraction", "fraction")),
    "result_saved_H2": lambda s, d: saved(s, d).select("mode", rounded("lambda_re", "lambda"), rounded("fraction", "fraction")),
    "coefficient_gram_H2": lambda s, d: _ij(reports.coefficient_gram(_pod2(s, d), 720), rounded("inner", "inner_product")),
    "dmd_energy_rank_H2": energy_ranks,
    "dmd_recon_error_H2": lambda s, d: reports.evolution_error(two(s, d), modal.dmd(two(s, d), rank=2)).select(rounded("error_pct", "error_pct")),
    "spod_capped_H2": lambda s, d: modal.spod(two(s, d), **WELCH, n_modes=1).eig.select("f", "mode", rounded("lambda_re", "lambda")),
    "spod_weights_H": lambda s, d: modal.spod(hours(s, d), **WELCH, weights=np.arange(1, hours(s, d).n_space + 1)).eig.groupBy("f").agg(rounded(F.sum("lambda_re"), "trace")),
    "bsmd_user_triads_H2": user_triads,
    "periodogram_peaks_H": lambda s, d: reports.peaks(reports.periodogram(hours(s, d).long, 720, 1.0), 3).select("s", "rank", "f", rounded("power", "power")),
    "masked_gyre": masked,
    "volume_gyre": volume_crop,
    "track_crop_gyre": track_crop,
    "phase_unwrap_H": phases,
    "pod_trace_D": trace_of(lambda s, d: modal.pod(tables.daily_events(s, d), n_modes=200)),
    "pod_trace_E": trace_of(lambda s, d: modal.pod(tables.vectors(s, d), n_modes=64)),
    "stpod_trace_H": trace_of(lambda s, d: modal.stpod(hours(s, d), delays=4, n_modes=20)),
    "gen_double_gyre": lambda s, d: _long(generators.double_gyre(s, 20, 10, 30).long),
    "gen_taylor_green": lambda s, d: _long(generators.taylor_green(s, 16, 16, 20).long),
    "gen_double_gyre_full": lambda s, d: _long(generators.double_gyre(s).long),
    "gen_taylor_green_full": lambda s, d: _long(generators.taylor_green(s).long),
    "gen_cylinder_wake": lambda s, d: _long(generators.cylinder_wake(s).long),
    "periodogram_H": lambda s, d: reports.periodogram(hours(s, d).long, 720, 1.0).select("s", "f", rounded("power", "power")),
    # The two-place and one-place queries above are checks against closed forms in SQL; these are over all event types.
    "pod_modes_H": lambda s, d: _pod5(s, d).modes.select(F.col("mode").cast("long").alias("mode"), "s", rounded("re", "phi")),
    "pod_coeffs_H": lambda s, d: _pod5(s, d).coef.select(F.col("mode").cast("long").alias("mode"), "t", rounded("re", "a")),
    "pod_cumulative_H": lambda s, d: reports.cumulative(_pod5(s, d)).select("mode", rounded("pct", "pct"), rounded("cum_pct", "cum_pct")),
    "pod_recon_error_H": lambda s, d: reports.reconstruction(hours(s, d), _pod5(s, d), [1, 2, 3, 4]).select("k", rounded("error_pct", "error_pct")),
    "pod_orthogonality_H": lambda s, d: _ij(reports.orthogonality(hours(s, d), _pod5(s, d)), rounded("inner", "inner_product")),
    "mode_pair_corr_H": lambda s, d: _ij(reports.pair_correlation(_pod5(s, d)), rounded("r", "r")),
    "stpod_eig_H_d2": lambda s, d: modal.stpod(hours(s, d), delays=2).eig.select("mode", rounded("lambda_re", "lambda")),
    "shifted_pairs_H": lambda s, d: lifts.pairs(hours(s, d).long).select("t", "s", rounded("x1", "x1"), rounded("x2", "x2")),
    "dmd_operator_H": lambda s, d: dmd_operator(hours(s, d)),
    "dmd_eig_H": lambda s, d: _eig(modal.dmd(hours(s, d), rank=5).eig),
    "dmd_omega_H": lambda s, d: modal.dmd(hours(s, d), rank=5).eig.select("mode", rounded("growth", "growth"), rounded("freq", "freq")),
    "hodmd_eig_H_d2": lambda s, d: _eig(modal.hodmd(hours(s, d), rank=10, delays=2).eig),
    "welch_qhat_H": lambda s, d: qhat(hours(s, d), "hamming").select("f", "s", "b", rounded("re", "re"), rounded("im", "im")),
    "spod_eig_H": lambda s, d: modal.spod(hours(s, d), **WELCH).eig.where("mode < 5").select("f", "mode", rounded("lambda_re", "lambda")),
    "spod_peak_H": lambda s, d: reports.peak(modal.spod(hours(s, d), **WELCH)).select("f", rounded("lambda", "lambda")),
    "psdpod_trace_H": lambda s, d: modal.psd_pod(hours(s, d), **WELCH).eig.agg(rounded(F.sum("lambda_re"), "trace")),
    "psdpod_eig_H": lambda s, d: modal.psd_pod(hours(s, d), **WELCH).eig.select("mode", rounded("lambda_re", "lambda")),
    "mpod_eig_H": lambda s, d: modal.mpod(hours(s, d), [0.0, 0.05, 0.2, 0.5]).eig.select("mode", "band", rounded("lambda_re", "lambda")),
    "bispectrum_H": lambda s, d: _bispectrum(hours(s, d)).select("p1", "p2", "p3", "s", rounded("re", "re"), rounded("im", "im")),
    "bsmd_eig_H": lambda s, d: _bsmd(hours(s, d)).eig.select(*[F.col(p).cast("long").alias(p) for p in ("p1", "p2", "p3")], rounded("modulus", "modulus", 4)),
    "bsmd_energy_map_H": lambda s, d: reports.energy_map(_bsmd(hours(s, d)), 8).select("p1", "p2", rounded(F.when(F.isnan("modulus"), -1.0).otherwise(F.col("modulus")), "modulus", 4)),
    "pod_eig_H": rows_only(lambda s, d: modal.pod(hours(s, d))),
    "pod_E": rows_only(lambda s, d: modal.pod(tables.vectors(s, d))),
    "pod_D": rows_only(lambda s, d: modal.pod(tables.daily_events(s, d))),
    "stpod_H": rows_only(lambda s, d: modal.stpod(hours(s, d), delays=10)),
    "spod_H_full": rows_only(lambda s, d: modal.spod(hours(s, d), nfft=48)),
    "bsmd_H_full": rows_only(lambda s, d: modal.bsmd(hours(s, d), nfft=48)),
    "dmd_M": rows_only(lambda s, d: modal.dmd(tables.monthly_orders(s, d), rank="energy")),
    "dmd_tls_M": rows_only(lambda s, d: modal.dmd(tables.monthly_orders(s, d), rank=5, method="tls")),
    "hodmd_M": rows_only(lambda s, d: modal.hodmd(tables.monthly_orders(s, d), rank="svht", delays=4)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return sql.queries()
