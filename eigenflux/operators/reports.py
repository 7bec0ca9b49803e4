"""Plot-ready tables: energies, errors, checks, correlations, limits, periodograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenflux.dataset import Dataset
from eigenflux.results import Result


def cumulative(result: Result) -> DataFrame:
    """``mode, pct, cum_pct`` of the total energy (of what is kept, where the total is unknown)."""
    total = result.attrs.get("total_energy")
    whole = F.lit(float(total)) if total else F.sum("lambda_re").over(Window.partitionBy())
    running = F.sum("lambda_re").over(Window.orderBy(F.desc("lambda_re"), "mode").rowsBetween(Window.unboundedPreceding, 0))
    return result.eig.select("mode", (100 * F.col("lambda_re") / whole).alias("pct"), (100 * running / whole).alias("cum_pct"))


def modes_for(result: Result, threshold: float) -> int:
    """Modes needed to pass a share of the energy in percent."""
    row = cumulative(result).where(F.col("cum_pct") > threshold).agg(F.min("mode")).first()
    return int(row[0]) + 1 if row[0] is not None else result.eig.count()


def _by_mode(table: DataFrame, key: str, name: str) -> DataFrame:
    """``key`` and ``name``: an array of (re, im) in order of modes."""
    pairs = F.array_sort(F.collect_list(F.struct("mode", "re", "im")))
    return table.groupBy(key).agg(pairs.alias(name))


def reconstruction(data: Dataset, result: Result, counts: list[int] | None = None) -> DataFrame:
    """``k, error_pct``: the unweighted norm of what ``k`` modes leave, in percent of the centred norm."""
    n = result.eig.count()
    counts = counts or list(range(1, n + 1))
    both = data.centred().join(_by_mode(result.coef, "t", "c"), "t").join(_by_mode(result.modes, "s", "p"), "s")
    terms = F.zip_with("c", "p", lambda c, p: c["re"] * p["re"])
    both = both.select("q", terms.alias("terms")).withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in counts])))
    left = F.col("q") - F.aggregate(F.slice("terms", 1, F.col("k")), F.lit(0.0), lambda a, x: a + x)
    sums = both.select("k", "q", left.alias("left")).groupBy("k").agg(F.sum(F.col("left") ** 2).alias("r"), F.sum(F.col("q") ** 2).alias("q2"))
    return sums.select("k", (100 * F.sqrt(F.col("r") / F.col("q2"))).alias("error_pct"))


def evolution_error(data: Dataset, result: Result) -> DataFrame:
    """One row ``error_pct``: what dynamic modes leave of the field as it is, in percent of its norm (first delay of each mode)."""
    modes = result.modes.where("d = 0")
    both = data.long.join(_by_mode(result.coef, "t", "c"), "t").join(_by_mode(modes, "s", "p"), "s")
    terms = F.zip_with("c", "p", lambda c, p: c["re"] * p["re"] - c["im"] * p["im"])
    left = F.col("q") - F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    sums = both.select("q", left.alias("left")).agg(F.sum(F.col("left") ** 2).alias("r"), F.sum(F.col("q") ** 2).alias("q2"))
    return sums.select((100 * F.sqrt(F.col("r") / F.col("q2"))).alias("error_pct"))


def orthogonality(data: Dataset, result: Result) -> DataFrame:
    """``i, j, inner``: weighted products of the modes, and of a space-time mode over all delays."""
    keys = ["d", "s"] if "d" in result.modes.columns else ["s"]
    m = result.modes.join(data.grid.select("s", "w"), "s")
    a = m.select(*keys, F.col("mode").alias("i"), F.col("re").alias("x"), "w")
    b = m.select(*keys, F.col("mode").alias("j"), F.col("re").alias("y"))
    return a.join(b, keys).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("x") * F.col("y")).alias("inner"))


def coefficient_gram(result: Result, n: int) -> DataFrame:
    """``i, j, inner``: products of the coefficients over time, divided by the number of times."""
    a = result.coef.select("t", F.col("mode").alias("i"), F.col("re").alias("x"))
    b = result.coef.select("t", F.col("mode").alias("j"), F.col("re").alias("y"))
    return a.join(b, "t").where("i <= j").groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) / n).alias("inner"))


def pair_correlation(result: Result) -> DataFrame:
    """``i, j, r``: correlation of coefficient pairs."""
    a = result.coef.select("t", F.col("mode").alias("i"), F.col("re").alias("x"))
    b = result.coef.select("t", F.col("mode").alias("j"), F.col("re").alias("y"))
    return a.join(b, "t").where("i < j").groupBy("i", "j").agg(F.corr("x", "y").alias("r"))


def mode_pairs(result: Result, start: int = 0, threshold: float = 0.9) -> list[tuple[int, int]]:
    """Pairs of modes with equal energy and a quarter turn between them: correlation of one with the other's quadrature.

    A greedy pass in order of modes; the search goes on behind a found pair's second mode.
    """
    table = result.coef.toPandas().pivot(index="t", columns="mode", values="re").to_numpy()
    found, i = [], start
    while i < table.shape[1] - 1:
        hit = None
        for j in range(i + 1, table.shape[1]):
            spectrum = np.fft.fft(table[:, j])
            half = np.sign(np.fft.fftfreq(len(spectrum)))
            quadrature = np.fft.ifft(-1j * half * spectrum).real
            if abs(np.corrcoef(table[:, i], quadrature)[0, 1]) >= threshold:
                hit = j
                break
        if hit is not None:
            found.append((i, hit))
        i = hit + 1 if hit is not None else i + 1
    return found


def limits(values: DataFrame, column: str, method: str = "percentile") -> DataFrame:
    """One row ``low, high``: symmetric limits that outliers do not stretch."""
    x = F.col(column)
    finite = values.where(~F.isnan(x) & (F.abs(x) < float("inf")))
    if method == "percentile":
        q = finite.agg(F.percentile(column, F.array(F.lit(0.02), F.lit(0.98))).alias("q")).select(F.greatest(F.abs(F.col("q")[0]), F.abs(F.col("q")[1])).alias("m"))
    elif method == "sigma":
        middle = finite.agg(F.median(column).alias("med"))
        spread = finite.crossJoin(F.broadcast(middle)).agg(F.median(F.abs(x - F.col("med"))).alias("mad"), F.first("med").alias("med"))
        reach = 2.5 * 1.4826 * F.col("mad")
        q = spread.select(F.greatest(F.abs(F.col("med") - reach), F.abs(F.col("med") + reach)).alias("m"))
    elif method == "minmax":
        q = finite.agg(F.max(F.abs(x)).alias("m"))
    else:
        raise ValueError(f"unknown method {method!r}")
    m = F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    return q.select((-m).alias("low"), m.alias("high"))


def periodogram(long: DataFrame, n: int, dt: float, key: str = "s") -> DataFrame:
    """``key, f, freq, power``: one-sided density of each series less its mean; times without a value count as the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = np.full(n // 2 + 1, 2.0)
        sides[0] = 1.0
        if n % 2 == 0:
            sides[-1] = 1.0
        for b in batches:
            for k, at, v in zip(b.column(0), b.column(1), b.column(2)):
                x, t = np.asarray(v.values, np.float64), np.asarray(at.values)
                full = np.zeros(n)
                np.add.at(full, t % n, x - x.mean())
                power = sides * np.abs(np.fft.rfft(full)) ** 2 * dt / n
                f = np.arange(len(power))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(f), b.schema.field(0).type), pa.array(f), pa.array(f / (n * dt)), pa.array(power)], names=[key, "f", "freq", "power"])

    pairs = F.array_sort(F.collect_list(F.struct("t", "q")))
    series = long.groupBy(key).agg(pairs.alias("p")).select(key, F.col("p.t").alias("t"), F.col("p.q").alias("q"))
    return series.mapInArrow(run, f"{key} {dict(long.dtypes)[key]}, f long, freq double, power double")


def peaks(spectrum: DataFrame, k: int, key: str = "s") -> DataFrame:
    """The ``k`` largest peaks of each series of ``periodogram``: bins above both neighbours, ``rank`` from 0; ties by bin."""
    by = Window.partitionBy(key).orderBy("f")
    beside = spectrum.withColumn("before", F.lag("power").over(by)).withColumn("after", F.lead("power").over(by))
    found = beside.where("power > before and power > after").drop("before", "after")
    order = Window.partitionBy(key).orderBy(F.desc("power"), "f")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)


def unwrapped(table: DataFrame, by: list[str], order: str) -> DataFrame:
    """``by``, ``order``, ``phase`` of ``re`` and ``im``, without jumps of more than half a turn from one row of a group to the next."""
    rows = Window.partitionBy(*by).orderBy(order)
    raw = table.select(*by, order, F.atan2("im", "re").alias("raw"))
    step = F.col("raw") - F.lag("raw").over(rows)
    turns = F.when(step > F.pi(), -1).when(step < -F.pi(), 1).otherwise(0)
    raw = raw.withColumn("turns", turns)
    total = F.sum("turns").over(rows.rowsBetween(Window.unboundedPreceding, 0))
    return raw.select(*by, order, (F.col("raw") + 2 * F.pi() * total).alias("phase"))


def movie(result: Result, mode: int) -> DataFrame:
    """``d, time, s, re``: the frames of a space-time mode, one a delay."""
    dt = float(result.attrs.get("dt") or 1.0)
    return result.modes.where(F.col("mode") == mode).select("d", (F.col("d") * F.lit(dt)).alias("time"), "s", "re")


def energy_map(result: Result, limit: int) -> DataFrame:
    """``p1, p2, modulus`` over the full square of bins; NaN where nothing was analysed."""
    span = result.eig.sparkSession.range(-limit, limit + 1)
    square = span.select(F.col("id").alias("p1")).crossJoin(span.select(F.col("id").alias("p2")))
    found = result.eig.select(F.col("p1").cast("long"), F.col("p2").cast("long"), "modulus")
    return square.join(found, ["p1", "p2"], "left").select("p1", "p2", F.coalesce("modulus", F.lit(float("nan"))).alias("modulus"))


def band_counts(result: Result) -> DataFrame:
    """``band, n``: modes that each band has."""
    return result.eig.groupBy("band").agg(F.count("*").alias("n"))


def missing_bins(triads: list[tuple[int, int, int]], cached: DataFrame) -> DataFrame:
    """``f``: distinct frequency bins that the triads need and ``cached(f)`` lacks."""
    spark = cached.sparkSession
    needed = spark.createDataFrame([(abs(p),) for triad in triads for p in triad], "f long").distinct()
    return needed.join(cached.select(F.col("f").cast("long").alias("f")), "f", "left_anti")


def top_triads(result: Result, k: int) -> DataFrame:
    return result.eig.where(~F.isnan("modulus")).orderBy(F.desc("modulus"), "triad").limit(k)


def peak(result: Result) -> DataFrame:
    """The frequency of the largest leading eigenvalue."""
    return result.eig.where("mode = 0").agg(F.max_by(F.struct("f", "freq"), F.struct("lambda_re", -F.col("f"))).alias("p"), F.max("lambda_re").alias("lambda")).select("p.f", "p.freq", "lambda")


def masked(modes: DataFrame, grid: DataFrame, radius: float = 0.5) -> DataFrame:
    """Modes with coordinates, NaN inside a cylinder at the origin."""
    inside = F.col("x") ** 2 + F.col("y") ** 2 <= radius**2
    both = modes.join(grid, "s")
    hide = lambda c: F.when(inside, float("nan")).otherwise(F.col(c)).alias(c)
    return both.select("mode", "s", "x", "y", "z", hide("re"), hide("im"))


def volume(modes: DataFrame, grid: DataFrame, xlim=None, ylim=None, zlim=None) -> DataFrame:
    """Modes with their grid places, cropped to coordinate limits."""
    out = modes.join(grid, "s")
    for name, lim in (("x", xlim), ("y", ylim), ("z", zlim)):
        if lim is not None:
            out = out.where(F.col(name).between(*lim))
    return out


def modulus(re: str = "re", im: str = "im") -> Column:
    return F.hypot(re, im)
