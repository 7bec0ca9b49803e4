"""A field over time and space as DataFrames: ``long(t, s, q)``, ``grid(s, ix, iy, iz, x, y, z, w)`` and scalars.

Two array layouts come from ``long`` by one shuffle each: ``series`` (a row for each place, values in order of time) and
``snapshots`` (a row for each time, values in order of place).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "s long, ix int, iy int, iz int, x double, y double, z double, w double"


REDUCTIONS = {"min": F.min, "max": F.max, "mean": F.avg}


def reduction(kind: str):
    if kind not in REDUCTIONS:
        raise ValueError(f"unknown reduction {kind!r}; one of {sorted(REDUCTIONS)}")
    return REDUCTIONS[kind]


def positive(name: str, value: Any, source: str = "data") -> float:
    """A positive finite scalar, or ``ValueError`` that names its source."""
    try:
        number = float(np.asarray(value).reshape(()))
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} of {source} must be one number, got {value!r}") from e
    if not np.isfinite(number) or number <= 0 or isinstance(value, bool):
        raise ValueError(f"{name} of {source} must be positive and finite, got {value!r}")
    return number


@dataclass(frozen=True)
class Dataset:
    """Field with ``n_time`` x ``n_space`` values; every (t, s) occurs once."""

    long: DataFrame
    grid: DataFrame
    dt: float
    n_time: int
    n_space: int
    shape: tuple[int, int, int] = (0, 0, 0)
    meta: dict[str, Any] = field(default_factory=dict)
    #: A ``long``, its ``snapshots``, their mean and the sums of products about it, of a source that stores snapshots; they
    #: hold while that is the field's ``long``.
    stored: tuple[DataFrame, DataFrame, np.ndarray, np.ndarray] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.long.sparkSession

    def check(self) -> Dataset:
        """Raise if the field is not dense, finite and of the claimed size, or ``dt`` is no step."""
        positive("dt", self.dt, str(self.meta.get("name", "data")))
        got = self.long.agg(
            F.count("*").alias("n"), F.countDistinct("t", "s").alias("d"), F.count(F.when(F.col("q").isNull() | F.isnan("q"), 1)).alias("bad"),
            F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("s").alias("s0"), F.max("s").alias("s1"),
        ).first()
        if got["n"] != self.n_time * self.n_space or got["d"] != got["n"]:
            raise ValueError(f"field has {got['n']} values, {got['d']} distinct places; expected {self.n_time} x {self.n_space}")
        if got["bad"]:
            raise ValueError(f"field has {got['bad']} values that are null or NaN")
        if got["n"] and (got["t0"], got["t1"], got["s0"], got["s1"]) != (0, self.n_time - 1, 0, self.n_space - 1):
            raise ValueError("t and s must count from 0 without gaps")
        if np.prod(self.shape) and int(np.prod([max(1, n) for n in self.shape])) != self.n_space:
            raise ValueError(f"grid {self.shape} does not have {self.n_space} places")
        return self

    def weighted(self) -> DataFrame:
        """``long`` with the metric column ``w``; the grid is broadcast only while it is small by its count."""
        grid = self.grid.select("s", "w")
        return self.long.join(F.broadcast(grid) if self.n_space <= 1_000_000 else grid, "s")

    def centred(self) -> DataFrame:
        """``long`` less the mean over time of each place."""
        mean = self.long.groupBy("s").agg(F.avg("q").alias("m"))
        return self.long.join(mean, "s").select("t", "s", (F.col("q") - F.col("m")).alias("q"))

    def reduced(self, kind: str) -> DataFrame:
        """One row ``v``: the least, greatest or mean value of the field (``min``, ``max``, ``mean``)."""
        return self.long.agg(reduction(kind)("q").alias("v"))

    def centredness(self) -> DataFrame:
        """One row ``ratio``: the largest mean of a place over the field's spread; infinite where the field is constant."""
        by = self.long.groupBy("s").agg(F.avg("q").alias("m"), F.count("*").alias("n"), F.var_pop("q").alias("v"))
        # the whole variance is the mean within places and the variance between their means
        all_ = by.agg(
            F.max(F.abs("m")).alias("top"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"),
            F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") ** 2).alias("s2"),
        )
        var = F.greatest(F.lit(0.0), F.col("within") + F.col("s2") - F.col("s1") ** 2 / F.col("n")) / F.col("n")
        return all_.select(F.when(var > 0, F.col("top") / F.sqrt(var)).otherwise(float("inf")).alias("ratio"))

    def is_centred(self, tolerance: float = 1e-6) -> bool:
        return bool(self.centredness().first()[0] < tolerance)

    def axis(self, count: int | None = None, times: list[float] | None = None) -> DataFrame:
        """``t, time``: ``times`` where there are enough, else steps of ``dt``, else sample numbers."""
        count = self.n_time if count is None else count
        if times is not None and len(times) >= count:
            return self.spark.createDataFrame([(k, float(x)) for k, x in enumerate(times[:count])], "t long, time double")
        step = self.dt if self.dt and self.dt > 0 else 1.0
        return self.spark.range(count).select(F.col("id").alias("t"), (F.col("id") * F.lit(float(step))).alias("time"))

    def series(self) -> DataFrame:
        """``s, w, v`` with the values of a place by time."""
        return _gather(self.weighted(), ["s", "w"], "t")

    def snapshots(self, *, narrow: bool = False) -> DataFrame:
        """``t, v`` with the values of a time by place; as they are stored where the source has them so.

        ``narrow`` leaves stored numbers in their own width, for kernels that widen them.
        """
        if not self.has_stored:
            return _gather(self.long, ["t"], "s")
        return self.stored[1] if narrow else self.stored[1].select("t", F.col("v").cast("array<double>").alias("v"))

    @property
    def has_stored(self) -> bool:
        return self.stored is not None and self.stored[0] is self.long

    def weights(self) -> np.ndarray:
        """The metric by place; for driver-side factors of at most ``n_space`` numbers."""
        rows = self.grid.select("s", "w").orderBy("s").toPandas()
        return rows["w"].to_numpy(np.float64)

    def first(self, n: int | None) -> Dataset:
        """The first ``n`` times; ignored below 2 or beyond the record."""
        if n is None or n < 2 or n >= self.n_time:
            return self
        return replace(self, long=self.long.where(F.col("t") < n), n_time=n)

    def strided(self, start: int = 0, stop: int | None = None, stride: int = 1) -> Dataset:
        """Times ``start, start + stride, ...`` below ``stop``, counted anew."""
        stop = self.n_time if stop is None else min(stop, self.n_time)
        if stride < 1 or start < 0 or start >= stop:
            raise ValueError("need stride >= 1 and 0 <= start < stop")
        keep = (F.col("t") >= start) & (F.col("t") < stop) & ((F.col("t") - start) % stride == 0)
        long = self.long.where(keep).select(F.floor((F.col("t") - start) / stride).cast("long").alias("t"), "s", "q")
        return replace(self, long=long, n_time=-(-(stop - start) // stride), dt=self.dt * stride)

    def crop(self, where: Column, stride: tuple[int, int, int] = (1, 1, 1)) -> Dataset:
        """Places that fulfil a condition on the grid and the strides, numbered anew in order."""
        from pyspark.sql import Window

        keep = where & (F.col("ix") % stride[0] == 0) & (F.col("iy") % stride[1] == 0) & (F.col("iz") % stride[2] == 0)
        ranked = self.grid.where(keep)
        for axis in ("ix", "iy", "iz"):
            ranked = ranked.withColumn(f"new_{axis}", F.dense_rank().over(Window.orderBy(axis)) - 1)
        top = ranked.agg(*[F.max(f"new_{a}").alias(a) for a in ("ix", "iy", "iz")]).first()
        nx, ny, nz = (int(v) + 1 if v is not None else 0 for v in top)
        new = ((F.col("new_ix") * ny + F.col("new_iy")) * nz + F.col("new_iz")).cast("long")
        ranked = ranked.withColumn("new_s", new)
        long = self.long.join(F.broadcast(ranked.select("s", "new_s")), "s").select("t", F.col("new_s").alias("s"), "q")
        grid = ranked.select(F.col("new_s").alias("s"), *[F.col(f"new_{a}").cast("int").alias(a) for a in ("ix", "iy", "iz")], "x", "y", "z", "w")
        return replace(self, long=long, grid=grid, n_space=nx * ny * nz, shape=(nx, ny, nz))

    def nearest(self, axis: str, value: float) -> int:
        """Index along ``x``, ``y`` or ``z`` of the grid coordinate nearest to a value, the first of equals."""
        at = F.min_by(f"i{axis}", F.struct(F.abs(F.col(axis) - F.lit(float(value))), f"i{axis}"))
        found = self.grid.agg(at).first()[0]
        if found is None:
            raise ValueError("the grid has no place")
        return int(found)

    def along_track(self, track: DataFrame, kind: str = "min", *, offset: float = 0.0, y_max: float | None = None) -> Dataset:
        """The field from the x nearest to the ``min``, ``max`` or ``mean`` of ``track(v)`` plus ``offset`` on.

        With ``y_max``, only places before the y nearest to it.
        """
        start = track.agg(reduction(kind)("v")).first()[0]
        if start is None:
            raise ValueError("the track has no value")
        keep = F.col("ix") >= self.nearest("x", start + offset)
        if y_max is not None:
            keep = keep & (F.col("iy") < self.nearest("y", y_max))
        return self.crop(keep)

    def with_metric(self, kind: str | None = "uniform", values: Any = None) -> Dataset:
        """The field with a ``uniform``, ``polar`` or ``prescribed`` metric."""
        from eigenflux.functions import metric

        return replace(self, grid=metric.apply(self.grid, self.n_space, kind, values))


def _gather(long: DataFrame, key: list[str], order: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(order, "q")))
    return long.groupBy(*key).agg(F.transform(pairs, lambda p: p["q"]).alias("v"))


def plain_grid(spark: SparkSession, n: int) -> DataFrame:
    """Places on a line with unit weights."""
    return spark.range(n).select(
        F.col("id").alias("s"), F.col("id").cast("int").alias("ix"), F.lit(0).alias("iy"), F.lit(0).alias("iz"),
        F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("w"),
    )


def mesh(spark: SparkSession, x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> DataFrame:
    """Tensor grid in C order with unit weights; axes are literals of the plan."""
    axes = [np.asarray(a, np.float64).reshape(-1) for a in (x, y, [0.0] if z is None else z)]
    nx, ny, nz = map(len, axes)
    frame = spark.range(nx * ny * nz).withColumnRenamed("id", "s")
    index = {"ix": F.floor(F.col("s") / (ny * nz)), "iy": F.floor(F.col("s") / nz) % ny, "iz": F.col("s") % nz}
    frame = frame.select("s", *[v.cast("int").alias(k) for k, v in index.items()])
    for name, axis in zip("xyz", axes):
        values = F.array(*[F.lit(float(v)) for v in axis]) if len(axis) <= 4096 else None
        if values is None:
            step = spark.createDataFrame(list(enumerate(map(float, axis))), f"i{name} int, {name} double")
            frame = frame.join(step, f"i{name}")
        else:
            frame = frame.withColumn(name, F.element_at(values, F.col(f"i{name}") + 1))
    return frame.select("s", "ix", "iy", "iz", "x", "y", "z", F.lit(1.0).alias("w"))


def from_array(spark: SparkSession, q: np.ndarray, dt: float, *, x=None, y=None, z=None, meta: dict | None = None, w=None) -> Dataset:
    """A small in-memory snapshot matrix (times by places)."""
    q = np.asarray(q, np.float64)
    n, m = q.shape
    rows = spark.createDataFrame([(t, row.tolist()) for t, row in enumerate(q)], "t long, v array<double>")
    long = rows.select("t", F.posexplode("v").alias("s", "q")).select("t", F.col("s").cast("long").alias("s"), "q")
    scattered = x is not None and y is not None and len(np.ravel(x)) == len(np.ravel(y)) == m and m > 1
    if x is None or scattered:
        grid, shape = plain_grid(spark, m), (m, 1, 1)
        if scattered:
            cloud = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.ravel(x), np.ravel(y)))], "s long, x double, y double")
            grid = grid.drop("x", "y").join(cloud, "s").select("s", "ix", "iy", "iz", "x", "y", "z", "w")
    else:
        y = [0.0] if y is None else y
        grid, shape = mesh(spark, x, y, z), (len(x), len(y), 1 if z is None else len(z))
        if int(np.prod(shape)) != m:
            raise ValueError(f"grid {shape} does not have {m} places")
    out = Dataset(long, grid, positive("dt", dt), n, m, shape, dict(meta or {}))
    return out if w is None else out.with_metric("prescribed", w)


def densify(sparse: DataFrame, n_time: int, n_space: int, dt: float, meta: dict | None = None) -> Dataset:
    """``(t, s, q)`` with missing places of the grid as 0; values of one place and time add up."""
    spark = sparse.sparkSession
    times = spark.range(n_time).withColumnRenamed("id", "t")
    places = spark.range(n_space).withColumnRenamed("id", "s")
    filled = times.crossJoin(F.broadcast(places)).withColumn("q", F.lit(0.0))  # the field's own size, by definition
    summed = filled.unionByName(sparse.select("t", "s", F.col("q").cast("double").alias("q"))).groupBy("t", "s").agg(F.sum("q").alias("q"))
    return Dataset(summed, plain_grid(spark, n_space), dt, n_time, n_space, (n_space, 1, 1), dict(meta or {}))
