"""Tall matrices: DataFrames whose rows hold one array ``v`` of ``k`` numbers (``re``/``im`` pairs side by side if complex).

Products over the rows are summed inside each partition in numpy and then across partitions in pieces; only ``k x k`` results
reach the driver, and ``k`` is held below ``MOST``. Row-wise products with a small factor need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest order of a matrix that the driver factorises.
MOST = 8192


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _guard(k: int) -> None:
    if k > MOST:
        raise ValueError(f"the smaller side has {k} entries, above {MOST}; where the method takes a solver, use 'randomized'")


def reduce_sum(
    df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], join: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add
) -> dict[int, np.ndarray]:
    """Sum of the arrays that ``each`` makes of a partition, by key, or what ``join`` makes of two; complex arrays are kept as pairs."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, a in each(batches).items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([list(a.shape)], pa.list_(pa.int64())), pa.array([a.dtype.kind == "c"]), pa.array([a.tobytes()], pa.binary())],
                names=["key", "shape", "is_complex", "data"],
            )

    kind = "key long, shape array<long>, is_complex boolean, data binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        shape = {}
        for b in batches:
            for key, dims, cplx, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                a = np.frombuffer(data, np.complex128 if cplx else np.float64).reshape(dims)
                total[key] = join(total[key], a) if key in total else a.copy()
                shape[key] = (dims, cplx)
        for key, a in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([shape[key][0]], pa.list_(pa.int64())), pa.array([shape[key][1]]), pa.array([a.tobytes()], pa.binary())],
                names=["key", "shape", "is_complex", "data"],
            )

    sums = df.mapInArrow(part, kind).repartition("key").mapInArrow(add, kind)
    return {r["key"]: np.frombuffer(r["data"], np.complex128 if r["is_complex"] else np.float64).reshape(r["shape"]) for r in sums.toLocalIterator()}


#: What is done to a batch of rows before a product, where something is.
Each = Callable[[np.ndarray], np.ndarray] | None


def _rows(column: pa.Array, each: Each) -> np.ndarray:
    x = matrix(column)
    x = x.astype(np.float64) if x.dtype == np.float32 else x  # what is stored narrow is widened here, not on its way
    return x if each is None or not len(x) else each(x)


def gram(rows: DataFrame, k: int, of: Each = None) -> np.ndarray:
    """``V^T V`` of the rows' arrays."""
    _guard(k)

    def each(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((k, k))
        for b in batches:
            x = _rows(b.column(0), of)
            if len(x):
                total += x.T @ x
        return {0: total}

    return reduce_sum(rows.select("v"), each).get(0, np.zeros((k, k)))


def _pooled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of both of two sets of rows: a row that begins with their number, their means, the sums of products about these."""
    n, m = a[0, 0], b[0, 0]
    if not n or not m:
        return a if n else b
    apart = b[1] - a[1]
    out = a + b
    out[1] = a[1] + apart * (m / (n + m))
    out[2:] += np.outer(apart, apart) * (n * m / (n + m))
    return out


def moments(rows: DataFrame, k: int) -> tuple[int, bool, np.ndarray, np.ndarray]:
    """Of rows ``t, v`` their number, whether all are whole (a key and ``k`` numbers), and if so the mean of their arrays and
    ``V^T V`` of the arrays less that mean, in one reading of the rows.

    Each batch is centred by its own mean and then pooled with the others, so a large mean costs no digits.
    """
    _guard(k)

    def each(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total, broken = np.zeros((k + 2, k)), np.zeros((k + 2, k))
        for b in batches:
            v = b.column(1)
            own = np.zeros((k + 2, k))
            own[0, 0] = len(v)
            if b.column(0).null_count or v.null_count or (np.diff(np.asarray(v.offsets)) != k).any() or v.flatten().null_count:
                broken = _pooled(broken, own)
            elif len(v):
                x = _rows(v, None)
                own[1] = x.mean(0)
                x = x - own[1]
                own[2:] = x.T @ x
                total = _pooled(total, own)
        return {0: total, 1: broken}

    got = reduce_sum(rows.select("t", "v"), each, _pooled)
    none = np.zeros((k + 2, k))
    total, broken = got.get(0, none), got.get(1, none)
    return int(total[0, 0] + broken[0, 0]), not broken[0, 0], total[1], total[2:]


def triangle(rows: DataFrame, k: int, column: str = "v") -> np.ndarray:
    """``R`` of a QR factorisation: by partition, then over the stacked factors; the data are never squared."""
    _guard(k)
    block = max(2 * k, 512)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = np.zeros((0, k)), [], 0
        for b in batches:
            held.append(matrix(b.column(0)))
            n += len(held[-1])
            if n >= block:
                r = np.linalg.qr(np.concatenate([r, *[h for h in held if len(h)]]), mode="r")
                held, n = [], 0
        if n:
            r = np.linalg.qr(np.concatenate([r, *[h for h in held if len(h)]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([lists(r)], names=["v"])

    parts = rows.select(F.col(column).alias("v")).mapInArrow(factor, "v array<double>")
    parts = parts.coalesce(8).mapInArrow(factor, "v array<double>")  # a tree of two levels
    stacked = np.array([r["v"] for r in parts.toLocalIterator()], np.float64).reshape(-1, k)
    return np.linalg.qr(stacked, mode="r") if len(stacked) else np.zeros((0, k))


def times(rows: DataFrame, factor: np.ndarray, keep: list[str], *, scale: str | None = None, out: str = "m", of: Each = None) -> DataFrame:
    """Row by row ``v @ factor`` (divided by ``sqrt(scale)``, 0 where that is 0); real parts then imaginary parts if complex."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(np.asarray(factor))
    chosen = rows.select(*keep, *([F.col(scale).alias("__scale")] if scale else []), "v")
    schema = T.StructType([*[f for f in chosen.schema.fields if f.name in keep], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = _rows(b.column(b.num_columns - 1), of)
            y = x @ f if len(x) else np.zeros((0, f.shape[1]), f.dtype)
            if scale:
                w = np.asarray(b.column(len(keep)))
                y = np.where(w[:, None] > 0, y / np.sqrt(np.where(w > 0, w, 1))[:, None], 0.0)
            if np.iscomplexobj(y):
                y = np.concatenate((y.real, y.imag), 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists(y.astype(np.float64))], names=[*keep, out])

    return chosen.mapInArrow(run, schema)


def _climbing(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are, in order of keys, larger in some column than all before them; equal rows leave only the first."""
    order = np.argsort(keys, kind="stable")
    keys, x = keys[order], x[order]
    top = np.maximum.accumulate(np.abs(x))
    before = np.concatenate((np.zeros((1, x.shape[1])), top[:-1]))
    rise = (np.abs(x) > before).any(1)
    return keys[rise], x[rise]


def pivots(modes: DataFrame, key: str, r: int, column: str = "m", complex_: bool = False) -> np.ndarray:
    """Of each mode, its value at the first key within a tie of the largest magnitude, over distributed rows."""
    from eigenflux.functions.numeric import TIE

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            x = matrix(b.column(1))
            if len(x):
                x = x[:, :r] + 1j * x[:, r:] if complex_ else x
                keys = np.asarray(b.column(0))
                if held:
                    x, keys = np.concatenate((held[0][1], x)), np.concatenate((held[0][0], keys))
                size = np.abs(x)
                keep = (size >= size.max(0) * (1 - 2 * TIE)).any(1)
                held = [_climbing(keys[keep], x[keep])]
        for keys, x in held:
            y = np.concatenate((x.real, x.imag), 1) if complex_ else x
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(y)], names=["k", "v"])

    rows = modes.select(F.col(key).cast("long").alias("k"), F.col(column).alias("v")).mapInArrow(best, "k long, v array<double>").orderBy("k").collect()
    if not rows:
        return np.ones(r)
    x = np.array([row["v"] for row in rows])
    x = x[:, :r] + 1j * x[:, r:] if complex_ else x
    size = np.abs(x)
    at = (size >= size.max(0) * (1 - TIE)).argmax(0)
    return x[at, np.arange(r)]


def exploded(wide: DataFrame, key: str, r: int, column: str = "m", complex_: bool = False) -> DataFrame:
    """``mode, key, re, im`` of rows that hold all modes."""
    both = wide.select(key, F.posexplode(F.slice(column, 1, r)).alias("mode", "re"), F.col(column).alias("__m"))
    im = F.element_at("__m", F.col("mode") + 1 + r) if complex_ else F.lit(0.0)
    return both.select("mode", key, "re", im.alias("im"))


def randomized(rows: DataFrame, k: int, rank: int, *, oversample: int = 10, power: int = 2, seed: int = 0, of: Each = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors by a randomized range finder with re-orthonormalised power steps."""
    rng = np.random.default_rng(seed)
    width = min(rank + oversample, k)
    basis = np.linalg.qr(rng.standard_normal((k, width)))[0]
    for _ in range(power):
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> dict[int, np.ndarray]:
            total = np.zeros((k, width))
            for b in batches:
                x = _rows(b.column(0), of)
                if len(x):
                    total += x.T @ (x @ shared.value)
            return {0: total}

        basis = np.linalg.qr(reduce_sum(rows.select("v"), each)[0])[0]
    r = triangle(times(rows, basis, [], out="v", of=of), width)
    _, s, vt = np.linalg.svd(r)
    return s[:rank], (basis @ vt.T)[:, :rank]
