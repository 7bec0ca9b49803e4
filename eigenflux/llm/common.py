"""Shared folder handling and small helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark deletes an execution's shuffle files when it ends.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows a batch for jobs that run inside."""
    bound_batches(spark, rows)
    try:
        yield
    finally:
        bound_batches(spark)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that are done; it acts when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Hands what this Python process has freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; at a task's end its worker, which waits for others, holds nothing that the task has freed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (master ``local``) gets a folder in its warehouse; on a cluster that raises,
    as no folder is known to be shared there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written inside the scopes that are open, innermost last.
_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


class Scope:
    """What ``scratch`` hands out."""

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written so that it outlives the scope (a scope further out still ends it)."""
        return materialize(df, name, outer=1)


@contextlib.contextmanager
def scratch() -> Iterator[Scope]:
    """Deletes at its end every table that ``materialize`` wrote inside it, but for ``result``'s."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield Scope()
    finally:
        for df in _scopes.get()[-1]:
            discard(df)
        _scopes.reset(token)


def materialize(df: DataFrame, name: str, *, outer: int = 0, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    kept = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")  # nothing but this write reads its shuffle files
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_FILE_CLEANUP) if kept is None else spark.conf.set(_FILE_CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._eigenflux_path = path  # noqa: SLF001  for discard()
    scopes = _scopes.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing that still reads it may run afterwards."""
    path = getattr(df, "_eigenflux_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(p, True)


def free_names(keep: tuple[str, ...], results: tuple[str, ...]) -> None:
    """Raises where columns to keep are named like the columns that an operator adds, or twice."""
    if len({*keep, *results}) < len(keep) + len(results):
        raise ValueError(f"columns to keep {list(keep)} may neither repeat nor be named like results {list(results)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Size for choosing numbers of shards: Catalyst's estimate where the input is files, else half the text's bytes."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < 1 << 50:
        return estimate
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0) // 2  # no estimate for rows that are not files


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % n


def _spread(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x >> np.uint64(20)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Marks of a long column's values in ``bits`` bits, a power of two: no false negatives, size fixed."""

    def mark(batches):
        out = np.zeros(bits // 64, np.uint64)
        for b in batches:
            at = _spread(b.column(0).drop_null().to_numpy(zero_copy_only=False)) % np.uint64(bits)
            np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        w = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(out[w].view(np.int64), pa.int64())], names=["w", "bits"])

    words = df.select(F.col(column).cast("long")).mapInArrow(mark, "w int, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits"))
    got = words.toPandas()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bitmap(marks: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each value may be marked; nulls are not."""
    at = _spread(column.fill_null(0).to_numpy(zero_copy_only=False)) % np.uint64(64 * len(marks))
    hit = (marks[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
    return (hit == 1) & column.is_valid().to_numpy(zero_copy_only=False)
