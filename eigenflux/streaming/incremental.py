"""Exact incremental decomposition: counts, means and products of snapshots add up over micro-batches.

Each micro-batch writes its sums below ``path/batch=<id>`` and replaces them if it is run again, so a restarted stream counts
nothing twice; the decomposition reads all batches. Only the square of the number of places reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eigenflux.operators import modal, tall


def hourly_snapshots(events: DataFrame, kinds: list[str], late: str = "2 hours") -> DataFrame:
    """Stream of ``window start, v``: sums of ``value`` by event type in each hour, closed by a watermark on ``ts``."""
    sums = [F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)) for k in kinds]
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour")).agg(F.array(*sums).alias("v")).select(F.col("window.start").alias("hour"), "v")


class IncrementalPOD:
    """Sums of a stream of snapshot arrays of one length."""

    def __init__(self, spark: SparkSession, path: str, n_space: int):
        tall._guard(n_space)
        self.spark, self.path, self.n = spark, path.rstrip("/"), n_space

    def add(self, rows: DataFrame, batch: int) -> None:
        """Sums of one batch's ``v`` arrays."""
        n = self.n

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total, square = 0, np.zeros(n), np.zeros((n, n))
            for b in batches:
                x = tall.matrix(b.column(0))
                if len(x):
                    count, total, square = count + len(x), total + x.sum(0), square + x.T @ x
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tobytes()]), pa.array([square.tobytes()])], names=["n", "total", "square"])

        rows.select("v").mapInArrow(sums, "n long, total binary, square binary").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def attach(self, snapshots: DataFrame, checkpoint: str) -> StreamingQuery:
        """Feed a stream of snapshots until it is stopped."""
        return snapshots.writeStream.foreachBatch(lambda df, i: self.add(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def eigen(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Snapshots seen, eigenvalues of their covariance and modes."""
        count, total, square = 0, np.zeros(self.n), np.zeros((self.n, self.n))
        for r in self.spark.read.parquet(self.path).toLocalIterator():  # one row a partition of each batch
            count += r["n"]
            total += np.frombuffer(r["total"])
            square += np.frombuffer(r["square"]).reshape(self.n, self.n)
        if not count:
            return 0, np.zeros(0), np.zeros((self.n, 0))
        mean = total / count
        values, vectors = modal._rayleigh(square / count - np.outer(mean, mean))
        return count, values, vectors
