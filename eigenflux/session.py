"""Session with the settings that the kernels expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "eigenflux", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, one BLAS thread a Python worker; other settings by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.executorEnv.OMP_NUM_THREADS": os.environ.get("EIGENFLUX_BLAS_THREADS", "1"),
        "spark.executorEnv.OPENBLAS_NUM_THREADS": os.environ.get("EIGENFLUX_BLAS_THREADS", "1"),
    }
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
