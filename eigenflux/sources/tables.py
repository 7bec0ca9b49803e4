"""Fields from event, order and vector tables: bucketed in time, zero-filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenflux.dataset import Dataset, densify, plain_grid
from eigenflux.operators import tall

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def _index(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a category with their place in order; categories are few by nature."""
    from pyspark.sql import Window

    return df.select(column).distinct().withColumn("s", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))


def hourly_events(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> Dataset:
    """H: hours of January 2024 by event type, sum of ``value``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events = events if types is None else events.where(F.col("event_type").isin(types))
    kinds = _index(events, "event_type")
    rows = events.join(F.broadcast(kinds), "event_type").select(F.expr(f"timestampdiff(HOUR, {EPOCH}, ts)").alias("t"), "s", F.col("value").alias("q"))
    rows = rows.where("t >= 0 and t < 720").groupBy("t", "s").agg(F.sum("q").alias("q"))
    return densify(rows, 720, kinds.count(), 1.0, {"name": "hourly events"})


def daily_events(spark: SparkSession, sf_dir: str) -> Dataset:
    """D: days of January 2024 by hour of day and event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    kinds = _index(events, "event_type")
    n = kinds.count()
    rows = events.join(F.broadcast(kinds), "event_type").select(F.expr(f"timestampdiff(HOUR, {EPOCH}, ts)").alias("h"), "s", F.col("value").alias("q"))
    rows = rows.where("h >= 0 and h < 720").select(F.floor(F.col("h") / 24).alias("t"), ((F.col("h") % 24) * n + F.col("s")).alias("s"), "q")
    return densify(rows.groupBy("t", "s").agg(F.sum("q").alias("q")), 30, 24 * n, 1.0, {"name": "daily events"})


def monthly_orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """M: months from January 1995 by order priority, sum of prices."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderpriority", "o_totalprice")
    kinds = _index(orders, "o_orderpriority")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    rows = orders.join(F.broadcast(kinds), "o_orderpriority").select(month.cast("long").alias("t"), "s", F.col("o_totalprice").alias("q"))
    rows = rows.where("t >= 0 and t < 80").groupBy("t", "s").agg(F.sum("q").alias("q"))
    return densify(rows, 80, kinds.count(), 1.0, {"name": "monthly orders"})


def vectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """E: stored vectors as snapshots, ordered by id (ids count from 0); the rows serve as they are where all are whole."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.col("embedding").alias("v"))
    n, whole, mean, products = tall.moments(rows, 64)
    long = rows.select("t", F.posexplode("v").alias("s", "q"))
    long = long.select("t", F.col("s").cast("long").alias("s"), F.col("q").cast("double").alias("q"))
    return Dataset(long, plain_grid(spark, 64), 1.0, n, 64, (64, 1, 1), {"name": "vectors"}, (long, rows, mean, products) if whole else None)
