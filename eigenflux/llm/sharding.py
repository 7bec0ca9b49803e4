"""Sharding by size-tiered compaction with a versioned manifest, in DataFrame operations only.

A dataset is a folder: ``data/`` holds immutable Parquet shards, ``manifest/`` one folder a version. Arrivals are appended as
small shards of their own. A shard's tier is ``floor(log_fanout(bytes / least))``; where a tier holds ``fanout`` shards or more,
all its shards are read together and rewritten at about ``target_bytes`` a file, which is the top tier and is left alone.
A commit writes the list of shards to a hidden folder and renames it to ``manifest/v<n>`` in one file-system step that fails
if that version exists, so two writers cannot both commit it; readers take the highest version and never see half a commit.
An append that loses the race is committed as the next version; a merge that loses it is given up and planned anew.
Merging deletes nothing: old versions stay readable and runs that are written but not yet committed stay whole until
``vacuum``, a call of its own, removes what no kept version names and what is older than an age. The commit needs a file
system that renames folders in one step (HDFS and local ones do, plain object stores do not).

Rows are kept as they are: nulls, empty and very long texts, repeated rows. An empty table commits a version without
shards. Columns of any name may occur but ``__arrival``, ``shard`` and ``shard_bytes``, which raise.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "path string, bytes long, rows long, tier int, version long"


class ShardedDataset:
    """Size-tiered shards below ``path``, a folder of a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = 32 << 20, fanout: int = 4, least_bytes: int = 64 << 10):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fanout, self.least = target_bytes, fanout, least_bytes

    # file system

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), p

    def _list(self, path: str) -> list:
        fs, p = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    # manifest

    def version(self) -> int:
        """The highest committed version; 0 before the first."""
        names = [s.getPath().getName() for s in self._list(f"{self.path}/manifest")]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{version}")

    def commit(self, shards: DataFrame, version: int) -> None:
        """Make ``shards`` the version; raises if another writer has committed it."""
        hidden = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(hidden)
        jvm, conf = self.spark._jvm, self.spark._jsc.sc().hadoopConfiguration()
        source, goal = (jvm.org.apache.hadoop.fs.Path(p) for p in (hidden, f"{self.path}/manifest/v{version}"))
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, goal, none)

    def _lost(self, version: int) -> bool:
        """Whether a commit failed because the version exists."""
        return self.version() >= version

    def _tier(self, size: Column) -> Column:
        full = size >= self.target // 2
        level = F.floor(F.log(float(self.fanout), F.greatest(size, F.lit(self.least)) / F.lit(float(self.least)))).cast("int")
        return F.when(full, F.lit(99)).otherwise(level)

    def _shards(self, run: str, version: int, schema: T.StructType) -> DataFrame:
        """Files of a written run, with their sizes and rows; no column of the files is read."""
        meta = self.spark.read.schema(schema).parquet(run).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        found = meta.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return found.select("path", "bytes", "rows", self._tier(F.col("bytes")).alias("tier"), F.lit(version).cast("long").alias("version"))

    # work

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Write each arrival (a value of the column) as small shards; one version commits them."""
        if clash := {"__arrival", "shard", "shard_bytes"} & set(rows.columns):
            raise ValueError(f"columns {sorted(clash)} have names that the dataset uses")
        run = f"{self.path}/data/append-{uuid.uuid4().hex}"
        rows.withColumn("__arrival", arrival).write.partitionBy("__arrival").parquet(run)
        while True:
            version = self.version() + 1
            try:
                self.commit(self.manifest(version - 1).union(self._shards(run, version, rows.schema)), version)
                return version
            except Exception:
                if not self._lost(version):
                    raise

    def merge(self) -> int:
        """Merge the lowest tier that holds ``fanout`` shards and commit; the version, or 0 where no tier does."""
        while True:
            now = self.version()
            shards = self.manifest(now)
            sums = shards.where("tier < 99").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
            ripe = sums.where(F.col("n") >= self.fanout).orderBy("tier").first()
            if ripe is None:
                return 0
            chosen = shards.where(F.col("tier") == ripe["tier"])
            files = max(1, round(ripe["bytes"] / self.target))
            run = f"{self.path}/data/merge-{uuid.uuid4().hex}"
            paths = [r["path"] for r in chosen.select("path").collect()]  # one tier's file names
            self.spark.read.parquet(*paths).coalesce(files).write.parquet(run)
            shards_schema = self.spark.read.parquet(paths[0]).schema
            rest = shards.where(F.col("tier") != ripe["tier"])
            new = self._shards(run, now + 1, shards_schema)
            if files == 1:  # a merge that stays small moves up a tier at least, so compaction ends
                new = new.withColumn("tier", F.greatest("tier", F.lit(ripe["tier"] + 1)))
            else:
                new = new.withColumn("tier", F.lit(99))
            try:
                self.commit(rest.union(new), now + 1)
                return now + 1
            except Exception:
                if not self._lost(now + 1):
                    raise
                self._fs(run)[0].delete(self._fs(run)[1], True)  # this writer's own run, which no version names

    def compact(self) -> int:
        """Merge tiers until none below the top has ``fanout`` shards; every merge commits a version. The last version."""
        while self.merge():
            pass
        return self.version()

    def vacuum(self, keep: int = 2, age: float = 7 * 86400.0) -> None:
        """Remove versions but the last ``keep``, and runs that no remaining version names, if older than ``age`` seconds.

        ``age`` must exceed the longest write before its commit and the longest read of a replaced version.
        """
        before = (time.time() - age) * 1000
        last, named = self.version(), set()
        for status in self._list(f"{self.path}/manifest"):
            name = status.getPath().getName()
            if not name.startswith("v"):
                continue
            if int(name[1:]) <= last - keep and status.getModificationTime() <= before:
                self._fs(f"{self.path}/manifest/{name}")[0].delete(status.getPath(), True)
            else:
                run = F.split(F.element_at(F.split("path", "/data/"), -1), "/")[0]
                named |= {r[0] for r in self.manifest(int(name[1:])).select(run).distinct().collect()}
        for status in self._list(f"{self.path}/data"):  # whole runs: a merge takes all shards of a tier, so runs empty out
            if status.getPath().getName() not in named and status.getModificationTime() <= before:
                self._fs(self.path)[0].delete(status.getPath(), True)

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Rows of a version with ``shard`` (its name) and ``shard_bytes``; ``schema`` serves where no shard exists."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            if schema is None:
                raise ValueError("the version holds no shard")
            return self.spark.createDataFrame([], schema).withColumns({"shard": F.lit(""), "shard_bytes": F.lit(0).cast("long")})
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
        return self.spark.read.parquet(*paths).withColumns({"shard": name, "shard_bytes": F.col("_metadata.file_size")})
