"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "qamill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    Adaptive execution does the rest: it coalesces small shuffle partitions,
    splits skewed join partitions and picks broadcast joins from real sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Rows here are small and the work on each is large, so keep all cores busy
        # before filling partitions up.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (one
    machine, as in tests) may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="qamill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back, so that later stages do not recompute ``df``.

    A written table survives the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a layer that is not read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles is removed at its end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class BucketTable:
    """A table under the shared folder whose rows lie in buckets of ``key``, one folder for each value of ``part``.

    Grouping by ``key`` moves none of its rows.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int, part: str):
        self.spark, self.key, self.buckets, self.part = spark, key, buckets, part
        self.path = scratch_path(spark, name)
        self.name = os.path.basename(self.path).replace("-", "_")

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy(self.part).bucketBy(self.buckets, self.key).option(
            "path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def remove(self, value: int) -> None:
        """Drop all rows of a part."""
        discard(self.spark, f"{self.path}/{self.part}={value}")
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)
