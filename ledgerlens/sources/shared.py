"""Cutting lineage and laying out tables where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder; on a cluster, whose executors
    could not reach it, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here, and its size is known to the plans that read it."""
    path = f"{shared_dir(df.sparkSession)}/checkpoint-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for the plans that are made meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Buckets:
    """A table in the shared folder, in as many buckets by some columns as a shuffle has partitions.

    Joins and groupings by these columns read it as it lies. Rows can be appended; within, a
    part of them is found by a column that names folders.
    """

    def __init__(self, df: DataFrame, by: list[str], folders: str | None = None, distinct: bool = False):
        self.spark, self.by, self.folders = df.sparkSession, by, folders
        self.name = f"laid_out_{uuid.uuid4().hex}"
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        # Dealt by bucket first, so that a bucket gets one file and not one from each task.
        dealt = df.repartition(self.n, *by)
        self.append(dealt.distinct() if distinct else dealt)

    def append(self, df: DataFrame) -> int:
        """Adds rows, which lie together by bucket as they are, and says how many."""
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").format("parquet").option("path", self.path).bucketBy(self.n, *self.by)
        (writer.partitionBy(self.folders) if self.folders else writer).saveAsTable(self.name)
        return seen.get["n"]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)
