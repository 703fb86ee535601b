"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach.

    It is what the session says in spark.checkpoint.dir. Where that is unset a local session
    gets a temporary folder; on a cluster, whose executors could not reach it, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: StructType) -> DataFrame:
    """Apply fn, from a record batch to columns of equal length, to every batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null counts as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of value, which is evaluated once though use names it several times."""
    return F.transform(F.array(value), use)[0]


def bounded_sample(df: DataFrame, draw: str, n: int, total: int) -> DataFrame:
    """The n rows of df (total rows) with the least draw, a column of 64-bit hashes.

    Only a share with about three times as many rows is ordered, so what reaches one task is
    bounded at any size.
    """
    share = min(1.0, 3 * n / max(total, 1))
    return df.where(F.col(draw).cast("double") / float(1 << 64) + 0.5 <= share).orderBy(draw).limit(n)
