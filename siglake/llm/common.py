"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.session import shared_dir
from siglake.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Deletes what operators have written in this process, tables, checkpoints and stores of queries, once their results are saved; how many there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `drop_written` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for small intermediate results."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _written.append(file.get())
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: few rows at a time, as a single text may be megabytes long. Workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
