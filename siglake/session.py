"""Session settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from siglake.shipping import ship


def session(cores: int | None = None, memory: str = "16g") -> SparkSession:
    """A local session: UTC, AQE, one shuffle partition for each core."""
    cores = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siglake")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, where lineage is cut: spark.checkpoint.dir.

    Where that is unset, the folder given to setCheckpointDir; a local session gets a temporary one, a cluster has to name one.
    """
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siglake-checkpoint-"))
    return named or context.getCheckpointDir()


_files: list[str] = []


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `drop_files` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _files.append(path)
    return path


def drop_files(spark: SparkSession) -> int:
    """Deletes what was written to paths of `own_path` in this process; how many there were."""
    n = len(_files)
    while _files:
        path = spark._jvm.org.apache.hadoop.fs.Path(_files.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
