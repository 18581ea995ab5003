"""Flat binary recordings: frames of n_channels samples one after the other, read and written in parallel.

`spark.read.format("flat_binary")` after `register(spark)`; options: path, channels, dtype (int16), fs, task_samples, and for
grids rows and cols. The path is a file, or a folder whose files part-* follow each other by name, as `write` leaves them.
A task reads its own range of frames, through pyarrow's file systems where the path is a URI.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "i long, t double, ch int, ap int, ml int, x double"
#: Samples that one task reads, and that go out at once.
TASK_SAMPLES, BATCH_SAMPLES = 8_000_000, 500_000


def opened(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
    else:
        store, inner = fs.LocalFileSystem(), path
    return store, inner


class Frames(InputPartition):
    """Frames start to stop of a file, whose first is the recording's frame `before`."""

    def __init__(self, path: str, start: int, stop: int, before: int) -> None:
        self.path, self.start, self.stop, self.before = path, start, stop, before


class FlatBinaryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.dtype, self.fs = options["path"], np.dtype(options.get("dtype", "int16")), float(options.get("fs", 1.0))
        self.task_samples = int(options.get("task_samples", TASK_SAMPLES))
        self.rows, self.cols = int(options.get("rows", 0)), int(options.get("cols", 0))
        self.channels = int(options.get("channels", 0)) or self.rows * self.cols
        if self.channels <= 0:
            raise ValueError("a flat binary needs the number of channels, or rows and cols")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, inner = opened(self.path)
        info, frame = store.get_file_info(inner), self.channels * self.dtype.itemsize
        files = [info]
        if info.type == fs.FileType.Directory:
            files = sorted((f for f in store.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.startswith("part-")), key=lambda f: f.base_name)
        out, before, step = [], 0, max(1, self.task_samples // self.channels)
        for f in files:
            if f.type == fs.FileType.NotFound or f.size % frame:
                raise ValueError(f"{f.path} has {f.size} bytes, which are no whole frames of {frame}")
            n = f.size // frame
            out += [Frames(f.path, a, min(n, a + step), before) for a in range(0, n, step)]
            before += n
        return out or [Frames(inner, 0, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        step = max(1, BATCH_SAMPLES // self.channels)
        with store.open_input_file(partition.path) as f:
            for a in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - a)
                f.seek(a * self.channels * self.dtype.itemsize)
                x = np.frombuffer(f.read(n * self.channels * self.dtype.itemsize), dtype=self.dtype).astype(float)
                i, ch = np.repeat(np.arange(a, a + n) + partition.before, self.channels), np.tile(np.arange(self.channels, dtype=np.int32), n)
                grid = self.rows * self.cols > 0
                ap, ml = ((ch % self.rows).astype(np.int32), (ch // self.rows).astype(np.int32)) if grid else (None, None)
                none = pa.nulls(len(i), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(i / self.fs), pa.array(ch), pa.array(ap) if grid else none, pa.array(ml) if grid else none, pa.array(x)], ["i", "t", "ch", "ap", "ml", "x"])


class FlatBinarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flat_binary"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FlatBinaryReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlatBinarySource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("flat_binary").options(path=path, **options).load()


def write(samples: DataFrame, folder: str, channels: int, dtype: str = "int16", parts: int = 8) -> DataFrame:
    """part, frames: samples (i, ch, x) as parts in the folder whose concatenation, in order of name, is the flat file.

    Frames are dealt by range, so parts are in order and no frame is split. The folder must be one that all tasks share.
    """
    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, inner = opened(folder)
        store.create_dir(inner, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}.dat", 0
        with store.open_output_stream(f"{inner}/{name}") as out:
            for b in batches:
                out.write(b["x"].to_numpy().astype(dtype).tobytes())
                n += len(b)
        if n % channels:
            raise ValueError(f"{name} has {n} samples, which are no whole frames of {channels}")
        yield pd.DataFrame({"part": [name], "frames": [n // channels]})

    own = samples.select("i", "ch", "x").repartitionByRange(parts, "i").sortWithinPartitions("i", "ch")
    return own.mapInPandas(save, "part string, frames long")


def split_channels(samples: DataFrame, grid_channels: int = 256) -> tuple[DataFrame, DataFrame]:
    """A combined recording's grid and probe, the latter's channels counted from 0."""
    return samples.where(F.col("ch") < grid_channels), samples.where(F.col("ch") >= grid_channels).withColumn("ch", F.col("ch") - grid_channels)
