"""Runs numpy kernels over series: samples become one array a series, arrays go through Arrow in batches.

A series must fit in memory. Long ones go by chunks where a kernel reaches only so far (`transformed` with chunk and margin), or are cut
by windows.chunked first, whose chunks overlap by what a window needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_arrays(df: DataFrame, keys: list[str], order: str = "i", values: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys and an array of each value, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    own = df.groupBy(*keys).agg(rows.alias("__r"))
    return own.select(*keys, *[F.col(f"__r.{v}").alias(v) for v in values], F.col(f"__r.{order}").alias("__order"))


def in_chunks(df: DataFrame, chunk: int, margin: int, order: str = "i") -> DataFrame:
    """Samples with __chunk, of `chunk` samples each; those within margin of another chunk are held by it too."""
    if not 0 <= margin <= chunk:
        raise ValueError(f"the margin, {margin}, must be at most a chunk, {chunk}")
    first, last = F.floor(F.greatest(F.col(order) - margin, F.lit(0)) / chunk), F.floor((F.col(order) + margin) / chunk)
    return df.withColumn("__chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def transformed(df: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray], order: str = "i", value: str = "x", out: str = "y", chunk: int | None = None, margin: int = 0) -> DataFrame:
    """keys, order, out: a kernel (series, samples) that gives a value for each sample; series of equal length go together.

    With a chunk, no task takes more than chunk + 2 margin samples of a series, whose order counts from 0. Results are those of whole
    series for a kernel whose values rest on samples within the margin.
    """
    if chunk is not None:
        got = transformed(in_chunks(df, chunk, margin, order), [*keys, "__chunk"], kernel, order, value, out)
        return got.where(F.floor(F.col(order) / chunk) == F.col("__chunk")).drop("__chunk")
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + f", __order array<{kind[order]}>, {out} array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            size, y = p[value].map(len), np.empty(len(p), dtype=object)
            for n in size.unique():
                at = np.flatnonzero(size == n)
                for k, row in zip(at, np.asarray(kernel(np.stack(p[value].iloc[at].to_list()).astype(float)), dtype=float), strict=True):
                    y[k] = row
            yield p[[*keys, "__order"]].assign(**{out: list(y)})

    got = as_arrays(df, keys, order, (value,)).mapInPandas(run, schema)
    zipped = got.select(*keys, F.explode(F.arrays_zip(F.col("__order"), F.col(out))).alias("z"))
    return zipped.select(*keys, F.col("z.__order").alias(order), F.col(f"z.{out}").alias(out))


def reduced(df: DataFrame, keys: list[str], kernel: Callable[..., dict[str, float]], names: list[str], order: str = "i", values: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys and doubles: a kernel that gives one row for each series."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"{k} {kind[k]}" for k in keys] + [f"{n} double" for n in names])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [kernel(*(np.asarray(x, dtype=float) for x in row)) for row in zip(*(p[v] for v in values), strict=True)]
            yield p[keys].reset_index(drop=True).assign(**{n: [float(r[n]) for r in rows] for n in names})

    return as_arrays(df, keys, order, values).mapInPandas(run, schema)


def expanded(df: DataFrame, keys: list[str], kernel: Callable[..., pd.DataFrame | dict], schema: str, order: str = "i", values: tuple[str, ...] = ("x",)) -> DataFrame:
    """keys and the columns of `schema`: a kernel that gives columns of equal length for each series."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [kernel(*(np.asarray(x, dtype=float) for x in row)) for row in zip(*(p[v] for v in values), strict=True)]
            if got:
                at = np.repeat(np.arange(len(got)), [len(g[names[0]]) for g in got])
                yield p[keys].iloc[at].reset_index(drop=True).assign(**{n: np.concatenate([np.asarray(g[n]) for g in got]) for n in names})

    return as_arrays(df, keys, order, values).mapInPandas(run, ", ".join(f"{k} {kind[k]}" for k in keys) + ", " + schema)


def spectra(df: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], order: str = "i", value: str = "x") -> DataFrame:
    """keys, k, freq, p: a kernel (series, samples) that gives frequencies and (series, frequencies); series of equal length go together."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size = part[value].map(len).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                freq, p = kernel(np.stack(part[value].iloc[at].to_list()).astype(float))
                own = part[keys].iloc[np.repeat(at, len(freq))].reset_index(drop=True)
                yield own.assign(k=np.tile(np.arange(len(freq)), len(at)), freq=np.tile(freq, len(at)), p=p.ravel())

    return as_arrays(df, keys, order, (value,)).mapInPandas(run, ", ".join(f"{k} {kind[k]}" for k in keys) + ", k int, freq double, p double")
