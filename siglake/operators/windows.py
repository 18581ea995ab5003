"""Sample-count windows: only complete ones, `size` samples long, one every `step`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import pairs
from siglake.operators import kernels
from siglake.operators.series import over

#: Series of a block of `pair_correlations`; a task holds two blocks of a window and the rows of their pairs, 32 MB.
BLOCK = 1024


def onsets(lengths: DataFrame, keys: list[str], n: str, size: int, step: int) -> DataFrame:
    """keys, win, onset, last, midpoint, lower, upper of each window of series with n samples; shorter ones have none."""
    own = lengths.where(F.col(n) >= size).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - size) / step).cast("long"))).alias("win"))
    onset = F.col("win") * step
    return own.select(*keys, "win", onset.alias("onset"), (onset + size - 1).alias("last"), (onset + (size - 1) / 2).alias("midpoint"), (onset + (size - 1) // 2).alias("lower"), (onset + size // 2).alias("upper"))


def windowed(samples: DataFrame, keys: list[str], size: int, step: int, i: str = "i") -> DataFrame:
    """Each sample once for each complete window that holds it, with win (from 0)."""
    n = F.max(i).over(W.partitionBy(*keys)) + 1
    low = F.greatest(F.ceil((F.col(i) - size + 1) / step), F.lit(0)).cast("long")
    high = F.least(F.floor(F.col(i) / step), F.floor((n - size) / step)).cast("long")
    held = samples.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    return held.withColumn("win", F.explode(F.sequence("__low", "__high"))).drop("__low", "__high")


def pair_correlations(samples: DataFrame, key: str, size: int, other: str = "other", digits: int | None = None, i: str = "i", value: str = "x", block: int = BLOCK) -> DataFrame:
    """key, other, win, r: Pearson's of each two series (the smaller key first) in each window of size samples that both have whole; NaN without spread, null
    without a sample of both.

    Series are dealt to blocks, and each two blocks of a window meet once: a window is sent as often as there are blocks, no samples are joined.
    Keys are of a numeric type.
    """
    import pyarrow as pa

    def run(at, t):
        win, p, q = (k.as_py() for k in at)
        ids, blocks = (t.column(c).to_numpy() for c in (key, "__b"))
        values = t.column("__x").combine_chunks().flatten()
        here = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
        x = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
        a, b = np.flatnonzero(blocks == p), np.flatnonzero(blocks == q)
        r, known = pairs.correlations(x[a], here[a], x[b], here[b])
        if digits is not None:
            r = pairs.rounded(r, digits)
        own, its = np.broadcast_arrays(ids[a][:, None], ids[b])
        rows = own < its if p == q else np.ones(r.shape, dtype=bool)
        low, high, r, known = np.minimum(own, its)[rows], np.maximum(own, its)[rows], r[rows], known[rows]
        return pa.Table.from_arrays([pa.array(low), pa.array(high), pa.array(np.full(len(r), win)), pa.array(r, mask=~known)], [key, other, "win", "r"])

    named = samples.where(F.col(key).isNotNull())
    windows = kernels.as_arrays(named.withColumn("win", F.floor(F.col(i) / size)), [key, "win"], i, (value,)).where(F.size(value) == size)
    n = named.select(key).distinct().agg(F.ceil(F.count("*") / block).alias("__n"))
    own = windows.crossJoin(F.broadcast(n)).select(key, "win", F.col(value).alias("__x"), F.pmod(F.xxhash64(key), "__n").alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__o"))
    met = own.select(key, "win", "__x", "__b", F.least("__b", "__o").alias("__p"), F.greatest("__b", "__o").alias("__q"))
    # not to be coalesced: a task's rows are many times what it reads
    dealt = met.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "win", "__p", "__q")
    kind = samples.schema[key].dataType.simpleString()
    return dealt.groupBy("win", "__p", "__q").applyInArrow(run, f"`{key}` {kind}, `{other}` {kind}, win long, r double")


def running_reduce(samples: DataFrame, keys: list[str], size: int, step: int, i: str = "i", **aggregates: Column) -> DataFrame:
    """Aggregates of each window. Non-overlapping windows cost no copies; others as many as overlap."""
    return windowed(samples, keys, size, step, i).groupBy(*keys, "win").agg(*[c.alias(n) for n, c in aggregates.items()])


def rolling_zscore(samples: DataFrame, keys: list[str], half: int, i: str = "i", value: str = "x") -> DataFrame:
    """z by mean and sample deviation of 2 half + 1 samples, the series mirrored at both ends (without the end itself)."""
    n = F.max(i).over(W.partitionBy(*keys))
    own = samples.select(*keys, i, value, n.alias("__n"))
    left = own.where((F.col(i) >= 1) & (F.col(i) <= half)).withColumn(i, -F.col(i))
    right = own.where((F.col(i) < F.col("__n")) & (F.col(i) >= F.col("__n") - half)).withColumn(i, 2 * F.col("__n") - F.col(i))
    w = over(keys, i).rowsBetween(-half, half)
    both = own.unionByName(left).unionByName(right)
    z = (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)
    return both.withColumn("z", z).where((F.col(i) >= 0) & (F.col(i) <= F.col("__n"))).select(*keys, i, "z")


def rolling(samples: DataFrame, keys: list[str], n: int, method: str = "median", min_periods: int = 1, i: str = "i", value: str = "x", out: str = "y") -> DataFrame:
    """Centred rolling median or mean of n samples (of an even number, one more before than after)."""
    w = over(keys, i).rowsBetween(-(n // 2), n - 1 - n // 2)
    y = F.percentile(value, 0.5).over(w) if method == "median" else F.avg(value).over(w)
    return samples.withColumn(out, F.when(F.count(value).over(w) >= min_periods, y))


def summarised(features: DataFrame, keys: list[str], names: list[str], stats: tuple[str, ...] = ("median", "mad", "max")) -> DataFrame:
    """feature_stat columns over the windows of each key."""
    own = features
    if "mad" in stats:
        for c in names:
            own = own.withColumn(f"__{c}", F.abs(F.col(c) - F.median(c).over(W.partitionBy(*keys))))
    of = {"median": F.median, "mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min, "p95": lambda c: F.percentile(c, 0.95), "p05": lambda c: F.percentile(c, 0.05), "mad": lambda c: F.median(f"__{c}")}
    return own.groupBy(*keys).agg(*[of[s](c).alias(f"{c}_{s}") for c in names for s in stats])


def chunk_length(size: int, step: int, min_windows: int = 4, floor: int = 65536, most: int | None = None) -> int:
    """Samples of a chunk that holds min_windows windows and floor samples at least."""
    n = max(size + (min_windows - 1) * step, floor)
    return n if most is None else max(size, min(n, most))


def chunked(samples: DataFrame, keys: list[str], size: int, step: int, chunk: int, i: str = "i") -> DataFrame:
    """Samples with the chunk that kernels may take them in; the size - step samples before a window's end are held twice.

    A window belongs to the chunk of its onset, so a chunk needs size - 1 samples of the next one.
    """
    whole = -(-chunk // step) * step
    here, before = F.floor(F.col(i) / whole), F.floor(F.greatest(F.col(i) - (size - 1), F.lit(0)) / whole)
    return samples.withColumn("chunk", F.explode(F.sequence(before.cast("long"), here.cast("long"))))
