"""Phase-amplitude and power coupling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators.series import over


def tort(df: DataFrame, keys: list[str], phase: str = "phase", amp: str = "amp", n_bins: int = 18) -> DataFrame:
    """keys, mi: divergence of mean amplitudes by phase bin over [-pi, pi) from uniform, over ln(n_bins); empty bins are 0."""
    k = F.floor((F.col(phase) + math.pi) / (2 * math.pi / n_bins)).cast("int")
    binned = df.where((F.col(phase) >= -math.pi) & (F.col(phase) < math.pi)).groupBy(*keys, k.alias("__k")).agg(F.avg(amp).alias("__a"))
    p = F.col("__a") / F.sum("__a").over(W.partitionBy(*keys))
    shares = binned.withColumn("__p", p)
    return shares.groupBy(*keys).agg((F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.ln(F.col("__p") * n_bins)).otherwise(0.0)) / math.log(n_bins)).alias("mi"))


def _resultant(phase: str, amp: str) -> Column:
    return F.hypot(F.avg(F.col(amp) * F.cos(phase)), F.avg(F.col(amp) * F.sin(phase)))


def canolty(phase: str = "phase", amp: str = "amp") -> Column:
    return _resultant(phase, amp)


def ozkurt(phase: str = "phase", amp: str = "amp") -> Column:
    return _resultant(phase, amp) / F.sqrt(F.avg(F.col(amp) * F.col(amp)))


def preferred_phase(df: DataFrame, keys: list[str], phase: str = "phase", amp: str = "amp") -> DataFrame:
    """keys, angle, length, p: the amplitude-weighted resultant, as a share of the total amplitude; p = exp(-R^2 / n) of the phases."""
    c, s = F.sum(F.col(amp) * F.cos(phase)), F.sum(F.col(amp) * F.sin(phase))
    r2 = F.pow(F.sum(F.cos(phase)), 2) + F.pow(F.sum(F.sin(phase)), 2)
    return df.groupBy(*keys).agg(F.atan2(s, c).alias("angle"), (F.hypot(c, s) / F.sum(amp)).alias("length"), F.exp(-r2 / F.count("*")).alias("p"))


def circular_surrogates(df: DataFrame, keys: list[str], shifts: list[int], i: str = "i", phase: str = "phase", amp: str = "amp") -> DataFrame:
    """keys, shift, phase, amp: amplitudes against phases that are shifted around the end."""
    n = F.max(i).over(W.partitionBy(*keys)) + 1
    own = df.select(*keys, i, phase, amp, n.alias("__n"))
    moved = own.select(*keys, F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"), i, phase, "__n")
    moved = moved.select(*keys, "shift", F.pmod(F.col(i) + F.col("shift"), F.col("__n")).cast("long").alias(i), phase)
    return moved.join(own.select(*keys, F.col(i).cast("long").alias(i), amp), [*keys, i]).drop(i)


def power_xcorr(a: DataFrame, b: DataFrame, keys: list[str], max_lag: int, log_transform: bool = True, normalize: bool = True) -> DataFrame:
    """keys, lag, r: sum of x[t] y[t + lag] of demeaned powers (keys, i, x), over the root of both energies."""
    def prepared(df: DataFrame, name: str) -> DataFrame:
        x = F.log10(F.greatest("x", F.lit(0.0)) + 1) if log_transform else F.col("x")
        own = df.select(*keys, "i", x.alias("v"))
        return own.select(*keys, "i", (F.col("v") - F.avg("v").over(W.partitionBy(*keys))).alias(name))

    both = prepared(a, "va").join(prepared(b, "vb"), [*keys, "i"])
    w = over(keys, "i")
    lags = range(-max_lag, max_lag + 1)
    cols = [(F.lead("vb", k).over(w) if k >= 0 else F.lag("vb", -k).over(w)).alias(f"b{k}") for k in lags]
    own = both.select(*keys, "va", "vb", *cols)
    norm = F.sqrt(F.sum(F.col("va") * F.col("va")) * F.sum(F.col("vb") * F.col("vb"))) if normalize else F.lit(1.0)
    got = own.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col("va") * F.col(f"b{k}")), norm).alias(str(k)) for k in lags])
    return got.unpivot(keys, [str(k) for k in lags], "lag", "r").withColumn("lag", F.col("lag").cast("int"))
