"""Lags between point processes: histograms, lag and drift estimates, correlograms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.operators.ranges import within


def bin_of(x: Column, low: float, width: float, n: int) -> Column:
    """Index of the bin of x among n of this width from low; the last is closed, outside is null."""
    k = F.floor((x - F.lit(float(low))) / F.lit(float(width))).cast("int")
    top = F.lit(float(low + n * width))
    return F.when(x == top, n - 1).when((x < F.lit(float(low))) | (x > top), None).otherwise(F.least(k, F.lit(n - 1)))


def dense(counts: DataFrame, n: int) -> DataFrame:
    """bin, n for every bin, 0 where counts(bin, n) has none."""
    axis = counts.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return axis.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def lag_histogram(a: DataFrame, b: DataFrame, keys: list[str], max_lag: float, bin_width: float, ta: str = "ta", tb: str = "tb") -> DataFrame:
    """bin, n: lags b - a of all pairs at most max_lag apart, in ceil(2 max_lag / bin_width) equal bins."""
    n = math.ceil(2 * max_lag / bin_width)
    lag = within(a, b, keys, max_lag, ta, tb).select(bin_of(F.col(tb) - F.col(ta), -max_lag, 2 * max_lag / n, n).alias("bin"))
    return dense(lag.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")), n)


def lag_estimates(matches: DataFrame) -> DataFrame:
    """Median, mean and mode of matched lags; the mode is the centre of the fullest of 100 bins over their range."""
    span = matches.agg(F.min("lag").alias("lo"), F.max("lag").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 100
    k = F.when(F.col("lag") == F.col("hi"), 99).otherwise(F.floor((F.col("lag") - F.col("lo")) / width).cast("int"))
    counts = matches.join(F.broadcast(span)).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    mode = counts.agg(F.max_by(F.struct("k", "lo", "hi"), F.struct("n", -F.col("k"))).alias("b")).select((F.col("b.lo") + (F.col("b.k") + 0.5) * (F.col("b.hi") - F.col("b.lo")) / 100).alias("mode"))
    return matches.agg(F.median("lag").alias("median"), F.avg("lag").alias("mean")).join(F.broadcast(mode))


def drift(matches: DataFrame, degree: int = 1) -> np.ndarray:
    """Coefficients, highest power first, of the polynomial of lag over ta; NaN with too few matches.

    Power sums alone reach the driver; time is centred and scaled first, for the sake of the normal equations.
    """
    base = matches.agg(F.avg("ta").alias("m"), F.stddev_pop("ta").alias("s"), F.count("*").alias("n")).first()
    if base["n"] < degree + 1:
        return np.full(degree + 1, np.nan)
    scale = base["s"] or 1.0
    z = (F.col("ta") - base["m"]) / scale
    sums = matches.agg(*[F.sum(F.pow(z, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(z, F.lit(k)) * F.col("lag")).alias(f"y{k}") for k in range(degree + 1)]).first()
    gram = np.array([[sums[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    own = np.linalg.lstsq(gram, np.array([sums[f"y{i}"] for i in range(degree + 1)]), rcond=None)[0]
    in_t = np.poly1d(own[::-1])(np.poly1d([1 / scale, -base["m"] / scale]))
    return np.atleast_1d(np.pad(in_t.coeffs, (degree + 1 - len(in_t.coeffs), 0)))


def correlogram(a: DataFrame, b: DataFrame, keys: list[str], bin_size: float, window: float, n_a: int | None = None, ta: str = "ta", tb: str = "tb") -> DataFrame:
    """bin, lag (centre), n, and rate: n over the number of a and the bin size. Bins from -window to window, the last closed."""
    edges = np.arange(-window, window + bin_size, bin_size)
    n = len(edges) - 1
    lags = within(a, b, keys, window, ta, tb).select(bin_of(F.col(tb) - F.col(ta), float(edges[0]), bin_size, n).alias("bin"))
    total = a.count() if n_a is None else n_a
    out = dense(lags.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")), n)
    return out.select("bin", (F.lit(float(edges[0])) + (F.col("bin") + 0.5) * bin_size).alias("lag"), "n", (F.col("n") / (total * bin_size)).alias("rate"))


def shifted(points: DataFrame, t: str, t_start: float, t_end: float, shift: float | Column) -> DataFrame:
    """Circular shift of times within [t_start, t_end), for surrogates."""
    span = t_end - t_start
    return points.withColumn(t, F.lit(t_start) + F.pmod(F.col(t) - t_start + shift, F.lit(span)))


def correlogram_surrogates(a: DataFrame, b: DataFrame, keys: list[str], bin_size: float, window: float, shares: list[float], ta: str = "ta", tb: str = "tb") -> DataFrame:
    """share, bin, n, rate: correlograms of a with b shifted around the end, by each share of the span of both trains.

    Shares (draw them from 0.1 to 0.9) are given, so that a task that runs again draws no others. A mean over events of rates
    by bin, as a peri-event histogram has it, is the same number with a as the events.
    """
    span = a.select(F.col(ta).alias("t")).union(b.select(F.col(tb).alias("t"))).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    edges = np.arange(-window, window + bin_size, bin_size)
    n, width = len(edges) - 1, (span["hi"] or 0.0) - (span["lo"] or 0.0)
    each = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    moved = shifted(b.select(*keys, tb, each), tb, span["lo"] or 0.0, (span["lo"] or 0.0) + (width or 1.0), F.col("share") * F.lit(width))
    lags = within(a.select("*", each), moved, [*keys, "share"], window, ta, tb).select("share", bin_of(F.col(tb) - F.col(ta), float(edges[0]), bin_size, n).alias("bin"))
    counts = lags.where("bin is not null").groupBy("share", "bin").agg(F.count("*").alias("n"))
    axis = a.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"), each)
    out = axis.join(F.broadcast(counts), ["share", "bin"], "left").select("share", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("rate", F.col("n") / F.lit(max(1, a.count()) * bin_size))


def peri_event_histogram(spikes: DataFrame, events: DataFrame, keys: list[str], bin_size: float, window: tuple[float, float], event: str = "event_id", te: str = "te", ts: str = "ts") -> DataFrame:
    """bin, rate, sem over events: counts a bin size, their mean and population deviation over the root of the events' number."""
    edges = np.arange(window[0], window[1] + bin_size / 2, bin_size)
    n = len(edges) - 1
    reach = max(abs(window[0]), abs(window[1]))
    hits = within(events.select(*keys, event, te), spikes.select(*keys, ts), keys, reach, te, ts)
    hits = hits.select(event, bin_of(F.col(ts) - F.col(te), float(edges[0]), bin_size, n).alias("bin")).where("bin is not null")
    per = hits.groupBy(event, "bin").agg((F.count("*") / bin_size).alias("r")).groupBy("bin").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    total = float(events.count())
    axis = events.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    s, q = F.coalesce("s", F.lit(0.0)) / total, F.coalesce("q", F.lit(0.0)) / total
    out = axis.join(F.broadcast(per), "bin", "left")
    return out.select("bin", (F.lit(float(edges[0])) + (F.col("bin") + 0.5) * bin_size).alias("lag"), s.alias("rate"), (F.sqrt(F.greatest(q - s * s, F.lit(0.0))) / F.sqrt(F.lit(total))).alias("sem"))


def baselined(histogram: DataFrame, low: float, high: float) -> DataFrame:
    """bin, lag, rate and sem over the mean rate of the bins whose centre is in [low, high]; as they are where that isn't above 0."""
    mean = F.broadcast(histogram.where(F.col("lag").between(low, high)).agg(F.avg("rate").alias("__b")))
    by = F.when(F.col("__b") > 0, F.col("__b")).otherwise(F.lit(1.0))
    return histogram.join(mean).select("bin", "lag", (F.col("rate") / by).alias("rate"), (F.col("sem") / by).alias("sem"))
