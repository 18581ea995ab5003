"""Scalar measures of a series, as aggregate expressions over columns that `prepared` adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators.series import EPS, gradient, over


def prepared(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """x with dx and ddx (gradients), d (difference) and s (difference of signs); x is null where it is NaN."""
    w = over(keys, order)
    out = df.select(*keys, order, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("x"))
    out = out.withColumn("dx", gradient("x", w)).withColumn("d", F.col("x") - F.lag("x").over(w)).withColumn("s", F.signum("x") - F.lag(F.signum("x")).over(w))
    return out.withColumn("ddx", gradient("dx", w))


def with_deviation(df: DataFrame, keys: list[str], value: str = "x", out: str = "dev") -> DataFrame:
    """Absolute deviation from the series' median."""
    return df.withColumn(out, F.abs(F.col(value) - F.median(value).over(W.partitionBy(*keys))))


def relative_variance(x: str = "x") -> Column:
    return F.var_pop(x)


def deviation(x: str = "x") -> Column:
    return F.avg(x)


def standard_deviation(x: str = "x") -> Column:
    return F.stddev_pop(x)


def amplitude(x: str = "x") -> Column:
    return F.max(x) - F.min(x)


def time_derivative(dx: str = "dx") -> Column:
    return F.avg(F.abs(dx))


def temporal_stability(x: str = "x") -> Column:
    return F.stddev_pop(x) / (F.abs(F.avg(x)) + F.lit(EPS))


def kurtosis(x: str = "x") -> Column:
    """Pearson's, not excess."""
    return F.kurtosis(x) + 3


def skewness(x: str = "x") -> Column:
    return F.skewness(x)


def hjorth_mobility(x: str = "x", dx: str = "dx") -> Column:
    return F.sqrt(F.var_pop(dx) / (F.var_pop(x) + F.lit(EPS)))


def hjorth_complexity(x: str = "x", dx: str = "dx", ddx: str = "ddx") -> Column:
    return hjorth_mobility(dx, ddx) / (hjorth_mobility(x, dx) + F.lit(EPS))


def jump_index(d: str = "d", dev: str = "dev") -> Column:
    return F.max(F.abs(d)) / (F.median(dev) * 1.4826 + F.lit(EPS))


def zero_crossing_rate(s: str = "s") -> Column:
    return F.avg((F.col(s) != 0).cast("double"))


def saturation_fraction(adc_max: float, eps: float = 2.0, x: str = "x") -> Column:
    return F.avg((F.abs(x) > adc_max - eps).cast("double"))


MEASURES = {
    f.__name__: f
    for f in (
        relative_variance, deviation, standard_deviation, amplitude, time_derivative, temporal_stability, kurtosis, skewness,
        hjorth_mobility, hjorth_complexity, jump_index, zero_crossing_rate,
    )
}


def measured(df: DataFrame, keys: list[str], order: str, value: str, names: list[str] | None = None, **more: Column) -> DataFrame:
    """One row for each series with the named measures, all in one pass over it; more: further aggregates."""
    wanted = {n: MEASURES[n]() for n in (MEASURES if names is None else names)} | more
    rows = prepared(df, keys, order, value)
    if "jump_index" in wanted:
        rows = with_deviation(rows, keys)
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in wanted.items()])
