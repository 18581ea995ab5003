"""Series helpers: gradients, differences, standard scores, runs. A series is the rows of equal keys in order of `order`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12


def over(keys: list[str], order: str | list[str]) -> W:
    return W.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def gradient(value: str | Column, w: W) -> Column:
    """Central differences, one-sided at both ends; null for a single sample."""
    x = F.col(value) if isinstance(value, str) else value
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def zscored(df: DataFrame, keys: list[str], value: str, out: str = "z") -> DataFrame:
    """Standard score by population deviation, over 1 where that is 0."""
    w = W.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))


def zscorex(df: DataFrame, keys: list[str], value: str, robust: bool = False, eps: float = EPS, out: str = "z") -> DataFrame:
    """(x - mean) / (deviation + eps), or by median and 1.4826 times the median absolute deviation."""
    w = W.partitionBy(*keys)
    if not robust:
        return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(eps)))
    mid = df.withColumn("__med", F.median(value).over(w)).withColumn("__mad", F.median(F.abs(F.col(value) - F.col("__med"))).over(w))
    return mid.withColumn(out, (F.col(value) - F.col("__med")) / (F.col("__mad") * 1.4826 + F.lit(eps))).drop("__med", "__mad")


def true_runs(df: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """keys, i0, i1 (inclusive): runs of consecutive integers `order` at which hit is true."""
    hits = df.where(hit).select(*keys, F.col(order).cast("long").alias("__i"))
    island = F.col("__i") - F.row_number().over(over(keys, "__i"))
    return hits.withColumn("__g", island).groupBy(*keys, "__g").agg(F.min("__i").alias("i0"), F.max("__i").alias("i1")).drop("__g")


def merged_runs(runs: DataFrame, keys: list[str], gap: int | Column, start: str = "i0", end: str = "i1") -> DataFrame:
    """Runs joined where the next starts no later than gap + 1 after the furthest end so far."""
    w = over(keys, [start, end])
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    gap = F.lit(gap) if isinstance(gap, int) else gap
    opened = runs.withColumn("__new", F.when(F.col(start) <= reach + gap + 1, 0).otherwise(1))
    grouped = opened.withColumn("__c", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__c").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__c", "__new")
