"""Range and nearest joins: inequality predicates as equi-joins on time buckets, so that no plan is a nested loop.

`width` should be near the usual length of an interval: each interval is held once for every bucket that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(t: str | Column, width: float) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(width))).cast("long")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], width: float, t: str = "t", t0: str = "t0", t1: str = "t1", how: str = "inner", closed: bool = False) -> DataFrame:
    """Joins each point to the intervals with t0 <= t < t1 (t <= t1 if closed) of the same keys."""
    p = points.withColumn("__b", bucket(t, width))
    iv = intervals.withColumn("__b", F.explode(F.sequence(bucket(t0, width), bucket(t1, width))))
    for k in keys:
        iv = iv.withColumnRenamed(k, f"__{k}")
    inside = (p[t] >= iv[t0]) & ((p[t] <= iv[t1]) if closed else (p[t] < iv[t1]))
    on = (p["__b"] == iv["__b"]) & inside
    for k in keys:
        on = on & (p[k] == iv[f"__{k}"])
    return p.join(iv, on, how).drop("__b", *[f"__{k}" for k in keys])


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float, a0: str, a1: str, b0: str, b1: str) -> DataFrame:
    """Pairs of intervals of equal keys that share more than a point. Columns other than the keys must differ.

    A pair that meets in several buckets is taken in the first of them.
    """
    left = a.withColumn("__a", F.explode(F.sequence(bucket(a0, width), bucket(a1, width))))
    right = b.withColumn("__b", F.explode(F.sequence(bucket(b0, width), bucket(b1, width))))
    for k in keys:
        right = right.withColumnRenamed(k, f"__{k}")
    on = (left["__a"] == right["__b"]) & (left[a0] < right[b1]) & (right[b0] < left[a1])
    for k in keys:
        on = on & (left[k] == right[f"__{k}"])
    first = F.col("__a") == F.greatest(bucket(a0, width), bucket(b0, width))
    return left.join(right, on).where(first).drop("__a", "__b", *[f"__{k}" for k in keys])


def within(a: DataFrame, b: DataFrame, keys: list[str], reach: float, ta: str, tb: str) -> DataFrame:
    """Pairs of points of equal keys at most `reach` apart. Columns other than the keys must differ."""
    left = a.withColumn("__b", F.explode(F.sequence(bucket(F.col(ta) - reach, reach), bucket(F.col(ta) + reach, reach))))
    right = b.withColumn("__b", bucket(tb, reach))
    return left.join(right, [*keys, "__b"]).where(F.abs(F.col(tb) - F.col(ta)) <= reach).drop("__b")


def nearest(a: DataFrame, b: DataFrame, keys: list[str], max_lag: float, chunk: float | None = None, ta: str = "t", tb: str = "t", ia: str = "ia", ib: str = "ib") -> DataFrame:
    """keys, ia, ib, ta, lag: for each row of a the nearest of b, the later one of two equally near, at most max_lag away.

    Time is cut into chunks of at least max_lag; b is held in each chunk that it may be wanted in, so one window over (keys,
    chunk) sees all that it needs, and no window spans more than a chunk.
    """
    chunk = max(float(chunk or 50 * max_lag), float(max_lag))
    left = a.select(*keys, F.col(ta).alias("__t"), F.col(ia).alias("__ia"), F.lit(None).cast(b.schema[ib].dataType).alias("__ib"), bucket(ta, chunk).alias("__c"))
    spread = F.explode(F.sequence(bucket(F.col(tb) - max_lag, chunk), bucket(F.col(tb) + max_lag, chunk)))
    right = b.select(*keys, F.col(tb).alias("__t"), F.lit(None).cast(a.schema[ia].dataType).alias("__ia"), F.col(ib).alias("__ib"), spread.alias("__c"))
    w = W.partitionBy(*keys, "__c").orderBy("__t")
    own = F.when(F.col("__ib").isNotNull(), F.struct("__t", "__ib"))
    both = left.unionByName(right)
    both = both.withColumn("__lo", F.max(own).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("__hi", F.min(own).over(w.rangeBetween(W.currentRow, W.unboundedFollowing)))
    later = F.col("__hi").isNotNull() & (F.col("__lo").isNull() | (F.col("__hi.__t") - F.col("__t") <= F.col("__t") - F.col("__lo.__t")))
    picked = both.where("__ia is not null").withColumn("__m", F.when(later, F.col("__hi")).otherwise(F.col("__lo")))
    out = picked.select(*keys, F.col("__ia").alias("ia"), F.col("__m.__ib").alias("ib"), F.col("__t").alias("ta"), (F.col("__m.__t") - F.col("__t")).alias("lag"))
    return out.where(F.abs("lag") <= max_lag)


def nearest_symmetric(a: DataFrame, b: DataFrame, keys: list[str], max_lag: float, **names) -> DataFrame:
    """Nearest matches of which each b keeps the one of smallest lag, the earlier a of equals; losers stay unmatched."""
    w = W.partitionBy(*keys, "ib").orderBy(F.abs("lag"), "ta", "ia")
    return nearest(a, b, keys, max_lag, **names).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
