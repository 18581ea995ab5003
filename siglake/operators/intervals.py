"""Interval and state algebra on tables (keys, state, iseg, t0, t1); intervals are half open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators.ranges import overlapping, points_in_intervals


def total_duration(iv: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of lengths; overlaps count twice."""
    return iv.groupBy(*keys).agg(F.sum(F.col("t1") - F.col("t0")).alias("duration"))


def around(points: DataFrame, pre: float, post: float, t: str = "t") -> DataFrame:
    """An interval about each point."""
    return points.withColumn("t0", F.col(t) - F.lit(float(pre))).withColumn("t1", F.col(t) + F.lit(float(post)))


def restrict(points: DataFrame, iv: DataFrame, keys: list[str], width: float, t: str = "t") -> DataFrame:
    """Points that lie in any interval of their keys."""
    return points_in_intervals(points, iv.select(*keys, "t0", "t1"), keys, width, t, how="left_semi")


def disjoint(iv: DataFrame, keys: list[str]) -> DataFrame:
    """keys, disjoint: whether no interval begins before an earlier one's end. Touching is disjoint."""
    following = F.lead("t0").over(W.partitionBy(*keys).orderBy("t0", "t1"))
    marked = iv.withColumn("__clash", F.coalesce(following < F.col("t1"), F.lit(False)))
    return marked.groupBy(*keys).agg((~F.bool_or("__clash")).alias("disjoint"))


def mapped(points: DataFrame, iv: DataFrame, keys: list[str], index: str, width: float, key: str, t: str = "t") -> DataFrame:
    """keys, key, found: the sorted indices of the intervals that hold each point, empty for none."""
    hit = points_in_intervals(points, iv.select(*keys, "t0", "t1", F.col(index).alias("__index")), keys, width, t, how="left")
    return hit.groupBy(*keys, key).agg(F.array_sort(F.collect_list("__index")).alias("found"))


def mapped_disjoint(points: DataFrame, iv: DataFrame, keys: list[str], index: str, width: float, t: str = "t", out: str = "found") -> DataFrame:
    """points with the index of the interval that holds each, -1 for none; intervals of a key must be disjoint."""
    hit = points_in_intervals(points, iv.select(*keys, "t0", "t1", F.col(index).cast("long").alias(out)), keys, width, t, how="left")
    return hit.drop("t0", "t1").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))


def subtracted(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """What is left of each interval of b (all its columns stay) without any of a."""
    cut = a.select(*keys, F.col("t0").alias("__s"), F.col("t1").alias("__e"))
    own = b.withColumn("__id", F.struct(*b.columns))
    hits = overlapping(own, cut, keys, width, "t0", "t1", "__s", "__e")
    ends = own.withColumn("__s", F.col("t1")).withColumn("__e", F.col("t1"))
    w = W.partitionBy("__id").orderBy("__s", "__e").rowsBetween(W.unboundedPreceding, -1)
    pieces = hits.unionByName(ends).withColumn("__from", F.coalesce(F.max("__e").over(w), F.col("t0")))
    out = pieces.where(F.col("__s") > F.col("__from")).withColumn("t0", F.col("__from")).withColumn("t1", F.col("__s"))
    return out.select(*b.columns)


def labelled(points: DataFrame, iv: DataFrame, keys: list[str], states: list[str], width: float, t: str = "t") -> DataFrame:
    """points with a column for each state: the index iseg of its interval that holds the point, else -1."""
    hit = points_in_intervals(points, iv.where(F.col("state").isin(states)).select(*keys, "state", "iseg", "t0", "t1"), keys, width, t, how="left")
    by = [c for c in points.columns]
    cols = [F.coalesce(F.max(F.when(F.col("state") == s, F.col("iseg"))), F.lit(-1)).cast("long").alias(s) for s in states]
    return hit.groupBy(*by).agg(*cols)


def in_states(df: DataFrame, include: list[str], exclude: list[str]) -> Column:
    """Whether a labelled row is in any of the states to include and in none to exclude."""
    out = reduce(lambda a, b: a & b, [F.col(s) == -1 for s in exclude], F.lit(True))
    return out & reduce(lambda a, b: a | b, [F.col(s) != -1 for s in include], F.lit(False))


def disjoint_states(iv: DataFrame, keys: list[str], width: float) -> DataFrame:
    """state, other, disjoint: whether any interval of one overlaps one of the other; for one state, two of its own."""
    a = iv.select(*keys, "state", F.col("iseg").alias("__ia"), F.col("t0").alias("__a0"), F.col("t1").alias("__a1"))
    b = iv.select(*keys, F.col("state").alias("other"), F.col("iseg").alias("__ib"), F.col("t0").alias("__b0"), F.col("t1").alias("__b1"))
    clash = overlapping(a, b, keys, width, "__a0", "__a1", "__b0", "__b1").where((F.col("state") != F.col("other")) | (F.col("__ia") != F.col("__ib")))
    names = iv.select("state").distinct()
    pairs = names.crossJoin(names.withColumnRenamed("state", "other"))  # of the few state names
    found = clash.select("state", "other").distinct().withColumn("__clash", F.lit(True))
    return pairs.join(found, ["state", "other"], "left").select("state", "other", F.col("__clash").isNull().alias("disjoint"))


def transitions(iv: DataFrame, keys: list[str], at_end: bool = True) -> DataFrame:
    """keys, t, before, after: changes of state between consecutive intervals, at the end of one or the start of the next."""
    w = W.partitionBy(*keys).orderBy("t0", "t1")
    if at_end:
        out = iv.select(*keys, F.col("t1").alias("t"), F.col("state").alias("before"), F.lead("state").over(w).alias("after"))
    else:
        out = iv.select(*keys, F.col("t0").alias("t"), F.lag("state").over(w).alias("before"), F.col("state").alias("after"))
    return out.where("before <> after")


def transition_intervals(iv: DataFrame, keys: list[str], before: str, after: str, pre: float, post: float, whole: bool = True) -> DataFrame:
    """keys, t0, t1 about each transition; whole: its time is cut to whole seconds first."""
    hit = transitions(iv, keys).where((F.col("before") == before) & (F.col("after") == after))
    t = F.col("t").cast("long") if whole else F.col("t")
    return hit.select(*keys, (t - F.lit(float(pre))).alias("t0"), (t + F.lit(float(post))).alias("t1"))


def with_state(iv: DataFrame, more: DataFrame, keys: list[str], state: str) -> DataFrame:
    """iv with the intervals `more` as a further state."""
    iseg = F.row_number().over(W.partitionBy(*keys).orderBy("t0", "t1")).cast("long") - 1
    return iv.select(*keys, "state", "iseg", "t0", "t1").unionByName(more.select(*keys, F.lit(state).alias("state"), iseg.alias("iseg"), "t0", "t1"))


def intermediate_intervals(iv: DataFrame, keys: list[str], before: str, after: str, duration: float, ignored: list[str]) -> DataFrame:
    """keys, t0, t1: the last `duration` before each change from one state to the other, as if others were not there."""
    hit = transitions(iv.where(~F.col("state").isin(ignored)), keys).where((F.col("before") == before) & (F.col("after") == after))
    return hit.select(*keys, (F.col("t") - F.lit(float(duration))).alias("t0"), F.col("t").alias("t1"))


def durations(iv: DataFrame) -> DataFrame:
    return iv.groupBy("state").agg(F.sum(F.col("t1") - F.col("t0")).alias("duration"))


def without_corrupt(iv: DataFrame) -> DataFrame:
    return iv.where("t1 > t0")


def purified(iv: DataFrame, keys: list[str], macro: list[str], micro: list[str], width: float) -> DataFrame:
    """keys, state, t0, t1 of the macro states without any micro state, and of the micro states as they are."""
    own = iv.select(*keys, "state", "t0", "t1")
    small = own.where(F.col("state").isin(micro))
    return subtracted(small, own.where(F.col("state").isin(macro)), keys, width).unionByName(small)
