"""Threshold, bout and slow-wave detectors: gaps and islands over integer sample index `i` with time `t` and value `x`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators.series import merged_runs, over, true_runs


def _inside(samples: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with the run (i0, i1) that holds them; runs of a key are disjoint.

    Each sample takes the last run that begins at or before it, by one ordered window over both tables.
    """
    none = F.lit(None).cast("long")
    both = samples.select(*keys, "i", "t", "x", none.alias("__i0"), none.alias("__i1")).unionByName(
        runs.select(*keys, F.col("i0").alias("i"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("x"), F.col("i0").alias("__i0"), F.col("i1").alias("__i1"))
    )
    w = over(keys, ["i", F.col("__i0").isNull()]).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = both.withColumn("i0", F.last("__i0", True).over(w)).withColumn("i1", F.last("__i1", True).over(w))
    return held.where("__i0 is null and i <= i1").drop("__i0", "__i1")


def summarised(samples: DataFrame, runs: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """keys, i0, i1, t0, t1, t (where `best` is largest, the first of equals), value, n of each run."""
    return _inside(samples, runs, keys).groupBy(*keys, "i0", "i1").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.max_by(F.struct("t", "x"), F.struct(best, -F.col("i"))).alias("p"), F.max(best).alias("top"), F.count("*").alias("n")
    ).select(*keys, "i0", "i1", "t0", "t1", F.col("p.t").alias("t"), F.col("p.x").alias("value"), "top", "n")


def threshold_events(samples: DataFrame, keys: list[str], threshold: float, direction: str = "positive", merge_gap: int = 0, min_duration: float = 0.0) -> DataFrame:
    """Runs beyond the threshold, merged over gaps; those of one sample or less than min_duration go. value is the raw one."""
    h = abs(threshold)
    hit, best = {"positive": (F.col("x") >= h, F.col("x")), "negative": (F.col("x") <= -h, -F.col("x")), "both": (F.abs("x") >= h, F.abs("x"))}[direction]
    runs = merged_runs(true_runs(samples, keys, "i", hit), keys, merge_gap).where("i1 > i0")
    out = summarised(samples, runs, keys, best).drop("top", "n")
    return out.withColumn("duration", F.col("t1") - F.col("t0")).where(F.col("duration") >= min_duration)


def dual_threshold_events(samples: DataFrame, keys: list[str], low: float, high: float, direction: str = "positive") -> DataFrame:
    """Runs of x >= low that reach high, with their first peak. Negative: of -x, whose value is reported."""
    own = samples if direction == "positive" else samples.withColumn("x", -F.col("x"))
    runs = true_runs(own, keys, "i", F.col("x") >= low)
    return summarised(own, runs, keys, F.col("x")).where(F.col("top") >= high).drop("top")


def bouts(samples: DataFrame, keys: list[str], low: float, high: float, min_duration: float = 0.0, merge_gap: float = 0.0) -> DataFrame:
    """Dual-threshold runs, those less than merge_gap apart merged (in samples of the median time step), of min_duration or more."""
    first = dual_threshold_events(samples, keys, low, high).select(*keys, "i0", "i1")
    if merge_gap > 0:
        step = samples.withColumn("__d", F.col("t") - F.lag("t").over(over(keys, "i"))).groupBy(*keys).agg(F.median("__d").alias("__step"))
        held = first.join(step, keys).withColumn("__gap", F.rint(F.lit(merge_gap) / F.col("__step")).cast("long"))
        first = merged_runs(held, keys, F.col("__gap"))
    out = summarised(samples, first, keys, F.col("x")).drop("top")
    return out.withColumn("duration", F.col("t1") - F.col("t0")).where(F.col("duration") >= min_duration)


def occupancy(found: DataFrame, keys: list[str], total: float) -> DataFrame:
    """Share of the total that bouts fill, 1 at most."""
    if total <= 0:
        raise ValueError("the total duration must be positive")
    return found.groupBy(*keys).agg(F.least(F.sum("duration") / total, F.lit(1.0)).alias("occupancy"))


def duration_summary(found: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("duration")
    return found.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"), F.percentile(d, 0.05).alias("p5"), F.percentile(d, 0.95).alias("p95")
    )


def zero_crossings(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, falling: the sample before each change of sign; 0 counts as positive."""
    positive = F.col("x") >= 0
    following = F.lead(positive).over(over(keys, "i"))
    return samples.withColumn("__next", following).where(F.col("__next") != positive).select(*keys, "i", positive.alias("falling"))


def slow_waves(samples: DataFrame, keys: list[str], neg: tuple[float, float], cycle: tuple[float, float], percentile: float) -> DataFrame:
    """Half-wave pairs: falling crossing, next rising, next falling one (or the end), with trough, peak and their height.

    Of the candidates with durations in both ranges, those whose height is at least this percentile of a key's candidates.
    """
    crossings = zero_crossings(samples, keys)
    ends = samples.groupBy(*keys).agg(F.max("i").alias("__last"))
    w = over(keys, "i").rowsBetween(1, W.unboundedFollowing)
    rise, fall = F.min(F.when(~F.col("falling"), F.col("i"))).over(w), F.min(F.when(F.col("falling"), F.col("i"))).over(w)
    waves = crossings.withColumn("i_up", rise).withColumn("i_end", fall).join(ends, keys).where("falling and i_up is not null")
    waves = waves.select(*keys, F.col("i").alias("i0"), "i_up", F.coalesce("i_end", "__last").alias("i1"))
    parts = waves.select(*keys, "i0", (F.col("i1") - 1).alias("i1"), F.col("i1").alias("end"), "i_up")
    inner = _inside(samples, parts.select(*keys, "i0", "i1"), keys).join(parts, [*keys, "i0", "i1"])
    bounds = samples.select(*keys, F.col("i").alias("end"), F.col("t").alias("t1"))
    got = inner.groupBy(*keys, "i0", "i_up", "end").agg(
        F.min(F.when(F.col("i") == F.col("i0"), F.col("t"))).alias("t0"), F.max(F.when(F.col("i") == F.col("i_up"), F.col("t"))).alias("t_up"),
        F.min_by(F.struct("t", "x"), F.struct("x", "i")).alias("trough"),
        F.max_by(F.struct("t", "x"), F.when(F.col("i") >= F.col("i_up"), F.struct("x", -F.col("i")))).alias("peak"),
    ).join(bounds, [*keys, "end"])
    got = got.select(*keys, "i0", "t0", "t_up", "t1", F.col("trough.t").alias("t"), F.col("trough.x").alias("trough"), F.col("peak.x").alias("peak"), (F.col("peak.x") - F.col("trough.x")).alias("ptp"))
    got = got.where((F.col("t_up") - F.col("t0")).between(*neg) & (F.col("t1") - F.col("t0")).between(*cycle))
    return got.withColumn("__p", F.percentile("ptp", percentile / 100).over(W.partitionBy(*keys))).where("ptp >= __p").drop("__p")


def isolated(found: DataFrame, keys: list[str], min_isolation: float) -> DataFrame:
    """Greedy from left to right: of events less than min_isolation after the last kept one, the larger value stays.

    A fold over each key's ordered events, as each decision rests on the one before.
    """
    row = F.struct("t", "value", *[c for c in found.columns if c not in (*keys, "t", "value")])
    ordered = found.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (x["t"] - last["t"] < min_isolation)
        return F.when(~near, F.array_append(kept, x)).when(x["value"] > last["value"], F.array_append(F.slice(kept, 1, F.size(kept) - 1), x)).otherwise(kept)

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return ordered.select(*keys, F.inline(kept)).select(*found.columns)


def enriched(samples: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """found (keys, i0, i1) with frequency by sign changes, power relative to the whole series', and symmetry of the peak."""
    inner = _inside(samples, found.select(*keys, "i0", "i1"), keys)
    signs = inner.withColumn("__s", (F.signum("x") != F.lag(F.signum("x")).over(W.partitionBy(*keys, "i0").orderBy("i"))).cast("int"))
    whole = samples.groupBy(*keys).agg(F.avg(F.col("x") * F.col("x")).alias("__all"))
    got = signs.groupBy(*keys, "i0").agg(F.sum("__s").alias("__n"), (F.max("t") - F.min("t")).alias("__d"), F.avg(F.col("x") * F.col("x")).alias("__own"), F.max_by("i", F.struct("x", -F.col("i"))).alias("__top"), F.count("*").alias("__len"))
    got = got.join(whole, keys).select(
        *keys, "i0", F.try_divide("__n", 2 * F.col("__d")).alias("frequency"), F.try_divide("__own", "__all").alias("rel_power"), F.try_divide(F.col("__top") - F.col("i0"), F.col("__len") - 1).alias("symmetry")
    )
    return found.join(got, [*keys, "i0"], "left")
