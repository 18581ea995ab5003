"""Synthetic signals as columns of t and position, and seeded tables for tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def biexp(t: Column, a: float = 1.0, alpha: float = 1.0, beta: float = 0.5, t0: float = 0.0) -> Column:
    return F.when(t >= t0, a * (F.exp(-alpha * (t - t0)) - F.exp(-beta * (t - t0)))).otherwise(F.lit(0.0))


def smoothstep_cutoff(t: Column, t0: float, span: float) -> Column:
    """1 before t0, falling smoothly to 0 at t0 + span."""
    x = (t - t0) / span
    return F.when(x < 0, F.lit(1.0)).when(x < 1, 1 - 3 * x * x + 2 * x * x * x).otherwise(F.lit(0.0))


def tukey_cutoff(t: Column, t0: float, span: float, alpha: float = 0.5) -> Column:
    """1 up to a share (1 - alpha) / 2 of the span, then a cosine taper to its end; 0 outside."""
    x, start = (t - t0) / span, (1 - alpha) / 2
    taper = 0.5 * (1 + F.cos(math.pi * (x - start) / (1 - start)))
    return F.when((x < 0) | (x > 1), F.lit(0.0)).when(x <= start, F.lit(1.0)).otherwise(taper)


def finite_biexp(t: Column, a: float = 1.0, alpha: float = 1.0, beta: float = 0.5, t0: float = 0.0, span: float = 1.0, window: str = "smoothstep") -> Column:
    return biexp(t, a, alpha, beta, t0) * (smoothstep_cutoff if window == "smoothstep" else tukey_cutoff)(t, t0, span)


def plane_wave(t: Column, x: Column, y: Column, direction: float, speed: float, frequency: float) -> Column:
    """cos of 2 pi f (t - k . r), k pointing along the direction."""
    return F.cos(2 * math.pi * frequency * (t - (math.cos(direction) * x + math.sin(direction) * y) / speed))


def spiral_wave(t: Column, x: Column, y: Column, cx: float, cy: float, angular: float) -> Column:
    return F.cos(angular * t + F.atan2(y - cy, x - cx))


def wave_packet(t: Column, x: Column, y: Column, direction: float, speed: float, frequency: float, t0: float, sigma_t: float, cx: float, cy: float, sigma_x: float) -> Column:
    """A plane wave in Gaussian envelopes of time and space."""
    envelope = F.exp(-F.pow(t - t0, F.lit(2)) / (2 * sigma_t**2) - (F.pow(x - cx, F.lit(2)) + F.pow(y - cy, F.lit(2))) / (2 * sigma_x**2))
    return plane_wave(t, x, y, direction, speed, frequency) * envelope


def gaussian_mode(x: Column, y: Column, cx: float, cy: float, sigma: float, period: float | None = None) -> Column:
    """A bump; distances wrap around the period, if there is one."""
    def off(v: Column, c: float) -> Column:
        d = F.abs(v - c)
        return F.least(d, F.lit(float(period)) - d) if period else d

    return F.exp(-(F.pow(off(x, cx), F.lit(2)) + F.pow(off(y, cy), F.lit(2))) / (2 * sigma * sigma))


def monopole(x: Column, y: Column, z: Column, charge: float = 1.0) -> Column:
    """1 / r^2 potential; null at the source."""
    return F.lit(charge) / F.nullif(x * x + y * y + z * z, F.lit(0.0))


def dipole(x: Column, y: Column, z: Column, gap: float, charge: float = 1.0) -> Column:
    return monopole(x, y, z - gap / 2, charge) - monopole(x, y, z + gap / 2, charge)


def grid(spark: SparkSession, n_time: int, n_ap: int, n_ml: int, fs: float) -> DataFrame:
    """i, t, ap, ml in row-major order, made where it is used."""
    own = spark.range(n_time * n_ap * n_ml)
    i = F.floor(F.col("id") / (n_ap * n_ml))
    return own.select(i.alias("i"), (i / fs).alias("t"), (F.floor(F.col("id") / n_ml) % n_ap).cast("int").alias("ap"), (F.col("id") % n_ml).cast("int").alias("ml"))


def noise(seed: int, scale: float = 1.0) -> Column:
    """Standard normal noise, reproducible for equal partitioning."""
    return F.randn(seed) * scale


def uniform(seed: int, *of: str) -> Column:
    """Uniform in [0, 1) by the first 52 bits of a digest of columns: the same however rows are partitioned, and in any engine with MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in of]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def normal(seed: int, *of: str) -> Column:
    """Standard normal by Box and Muller from two hashes."""
    return F.sqrt(-2 * F.ln(1 - uniform(seed, *of))) * F.cos(2 * math.pi * uniform(seed + 1, *of))


def poisson_process(spark: SparkSession, channels: int, rate: float, duration: float, seed: int) -> DataFrame:
    """ch, k, t: event times with exponential gaps; each channel draws what it needs for certain, and no more is kept."""
    from pyspark.sql import Window as W

    most = int(rate * duration + 10 * math.sqrt(rate * duration) + 20)
    gaps = spark.range(channels * most).select(F.floor(F.col("id") / most).alias("ch"), (F.col("id") % most).alias("k")).withColumn("gap", -F.ln(1 - uniform(seed, "ch", "k")) / rate)
    return gaps.withColumn("t", F.sum("gap").over(W.partitionBy("ch").orderBy("k").rowsBetween(W.unboundedPreceding, 0))).where(F.col("t") < duration).drop("gap")


def convolved(impulses: DataFrame, kernel: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """keys, i, x: the kernel (k, v) laid at every impulse (keys, i, a), overlaps summed; n cuts to the signal's length."""
    ends = kernel.agg(F.coalesce(F.min("k"), F.lit(0)).alias("a"), F.coalesce(F.max("k"), F.lit(0)).alias("b")).first()
    laid = impulses.withColumn("k", F.explode(F.sequence(F.lit(ends["a"]), F.lit(ends["b"])))).join(kernel, "k")
    out = laid.select(*keys, (F.col("i") + F.col("k")).alias("i"), (F.col("a") * F.col("v")).alias("x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return out if n is None else out.where((F.col("i") >= 0) & (F.col("i") < n))


def mixed(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of signals (keys, x)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("x").alias("x"))


def poisson_bursts(spark: SparkSession, channels: int, rate: float, duration: float, burst: float, refractory: float, seed: int) -> DataFrame:
    """ch, t0, t1: bursts at Poisson times; those that begin before the last kept one's end and refractory time are dropped."""
    trains = poisson_process(spark, channels, rate, duration, seed).groupBy("ch").agg(F.array_sort(F.collect_list("t")).alias("all"))
    keep = F.aggregate("all", F.expr("cast(array() as array<double>)"), lambda kept, t: F.when((F.size(kept) == 0) | (t >= F.element_at(kept, -1) + burst + refractory), F.array_append(kept, t)).otherwise(kept))
    return trains.select("ch", F.explode(keep).alias("t0")).withColumn("t1", F.col("t0") + burst)


def gaussian_cover(n_ap: int, n_ml: int, k_ap: int, k_ml: int, overlap: float = 0.5) -> list[list[tuple[int, int, float]]]:
    """(ap, ml, weight) of each of k_ap x k_ml Gaussian modes whose centres tile the grid; overlap: sigma over their distance."""
    step_ap, step_ml = n_ap / k_ap, n_ml / k_ml
    centres = [((a + 0.5) * step_ap - 0.5, (m + 0.5) * step_ml - 0.5) for a in range(k_ap) for m in range(k_ml)]
    places = [(a, m) for a in range(n_ap) for m in range(n_ml)]
    return [[(a, m, math.exp(-0.5 * (((a - x) / (overlap * step_ap)) ** 2 + ((m - y) / (overlap * step_ml)) ** 2))) for a, m in places] for x, y in centres]


def mode_process(mode: list[tuple[int, int, float]], envelope: DataFrame) -> DataFrame:
    """i, ap, ml, x: a mode of fixed places times an envelope (i, e)."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("ap"), F.lit(m).alias("ml"), F.lit(w).alias("w")) for a, m, w in mode])).alias("m")
    return envelope.select("i", "e", at).select("i", "m.ap", "m.ml", (F.col("e") * F.col("m.w")).alias("x"))


def mode_mixer(modes: list[list[tuple[int, int, float]]], envelopes: list[DataFrame]) -> DataFrame:
    """Sum of the modes' processes."""
    return mixed([mode_process(m, e) for m, e in zip(modes, envelopes, strict=True)], ["i", "ap", "ml"])


def blobs(points: DataFrame, centres: list[dict[str, float]], widths: dict[str, float], background: float = 0.0) -> DataFrame:
    """points with x: a background and a Gaussian blob at each centre, over the dimensions named in widths."""
    x = F.lit(background)
    for c in centres:
        far = sum((((F.col(d) - c[d]) / w) ** 2 for d, w in widths.items()), F.lit(0.0))
        x = x + c.get("amp", 1.0) * F.exp(-0.5 * far)
    return points.withColumn("x", x)
