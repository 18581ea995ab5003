"""Spectra and their features: tables (keys, k, freq, p), one row a frequency bin; complex values as re and im."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import dsp
from siglake.operators import kernels
from siglake.operators.series import EPS, gradient, over


def periodogram(df: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """|X|^2 / (fs n) of series without their mean, not doubled."""
    def f(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x.shape[-1]
        return np.fft.rfftfreq(n, 1 / fs), np.abs(np.fft.rfft(x - x.mean(axis=-1, keepdims=True), axis=-1)) ** 2 / (fs * n)

    return kernels.spectra(df, keys, f)


def psd_welch(df: DataFrame, keys: list[str], fs: float, nperseg: int = 256, noverlap: int | None = None) -> DataFrame:
    return kernels.spectra(df, keys, lambda x: dsp.welch(x, fs, nperseg, noverlap))


def psd_multitaper(df: DataFrame, keys: list[str], fs: float, nw: float = 4) -> DataFrame:
    return kernels.spectra(df, keys, lambda x: dsp.psd_multitaper(x, fs, nw))


def multitaper_fft(df: DataFrame, keys: list[str], fs: float, nw: float = 2) -> DataFrame:
    """keys, taper, k, freq, re, im."""
    def run(x: np.ndarray) -> pd.DataFrame:
        y = dsp.multitaper_fft(x, nw)
        taper, k = np.indices(y.shape)
        return pd.DataFrame({"taper": taper.ravel(), "k": k.ravel(), "freq": np.fft.rfftfreq(len(x), 1 / fs)[k.ravel()], "re": y.real.ravel(), "im": y.imag.ravel()})

    return kernels.expanded(df, keys, run, "taper int, k int, freq double, re double, im double")


def spectrogram(df: DataFrame, keys: list[str], fs: float, nperseg: int, noverlap: int | None = None, nw: float = 4) -> DataFrame:
    """keys, win, t, k, freq, p."""
    def run(x: np.ndarray) -> pd.DataFrame:
        f, t, p = dsp.spectrogram(x, fs, nperseg, noverlap, nw)
        win, k = np.indices(p.shape)
        return pd.DataFrame({"win": win.ravel(), "t": t[win.ravel()], "k": k.ravel(), "freq": f[k.ravel()], "p": p.ravel()})

    return kernels.expanded(df, keys, run, "win int, t double, k int, freq double, p double")


def psd_from_tapers(y: DataFrame, keys: list[str], fs: float, n: int) -> DataFrame:
    return y.groupBy(*keys, "k", "freq").agg((F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (fs * n)).alias("p"))


def to_db(p: str = "p", ref: float = 1.0) -> Column:
    return 10 * F.log10(F.col(p) / ref)


def _trapezoid(df: DataFrame, keys: list[str], out: str = "__area") -> DataFrame:
    """df with the area between each bin and the next one that is there."""
    w = over(keys, "freq")
    return df.withColumn(out, (F.lead("freq").over(w) - F.col("freq")) * (F.lead("p").over(w) + F.col("p")) / 2)


def band_power(psd: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """keys, power: trapezoid over the bins of the closed band; bands without a bin give no row."""
    return _trapezoid(psd.where(F.col("freq").between(low, high)), keys).groupBy(*keys).agg(F.coalesce(F.sum("__area"), F.lit(0.0)).alias("power"))


def relative_band_power(psd: DataFrame, keys: list[str], low: float, high: float, norm: tuple[float, float] | None = None) -> DataFrame:
    whole = psd if norm is None else psd.where(F.col("freq").between(*norm))
    total = _trapezoid(whole, keys).groupBy(*keys).agg(F.sum("__area").alias("__total"))
    return band_power(psd, keys, low, high).join(total, keys).select(*keys, (F.col("power") / (F.col("__total") + F.lit(EPS))).alias("relative"))


def spectral_entropy(psd: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entropy: -sum p ln(p) df of the spectrum with area 1, df by gradients of the frequency."""
    d = psd.withColumn("__df", gradient("freq", over(keys, "freq")))
    p = F.col("p") / (F.sum(F.col("p") * F.col("__df")).over(W.partitionBy(*keys)) + F.lit(EPS))
    return d.withColumn("__p", p).groupBy(*keys).agg((-F.sum(F.col("__p") * F.ln(F.col("__p") + F.lit(EPS)) * F.col("__df"))).alias("entropy"))


def spectral_edge(psd: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """keys, edge: frequency, interpolated, below which lies this share of the area."""
    w = over(keys, "freq")
    c = _trapezoid(psd, keys).withColumn("__c", F.coalesce(F.sum("__area").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    c = c.withColumn("__goal", share * F.max("__c").over(W.partitionBy(*keys))).withColumn("__f0", F.lag("freq").over(w)).withColumn("__c0", F.lag("__c").over(w))
    first = c.where("__c >= __goal").groupBy(*keys).agg(F.min_by(F.struct("freq", "__f0", "__c", "__c0", "__goal"), "freq").alias("z"))
    z = F.col("z")
    line = z["__f0"] + (z["__goal"] - z["__c0"]) / F.nullif(z["__c"] - z["__c0"], F.lit(0.0)) * (z["freq"] - z["__f0"])
    return first.select(*keys, F.coalesce(line, z["freq"]).alias("edge"))


def _mean(low: float, high: float) -> Column:
    return F.avg(F.when(F.col("freq").between(low, high), F.col("p")))


def broadband_snr(sig: tuple[float, float], noise: tuple[float, float]) -> Column:
    return F.log10((_mean(*sig) + F.lit(EPS)) / (_mean(*noise) + F.lit(EPS)))


def line_noise_ratio(line: float, bw: float) -> Column:
    """Mean power at the line over that of its flanks, 2 to 4 bandwidths away."""
    off = F.abs(F.col("freq") - line)
    return F.avg(F.when(off <= bw, F.col("p"))) / (F.avg(F.when(off.between(2 * bw, 4 * bw), F.col("p"))) + F.lit(EPS))


def am_artifact_score(fc: float, fm: float, bw: float) -> Column:
    """log10 of sideband over background power, which is taken 3 fm off the carrier."""
    side = (F.abs(F.abs(F.col("freq") - fc) - fm)) <= bw
    back = (F.abs(F.abs(F.col("freq") - fc) - 3 * fm)) <= bw
    return F.log10((F.avg(F.when(side, F.col("p"))) + F.lit(EPS)) / (F.avg(F.when(back, F.col("p"))) + F.lit(EPS)))


def am_depth(fc: float, fm: float, carrier_bw: float, bw: float) -> Column:
    side = (F.abs(F.abs(F.col("freq") - fc) - fm)) <= bw
    return F.log10((F.avg(F.when(side, F.col("p"))) + F.lit(EPS)) / (F.avg(F.when(F.abs(F.col("freq") - fc) <= carrier_bw, F.col("p"))) + F.lit(EPS)))


def spectral_flatness() -> Column:
    return F.exp(F.avg(F.ln(F.col("p") + F.lit(EPS)))) / (F.avg("p") + F.lit(EPS))


def narrowband_ratio(psd: DataFrame, keys: list[str], flank: float) -> DataFrame:
    """psd with ratio: power over the median of the bins within flank Hz but itself; null with fewer than two of them."""
    w = W.partitionBy(*keys).orderBy(F.rint(F.col("freq") * 1_000_000).cast("long")).rangeBetween(-round(flank * 1e6), round(flank * 1e6))
    around = F.array_sort(F.filter(F.collect_list(F.struct("k", "p")).over(w), lambda x: x["k"] != F.col("k")), lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))
    own = psd.withColumn("__a", F.transform(around, lambda x: x["p"])).withColumn("__n", F.size("__a"))
    mid = (F.element_at("__a", F.floor((F.col("__n") + 1) / 2).cast("int")) + F.element_at("__a", F.floor(F.col("__n") / 2 + 1).cast("int"))) / 2
    return own.withColumn("ratio", F.when(F.col("__n") >= 2, F.col("p") / mid)).drop("__a", "__n")


def reduced_bands(psd: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], method: str = "mean") -> DataFrame:
    """keys, band, value: one aggregate of the bins of each named band (closed)."""
    table = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for n, (a, b) in bands.items()])
    inside = psd.withColumn("__b", F.explode(F.filter(table, lambda b: (F.col("freq") >= b["lo"]) & (F.col("freq") <= b["hi"]))))
    return inside.groupBy(*keys, F.col("__b.band").alias("band")).agg({"mean": F.avg, "median": F.median, "max": F.max, "sum": F.sum}[method]("p").alias("value"))


def normalized(psd: DataFrame, keys: list[str], method: str = "robust_zscore") -> DataFrame:
    """psd with y: robust z over the bins of a key, or decibels above the smallest positive number."""
    if method == "db":
        return psd.withColumn("y", 10 * F.log10(F.greatest("p", F.lit(2.2250738585072014e-308))))
    w = W.partitionBy(*keys)
    m = psd.withColumn("__m", F.median("p").over(w)).withColumn("__s", F.median(F.abs(F.col("p") - F.col("__m"))).over(w))
    return m.withColumn("y", (F.col("p") - F.col("__m")) / (1.4826 * F.col("__s") + F.lit(EPS))).drop("__m", "__s")


def line_bins(f0: float, width: float, n: int) -> Column:
    """Whether a bin is within width of one of the first n harmonics."""
    out = F.lit(False)
    for k in range(1, n + 1):
        out = out | (F.abs(F.col("freq") - k * f0) <= width)
    return out


def cross(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, freq, and over tapers: mean of X conj(Y) (sxy_re, sxy_im), sxx, syy, and the phase-locking value plv."""
    b = y.select(*keys, "taper", "k", F.col("re").alias("re_y"), F.col("im").alias("im_y"))
    re = F.col("re") * F.col("re_y") + F.col("im") * F.col("im_y")
    im = F.col("im") * F.col("re_y") - F.col("re") * F.col("im_y")
    size = F.hypot(re, im) + F.lit(EPS)
    own = x.join(b, [*keys, "taper", "k"])
    return own.groupBy(*keys, "k", "freq").agg(
        F.avg(re).alias("sxy_re"), F.avg(im).alias("sxy_im"), F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("sxx"),
        F.avg(F.col("re_y") * F.col("re_y") + F.col("im_y") * F.col("im_y")).alias("syy"), F.hypot(F.avg(re / size), F.avg(im / size)).alias("plv"),
    )


def coherence() -> Column:
    c = (F.col("sxy_re") * F.col("sxy_re") + F.col("sxy_im") * F.col("sxy_im")) / (F.col("sxx") * F.col("syy") + F.lit(EPS))
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def fstat(y: DataFrame, keys: list[str], f0: float) -> DataFrame:
    """keys, f: (K - 1) |mu|^2 over the rest, of the tapers' sum mu at the bin nearest f0."""
    near = y.withColumn("__r", F.dense_rank().over(W.partitionBy(*keys, "taper").orderBy(F.abs(F.col("freq") - f0), "k"))).where("__r = 1")
    n, re, im = F.count("*"), F.sum("re"), F.sum("im")
    mu2, all_ = re * re + im * im, F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return near.groupBy(*keys).agg(((n - 1) * mu2 / n / (all_ - mu2 / n + F.lit(EPS))).alias("f"))


def autocovariance(df: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """keys, c0, c1, ...: sum of x[i + p] x[i] over n - p, less the squared mean."""
    w = over(keys, "i")
    own = df.select(*keys, "x", *[F.lead("x", p).over(w).alias(f"__{p}") for p in range(lags + 1)])
    n = F.count("x")
    return own.groupBy(*keys).agg(*[(F.try_divide(F.sum(F.col("x") * F.col(f"__{p}")), n - p) - F.avg("x") * F.avg("x")).alias(f"c{p}") for p in range(lags + 1)])


def ar_yule(df: DataFrame, keys: list[str], order: int) -> DataFrame:
    """keys, a1, ...: autoregressive coefficients by the Yule-Walker equations (Levinson and Durbin), as expressions."""
    c = autocovariance(df, keys, order)
    a: list[Column] = []
    error = F.col("c0")
    cols = c
    for m in range(1, order + 1):
        reflect = F.col(f"c{m}")
        for j in range(1, m):
            reflect = reflect - F.col(f"a{j}") * F.col(f"c{m - j}")
        cols = cols.withColumn("__k", F.try_divide(reflect, error if m == 1 else F.col("__e")))
        cols = cols.select("*", *[(F.col(f"a{j}") - F.col("__k") * F.col(f"a{m - j}")).alias(f"__a{j}") for j in range(1, m)])
        for j in range(1, m):
            cols = cols.withColumn(f"a{j}", F.col(f"__a{j}")).drop(f"__a{j}")
        cols = cols.withColumn(f"a{m}", F.col("__k")).withColumn("__e", (F.col("c0") if m == 1 else F.col("__e")) * (1 - F.col("__k") * F.col("__k"))).drop("__k")
        a.append(F.col(f"a{m}"))
    return cols.select(*keys, *a)


def whitened(df: DataFrame, keys: list[str], coefficients: list[float]) -> DataFrame:
    """df with y: x less its prediction from the samples before it; those before the start are 0."""
    w = over(keys, "i")
    out = F.col("x")
    for p, a in enumerate(coefficients, 1):
        out = out - float(a) * F.coalesce(F.lag("x", p).over(w), F.lit(0.0))
    return df.withColumn("y", out)


def clipped(psd: DataFrame, low: float = 1.0, high: float = 30.0) -> DataFrame:
    """The rows of frequencies in [low, high]."""
    return psd.where(F.col("freq").between(low, high))
