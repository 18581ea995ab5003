"""Channel features, interpolation over irregular places, line noise, surrogates, blobs, wavenumber spectra and the rest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import complexity, dsp, extra, neighbors, temporal
from siglake.operators import kernels, spatial, windows
from siglake.operators import series as ser
from siglake.plans import q_kernels, sqltext as st
from siglake.plans.registry import query
from siglake.sources import views

K, FS = ["vec_id"], 100.0


def _series(spark, sf_dir):
    return views.sig_64(spark, sf_dir)


def _grid(spark, sf_dir):
    return views.sig_grid(spark, sf_dir)


# Channel features: vectors of one label are the samples, positions the channels.
CH = "ch AS (SELECT (i // 8)::INT AS ap, (i % 8)::INT AS ml, vec_id AS n, x FROM sig_64)"


def _channels(spark, sf_dir):
    s = _grid(spark, sf_dir)
    return s.select("ap", "ml", F.col("vec_id").alias("n"), "x")


FEATURES = {
    "variance": (lambda: F.var_pop("x"), "var_pop(x)"),
    "amplitude": (lambda: F.max("x") - F.min("x"), "max(x) - min(x)"),
    "kurtosis": (lambda: F.kurtosis("x") + 3, "kurtosis_pop(x) + 3"),
    "deviation": (lambda: F.avg("x"), "avg(x)"),
}
DERIVATIVE = """d AS (SELECT ap, ml, n, x, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS dx FROM ch WINDOW w AS (PARTITION BY ap, ml ORDER BY n))"""


@query(f"{CH}, {DERIVATIVE} SELECT ap, ml, {', '.join(f'round({s}, 6) AS {n}' for n, (_, s) in FEATURES.items())}, round(avg(abs(dx)), 6) AS time_derivative FROM d GROUP BY ap, ml")
def extract_channel_features(spark, sf_dir):
    """Features of each channel in one pass; those that need the whole series are hurst_exponent and noise_to_signal."""
    own = temporal.prepared(_channels(spark, sf_dir), ["ap", "ml"], "n", "x")
    return own.groupBy("ap", "ml").agg(*[F.round(c(), 6).alias(n) for n, (c, _) in FEATURES.items()], F.round(temporal.time_derivative(), 6).alias("time_derivative"))


@query(f"{CH}, w AS (SELECT unnest(range(0, (max(n) + 1 - 60) // 25 + 1)) AS win FROM ch) SELECT win, ap, ml, {', '.join(f'round({s}, 6) AS {n}' for n, (_, s) in FEATURES.items())} FROM ch JOIN w ON n >= win * 25 AND n < win * 25 + 60 GROUP BY win, ap, ml")
def compute_features_sliding(spark, sf_dir):
    own = windows.running_reduce(_channels(spark, sf_dir), ["ap", "ml"], 60, 25, "n", **{n: c() for n, (c, _) in FEATURES.items()})
    return own.select("win", "ap", "ml", *[F.round(n, 6).alias(n) for n in FEATURES])


@query(
    f"""{CH}, f AS (SELECT ap, ml, var_pop(x) AS x FROM ch GROUP BY ap, ml), h AS (SELECT a.ap, a.ml, a.x, b.x AS y, median(b.x) OVER (PARTITION BY a.ap, a.ml) AS m FROM f a JOIN f b ON abs(a.ap - b.ap) <= 1 AND abs(a.ml - b.ml) <= 1 AND (a.ap <> b.ap OR a.ml <> b.ml))
  SELECT ap, ml, round(any_value(x) / (any_value(m) + 1e-12), 6) AS ratio, round(any_value(x) - any_value(m), 6) AS difference, round(0.67449 * (any_value(x) - any_value(m)) / (median(abs(y - m)) + 1e-12), 4) AS z FROM h GROUP BY ap, ml"""
)
def normalize_features_from_raw(spark, sf_dir):
    f = _channels(spark, sf_dir).groupBy("ap", "ml").agg(F.var_pop("x").alias("x"))
    own = spatial.neighborhood(f, [], spatial.ADJACENCY["queen"])
    return own.select("ap", "ml", F.round(spatial.normalize_ratio(), 6).alias("ratio"), F.round(spatial.normalize_difference(), 6).alias("difference"), F.round(spatial.normalize_robust_z(), 4).alias("z"))


@query(
    f"""{CH}, q AS (SELECT ap * 8 + ml AS c, quantile_cont(x, 0.8) AS a, quantile_cont(x, 0.95) AS b FROM ch GROUP BY ap, ml), d AS (SELECT u.c, median(sqrt(power(u.a - v.a, 2) + power(u.b - v.b, 2))) AS d FROM q u JOIN q v ON u.c <> v.c GROUP BY u.c),
  m AS (SELECT *, median(d) OVER () AS m FROM d) SELECT c::INT AS c, round((d - m) / (1.4826 * (SELECT median(abs(d - m)) FROM m)), 5) AS z FROM m"""
)
def deviation_zscore(spark, sf_dir):
    """Robust z of each channel's median distance to the others, by quantiles."""
    q = _channels(spark, sf_dir).groupBy((F.col("ap") * 8 + F.col("ml")).alias("c")).agg(F.percentile("x", 0.8).alias("a"), F.percentile("x", 0.95).alias("b"))
    d = spatial.median_distances(q, ["c"], ["a", "b"])
    m = F.broadcast(d.agg(F.median("d").alias("m")))
    e = d.join(m)
    s = F.broadcast(e.agg((1.4826 * F.median(F.abs(F.col("d") - F.col("m")))).alias("s")))
    return e.join(s).select("c", F.round((F.col("d") - F.col("m")) / F.col("s"), 5).alias("z"))


@query(
    f"""{CH}, q AS (SELECT ap * 8 + ml AS c, 1 AS one, {', '.join(f"quantile_cont(x, {v}) AS v{k}" for k, v in enumerate((0.8, 0.84, 0.88, 0.92, 0.95)))} FROM ch GROUP BY ap, ml),
  {q_kernels.outliers("q", "one", "c", [f"v{k}" for k in range(5)])} SELECT (c // 8)::INT AS ap, (c % 8)::INT AS ml, NOT EXISTS (SELECT 1 FROM ok WHERE ok.a = q.c) AS outlier FROM q"""
)
def find_outlier_channels(spark, sf_dir):
    """Channels apart from the rest by five upper quantiles."""
    q = _channels(spark, sf_dir).groupBy("ap", "ml").agg(F.percentile("x", F.array(*[F.lit(v) for v in (0.8, 0.84, 0.88, 0.92, 0.95)])).alias("q"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return p[["ap", "ml"]].assign(outlier=complexity.dbscan_outliers(np.stack(p["q"].to_list())))

    return q.groupBy(F.lit(1).alias("one")).applyInPandas(run, "ap int, ml int, outlier boolean")


@query(
    """z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), ks AS (SELECT unnest(range(33)) AS k), ps AS (SELECT vec_id, k, power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2) AS p FROM z, ks GROUP BY vec_id, k)
  SELECT vec_id, round(avg(p) FILTER (k * 100 / 64.0 BETWEEN 30 AND 48) / (avg(p) FILTER (k * 100 / 64.0 BETWEEN 1 AND 30) + 1e-12), 7) AS v FROM ps GROUP BY vec_id"""
)
def noise_to_signal(spark, sf_dir):
    """Mean high-band power over mean low-band power."""
    def f(x):
        p, freq = np.abs(np.fft.rfft(x - x.mean())) ** 2, np.fft.rfftfreq(len(x), 1 / FS)
        return {"v": p[(freq >= 30) & (freq <= 48)].mean() / (p[(freq >= 1) & (freq <= 30)].mean() + 1e-12)}

    return kernels.reduced(_series(spark, sf_dir), K, f, ["v"]).select("vec_id", F.round("v", 7).alias("v"))


@query(
    f"RECURSIVE {st.listed()}, {st.filtered('f', 'ls', extra.shoulder_sos(FS, 12, 25, 6), 64)}, {st.samples('f', 'y')} SELECT vec_id, i, round(x, 6) AS y FROM y"
)
def butterworth_bandpass_shoulder(spark, sf_dir):
    return kernels.transformed(_series(spark, sf_dir), K, lambda x: extra.shoulder_bandpass(x, FS, 12, 25, 6)).withColumn("y", F.round("y", 6))


@query(
    f"""o AS (SELECT dt, da, dm FROM range(-2, 3) a(dt), range(-1, 2) b(da), range(-1, 2) c(dm)), s AS (SELECT *, vec_id // 10 AS g, vec_id % 10 AS n FROM sig_grid),
  m AS (SELECT a.vec_id, a.ap, a.ml, any_value(a.x) AS x, median(b.x) AS m FROM s a, o JOIN s b ON b.g = a.g AND b.n = {st.reflected("a.n + dt", 10)} AND b.ap = {st.reflected("a.ap + da", 8)} AND b.ml = {st.reflected("a.ml + dm", 8)} GROUP BY a.vec_id, a.ap, a.ml)
  SELECT vec_id, ap, ml, round(x - m, 6) AS y FROM m"""
)
def median_highpass(spark, sf_dir):
    """x less a 3 x 3 x 5 median over places and samples; ten vectors in a row are the samples, of which some may be missing."""
    own = _grid(spark, sf_dir).select(F.expr("vec_id div 10").alias("g"), (F.col("vec_id") % 10).cast("int").alias("n"), "vec_id", "ap", "ml", "x")
    cubes = own.groupBy("g").agg(F.collect_list(F.struct("n", "ap", "ml", "x", "vec_id")).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in ("n", "ap", "ml", "x", "vec_id")])

    def run(parts):
        for p in parts:
            for k in range(0, len(p), 64):
                some = p.iloc[k : k + 64]
                at = (np.repeat(np.arange(len(some)), some["x"].map(len)), *(np.concatenate(some[c].to_list()) for c in ("n", "ap", "ml")))
                x = np.full((len(some), 10, 8, 8), np.nan)
                x[at] = np.concatenate(some["x"].to_list()).astype(float)
                y = (x - dsp.median_of_present(x, (5, 3, 3)))[at]
                yield pd.DataFrame({"vec_id": np.concatenate(some["vec_id"].to_list()), "ap": at[2], "ml": at[3], "y": y})

    got = cubes.mapInPandas(run, "vec_id long, ap int, ml int, y double")
    return got.withColumn("y", F.round(F.nanvl("y", F.lit(None)), 6))


@query("SELECT user_id, i, round(z, 6) AS z FROM (SELECT user_id, i, t, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS z FROM sig_ev WHERE i BETWEEN 5 AND 25 WINDOW w AS (PARTITION BY user_id)) WHERE user_id IN (3, 9)")
def processing_chain_window(spark, sf_dir):
    """A closed window, standardised, then two channels picked."""
    own = ser.zscorex(views.sig_ev(spark, sf_dir).where("i between 5 and 25"), ["user_id"], "x")
    return own.where("user_id in (3, 9)").select("user_id", "i", F.round("z", 6).alias("z"))


@query()
def interpolate_bads_coords(spark, sf_dir):
    """Bad places of an irregular layout by linear interpolation over triangles, the nearest beyond them. Weights depend on the
    layout alone, so they are computed once and joined."""
    xy = np.array([(m + 0.2 * math.sin(7 * a + m), a + 0.2 * math.cos(5 * m + a)) for a in range(8) for m in range(8)])
    bad = np.array([(k * 5) % 17 == 3 for k in range(64)])
    w = spark.createDataFrame([(int(b), int(g), float(v)) for b, g, v in extra.linear_weights(xy, bad)], "bad int, good int, w double")
    s = _series(spark, sf_dir)
    got = s.join(F.broadcast(w), F.col("i") == F.col("good")).groupBy("vec_id", "bad").agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("y"))
    return got.select("vec_id", F.col("bad").alias("i"), "y")


@query(
    f"""z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), {st.tapers("tp", 64, 2.0)}, h AS (SELECT taper, sum(w) AS h FROM tp GROUP BY taper), hh AS (SELECT sum(h * h) AS hh FROM h),
  y AS (SELECT vec_id, taper, sum(x * w * cos(pi() * i / 2)) AS re, -sum(x * w * sin(pi() * i / 2)) AS im FROM z JOIN tp USING (i) GROUP BY vec_id, taper),
  mu AS (SELECT vec_id, sum(h * re) / any_value(hh) AS a, sum(h * im) / any_value(hh) AS b FROM y JOIN h USING (taper), hh GROUP BY vec_id),
  f AS (SELECT vec_id, any_value(a) AS a, any_value(b) AS b, 2 * any_value(a * a + b * b) * any_value(hh) / sum(power(re - h * a, 2) + power(im - h * b, 2)) > 2 * (power(0.05::DOUBLE, -0.5::DOUBLE) - 1) AS line FROM y JOIN h USING (taper) JOIN mu USING (vec_id), hh GROUP BY vec_id)
  SELECT vec_id, i::INT AS i, round(CASE WHEN line THEN x - 2 * (a * cos(pi() * i / 2) - b * sin(pi() * i / 2)) ELSE x END, 6) AS y, line FROM sig_64 JOIN f USING (vec_id)"""
)
def line_noise_multitaper(spark, sf_dir):
    """Amplitude and phase of a 25 Hz line by Thomson's estimate, where the F test finds one, and what is left without it."""
    def run(x):
        y, found = extra.without_line(x, FS, 25.0)
        return pd.DataFrame({"i": np.arange(len(x)), "y": np.round(y, 6), "line": found})

    return kernels.expanded(_series(spark, sf_dir), K, run, "i int, y double, line boolean")


def _cubic(name: str, source: str, value: str) -> str:
    """Monotone cubics through every seventh of 64 samples (vec_id, i, value), at all samples (vec_id, i, v)."""
    return f"""{name}_k AS (SELECT vec_id, i // 7 AS k, {value} AS v FROM {source} WHERE i % 7 = 0), {name}_d AS (SELECT vec_id, k, v, lead(v) OVER w AS v1, lead(v) OVER w - v AS d, v - lag(v) OVER w AS d0, lead(v, 2) OVER w - lead(v) OVER w AS d1, lag(v) OVER w - lag(v, 2) OVER w AS dm FROM {name}_k WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
  {name}_e AS (SELECT *, CASE WHEN d0 IS NULL THEN d WHEN d IS NULL THEN d0 END AS e0, CASE WHEN d0 IS NULL THEN d1 WHEN d IS NULL THEN dm END AS e1 FROM {name}_d), {name}_m AS (SELECT vec_id, k, v, v1, CASE WHEN e0 IS NULL THEN CASE WHEN d * d0 > 0 THEN 2 / (1 / d + 1 / d0) ELSE 0 END
    WHEN sign((3 * e0 - e1) / 2) <> sign(e0) THEN 0 WHEN sign(e0) <> sign(e1) AND abs((3 * e0 - e1) / 2) > 3 * abs(e0) THEN 3 * e0 ELSE (3 * e0 - e1) / 2 END AS m FROM {name}_e), {name}_n AS (SELECT *, lead(m) OVER (PARTITION BY vec_id ORDER BY k) AS m1 FROM {name}_m),
  {name} AS (SELECT vec_id, i, (1 + 2 * t) * power(1 - t, 2) * v + t * power(1 - t, 2) * m + t * t * (3 - 2 * t) * v1 + t * t * (t - 1) * m1 AS v FROM (SELECT n.*, i, i / 7::DOUBLE - k AS t FROM {name}_n n JOIN (SELECT unnest(range(64)) AS i) ON k = least(i // 7, 8)))"""


@query(
    f"""{q_kernels.ANALYTIC}, ph AS (SELECT vec_id, i, atan2(b, a) AS p, sqrt(a * a + b * b) AS e FROM an), st AS (SELECT vec_id, i, p, e, p - lag(p) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM ph),
  un AS (SELECT vec_id, i, e, first_value(p) OVER s + coalesce(sum(d - 2 * pi() * floor((d + pi()) / (2 * pi()))) OVER s, 0) AS p FROM st WINDOW s AS (PARTITION BY vec_id ORDER BY i)), {_cubic("ce", "un", "e")}, {_cubic("cp", "un", "p")}
  SELECT vec_id, i, round(ce.v * cos(cp.v), 6) AS y FROM ce JOIN cp USING (vec_id, i)"""
)
def interpolate_local_line(spark, sf_dir):
    """A line rebuilt from amplitude and phase at every eighth sample, by monotone cubics."""
    def kernel(x):
        t = np.arange(x.shape[-1]) / FS
        z = dsp.hilbert(x)
        return np.array([complexity.pchip(t[::7], np.abs(r)[::7], t) * np.cos(complexity.pchip(t[::7], np.unwrap(np.angle(r))[::7], t)) for r in z])

    return kernels.transformed(_series(spark, sf_dir), K, kernel).withColumn("y", F.round("y", 6))


@query(
    """z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), ps AS (SELECT vec_id, k, log10(k * 100 / 64::DOUBLE) AS lf, log10((power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2)) / 6400 + 1e-30) AS lp FROM z, (SELECT unnest(range(1, 33)) AS k) GROUP BY vec_id, k),
  l AS (SELECT vec_id, regr_slope(lp, lf) AS s, regr_intercept(lp, lf) AS c FROM ps GROUP BY vec_id) SELECT vec_id, k::INT AS k, round(greatest(lp - s * lf - c, 0), 5) AS y FROM ps JOIN l USING (vec_id)"""
)
def fooof_periodic(spark, sf_dir):
    """What a spectrum has above its log-log line."""
    def run(x):
        f, p = np.fft.rfftfreq(len(x), 1 / FS)[1:], (np.abs(np.fft.rfft(x - x.mean())) ** 2 / (FS * len(x)))[1:]
        line = np.polyval(np.polyfit(np.log10(f), np.log10(p + 1e-30), 1), np.log10(f))
        return pd.DataFrame({"k": np.arange(1, len(f) + 1), "y": np.round(np.maximum(np.log10(p + 1e-30) - line, 0), 5)})

    return kernels.expanded(_series(spark, sf_dir), K, run, "k int, y double")


@query(
    """v AS (SELECT vec_id, avg(x) AS m FROM sig_64 GROUP BY vec_id), ac AS (SELECT vec_id, (SELECT sum(a.x * a.x) / 64 FROM sig_64 a WHERE a.vec_id = v.vec_id) - m * m AS c0, (SELECT sum(a.x * b.x) / 63 FROM sig_64 a JOIN sig_64 b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.vec_id = v.vec_id) - m * m AS c1 FROM v),
  a AS (SELECT quantile_disc(c1 / c0, 0.5) AS a FROM ac)
  SELECT vec_id, i, round(x - a * coalesce(lag(x) OVER (PARTITION BY vec_id ORDER BY i), 0), 6) AS y FROM sig_64, a"""
)
def ar_whiten_fit_transform(spark, sf_dir):
    """Whitening by the coefficient of the channel whose first coefficient is the median one."""
    from siglake.operators import spectral

    s = _series(spark, sf_dir)
    a = spectral.ar_yule(s, K, 1).agg(F.percentile_approx("a1", 0.5, 1_000_000).alias("a")).first()["a"]
    return spectral.whitened(s, K, [a]).select("vec_id", "i", F.round("y", 6).alias("y"))


@query(
    f"""{q_kernels.SPECTROGRAM}, o AS (SELECT dw, dk FROM range(-1, 2) a(dw), range(-1, 2) b(dk))
  SELECT a.vec_id, a.win, a.k, round(median(b.p), 9) AS p FROM sg a, o JOIN sg b ON b.vec_id = a.vec_id AND b.win = {st.reflected("a.win + dw", 7)} AND b.k = {st.reflected("a.k + dk", 9)} GROUP BY a.vec_id, a.win, a.k"""
)
def median_spectrogram(spark, sf_dir):
    """Spectrograms smoothed by a 3 x 3 median."""
    def run(x):
        f, t, p = dsp.spectrogram(x, FS, 16, 8, 2)
        q = dsp.median_filter(p, (3, 3))
        win, k = np.indices(q.shape)
        return pd.DataFrame({"win": win.ravel(), "k": k.ravel(), "p": np.round(q.ravel(), 9)})

    return kernels.expanded(_series(spark, sf_dir), K, run, "win int, k int, p double")


@query(
    f"""{q_kernels.SPECTROGRAM}, {st.gaussian("g", 1.0)}, u AS (SELECT a.vec_id, a.win, a.k, sum(w * b.p) AS p FROM sg a, g JOIN sg b ON b.vec_id = a.vec_id AND b.win = a.win AND b.k = {st.reflected("a.k + j", 9)} GROUP BY a.vec_id, a.win, a.k)
  SELECT a.vec_id, a.win, a.k, round(sum(w * b.p), 9) AS p FROM u a, g JOIN u b ON b.vec_id = a.vec_id AND b.k = a.k AND b.win = {st.reflected("a.win + j", 7)} GROUP BY a.vec_id, a.win, a.k"""
)
def gaussian_spectrogram(spark, sf_dir):
    """Spectrograms smoothed by Gaussians over windows and frequencies."""
    def run(x):
        f, t, p = dsp.spectrogram(x, FS, 16, 8, 2)
        q = dsp.gaussian_filter(dsp.gaussian_filter(p, 1.0).T, 1.0).T
        win, k = np.indices(q.shape)
        return pd.DataFrame({"win": win.ravel(), "k": k.ravel(), "p": np.round(q.ravel(), 9)})

    return kernels.expanded(_series(spark, sf_dir), K, run, "win int, k int, p double")


@query(
    """m AS (SELECT vec_id, i, x, quantile_cont(x, 0.5) OVER w AS m FROM sig_64 WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), d AS (SELECT *, abs(x - m) > 2 * 1.4826 * median(abs(x - m)) OVER (PARTITION BY vec_id) AS bad FROM m)
  SELECT vec_id, i, round(CASE WHEN bad THEN m ELSE x END, 6) AS y FROM d"""
)
def fix_outliers(spark, sf_dir):
    """Samples far from their running median take its value."""
    own = windows.rolling(_series(spark, sf_dir), K, 7, out="m").withColumn("d", F.abs(F.col("x") - F.col("m")))
    bad = F.col("d") > 2 * 1.4826 * F.median("d").over(W.partitionBy("vec_id"))
    return own.withColumn("bad", bad).select("vec_id", "i", F.round(F.when(F.col("bad"), F.col("m")).otherwise(F.col("x")), 6).alias("y"))


@query("w AS (SELECT vec_id, i // 16 AS win, x, i FROM sig_64), s AS (SELECT vec_id, win, row_number() OVER (PARTITION BY vec_id, win ORDER BY x) - 1 AS r, x FROM w) SELECT vec_id, win, round(sum((2 * r - 15) * x) / 256, 7) AS spread FROM s GROUP BY ALL")
def running_blockwise(spark, sf_dir):
    """A function of whole windows: half the mean difference of sorted samples."""
    own = windows.windowed(_series(spark, sf_dir), K, 16, 16)
    got = kernels.reduced(own, ["vec_id", "win"], lambda x: {"spread": float(((2 * np.arange(16) - 15) * np.sort(x)).sum() / 256)}, ["spread"])
    return got.select("vec_id", "win", F.round("spread", 7).alias("spread"))


@query("p AS (SELECT vec_id, i, x, abs(i - 20) AS d FROM sig_64) SELECT vec_id, i, round(x, 6) AS x FROM p WHERE i BETWEEN 14 AND 26 AND (i - 20) % 3 = 0")
def spaced_sample_around(spark, sf_dir):
    """Five samples, three apart, about one."""
    return _series(spark, sf_dir).where((F.abs(F.col("i") - 20) <= 6) & ((F.col("i") - 20) % 3 == 0)).select("vec_id", "i", F.round("x", 6).alias("x"))


@query(
    "s AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x) - 1 AS r, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM sig_64 WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, (arg_max(r, (r / 63::DOUBLE - (x - lo) / (hi - lo), -r)))::INT AS knee FROM s GROUP BY vec_id"
)
def find_elbow(spark, sf_dir):
    """Knee of each sorted series."""
    got = kernels.reduced(_series(spark, sf_dir), K, lambda x: {"knee": complexity.knee(np.sort(x))}, ["knee"])
    return got.select("vec_id", F.col("knee").cast("int").alias("knee"))


@query()
def simplify_point_cloud(spark, sf_dir):
    """Vectors of each label, thinned to more than 1.3 apart."""
    own = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id").reset_index(drop=True)
        kept = complexity.spread_points(np.stack(p["embedding"].to_list()).astype(float), 1.3, 0)
        return p.loc[np.sort(kept), ["label", "vec_id"]]

    return own.groupBy("label").applyInPandas(run, "label int, vec_id long")


@query(
    f"""{", ".join(st.gaussian(f"k{n}", sigma) for n, sigma in enumerate((0.8, 1.2, 1.8)))}, ks AS ({" UNION ALL ".join(f"SELECT {n} AS s, {st.number(sigma)} AS sigma, j, w FROM k{n}" for n, sigma in enumerate((0.8, 1.2, 1.8)))}),
  u AS (SELECT a.vec_id, s, sigma, a.ap, a.ml, sum(w * b.x) AS x FROM sig_grid a, ks JOIN sig_grid b ON b.vec_id = a.vec_id AND b.ap = a.ap AND b.ml = {st.reflected("a.ml + j", 8)} GROUP BY ALL),
  g AS (SELECT a.vec_id, a.s, a.sigma, a.ap, a.ml, sum(w * b.x) AS x FROM u a JOIN ks ON ks.s = a.s JOIN u b ON b.vec_id = a.vec_id AND b.s = a.s AND b.ml = a.ml AND b.ap = {st.reflected("a.ap + j", 8)} GROUP BY ALL),
  v AS (SELECT vec_id, s, sigma, ap, ml, -sigma * sigma * (coalesce(lag(x) OVER d, x) + coalesce(lead(x) OVER d, x) + coalesce(lag(x) OVER r, x) + coalesce(lead(x) OVER r, x) - 4 * x) AS v FROM g WINDOW d AS (PARTITION BY vec_id, s, ml ORDER BY ap), r AS (PARTITION BY vec_id, s, ap ORDER BY ml)),
  t AS (SELECT vec_id, max(v) AS top FROM v GROUP BY vec_id)
  SELECT a.vec_id, a.ap, a.ml, a.sigma, round(a.v, 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id AND abs(b.s - a.s) <= 1 AND abs(b.ap - a.ap) <= 1 AND abs(b.ml - a.ml) <= 1 JOIN t ON t.vec_id = a.vec_id WHERE a.v > 0.2::DOUBLE * top GROUP BY a.vec_id, a.ap, a.ml, a.sigma, a.v HAVING a.v >= max(b.v)"""
)
def detect_blobs(spark, sf_dir):
    """Maxima of the scale-normalised Laplacian of Gaussians."""
    def run(x):
        rows = extra.log_blobs(x.reshape(8, 8), (0.8, 1.2, 1.8))
        return pd.DataFrame(rows, columns=["ap", "ml", "sigma", "score"]).round({"score": 6})

    return kernels.expanded(_series(spark, sf_dir), K, run, "ap int, ml int, sigma double, score double")


@query()
def track_extrema(spark, sf_dir):
    """Minima of consecutive frames within one electrode keep their label; ten vectors in a row are the frames."""
    own = _grid(spark, sf_dir).withColumn("g", F.floor(F.col("vec_id") / 10))
    low = spatial.extrema(own, ["g", "vec_id"], spatial.ADJACENCY["queen"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return extra.tracked(p.sort_values(["vec_id", "ap", "ml"]), 1)[["g", "vec_id", "ap", "ml", "wave"]]

    return low.groupBy("g").applyInPandas(run, "g long, vec_id long, ap int, ml int, wave int")


def _frames(spark, sf_dir):
    return _grid(spark, sf_dir).withColumn("g", F.floor(F.col("vec_id") / 32))


def _cube(p: pd.DataFrame) -> np.ndarray:
    return p.sort_values(["vec_id", "ap", "ml"])["x"].to_numpy().reshape(-1, 8, 8)


def _kw(weights: str, scale: str) -> str:
    """Power over frequency and wavenumbers by sums over time, then ap, then ml; weights w of (n, taper, i) for time, 8 places by sums of their own."""
    return f"""fr AS (SELECT vec_id // 32 AS g, vec_id % 32 AS i, ap, ml, x - avg(x) OVER (PARTITION BY vec_id // 32, ap, ml) AS x, count(*) OVER (PARTITION BY vec_id // 32, ap, ml) AS n FROM sig_grid), {weights},
  ft AS (SELECT g, fr.n, u.taper AS t0, k, ap, ml, sum(x * w * cos(2 * pi() * k * fr.i / fr.n)) AS re, -sum(x * w * sin(2 * pi() * k * fr.i / fr.n)) AS im FROM fr JOIN wt u ON u.n = fr.n AND u.i = fr.i JOIN (SELECT unnest(range(1, 16)) AS k) ON k < fr.n / 2 GROUP BY ALL),
  fa AS (SELECT g, n, t0, u.taper AS t1, k, q, ml, sum(w * (re * cos(2 * pi() * q * ap / 8) + im * sin(2 * pi() * q * ap / 8))) AS re, sum(w * (im * cos(2 * pi() * q * ap / 8) - re * sin(2 * pi() * q * ap / 8))) AS im FROM ft JOIN wp u ON u.i = ap, (SELECT unnest(range(-4, 4)) AS q) GROUP BY ALL),
  fm AS (SELECT g, n, t0, t1, u.taper AS t2, k, q, r, sum(w * (re * cos(2 * pi() * r * ml / 8) + im * sin(2 * pi() * r * ml / 8))) AS re, sum(w * (im * cos(2 * pi() * r * ml / 8) - re * sin(2 * pi() * r * ml / 8))) AS im FROM fa JOIN wp u ON u.i = ml, (SELECT unnest(range(-4, 4)) AS r) GROUP BY ALL)
  SELECT g, k * (1 / (n * 0.01::DOUBLE)) AS f, q / 8::DOUBLE AS ky, r / 8::DOUBLE AS kx, round(avg(re * re + im * im), {scale}) AS p FROM fm GROUP BY g, n, k, q, r"""


HANN = "wt AS (SELECT n, 0 AS taper, i, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1)) AS w FROM (SELECT DISTINCT n FROM fr), (SELECT unnest(range(32)) AS i) WHERE i < n), wp AS (SELECT 0 AS taper, unnest(range(8)) AS i, 1 AS w)"
TAPERS = f"{st.tapers('w32', 32, 2.0)}, {st.tapers('w20', 20, 2.0)}, {st.tapers('wp', 8, 1.5)}, wt AS (SELECT 32 AS n, * FROM w32 UNION ALL SELECT 20, * FROM w20)"


@query(_kw(HANN, "8"))
def kw_spectrum(spark, sf_dir):
    """Power over frequency and both wavenumbers, of 32 frames."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        f, ky, kx, s = extra.kw_spectrum(_cube(p), FS)
        a, b, c = np.indices(s.shape)
        return pd.DataFrame({"g": int(p["g"].iloc[0]), "f": f[a.ravel()], "ky": ky[b.ravel()], "kx": kx[c.ravel()], "p": np.round(s.ravel(), 8)})

    return _frames(spark, sf_dir).groupBy("g").applyInPandas(run, "g long, f double, ky double, kx double, p double")


@query(_kw(TAPERS, "10"))
def multitaper_kw_spectrum(spark, sf_dir):
    """The same, averaged over products of tapers."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        f, ky, kx, s = extra.kw_spectrum(_cube(p), FS, tapers=(2.0, 1.5))
        a, b, c = np.indices(s.shape)
        return pd.DataFrame({"g": int(p["g"].iloc[0]), "f": f[a.ravel()], "ky": ky[b.ravel()], "kx": kx[c.ravel()], "p": np.round(s.ravel(), 10)})

    return _frames(spark, sf_dir).groupBy("g").applyInPandas(run, "g long, f double, ky double, kx double, p double")


@query()
def capon_beamformer(spark, sf_dir):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows = extra.capon(_cube(p), FS, 12.5, np.arange(-3, 4) / 100)
        return pd.DataFrame(rows, columns=["sx", "sy", "p"]).assign(g=int(p["g"].iloc[0]))[["g", "sx", "sy", "p"]].round({"p": 7})

    return _frames(spark, sf_dir).groupBy("g").applyInPandas(run, "g long, sx double, sy double, p double")


@query(
    """s AS (SELECT vec_id // 32 AS g, vec_id % 32 AS f, ap, ml, x, lead(x) OVER (PARTITION BY vec_id // 32, ap, ml ORDER BY vec_id) AS y FROM sig_grid), m AS (SELECT g, f, ap, ml, (x + y) / 2 AS m, y - x AS gt FROM s WHERE y IS NOT NULL),
  d AS (SELECT g, f, ap, ml, gt, CASE WHEN ap = 0 THEN lead(m) OVER a - m WHEN ap = 7 THEN m - lag(m) OVER a ELSE (lead(m) OVER a - lag(m) OVER a) / 2 END AS gy, CASE WHEN ml = 0 THEN lead(m) OVER b - m WHEN ml = 7 THEN m - lag(m) OVER b ELSE (lead(m) OVER b - lag(m) OVER b) / 2 END AS gx FROM m WINDOW a AS (PARTITION BY g, f, ml ORDER BY ap), b AS (PARTITION BY g, f, ap ORDER BY ml)),
  o AS (SELECT da, dm FROM range(-1, 2) a(da), range(-1, 2) b(dm)), n AS (SELECT p.g, p.f, p.ap, p.ml, sum(q.gx * q.gx) + 1e-6 AS xx, sum(q.gy * q.gy) + 1e-6 AS yy, sum(q.gx * q.gy) AS xy, sum(q.gx * q.gt) AS xt, sum(q.gy * q.gt) AS yt FROM d p, o JOIN d q ON q.g = p.g AND q.f = p.f AND q.ap = least(greatest(p.ap + da, 0), 7) AND q.ml = least(greatest(p.ml + dm, 0), 7) GROUP BY ALL)
  SELECT g, f::INT AS frame, ap, ml, round((xy * yt - yy * xt) / (xx * yy - xy * xy), 5) AS u, round((xy * xt - xx * yt) / (xx * yy - xy * xy), 5) AS v FROM n"""
)
def optical_flow(spark, sf_dir):
    """Flow between consecutive frames by local least squares of brightness gradients."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        u, v = extra.lucas_kanade(_cube(p))
        n, a, m = np.indices(u.shape)
        return pd.DataFrame({"g": int(p["g"].iloc[0]), "frame": n.ravel(), "ap": a.ravel(), "ml": m.ravel(), "u": np.round(u.ravel(), 5), "v": np.round(v.ravel(), 5)})

    return _frames(spark, sf_dir).groupBy("g").applyInPandas(run, "g long, frame int, ap int, ml int, u double, v double")


def _flow(name: str, kernel) -> None:
    def run(spark, sf_dir):
        def flow(p: pd.DataFrame) -> pd.DataFrame:
            u, v = kernel(_cube(p))
            n, a, m = np.indices(u.shape)
            return pd.DataFrame({"g": int(p["g"].iloc[0]), "frame": n.ravel(), "ap": a.ravel(), "ml": m.ravel(), "u": np.round(u.ravel(), 5), "v": np.round(v.ravel(), 5)})

        return _frames(spark, sf_dir).groupBy("g").applyInPandas(flow, "g long, frame int, ap int, ml int, u double, v double")

    query(None, name)(run)


_flow("flow_tvl1", extra.flow_tvl1)
_flow("flow_ilk", extra.flow_ilk)


SHUFFLED = "(row_number() OVER (PARTITION BY vec_id{r} ORDER BY md5({seed} || ':' || vec_id || ':' || ap || ':' || ml)) - 1)"


@query(f"s AS (SELECT vec_id, {SHUFFLED.format(r='', seed=7)} AS k, x FROM sig_grid) SELECT vec_id, (k // 8)::INT AS ap, (k % 8)::INT AS ml, x FROM s")
def spatial_shuffle(spark, sf_dir):
    """Electrodes of each frame permuted, in an order by hash."""
    return spatial.shuffled(_grid(spark, sf_dir), K, F.lit(7), 8)


@query(
    f"""m AS (SELECT vec_id, ap, ml, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_grid), rs AS (SELECT unnest(range(40)) AS r),
  k AS (SELECT vec_id, r, {SHUFFLED.format(r=', r', seed='r')} AS k, x FROM m, rs), g AS (SELECT vec_id, r, k // 8 AS ap, k % 8 AS ml, x FROM k UNION ALL SELECT vec_id, -1, ap, ml, x FROM m),
  st AS (SELECT a AS da, b AS dm FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE a <> 0 OR b <> 0),
  i AS (SELECT a.vec_id, a.r, sum(a.x * b.x) AS s FROM g a, st JOIN g b ON b.vec_id = a.vec_id AND b.r = a.r AND b.ap = a.ap + da AND b.ml = a.ml + dm GROUP BY ALL)
  SELECT n.vec_id, avg((n.s >= o.s)::INT::DOUBLE) AS p FROM i n JOIN i o ON n.vec_id = o.vec_id AND o.r = -1 WHERE n.r >= 0 GROUP BY n.vec_id"""
)
def surrogate_test(spark, sf_dir):
    """Share of 40 spatial shuffles whose Moran index reaches the frame's own."""
    return spatial.surrogate_share(_grid(spark, sf_dir), K, 40, 8)


def _neighborfunc(name: str, kernel, sql: str) -> None:
    def run(spark, sf_dir):
        return spatial.around_stored(views.vectors(spark, sf_dir), K, "embedding", 8, spatial.footprint(2), kernel, "y").select("vec_id", "ap", "ml", F.round("y", 6).alias("v"))

    near = "sig_grid a JOIN sig_grid b ON a.vec_id = b.vec_id AND abs(a.ap - b.ap) + abs(a.ml - b.ml) BETWEEN 1 AND 2"
    query(f"SELECT a.vec_id, a.ap, a.ml, round({sql}, 6) AS v FROM {near} GROUP BY ALL", f"neighborfunc_{name}")(run)


_neighborfunc("mean", neighbors.mean_of, "avg(b.x)")
_neighborfunc("std", neighbors.std_of, "stddev_pop(b.x)")
_neighborfunc("median", neighbors.median_of, "median(b.x)")


@query(
    """m AS (SELECT vec_id, ap, ml, x - avg(x) OVER (PARTITION BY vec_id) AS c, x FROM sig_grid), t AS (SELECT vec_id, count(*) AS n, sum(c * c) AS q, kurtosis_pop(x) AS kurtosis FROM m GROUP BY vec_id),
  s AS (SELECT a.vec_id, sum(a.c * b.c) AS s, count(*) AS w FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.ap - b.ap) <= 1 AND abs(a.ml - b.ml) <= 1 AND (a.ap <> b.ap OR a.ml <> b.ml) GROUP BY a.vec_id),
  d AS (SELECT vec_id, abs(lead(x) OVER (PARTITION BY vec_id, ml ORDER BY ap) - x) AS da, abs(lead(x) OVER (PARTITION BY vec_id, ap ORDER BY ml) - x) AS dm FROM sig_grid), g AS (SELECT vec_id, log2((avg(da) + 1e-12) / (avg(dm) + 1e-12)) AS anisotropy FROM d GROUP BY vec_id)
  SELECT vec_id, round(n / w * s / (q + 1e-12), 6) AS moran, round(anisotropy, 6) AS anisotropy, round(kurtosis, 6) AS kurtosis FROM t JOIN s USING (vec_id) JOIN g USING (vec_id)"""
)
def spatial_summary(spark, sf_dir):
    """Several measures of each frame, joined on one partitioning."""
    g = _grid(spark, sf_dir)
    out = spatial.moran(g, K).join(spatial.gradient_anisotropy(g, K), "vec_id").join(g.groupBy("vec_id").agg(spatial.spatial_kurtosis().alias("kurtosis")), "vec_id")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("moran", "anisotropy", "kurtosis")])


@query(
    f"""RECURSIVE {st.listed()}, {st.filtered("f", "ls", dsp.butter(2, (8, 20), "band", FS), 64)}, {st.samples("f", "fs")}, {st.analytic("fs", "an")}, t AS (SELECT vec_id, arg_max(i, (x, -i)) AS hi, arg_min(i, (x, i)) AS lo FROM sig_64 GROUP BY vec_id)
  SELECT vec_id, round(max(atan2(b, a)) FILTER (i = hi), 5) AS peak, round(max(atan2(b, a)) FILTER (i = lo), 5) AS trough FROM an JOIN t USING (vec_id) GROUP BY vec_id"""
)
def burst_wave_phase(spark, sf_dir):
    """Phase of a vector's band at its own peak and at its trough."""
    def f(x):
        z = np.angle(dsp.hilbert(dsp.bandpass(x, FS, 8, 20, 2)))
        return {"peak": z[int(np.argmax(x))], "trough": z[int(np.argmin(x))]}

    got = kernels.reduced(_series(spark, sf_dir), K, f, ["peak", "trough"])
    return got.select("vec_id", F.round("peak", 5).alias("peak"), F.round("trough", 5).alias("trough"))


@query(
    """a AS (SELECT vec_id, vec_id // 40 AS g, i, x FROM sig_64) SELECT a.vec_id AS v1, b.vec_id AS v2, round(corr(a.x, b.x), 6) AS r FROM a JOIN a b ON a.g = b.g AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY a.vec_id, b.vec_id"""
)
def burst_correlation_matrix(spark, sf_dir):
    """Correlations of the pairs within groups of forty windows."""
    a = _series(spark, sf_dir).select(F.col("vec_id").alias("v1"), F.floor(F.col("vec_id") / 40).alias("g"), "i", "x")
    b = a.select(F.col("v1").alias("v2"), "g", "i", F.col("x").alias("y"))
    return a.join(b, ["g", "i"]).where("v1 < v2").groupBy("v1", "v2").agg(F.round(F.corr("x", "y"), 6).alias("r"))


@query(
    f"""RECURSIVE e AS (SELECT i, ap::INT AS ap, ml::INT AS ml, {st.normal(11, 'i', 'ap', 'ml')} AS e FROM range(200) a(i), range(4) b(ap), range(4) c(ml)),
  y AS (SELECT ap, ml, 0::BIGINT AS i, e AS y, 0::DOUBLE AS z FROM e WHERE i = 0 UNION ALL SELECT y.ap, y.ml, e.i, e.e + {st.number(2 * 0.97 * math.cos(2 * math.pi * 12 / 200))} * y.y - {st.number(0.97**2)} * y.z, y.y FROM y JOIN e ON e.ap = y.ap AND e.ml = y.ml AND e.i = y.i + 1)
  SELECT ap, ml, i, round(y, 5) AS y FROM y"""
)
def ar_oscillator_grid(spark, sf_dir):
    """Seeded second-order oscillators on a grid, each electrode a fold over its samples."""
    from siglake.functions import generators as gen

    g = gen.grid(spark, 200, 4, 4, 200.0).withColumn("e", gen.normal(11, "i", "ap", "ml"))
    a1, a2 = 2 * 0.97 * math.cos(2 * math.pi * 12 / 200), -(0.97**2)

    def kernel(x):
        y = np.zeros_like(x)
        for i in range(x.shape[-1]):
            y[..., i] = x[..., i] + (a1 * y[..., i - 1] if i else 0) + (a2 * y[..., i - 2] if i > 1 else 0)
        return y

    return kernels.transformed(g, ["ap", "ml"], kernel, value="e").withColumn("y", F.round("y", 5))
