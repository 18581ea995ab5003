"""Spectral queries: each embedding as a series of 64 samples at 100 Hz. DuckDB computes the transform by its definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.operators import spectral
from siglake.plans.registry import query
from siglake.sources import views

K, FS = ["vec_id"], 100.0
PSD = """z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), ks AS (SELECT unnest(range(33)) AS k),
  psd AS (SELECT vec_id, k::INT AS k, k * 100 / 64.0::DOUBLE AS freq, (power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2)) / 6400 AS p FROM z, ks GROUP BY vec_id, k)"""


def _psd(spark, sf_dir):
    return spectral.periodogram(views.sig_64(spark, sf_dir), K, FS)


@query(f"{PSD} SELECT vec_id, k, freq, round(p, 9) AS p FROM psd")
def psd_periodogram(spark, sf_dir):
    return _psd(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(
    """f AS (SELECT vec_id, w.win, s.i - w.win * 16 AS i, x - avg(x) OVER (PARTITION BY vec_id, w.win) AS x FROM sig_64 s JOIN (SELECT unnest(range(3)) AS win) w ON s.i BETWEEN w.win * 16 AND w.win * 16 + 31), ks AS (SELECT unnest(range(17)) AS k),
  h AS (SELECT vec_id, win, k, power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * cos(2 * pi() * k * i / 32)), 2) + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * sin(2 * pi() * k * i / 32)), 2) AS q FROM f, ks GROUP BY ALL)
  SELECT vec_id, k::INT AS k, k * 100 / 32.0::DOUBLE AS freq, round(avg(q) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / 1200, 9) AS p FROM h GROUP BY vec_id, k"""
)
def psd_welch(spark, sf_dir):
    return spectral.psd_welch(views.sig_64(spark, sf_dir), K, FS, 32).withColumn("p", F.round("p", 9))


@query(f"{PSD} SELECT vec_id, k, round(10 * log10(p), 5) AS db FROM psd WHERE p > 1e-6")
def psd_to_db(spark, sf_dir):
    return _psd(spark, sf_dir).where("p > 1e-6").select("vec_id", "k", F.round(spectral.to_db(), 5).alias("db"))


AREA = """ar AS (SELECT *, (lead(freq) OVER w - freq) * (lead(p) OVER w + p) / 2 AS a FROM psd {where} WINDOW w AS (PARTITION BY vec_id ORDER BY freq))"""


@query(f"{PSD}, {AREA.format(where='WHERE freq BETWEEN 8 AND 30')} SELECT vec_id, round(sum(a), 8) AS power FROM ar GROUP BY vec_id")
def band_power(spark, sf_dir):
    return spectral.band_power(_psd(spark, sf_dir), K, 8, 30).select("vec_id", F.round("power", 8).alias("power"))


@query(f"{PSD}, {AREA.format(where='')}, b AS (SELECT *, (lead(freq) OVER w - freq) * (lead(p) OVER w + p) / 2 AS a FROM psd WHERE freq BETWEEN 8 AND 30 WINDOW w AS (PARTITION BY vec_id ORDER BY freq)) SELECT vec_id, round((SELECT sum(a) FROM b WHERE b.vec_id = ar.vec_id) / (sum(a) + 1e-12), 8) AS relative FROM ar GROUP BY vec_id")
def relative_band_power(spark, sf_dir):
    return spectral.relative_band_power(_psd(spark, sf_dir), K, 8, 30).select("vec_id", F.round("relative", 8).alias("relative"))


@query(f"{PSD}, q AS (SELECT vec_id, p / (sum(p * 1.5625::DOUBLE) OVER (PARTITION BY vec_id) + 1e-12) AS p FROM psd) SELECT vec_id, round(-sum(p * ln(p + 1e-12) * 1.5625::DOUBLE), 7) AS entropy FROM q GROUP BY vec_id")
def spectral_entropy(spark, sf_dir):
    return spectral.spectral_entropy(_psd(spark, sf_dir), K).select("vec_id", F.round("entropy", 7).alias("entropy"))


@query(
    f"""{PSD}, {AREA.format(where="")}, c AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY vec_id ORDER BY freq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ar),
  g AS (SELECT *, 0.95::DOUBLE * max(c) OVER (PARTITION BY vec_id) AS goal, lag(freq) OVER w AS f0, lag(c) OVER w AS c0 FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY freq)),
  f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY freq) AS r FROM g WHERE c >= goal) SELECT vec_id, round(f0 + (goal - c0) / (c - c0) * (freq - f0), 5) AS edge FROM f WHERE r = 1"""
)
def spectral_edge(spark, sf_dir):
    return spectral.spectral_edge(_psd(spark, sf_dir), K).select("vec_id", F.round("edge", 5).alias("edge"))


def _aggregate(name: str, column, sql: str) -> None:
    def run(spark, sf_dir):
        return _psd(spark, sf_dir).groupBy("vec_id").agg(F.round(column(), 6).alias("v"))

    query(f"{PSD} SELECT vec_id, round({sql}, 6) AS v FROM psd GROUP BY vec_id", name)(run)


_aggregate("broadband_snr", lambda: spectral.broadband_snr((1, 20), (30, 50)), "log10((avg(p) FILTER (freq BETWEEN 1 AND 20) + 1e-12) / (avg(p) FILTER (freq BETWEEN 30 AND 50) + 1e-12))")
_aggregate("line_noise_ratio", lambda: spectral.line_noise_ratio(25, 2), "avg(p) FILTER (abs(freq - 25) <= 2) / (avg(p) FILTER (abs(freq - 25) BETWEEN 4 AND 8) + 1e-12)")
_aggregate("am_artifact_score", lambda: spectral.am_artifact_score(25, 5, 2), "log10((avg(p) FILTER (abs(abs(freq - 25) - 5) <= 2) + 1e-12) / (avg(p) FILTER (abs(abs(freq - 25) - 15) <= 2) + 1e-12))")
_aggregate("am_depth", lambda: spectral.am_depth(25, 5, 2, 2), "log10((avg(p) FILTER (abs(abs(freq - 25) - 5) <= 2) + 1e-12) / (avg(p) FILTER (abs(freq - 25) <= 2) + 1e-12))")
_aggregate("spectral_flatness", spectral.spectral_flatness, "exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12)")


@query(
    f"""{PSD}, f AS (SELECT a.vec_id, a.k, any_value(a.p) AS p, median(b.p) AS m FROM psd a JOIN psd b ON a.vec_id = b.vec_id AND a.k <> b.k AND abs(a.freq - b.freq) <= 5 WHERE a.k > 0 AND b.k > 0 GROUP BY a.vec_id, a.k)
  SELECT vec_id, k, round(p / m, 5) AS ratio FROM f"""
)
def narrowband_ratio(spark, sf_dir):
    return spectral.narrowband_ratio(_psd(spark, sf_dir).where("k > 0"), K, 5.0).select("vec_id", "k", F.round("ratio", 5).alias("ratio"))


def _bands(method: str, sql: str) -> None:
    def run(spark, sf_dir):
        return spectral.reduced_bands(_psd(spark, sf_dir), K, {"alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45)}, method).withColumn("value", F.round("value", 8))

    query(
        f"{PSD}, b AS (SELECT * FROM (VALUES ('alpha', 8, 13), ('beta', 13, 30), ('gamma', 30, 45)) v(band, lo, hi)) SELECT vec_id, band, round({sql}(p), 8) AS value FROM psd JOIN b ON freq BETWEEN lo AND hi GROUP BY vec_id, band",
        f"reduce_tf_bands_{method}",
    )(run)


for _m, _s in (("mean", "avg"), ("median", "median"), ("max", "max"), ("sum", "sum")):
    _bands(_m, _s)


@query(f"{PSD}, m AS (SELECT *, median(p) OVER (PARTITION BY vec_id) AS m FROM psd), s AS (SELECT *, median(abs(p - m)) OVER (PARTITION BY vec_id) AS s FROM m) SELECT vec_id, k, round((p - m) / (1.4826 * s + 1e-12), 5) AS y FROM s")
def normalize_spectrogram(spark, sf_dir):
    return spectral.normalized(_psd(spark, sf_dir), K).select("vec_id", "k", F.round("y", 5).alias("y"))


@query(f"{PSD} SELECT DISTINCT k, freq FROM psd WHERE abs(freq - 10) <= 2 OR abs(freq - 20) <= 2 OR abs(freq - 30) <= 2")
def get_linenoise_freqs(spark, sf_dir):
    return _psd(spark, sf_dir).select("k", "freq").distinct().where(spectral.line_bins(10, 2, 3))


@query(f"{PSD} SELECT vec_id, k, round(p, 9) AS p FROM psd WHERE NOT (abs(freq - 10) <= 2 OR abs(freq - 20) <= 2 OR abs(freq - 30) <= 2)")
def drop_linenoise_harmonics(spark, sf_dir):
    return _psd(spark, sf_dir).where(~spectral.line_bins(10, 2, 3)).select("vec_id", "k", F.round("p", 9).alias("p"))


@query(f"{PSD} SELECT vec_id, k, round(p, 6)::FLOAT AS p FROM psd WHERE freq BETWEEN 1 AND 30")
def compress_specgram(spark, sf_dir):
    """Bins within 1 to 30 Hz as 32-bit floats."""
    return _psd(spark, sf_dir).where(F.col("freq").between(1, 30)).select("vec_id", "k", F.round("p", 6).cast("float").alias("p"))


BEFORE = f"""{PSD}, af AS (SELECT a.vec_id, a.k, a.freq, a.p AS p0, b.p AS p1 FROM psd a JOIN psd b ON b.vec_id = a.vec_id + 1 AND b.k = a.k)"""


def _pairs(spark, sf_dir):
    p = _psd(spark, sf_dir)
    return p, p.withColumn("vec_id", F.col("vec_id") - 1)


@query(
    f"""{BEFORE}, ar AS (SELECT vec_id, (lead(freq) OVER w - freq) * (lead(p0) OVER w + p0) / 2 AS a0, (lead(freq) OVER w - freq) * (lead(p1) OVER w + p1) / 2 AS a1 FROM af WHERE freq BETWEEN 8 AND 30 WINDOW w AS (PARTITION BY vec_id ORDER BY freq))
  SELECT vec_id, round((sum(a1) - sum(a0)) / (sum(a0) + 1e-30), 7) AS change FROM ar GROUP BY vec_id"""
)
def bandpower_change(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    both = spectral.band_power(a, K, 8, 30).join(spectral.band_power(b, K, 8, 30).withColumnRenamed("power", "after"), K)
    return both.select("vec_id", F.round((F.col("after") - F.col("power")) / (F.col("power") + F.lit(1e-30)), 7).alias("change"))


@query(
    f"""{BEFORE}, m AS (SELECT vec_id, avg(p0) FILTER (freq BETWEEN 5 AND 20) AS s0, avg(p1) FILTER (freq BETWEEN 5 AND 20) AS s1, avg(p0) FILTER (freq BETWEEN 30 AND 45) AS n0, avg(p1) FILTER (freq BETWEEN 30 AND 45) AS n1 FROM af GROUP BY vec_id)
  SELECT vec_id, round(10 * log10((s1 + 1e-30) / (n1 + 1e-30)) - 10 * log10((s0 + 1e-30) / (n0 + 1e-30)), 6) AS db FROM m"""
)
def snr_improvement(spark, sf_dir):
    """Change of signal over noise band power, in decibels."""
    a, b = _pairs(spark, sf_dir)

    def ratio(df, name):
        s, n = (F.avg(F.when(F.col("freq").between(*r), F.col("p"))) + F.lit(1e-30) for r in ((5, 20), (30, 45)))
        return df.groupBy("vec_id").agg((10 * F.log10(s / n)).alias(name))

    return ratio(a, "r0").join(ratio(b, "r1"), "vec_id").select("vec_id", F.round(F.col("r1") - F.col("r0"), 6).alias("db"))


def _cov(lag: int) -> str:
    return f"(SELECT sum(a.x * b.x) / (64 - {lag}) FROM sig_64 a JOIN sig_64 b ON a.vec_id = b.vec_id AND b.i = a.i + {lag} WHERE a.vec_id = v.vec_id) - power(m, 2) AS c{lag}"


COV = f"ac AS (SELECT vec_id, {', '.join(_cov(p) for p in range(3))} FROM (SELECT vec_id, avg(x) AS m FROM sig_64 GROUP BY vec_id) v)"


@query(f"{COV} SELECT vec_id, round(c0, 7) AS c0, round(c1, 7) AS c1, round(c2, 7) AS c2 FROM ac")
def autocovariance(spark, sf_dir):
    got = spectral.autocovariance(views.sig_64(spark, sf_dir), K, 2)
    return got.select("vec_id", *[F.round(c, 7).alias(c) for c in ("c0", "c1", "c2")])


@query(f"{COV} SELECT vec_id, round(c1 * (c0 - c2) / (c0 * c0 - c1 * c1), 6) AS a1, round((c0 * c2 - c1 * c1) / (c0 * c0 - c1 * c1), 6) AS a2 FROM ac")
def ar_yule(spark, sf_dir):
    got = spectral.ar_yule(views.sig_64(spark, sf_dir), K, 2)
    return got.select("vec_id", F.round("a1", 6).alias("a1"), F.round("a2", 6).alias("a2"))


@query("SELECT vec_id, i, round(x - 0.5 * coalesce(lag(x) OVER w, 0) + 0.25 * coalesce(lag(x, 2) OVER w, 0), 7) AS y FROM sig_64 WINDOW w AS (PARTITION BY vec_id ORDER BY i)")
def ar_whitening(spark, sf_dir):
    return spectral.whitened(views.sig_64(spark, sf_dir), K, [0.5, -0.25]).select("vec_id", "i", F.round("y", 7).alias("y"))


# Cross spectra: stretches of 16 samples take the place of tapers, so that SQL can form the same transforms.
TAPERS = """s AS (SELECT vec_id, (i // 16)::INT AS taper, i % 16 AS j, x FROM sig_64), ks AS (SELECT unnest(range(9)) AS k),
  y AS (SELECT vec_id, taper, k::INT AS k, k * 6.25::DOUBLE AS freq, sum(x * cos(2 * pi() * k * j / 16)) AS re, -sum(x * sin(2 * pi() * k * j / 16)) AS im FROM s, ks GROUP BY vec_id, taper, k),
  pr AS (SELECT a.vec_id, a.k, a.freq, a.re * b.re + a.im * b.im AS cr, a.im * b.re - a.re * b.im AS ci, a.re * a.re + a.im * a.im AS xx, b.re * b.re + b.im * b.im AS yy FROM y a JOIN y b ON b.vec_id = a.vec_id + 1 AND a.k = b.k AND a.taper = b.taper)"""


def _tapers(spark, sf_dir):
    import math

    s = views.sig_64(spark, sf_dir).select("vec_id", F.floor(F.col("i") / 16).cast("int").alias("taper"), (F.col("i") % 16).alias("j"), "x")
    angle = lambda k: F.col("j") * (2 * math.pi * k / 16)
    wide = s.groupBy("vec_id", "taper").agg(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k * 6.25).alias("freq"), F.sum(F.col("x") * F.cos(angle(k))).alias("re"), (-F.sum(F.col("x") * F.sin(angle(k)))).alias("im")) for k in range(9)]).alias("s"))
    return wide.select("vec_id", "taper", F.inline("s"))


def _cross(spark, sf_dir):
    y = _tapers(spark, sf_dir)
    return spectral.cross(y, y.withColumn("vec_id", F.col("vec_id") - 1), K)


@query(f"{TAPERS} SELECT vec_id, k, round(avg(cr), 6) AS re, round(avg(ci), 6) + 0.0 AS im FROM pr WHERE k BETWEEN 1 AND 7 GROUP BY vec_id, k")
def cross_spectrum(spark, sf_dir):
    return _cross(spark, sf_dir).where("k between 1 and 7").select("vec_id", "k", F.round("sxy_re", 6).alias("re"), (F.round("sxy_im", 6) + F.lit(0.0)).alias("im"))


@query(f"{TAPERS} SELECT vec_id, k, round(least(greatest((power(avg(cr), 2) + power(avg(ci), 2)) / (avg(xx) * avg(yy) + 1e-12), 0), 1), 6) AS coherence FROM pr GROUP BY vec_id, k")
def coherence(spark, sf_dir):
    return _cross(spark, sf_dir).select("vec_id", "k", F.round(spectral.coherence(), 6).alias("coherence"))


@query(f"{TAPERS} SELECT vec_id, k, round(sqrt(power(avg(cr / (sqrt(cr * cr + ci * ci) + 1e-12)), 2) + power(avg(ci / (sqrt(cr * cr + ci * ci) + 1e-12)), 2)), 6) AS plv FROM pr WHERE k BETWEEN 1 AND 7 GROUP BY vec_id, k")
def plv(spark, sf_dir):
    return _cross(spark, sf_dir).where("k between 1 and 7").select("vec_id", "k", F.round("plv", 6).alias("plv"))


@query(f"{TAPERS} SELECT vec_id, k, round(avg(re * re + im * im) / 1600, 8) AS p FROM y GROUP BY vec_id, k")
def psd_from_mtfft(spark, sf_dir):
    return spectral.psd_from_tapers(_tapers(spark, sf_dir), K, FS, 16).select("vec_id", "k", F.round("p", 8).alias("p"))


@query(f"{TAPERS}, n AS (SELECT vec_id, count(*) AS n, power(sum(re), 2) + power(sum(im), 2) AS m, sum(re * re + im * im) AS s FROM y WHERE k = 3 GROUP BY vec_id) SELECT vec_id, round((n - 1) * m / n / (s - m / n + 1e-12), 5) AS f FROM n")
def mtm_fstat(spark, sf_dir):
    return spectral.fstat(_tapers(spark, sf_dir), K, 19.0).select("vec_id", F.round("f", 5).alias("f"))
