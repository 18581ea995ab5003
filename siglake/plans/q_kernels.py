"""Kernel queries over 64-sample series at 100 Hz. Where SQL can't express a kernel, tests check it against known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siglake.functions import complexity, dsp, granger
from siglake.functions import generators as gen
from siglake.operators import kernels, pipeline, spectral
from siglake.plans import sqltext as st
from siglake.plans.q_detect import runs_sql
from siglake.plans.registry import query
from siglake.sources import views

K, FS = ["vec_id"], 100.0


def _series(spark, sf_dir):
    return views.sig_64(spark, sf_dir)


def _transform(name: str, kernel, sql: str | None = None, digits: int = 6) -> None:
    def run(spark, sf_dir):
        return kernels.transformed(_series(spark, sf_dir), K, kernel).select("vec_id", "i", F.round("y", digits).alias("y"))

    query(sql, name)(run)


ANALYTIC = """ks AS (SELECT unnest(range(33)) AS k), ft AS (SELECT vec_id, k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * sum(x * cos(2 * pi() * k * i / 64)) / 64 AS re, -CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * sum(x * sin(2 * pi() * k * i / 64)) / 64 AS im FROM sig_64, ks GROUP BY vec_id, k),
  an AS (SELECT vec_id, n.i, sum(re * cos(2 * pi() * k * n.i / 64) - im * sin(2 * pi() * k * n.i / 64)) AS a, sum(re * sin(2 * pi() * k * n.i / 64) + im * cos(2 * pi() * k * n.i / 64)) AS b FROM ft, (SELECT unnest(range(64)) AS i) n GROUP BY vec_id, n.i)"""

_transform("hilbert_envelope", dsp.envelope, f"{ANALYTIC} SELECT vec_id, i, round(sqrt(a * a + b * b), 6) AS y FROM an")
_transform("hilbert_phase", lambda x: np.angle(dsp.hilbert(x)), f"{ANALYTIC} SELECT vec_id, i, round(atan2(b, a), 6) AS y FROM an")
_transform("lower_envelope", dsp.lower_envelope, f"{ANALYTIC} SELECT vec_id, i, round(-sqrt(a * a + b * b), 6) AS y FROM an")
_transform(
    "scx_gaussian",
    lambda x: dsp.gaussian_filter(x, 1.5),
    """kn AS (SELECT j, exp(-j * j / 4.5::DOUBLE) AS e FROM (SELECT unnest(range(-6, 7)) AS j)), w AS (SELECT j, e / (SELECT sum(e) FROM kn) AS w FROM kn)
  SELECT a.vec_id, a.i, round(sum(w * b.x), 6) AS y FROM sig_64 a, w JOIN sig_64 b ON b.vec_id = a.vec_id AND b.i = CASE WHEN a.i + j < 0 THEN -(a.i + j) - 1 WHEN a.i + j > 63 THEN 127 - (a.i + j) ELSE a.i + j END GROUP BY a.vec_id, a.i""",
)
_transform(
    "linear_detrend",
    lambda x: dsp.detrend(x, "linear"),
    "r AS (SELECT vec_id, regr_slope(x, i) AS s, regr_intercept(x, i) AS c FROM sig_64 GROUP BY vec_id) SELECT vec_id, i, round(x - s * i - c, 6) AS y FROM sig_64 JOIN r USING (vec_id)",
)


def _filter(name: str, kernel, *sos: np.ndarray) -> None:
    steps = ["ls"] + [f"f{k}" for k in range(len(sos))]
    ctes = ", ".join([st.listed()] + [st.filtered(out, source, own, 64) for own, source, out in zip(sos, steps, steps[1:], strict=False)])
    _transform(name, kernel, f"RECURSIVE {ctes}, y AS (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS y FROM {steps[-1]}) SELECT vec_id, i, round(y, 6) AS y FROM y")


_filter("bandpass", lambda x: dsp.bandpass(x, FS, 8, 30), dsp.butter(4, (8, 30), "band", FS))
_filter("lowpass", lambda x: dsp.lowpass(x, FS, 20), dsp.butter(4, 20, "low", FS))
_filter("highpass", lambda x: dsp.highpass(x, FS, 5), dsp.butter(4, 5, "high", FS))
_filter("notch", lambda x: dsp.notches(x, FS, [25.0]), dsp.notch_sos(FS, 25.0))
_filter("notches", lambda x: dsp.notches(x, FS, [10.0, 20.0]), dsp.notch_sos(FS, 10.0), dsp.notch_sos(FS, 20.0))
UNWRAPPED = """w AS (SELECT vec_id, i, p, p - lag(p) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM ph)
  SELECT vec_id, i, round(first_value(p) OVER s + coalesce(sum(d - 2 * pi() * floor((d + pi()) / (2 * pi()))) OVER s, 0), 5) AS y FROM w WINDOW s AS (PARTITION BY vec_id ORDER BY i)"""
_transform("generalized_phase", dsp.generalized_phase, f"{ANALYTIC.replace('FROM ft,', 'FROM (FROM ft WHERE k > 0),')}, ph AS (SELECT vec_id, i, atan2(b, a) AS p FROM an), {UNWRAPPED}", 5)
_transform("unwrapped_phase", dsp.unwrapped_phase, f"{ANALYTIC}, ph AS (SELECT vec_id, i, atan2(b, a) AS p FROM an), {UNWRAPPED}", 5)
_transform("scx_lowerenv", lambda x: x - dsp.lower_envelope(x), f"{ANALYTIC} SELECT vec_id, i, round(x + sqrt(a * a + b * b), 6) AS y FROM an JOIN sig_64 USING (vec_id, i)")


def _resampled(name: str, kernel, sql: str) -> None:
    def run(spark, sf_dir):
        def frame(x: np.ndarray) -> pd.DataFrame:
            y = kernel(x)
            return pd.DataFrame({"i": np.arange(len(y)), "y": np.round(y, 6)})

        return kernels.expanded(_series(spark, sf_dir), K, frame, "i int, y double")

    query(sql, name)(run)


_resampled(
    "decimate",
    lambda x: dsp.decimate(x, 2),
    f"RECURSIVE {st.listed()}, {st.filtered('f', 'ls', dsp.decimation_sos(2), 64)}, {st.samples('f', 'y')} SELECT vec_id, (i // 2)::INT AS i, round(x, 6) AS y FROM y WHERE i % 2 = 0",
)
_resampled(
    "resample_poly",
    lambda x: dsp.resample_poly(x, 3, 4),
    f"""h AS (SELECT unnest(range(81)) AS j, unnest({st.numbers(3 * dsp.firwin(81, 0.25))}) AS h), o AS (SELECT unnest(range(48)) AS n)
  SELECT vec_id, n::INT AS i, round(sum(x * h), 6) AS y FROM sig_64, o JOIN h ON j = 40 + 4 * n - 3 * i GROUP BY vec_id, n""",
)


def _sizes(low: int, high: int) -> list[int]:
    return [int(v) for v in np.unique(np.floor(np.geomspace(low, high, 12)))]


def _scalar(name: str, f, sql: str | None = None) -> None:
    def run(spark, sf_dir):
        return kernels.reduced(_series(spark, sf_dir), K, lambda x: {"v": f(x)}, ["v"]).select("vec_id", F.round("v", 6).alias("v"))

    query(sql, name)(run)


_scalar(
    "hurst_exponent",
    complexity.hurst,
    f"""ms AS (SELECT unnest({_sizes(8, 32)}) AS m), p AS (SELECT vec_id, m, i // m AS part, i, x - avg(x) OVER (PARTITION BY vec_id, m, i // m) AS d FROM sig_64 JOIN ms ON i < 64 // m * m),
  w AS (SELECT *, sum(d) OVER (PARTITION BY vec_id, m, part ORDER BY i) AS walk FROM p), r AS (SELECT vec_id, m, (max(walk) - min(walk)) / stddev_pop(d) AS rs FROM w GROUP BY vec_id, m, part HAVING stddev_pop(d) > 0),
  a AS (SELECT vec_id, m, avg(rs) AS rs FROM r GROUP BY ALL) SELECT vec_id, round(regr_slope(ln(rs), ln(m)), 6) AS v FROM a GROUP BY vec_id""",
)
_scalar(
    "dfa_exponent",
    complexity.dfa,
    f"""ms AS (SELECT unnest({_sizes(4, 16)}) AS m), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM sig_64), w AS (SELECT vec_id, i, sum(c) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM c),
  f AS (SELECT vec_id, m, sqrt(greatest(var_pop(y) - power(covar_pop(y, i), 2) / var_pop(i), 0)) AS f FROM w JOIN ms ON i < 64 // m * m GROUP BY vec_id, m, i // m), a AS (SELECT vec_id, m, avg(f) AS f FROM f GROUP BY ALL)
  SELECT vec_id, round(regr_slope(ln(f), ln(m)), 6) AS v FROM a GROUP BY vec_id""",
)
_scalar(
    "sample_entropy",
    complexity.sample_entropy,
    """t AS (SELECT vec_id, 0.2::DOUBLE * stddev_pop(x) AS r FROM sig_64 GROUP BY vec_id), v AS (SELECT vec_id, i, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM sig_64 WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
  p AS (SELECT v.vec_id, abs(v.c - u.c) <= r AS more FROM v JOIN u ON u.vec_id = v.vec_id AND u.i > v.i JOIN t ON t.vec_id = v.vec_id WHERE v.c IS NOT NULL AND u.c IS NOT NULL AND abs(v.a - u.a) <= r AND abs(v.b - u.b) <= r)
  SELECT vec_id, round(-ln(count(*) FILTER (more) / count(*)), 6) AS v FROM p GROUP BY vec_id""".replace("JOIN u ON", "JOIN v u ON"),
)
_scalar(
    "lempel_ziv",
    complexity.lempel_ziv,
    """RECURSIVE md AS (SELECT vec_id, i, x, median(x) OVER (PARTITION BY vec_id) AS m FROM sig_64), s AS (SELECT vec_id, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY i) AS s FROM md GROUP BY vec_id),
  lz AS (SELECT vec_id, s, 0 AS i, 1 AS k, 0 AS c FROM s UNION ALL SELECT vec_id, s, CASE WHEN more THEN i ELSE i + k END, CASE WHEN more THEN k + 1 ELSE 1 END, CASE WHEN more THEN c ELSE c + 1 END
    FROM (SELECT *, i + k <= 64 AND contains(substr(s, 1, i + k - 1), substr(s, i + 1, k)) AS more FROM lz WHERE i < 64))
  SELECT vec_id, round(least(max(c) * log2(64) / 64, 1), 6) AS v FROM lz GROUP BY vec_id""",
)


MT = st.multitaper("mt", "sig_64", 64, 2)


@query(f"{MT} SELECT vec_id, k::INT AS k, k * (1 / (64 * 0.01::DOUBLE)) AS freq, round(avg(re * re + im * im) / 6400, 9) AS p FROM mt GROUP BY vec_id, k")
def psd_multitaper(spark, sf_dir):
    return spectral.psd_multitaper(_series(spark, sf_dir), K, FS, 2).select("vec_id", "k", "freq", F.round("p", 9).alias("p"))


@query(f"{MT} SELECT vec_id, taper, k::INT AS k, round(re, 6) AS re, round(im, 6) AS im FROM mt")
def multitaper_fft(spark, sf_dir):
    return spectral.multitaper_fft(_series(spark, sf_dir), K, FS, 2).select("vec_id", "taper", "k", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


SPECTROGRAM = f"""fr AS (SELECT vec_id * 8 + win AS id, i - win * 8 AS i, x FROM sig_64 JOIN (SELECT unnest(range(7)) AS win) ON i >= win * 8 AND i < win * 8 + 16), {st.multitaper("mt", "fr", 16, 2, "id")},
  sg AS (SELECT id // 8 AS vec_id, (id % 8)::INT AS win, k::INT AS k, avg(re * re + im * im) / 1600 AS p FROM mt GROUP BY id, k)"""


@query(f"{SPECTROGRAM} SELECT vec_id, win, k, (win * 8 + 7.5::DOUBLE) / 100 AS t, k * (1 / (16 * 0.01::DOUBLE)) AS freq, round(p, 9) AS p FROM sg")
def spectrogram(spark, sf_dir):
    return spectral.spectrogram(_series(spark, sf_dir), K, FS, 16, 8, 2).select("vec_id", "win", "k", "t", "freq", F.round("p", 9).alias("p"))


@query(
    f"""z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), {st.tapers("tp", 64, 2)}, h AS (SELECT taper, sum(w) AS h FROM tp GROUP BY taper), hh AS (SELECT sum(h * h) AS hh FROM h),
  y AS (SELECT vec_id, taper, k, sum(x * w * cos(2 * pi() * k * i / 64)) AS re, -sum(x * w * sin(2 * pi() * k * i / 64)) AS im FROM z JOIN tp USING (i), (SELECT unnest(range(33)) AS k) GROUP BY vec_id, taper, k),
  mu AS (SELECT vec_id, k, sum(h * re) / any_value(hh) AS a, sum(h * im) / any_value(hh) AS b FROM y JOIN h USING (taper), hh GROUP BY vec_id, k),
  f AS (SELECT vec_id, k, 2 * any_value(a * a + b * b) * any_value(hh) / sum(power(re - h * a, 2) + power(im - h * b, 2)) AS f FROM y JOIN h USING (taper) JOIN mu USING (vec_id, k), hh GROUP BY vec_id, k)
  SELECT vec_id, k::INT AS k, k * (1 / (64 * 0.01::DOUBLE)) AS freq, round(f, 5) AS f, f > 2 * (power(0.05::DOUBLE, -0.5::DOUBLE) - 1) AS line FROM f"""
)
def ftest_line_scan(spark, sf_dir):
    def run(x):
        freq, f, threshold = dsp.ftest(x, FS, 2)
        return pd.DataFrame({"k": np.arange(len(f)), "freq": freq, "f": np.round(f, 5), "line": f > threshold})

    return kernels.expanded(_series(spark, sf_dir), K, run, "k int, freq double, f double, line boolean")


def _peaks(source: str, last: int, least: str, floor: str = "TRUE", reach: int | None = None) -> str:
    """Maxima (vec_id, i, x) of rows (vec_id, i, x), i up to `last`, that stand `least` above the higher of the lowest points to either side, before anything higher and within reach."""
    lo, hi = ("0", str(last)) if reach is None else (f"greatest(0, p.i - {reach})", f"least({last}, p.i + {reach})")
    return f"""nb AS (SELECT vec_id, i, x, lag(x) OVER w AS before, lead(x) OVER w AS after FROM {source} WINDOW w AS (PARTITION BY vec_id ORDER BY i)), pk AS (SELECT * FROM nb WHERE x > before AND x > after AND {floor}),
  ends AS (SELECT p.vec_id, p.i, any_value(p.x) AS x, coalesce(max(o.i) FILTER (o.i < p.i AND o.x > p.x) + 1, any_value({lo})) AS a, coalesce(min(o.i) FILTER (o.i > p.i AND o.x > p.x) - 1, any_value({hi})) AS b FROM pk p JOIN nb o ON o.vec_id = p.vec_id AND o.i BETWEEN {lo} AND {hi} GROUP BY p.vec_id, p.i),
  pr AS (SELECT e.vec_id, e.i, any_value(e.x) AS x, any_value(e.x) - greatest(min(o.x) FILTER (o.i <= e.i), min(o.x) FILTER (o.i >= e.i)) AS prominence FROM ends e JOIN nb o ON o.vec_id = e.vec_id AND o.i BETWEEN e.a AND e.b GROUP BY e.vec_id, e.i),
  peaks AS (SELECT pr.* FROM pr WHERE prominence >= {least})"""


@query(
    f"""z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), ps AS (SELECT vec_id, k AS i, power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2) AS x FROM z, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
  {_peaks("ps", 32, "2")} SELECT vec_id, i * (1 / (64 * 0.01::DOUBLE)) AS freq, round(x, 6) AS p FROM peaks"""
)
def spectral_peak_freqs(spark, sf_dir):
    def run(x):
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2
        at = dsp.find_peaks(p, prominence=2.0, distance=2)
        return pd.DataFrame({"freq": np.fft.rfftfreq(len(x), 1 / FS)[at], "p": np.round(p[at], 6)})

    return kernels.expanded(_series(spark, sf_dir), K, run, "freq double, p double")


@query(f"""q AS (SELECT vec_id, greatest(1e-9, 0.25::DOUBLE * quantile_cont(x, 0.95)) AS q FROM sig_64 GROUP BY vec_id), {_peaks("sig_64", 63, "(SELECT q FROM q WHERE q.vec_id = pr.vec_id)", "x >= 0", 16)} SELECT vec_id, i::INT AS i, round(x, 6) AS value FROM peaks""")
def extract_wave_table(spark, sf_dir):
    """Peaks whose prominence is a quarter of the series' 95th percentile or more."""
    def run(x):
        at = dsp.find_peaks(x, height=0.0, prominence=max(1e-9, 0.25 * float(np.quantile(x, 0.95))), wlen=32)
        return pd.DataFrame({"i": at, "value": np.round(x[at], 6)})

    return kernels.expanded(_series(spark, sf_dir), K, run, "i int, value double")


@query(f"RECURSIVE {st.listed()}, {st.hmaxima('hm', 'ls', 8, 8, 0.8)} SELECT vec_id, (k // 8)::INT AS ap, (k % 8)::INT AS ml, round(x, 6) AS amp FROM hm")
def detect_hmaxima(spark, sf_dir):
    def run(x):
        at = dsp.detect_hmaxima(x.reshape(8, 8), 0.8)
        return pd.DataFrame({"ap": at[:, 0], "ml": at[:, 1], "amp": np.round(x.reshape(8, 8)[tuple(at.T)], 6)})

    return kernels.expanded(_series(spark, sf_dir), K, run, "ap int, ml int, amp double")


def outliers(source: str, group: str, key: str, values: list[str]) -> str:
    """`ok`: rows (g, a) that are core points or near one, by standardised values; eps by the knee of the fifth distances."""
    standard = ", ".join(f"({v} - avg({v}) OVER w) / stddev_pop({v}) OVER w AS z{k}" for k, v in enumerate(values))
    far = " + ".join(f"power(u.z{k} - v.z{k}, 2)" for k in range(len(values)))
    return f"""z AS (SELECT *, {standard} FROM {source} WINDOW w AS (PARTITION BY {group})), d AS (SELECT u.{group} AS g, u.{key} AS a, v.{key} AS b, sqrt({far}) AS d FROM z u JOIN z v ON v.{group} = u.{group}), kd AS (SELECT g, a, d, row_number() OVER (PARTITION BY g, a ORDER BY d) AS r FROM d),
  kth AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM kd WHERE r = 5), sm AS (SELECT g, r, n, (coalesce(lag(d) OVER w, d) + d + coalesce(lead(d) OVER w, d)) / 3 AS y FROM kth WINDOW w AS (PARTITION BY g ORDER BY r)),
  kn AS (SELECT *, min(y) OVER (PARTITION BY g) AS lo, max(y) OVER (PARTITION BY g) AS hi FROM sm), ep AS (SELECT g, arg_max(y, (r / (n - 1)::DOUBLE - (y - lo) / (hi - lo), -r)) AS eps FROM kn GROUP BY g),
  nr AS (SELECT d.* FROM d JOIN ep USING (g) WHERE d <= eps), co AS (SELECT g, a FROM nr GROUP BY g, a HAVING count(*) >= 5), ok AS (SELECT DISTINCT nr.g, nr.a FROM nr JOIN co ON co.g = nr.g AND co.a = nr.b)"""


@query(
    f"""v AS (SELECT vec_id, any_value(label)::INT AS label, avg(x) AS p, stddev_pop(x) AS q, max(x) - min(x) AS r FROM sig_64 JOIN embeddings USING (vec_id) GROUP BY vec_id), {outliers("v", "label", "vec_id", ["p", "q", "r"])}
  SELECT label, vec_id, NOT EXISTS (SELECT 1 FROM ok WHERE ok.a = v.vec_id) AS outlier FROM v"""
)
def dbscan_outliers(spark, sf_dir):
    """Vectors in no cluster by mean, deviation and amplitude, for each label."""
    x = _series(spark, sf_dir).groupBy("vec_id").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("b"), (F.max("x") - F.min("x")).alias("c"))
    own = x.join(views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")), "vec_id")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return p[["label", "vec_id"]].assign(outlier=complexity.dbscan_outliers(p[["a", "b", "c"]].to_numpy()))

    return own.groupBy("label").applyInPandas(run, "label int, vec_id long, outlier boolean")


def _scored(low: float, high: float) -> str:
    """Standard score z of a band's envelope (vec_id, i, t, x), and the band itself, bd."""
    return f"""{st.listed()}, {st.filtered("f", "ls", dsp.butter(4, (low, high), "band", FS), 64)}, {st.samples("f", "fs")}, bd AS (SELECT vec_id, i, i / 100::DOUBLE AS t, x FROM fs), {st.analytic("fs", "an")}, en AS (SELECT vec_id, i, sqrt(a * a + b * b) AS e FROM an),
  z AS (SELECT vec_id, i, i / 100::DOUBLE AS t, (e - avg(e) OVER w) / stddev_pop(e) OVER w AS x FROM en WINDOW w AS (PARTITION BY vec_id))"""


def _dual(low: float, high: float, shortest: float, longest: float) -> str:
    runs = runs_sql(f"x >= {low}", 0, "z").replace("user_id", "vec_id")
    return f"{runs}, du AS (SELECT r.vec_id, i0, i1, arg_max(t, (x, -i)) AS t, max(x) AS value FROM r JOIN z s ON s.vec_id = r.vec_id AND i BETWEEN i0 AND i1 GROUP BY r.vec_id, i0, i1 HAVING max(x) >= {high} AND max(t) - min(t) BETWEEN {shortest}::DOUBLE AND {longest}::DOUBLE)"


@query(f"RECURSIVE {_scored(15, 35)}, {_dual(0.8, 1.2, 0.02, 2.0)} SELECT vec_id, i0, i1, round(value, 6) AS value FROM du")
def detect_ripples(spark, sf_dir):
    own = _series(spark, sf_dir).withColumn("t", F.col("i") / FS)
    got = pipeline.Ripple(fs=FS, low=15.0, high=35.0, threshold_low=0.8, threshold_high=1.2, max_duration=2.0).detect(own, K)
    return got.select("vec_id", "i0", "i1", F.round("value", 6).alias("value"))


@query(
    f"""RECURSIVE {_scored(11, 16)}, {_dual(0.8, 1.2, 0.02, 3.0)},
  sg AS (SELECT d.vec_id, d.i0, x, s.t, i, sign(x) <> lag(sign(x)) OVER (PARTITION BY d.vec_id, d.i0 ORDER BY i) AS s FROM du d JOIN bd s ON s.vec_id = d.vec_id AND i BETWEEN i0 AND i1),
  en2 AS (SELECT vec_id, i0, sum(s::INT) / (2 * (max(t) - min(t))) AS frequency, (arg_max(i, (x, -i)) - i0) / (count(*) - 1) AS symmetry FROM sg GROUP BY vec_id, i0),
  o AS (SELECT vec_id, i0, t, value, row_number() OVER (PARTITION BY vec_id ORDER BY t, value) AS k FROM du),
  w AS (SELECT vec_id, k, t AS lt, value AS lv, i0 AS l0, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT o.vec_id, o.k, CASE WHEN far OR o.value > w.lv THEN o.t ELSE w.lt END, CASE WHEN far OR o.value > w.lv THEN o.value ELSE w.lv END, CASE WHEN far OR o.value > w.lv THEN o.i0 ELSE w.l0 END, CASE WHEN far THEN w.n + 1 ELSE w.n END
    FROM w JOIN o ON o.vec_id = w.vec_id AND o.k = w.k + 1, LATERAL (SELECT o.t - w.lt >= 0.1::DOUBLE AS far)),
  kp AS (SELECT vec_id, n, arg_max(l0, k) AS i0 FROM w GROUP BY vec_id, n) SELECT vec_id, i0, i1, round(frequency, 4) AS frequency, round(symmetry, 6) AS symmetry FROM kp JOIN du USING (vec_id, i0) JOIN en2 USING (vec_id, i0)"""
)
def detect_spindles(spark, sf_dir):
    own = _series(spark, sf_dir).withColumn("t", F.col("i") / FS)
    got = pipeline.Spindle(fs=FS, threshold_low=0.8, threshold_high=1.2, min_duration=0.02, min_isolation=0.1).detect(own, K)
    return got.select("vec_id", "i0", "i1", F.round("frequency", 4).alias("frequency"), F.round("symmetry", 6).alias("symmetry"))


@query(
    f"""RECURSIVE {st.listed()}, {st.filtered("f", "ls", dsp.butter(2, (2, 12), "band", FS), 64)}, {st.samples("f", "fs")}, z AS (SELECT vec_id, i, i / 100::DOUBLE AS t, x, x >= 0 AS pos FROM fs), n AS (SELECT *, lead(pos) OVER (PARTITION BY vec_id ORDER BY i) AS nxt FROM z), cr AS (SELECT vec_id, i, pos AS falling FROM n WHERE nxt <> pos),
  w AS (SELECT vec_id, i AS i0, (SELECT min(i) FROM cr b WHERE b.vec_id = a.vec_id AND b.i > a.i AND NOT b.falling) AS up, coalesce((SELECT min(i) FROM cr b WHERE b.vec_id = a.vec_id AND b.i > a.i AND b.falling), 63) AS e FROM cr a WHERE falling),
  q AS (SELECT w.vec_id, i0, up, e, min(x) AS trough, max(x) FILTER (i >= up) AS peak FROM w JOIN z ON z.vec_id = w.vec_id AND i >= i0 AND i < e WHERE up IS NOT NULL GROUP BY ALL),
  g AS (SELECT *, peak - trough AS ptp FROM q WHERE up / 100::DOUBLE - i0 / 100::DOUBLE BETWEEN 0.02::DOUBLE AND 1 AND e / 100::DOUBLE - i0 / 100::DOUBLE BETWEEN 0.04::DOUBLE AND 2)
  SELECT vec_id, i0, round(ptp, 6) AS ptp FROM (SELECT *, quantile_cont(ptp, 0.25) OVER (PARTITION BY vec_id) AS p FROM g) WHERE ptp >= p"""
)
def detect_slow_waves_filtered(spark, sf_dir):
    own = _series(spark, sf_dir).withColumn("t", F.col("i") / FS)
    return pipeline.SlowWave(fs=FS, low=2.0, high=12.0, neg=(0.02, 1.0), cycle=(0.04, 2.0)).detect(own, K).select("vec_id", "i0", F.round("ptp", 6).alias("ptp"))


@query(f"RECURSIVE {SPECTROGRAM}, sl AS (SELECT vec_id, list(p ORDER BY win, k) AS x FROM sg GROUP BY vec_id), {st.hmaxima('hm', 'sl', 7, 9, 0.9)} SELECT vec_id, ((k // 9) * 8 + 7.5::DOUBLE) / 100 AS t, (k % 9) * (1 / (16 * 0.01::DOUBLE)) AS freq, round(x, 8) AS value FROM hm")
def detect_bursts(spark, sf_dir):
    own = _series(spark, sf_dir).withColumn("t", F.col("i") / FS)
    return pipeline.Burst(fs=FS, nperseg=16, noverlap=8, bandwidth=12.5).detect(own, K).withColumn("value", F.round("value", 8))


@query(
    f"""RECURSIVE {_scored(15, 35)}, {runs_sql("x >= 1", 0, "z").replace("user_id", "vec_id")}, th AS (SELECT r.vec_id, i0, i1, arg_max(t, (x, -i)) AS t, max(x) AS value FROM r JOIN z s ON s.vec_id = r.vec_id AND i BETWEEN i0 AND i1 WHERE i1 > i0 GROUP BY r.vec_id, i0, i1)
  SELECT vec_id, printf('thresh_%06d', row_number() OVER (PARTITION BY vec_id ORDER BY t) - 1) AS event_id, i0, i1, round(value, 6) AS value FROM th"""
)
def ripple_pipeline(spark, sf_dir):
    own = _series(spark, sf_dir).withColumn("t", F.col("i") / FS)
    pipe = pipeline.DetectionPipeline("ripple", [pipeline.Bandpass(fs=FS, low=15.0, high=35.0), pipeline.Envelope(), pipeline.ZScore()], pipeline.Threshold(threshold=1.0))
    return pipe.run(own, K).table.select("vec_id", "event_id", "i0", "i1", F.round("value", 6).alias("value"))


@query(
    f"""RECURSIVE {st.listed()}, {st.filtered("f", "ls", dsp.butter(4, (20, 45), "band", FS), 64)}, {st.samples("f", "fs")}, {st.analytic("fs", "an")}, ev64 AS (SELECT vec_id, i, sqrt(a * a + b * b) AS e FROM an), {st.gaussian("g", 50 / 1000 * FS / 2.35)},
  sm AS (SELECT c.vec_id, c.i, sum(w * o.e) AS x FROM ev64 c, g JOIN ev64 o ON o.vec_id = c.vec_id AND o.i = {st.reflected("c.i + j", 64)} GROUP BY c.vec_id, c.i), z AS (SELECT vec_id, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM sm WINDOW w AS (PARTITION BY vec_id))
  SELECT vec_id, i / 100::DOUBLE AS t, round(z, 5) AS gamma_z, z < 0 AS valid FROM z WHERE i % 16 = 5"""
)
def gamma_envelope_validator(spark, sf_dir):
    own = _series(spark, sf_dir).withColumn("t", F.col("i") / FS)
    found = own.where("i % 16 = 5").select("vec_id", "t")
    return pipeline.gamma_validated(own, found, K, FS, (20.0, 45.0)).select("vec_id", "t", F.round("gamma_z", 5).alias("gamma_z"), "valid")


def _lines(name: str, f) -> None:
    def run(spark, sf_dir):
        return kernels.reduced(_series(spark, sf_dir), K, f, ["slope", "offset"]).select("vec_id", F.round("slope", 5).alias("slope"), F.round("offset", 5).alias("offset"))

    query(
        """z AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_64), ks AS (SELECT unnest(range(5, 29)) AS k), ps AS (SELECT vec_id, ln(k * 100 / 64.0::DOUBLE) AS lf, ln((power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2)) / 6400 + 1e-30) AS lp FROM z, ks GROUP BY vec_id, k)
  SELECT vec_id, round(-regr_slope(lp, lf), 5) AS slope, round(regr_intercept(lp, lf), 5) AS offset FROM ps GROUP BY vec_id""",
        name,
    )(run)


def _aperiodic(x: np.ndarray) -> dict[str, float]:
    """Exponent and offset of the log-log line from 7.8 to 43.8 Hz."""
    f, p = np.fft.rfftfreq(len(x), 1 / FS)[5:29], (np.abs(np.fft.rfft(x - x.mean())) ** 2 / (FS * len(x)))[5:29]
    slope, offset = np.polyfit(np.log(f), np.log(p + 1e-30), 1)
    return {"slope": -slope, "offset": offset}


_lines("aperiodic_exponent", _aperiodic)


BANDS = {"p4": (2, 6, 3), "p8": (6, 10, 3), "a20": (15, 25, 3), "a30": (25, 35, 3), "a40": (35, 45, 3)}
COMODULOGRAM = ", ".join([st.listed()] + [f"{st.filtered(f'f{n}', 'ls', dsp.butter(order, (low, high), 'band', FS), 64)}, {st.samples(f'f{n}', f's{n}')}, {st.analytic(f's{n}', n)}" for n, (low, high, order) in BANDS.items()])
PHASES = " UNION ALL ".join(f"SELECT {f}::DOUBLE AS f_phase, vec_id, i, a / sqrt(a * a + b * b) AS c, b / sqrt(a * a + b * b) AS s FROM p{f}" for f in (4, 8))
AMPLITUDES = " UNION ALL ".join(f"SELECT {f}::DOUBLE AS f_amp, vec_id, i, sqrt(a * a + b * b) AS e FROM a{f}" for f in (20, 30, 40))


@query(f"RECURSIVE {COMODULOGRAM}, ph AS ({PHASES}), am AS ({AMPLITUDES}) SELECT vec_id, f_phase, f_amp, round(sqrt(power(avg(e * c), 2) + power(avg(e * s), 2)), 6) AS mi FROM ph JOIN am USING (vec_id, i) GROUP BY ALL")
def comodulogram(spark, sf_dir):
    """Mean-vector index of each phase band against each amplitude band."""
    def run(x):
        rows = []
        for fp in (4.0, 8.0):
            phase = np.angle(dsp.hilbert(dsp.bandpass(x, FS, fp - 2, fp + 2, 3)))
            for fa in (20.0, 30.0, 40.0):
                amp = dsp.envelope(dsp.bandpass(x, FS, fa - 5, fa + 5, 3))
                rows.append((fp, fa, round(float(np.abs((amp * np.exp(1j * phase)).mean())), 6)))
        return pd.DataFrame(rows, columns=["f_phase", "f_amp", "mi"])

    return kernels.expanded(_series(spark, sf_dir), K, run, "f_phase double, f_amp double, mi double")


@query(
    """z AS (SELECT vec_id, ap, ml, x - avg(x) OVER (PARTITION BY vec_id, ap) AS x FROM sig_grid), y AS (SELECT vec_id, vec_id // 20 AS g, ap, k, sum(x * cos(2 * pi() * k * ml / 8)) AS re, -sum(x * sin(2 * pi() * k * ml / 8)) AS im FROM z, (SELECT unnest(range(1, 5)) AS k) GROUP BY ALL),
  s AS (SELECT a.g, a.ap, b.ap - a.ap AS distance, a.k, (power(avg(a.re * b.re + a.im * b.im), 2) + power(avg(a.im * b.re - a.re * b.im), 2)) / (avg(a.re * a.re + a.im * a.im) * avg(b.re * b.re + b.im * b.im) + 1e-12) AS c FROM y a JOIN y b ON b.vec_id = a.vec_id AND b.k = a.k AND b.ap > a.ap GROUP BY ALL),
  m AS (SELECT g, ap, distance, avg(c) AS c FROM s GROUP BY ALL) SELECT g, distance, round(avg(c), 6) AS coherence FROM m GROUP BY g, distance"""
)
def spatial_coherence_profile(spark, sf_dir):
    """Rows of a grid as channels of 8 samples: mean coherence by distance, vectors taken as segments."""
    own = views.sig_grid(spark, sf_dir).withColumn("g", F.floor(F.col("vec_id") / 20))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values(["vec_id", "ap", "ml"])["x"].to_numpy().reshape(-1, 8, 8)
        y = np.fft.rfft(x - x.mean(-1, keepdims=True), axis=-1)
        s = np.einsum("nak,nbk->abk", y, y.conj()) / len(y)
        c = np.abs(s) ** 2 / (np.einsum("aak->ak", s).real[:, None] * np.einsum("aak->ak", s).real[None] + 1e-12)
        rows = [(int(p["g"].iloc[0]), d, round(float(np.mean([c[a, a + d, 1:].mean() for a in range(8 - d)])), 6)) for d in range(1, 8)]
        return pd.DataFrame(rows, columns=["g", "distance", "coherence"])

    return own.groupBy("g").applyInPandas(run, "g long, distance int, coherence double")


@query(
    f"""{ANALYTIC}, tn AS (SELECT vec_id, k, re, im, CASE WHEN k IN (0, 32) THEN 0 ELSE 2 * pi() * {st.uniform(5, "vec_id", "k")} END AS turn FROM ft)
  SELECT vec_id, n.i::INT AS i, round(sum((re * cos(turn) - im * sin(turn)) * cos(2 * pi() * k * n.i / 64) - (re * sin(turn) + im * cos(turn)) * sin(2 * pi() * k * n.i / 64)), 6) AS y FROM tn, (SELECT unnest(range(64)) AS i) n GROUP BY vec_id, n.i"""
)
def phase_randomize(spark, sf_dir):
    """Surrogates of equal power: random phases, by a hash of series and frequency, but for the constant and Nyquist terms."""
    own = _series(spark, sf_dir).withColumn("u", gen.uniform(5, "vec_id", "i"))

    def f(x, u):
        turn = np.exp(2j * np.pi * u[: len(x) // 2 + 1])
        turn[0] = turn[-1] = 1
        return {"i": np.arange(len(x)), "y": np.round(np.fft.irfft(np.fft.rfft(x) * turn, len(x)), 6)}

    return kernels.expanded(own, K, f, "i int, y double", values=("x", "u"))


@query()
def spectral_granger(spark, sf_dir):
    """Influence each way between neighbouring vectors at each frequency, by factored multitaper cross spectra."""
    s = _series(spark, sf_dir)
    both = s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("y")), ["vec_id", "i"])

    def f(x, y):
        freq, there, back = granger.spectral(x, y, FS)
        return pd.DataFrame({"freq": freq, "x_to_y": np.round(there, 6), "y_to_x": np.round(back, 6)})

    return kernels.expanded(both, K, f, "freq double, x_to_y double, y_to_x double", values=("x", "y"))


@query()
def line_noise_ica(spark, sf_dir):
    """Groups of ten vectors as channels: components with an outstanding share of power at 25 Hz are taken out."""
    own = _series(spark, sf_dir).withColumn("g", F.floor(F.col("vec_id") / 10))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["vec_id", "i"])
        x = p["x"].to_numpy().reshape(-1, 64)
        sources, mixing = complexity.fast_ica(x, 6)
        power = np.abs(np.fft.rfft(sources, axis=1)) ** 2
        share = power[:, 16] / power.sum(1)
        bad = (share - share.mean()) / (share.std() or 1) > 1.5
        clean = x - mixing[:, bad] @ sources[bad]
        return p[["vec_id", "i"]].assign(y=np.round(clean.ravel(), 5))

    return own.groupBy("g").applyInPandas(run, "vec_id long, i long, y double")
