"""Queries of catalogs from detections, bands, embeddings, baselines, modes and the processing chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.functions import dsp
from siglake.functions import generators as gen
from siglake.operators import catalog, chain, decomposition, matching, ranges, spectral
from siglake.plans import sqltext as st
from siglake.plans.registry import query
from siglake.sources import views

FS = 100.0


@query(
    """r AS (SELECT user_id, t0 AS s, t1 AS e, t0 + (t1 - t0) * 0.25 AS p, iseg FROM intervals WHERE state = 'view'),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, p, iseg) - 1 AS k FROM r)
  SELECT user_id, printf('ripple_%06d', k) AS event_id, p AS t, s AS t0, e AS t1, round(e - s, 6) AS duration, 'ripple' AS label, iseg::DOUBLE AS value FROM n"""
)
def catalog_from_start_peak_end(spark, sf_dir):
    rows = views.intervals(spark, sf_dir).where("state = 'view'")
    rows = rows.select("user_id", F.col("t0").alias("start"), F.col("t1").alias("end"), (F.col("t0") + (F.col("t1") - F.col("t0")) * 0.25).alias("peak"), F.col("iseg").alias("peak_amplitude"))
    return catalog.from_start_peak_end(rows, "ripple", ["user_id"], ["t0", "t", "value"]).table.withColumn("duration", F.round("duration", 6))


@query("e AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'error') SELECT event_id, i, round(s.t - e.t, 6) AS rel FROM e JOIN sig_ev s ON s.user_id = e.user_id AND abs(s.t - e.t) <= 40000")
def burst_relative_time(spark, sf_dir):
    """Samples of a burst's channel around it, by time from its peak."""
    e = views.events(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id", F.col("t").alias("tb"))
    near = ranges.within(e, views.sig_ev(spark, sf_dir).select("user_id", "i", F.col("t").alias("ts")), ["user_id"], 40000.0, "tb", "ts")
    return near.select("event_id", "i", F.round(F.col("ts") - F.col("tb"), 6).alias("rel"))


@query("SELECT vec_id, i / 2.0 AS freq, x FROM sig_64 WHERE i / 2.0 BETWEEN 1 AND 30")
def clip_freq(spark, sf_dir):
    return spectral.clipped(views.sig_64(spark, sf_dir).select("vec_id", (F.col("i") / 2).alias("freq"), "x"))


@query("f AS (SELECT vec_id, arg_max(i / 2.0, x) AS freq FROM (FROM sig_64 ORDER BY i) GROUP BY vec_id) SELECT vec_id, freq, freq >= 8 AND freq < 20 AS is_alpha FROM f")
def mark_freq_band(spark, sf_dir):
    peaks = views.sig_64(spark, sf_dir).groupBy("vec_id").agg((F.max_by("i", F.struct("x", -F.col("i"))) / 2).alias("freq"))
    return decomposition.in_band(peaks, "alpha", 8, 20)


@query(
    """b AS (SELECT vec_id, ap, ml, abs(x) > 0.28 AS bad FROM sig_grid)
  SELECT a.vec_id, a.ap, a.ml FROM b a JOIN b n ON n.vec_id = a.vec_id AND abs(n.ap - a.ap) <= 1 AND abs(n.ml - a.ml) <= 1 GROUP BY ALL HAVING count(*) = 9 AND NOT bool_or(n.bad)"""
)
def embed_chan(spark, sf_dir):
    grid = views.sig_grid(spark, sf_dir).withColumn("bad", F.abs("x") > 0.28)
    return decomposition.embedded(grid, ["vec_id"], "bad", 1)


@query(
    """e AS (SELECT event_id, t FROM ev WHERE event_type = 'signup'), s AS (SELECT t FROM ev WHERE event_type = 'view'),
  c AS (SELECT event_id, least(floor((s.t - e.t + 1000) / 200), 14)::INT AS bin, count(*) / 200.0::DOUBLE AS r FROM e JOIN s ON s.t BETWEEN e.t - 1000 AND e.t + 2000 GROUP BY ALL),
  f AS (SELECT e.event_id, k::INT AS bin, coalesce(r, 0) AS r FROM e CROSS JOIN range(15) q(k) LEFT JOIN c ON c.event_id = e.event_id AND c.bin = k),
  h AS (SELECT bin, -1000 + (bin + 0.5::DOUBLE) * 200 AS lag, avg(r) AS rate, stddev_pop(r) / sqrt(count(*)) AS sem FROM f GROUP BY bin),
  b AS (SELECT avg(rate) AS b FROM h WHERE lag BETWEEN -900 AND -300)
  SELECT bin, lag, round(CASE WHEN b > 0 THEN rate / b ELSE rate END, 6) AS rate, round(CASE WHEN b > 0 THEN sem / b ELSE sem END, 6) AS sem FROM h, b"""
)
def peri_event_histogram_baseline(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    e = ev.where("event_type = 'signup'").select("event_id", F.col("t").alias("te"))
    s = ev.where("event_type = 'view'").select(F.col("t").alias("ts"))
    out = matching.baselined(matching.peri_event_histogram(s, e, [], 200.0, (-1000.0, 2000.0)), -900.0, -300.0)
    return out.select("bin", "lag", F.round("rate", 6).alias("rate"), F.round("sem", 6).alias("sem"))


@query(
    """p AS (SELECT unnest(range(6)) AS ap), q AS (SELECT unnest(range(4)) AS ml),
  m AS (SELECT vec_id, i, ap, ml, x * exp(-0.5 * (power((ap - (1 + vec_id // 2 * 3)) / 1.5::DOUBLE, 2) + power((ml - (0.5::DOUBLE + vec_id % 2 * 2)) / 1.0, 2))) AS x FROM sig_64, p, q WHERE vec_id < 4)
  SELECT i, ap, ml, round(sum(x), 6) AS x FROM m GROUP BY ALL"""
)
def mode_mixer(spark, sf_dir):
    """Four Gaussian modes that tile a grid, each with a series as its envelope, summed."""
    own = views.sig_64(spark, sf_dir)
    envelopes = [own.where(F.col("vec_id") == k).select("i", F.col("x").alias("e")) for k in range(4)]
    return gen.mode_mixer(gen.gaussian_cover(6, 4, 2, 2), envelopes).withColumn("x", F.round("x", 6))


CENTRES = [{"ap": 1.0, "ml": 2.0, "t": 3.0, "freq": 8.0, "amp": 1.0}, {"ap": 4.0, "ml": 1.0, "t": 6.0, "freq": 20.0, "amp": 0.5}]
WIDTHS = {"ap": 1.0, "ml": 1.5, "t": 2.0, "freq": 4.0}


@query(
    """g AS (SELECT k // 400 AS ap, k // 80 % 5 AS ml, k // 10 % 8 AS t, k % 10 * 3.0::DOUBLE AS freq FROM (SELECT unnest(range(2400)) AS k))
  SELECT ap, ml, t, freq, round(0.1 + exp(-0.5 * (power(ap - 1, 2) + power((ml - 2) / 1.5::DOUBLE, 2) + power((t - 3) / 2.0::DOUBLE, 2) + power((freq - 8) / 4, 2)))
    + 0.5 * exp(-0.5 * (power(ap - 4, 2) + power((ml - 1) / 1.5::DOUBLE, 2) + power((t - 6) / 2.0::DOUBLE, 2) + power((freq - 20) / 4, 2))), 9) AS x FROM g"""
)
def example_spectrogram4d(spark, sf_dir):
    """Gaussian blobs over place, time and frequency on a flat background."""
    k = F.col("id")
    g = spark.range(2400).select(F.floor(k / 400).alias("ap"), (F.floor(k / 80) % 5).alias("ml"), (F.floor(k / 10) % 8).alias("t"), (k % 10 * 3.0).alias("freq"))
    return gen.blobs(g, CENTRES, WIDTHS, 0.1).withColumn("x", F.round("x", 9))


@query(
    f"""RECURSIVE sc AS (SELECT ap * 8 + ml AS c, vec_id AS i, x - median(x) OVER (PARTITION BY vec_id) AS x FROM sig_grid WHERE vec_id >= 4), {st.listed("sc", "ls", "c")}, {st.filtered("f0", "ls", dsp.butter(4, (5, 30), "band", FS), None, "c")}, {st.filtered("f1", "f0", dsp.notch_sos(FS, 25.0), None, "c")},
  y AS (SELECT c // 8 AS ap, c % 8 AS ml, unnest(range(len(x))) + 4 AS i, unnest(x) AS x FROM f1), o AS (SELECT da, dm FROM range(-1, 2) a(da), range(-1, 2) b(dm)),
  m AS (SELECT a.ap, a.ml, a.i, median(b.x) AS x FROM y a, o JOIN y b ON b.i = a.i AND b.ap = {st.reflected("a.ap + da", 8)} AND b.ml = {st.reflected("a.ml + dm", 8)} GROUP BY a.ap, a.ml, a.i),
  z AS (SELECT ap, ml, i, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12) AS z FROM m WINDOW w AS (PARTITION BY ap, ml)) SELECT ap::INT AS ap, ml::INT AS ml, i, round(z, 6) AS x FROM z WHERE (ap, ml) IN ((0, 0), (3, 4), (7, 7))"""
)
def processing_chain(spark, sf_dir):
    """Vectors as the samples of 64 channels: reference, band, notch, spatial median, z-score, and three channels of it."""
    own = views.sig_grid(spark, sf_dir).select("ap", "ml", F.col("vec_id").cast("long").alias("i"), "x")
    out = chain.window(own, FS, 4, 2_000_000_000, (8, 8), band=(5.0, 30.0), notches=[25.0], median=3, channels=[(0, 0), (3, 4), (7, 7)])
    return out.withColumn("x", F.round("x", 6))
