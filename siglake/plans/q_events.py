"""Catalog, matching, burst and correlogram queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.operators import bursts, catalog, matching, ranges
from siglake.plans.registry import query
from siglake.sources import views


def _own(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return catalog.numbered(ev.select(F.col("event_id").alias("src"), F.col("user_id").alias("channel"), "t", F.col("event_type").alias("label"), F.col("x").alias("value")), "peak", ["t", "src"], ["channel"])


ROWS = """c AS (SELECT event_id AS src, user_id AS channel, t, event_type AS label, x AS value, format('peak_{:06d}', row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) AS event_id FROM ev)"""


@query(f"{ROWS} SELECT channel, event_id, src, label FROM c")
def catalog_from_peaks(spark, sf_dir):
    return _own(spark, sf_dir).select("channel", "event_id", "src", "label")


@query(f"{ROWS} SELECT src, round(t - 2.5, 3) AS t0, round(t + 2.5, 3) AS t1 FROM c")
def catalog_to_point_intervals(spark, sf_dir):
    own = _own(spark, sf_dir)
    return own.select("src", F.round(F.col("t") - 2.5, 3).alias("t0"), F.round(F.col("t") + 2.5, 3).alias("t1"))


@query("SELECT event_id, round(x * 2, 6) AS duration FROM (SELECT event_id, x, t - x AS t0, t + x AS t1 FROM ev) WHERE t1 > t0")
def catalog_duration(spark, sf_dir):
    ev = views.events(spark, sf_dir).withColumn("t0", F.col("t") - F.col("x")).withColumn("t1", F.col("t") + F.col("x")).where("t1 > t0")
    return catalog.EventCatalog(ev.withColumn("duration", F.col("x") * 2)).table.select("event_id", F.round("duration", 6).alias("duration"))


@query(f"{ROWS}, s AS (SELECT min(t) AS m FROM ev) SELECT src FROM c, s WHERE t BETWEEN m + 1000 AND m + 90000")
def catalog_filter_by_time(spark, sf_dir):
    m = views.events(spark, sf_dir).agg(F.min("t")).first()[0]
    own = catalog.EventCatalog(_own(spark, sf_dir))
    return own.filter_by_time(m + 90000, m + 1000).table.select("src")


@query(f"{ROWS} SELECT src FROM c WHERE channel IN (3, 5, 8)")
def catalog_filter_by_channel(spark, sf_dir):
    return catalog.EventCatalog(_own(spark, sf_dir)).filter_by_channel([3, 5, 8]).table.select("src")


def _placed(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return ev.select("event_id", "t", (F.col("user_id") % 16).alias("AP"), (F.floor(F.col("user_id") / 16) % 16).alias("ML"), F.col("x").alias("amp"), "event_type", "user_id")


PLACED = "p AS (SELECT event_id, t, user_id % 16 AS AP, (user_id // 16) % 16 AS ML, x AS amp, event_type, user_id FROM ev)"


@query(f"{PLACED} SELECT event_id FROM p WHERE sqrt((AP - 4) * (AP - 4) + (ML - 3) * (ML - 3)) <= 2.5")
def catalog_filter_by_radius(spark, sf_dir):
    return catalog.EventCatalog(_placed(spark, sf_dir)).filter_by_spatial(4, 3, 2.5).table.select("event_id")


@query(f"{PLACED} SELECT event_id FROM p WHERE AP = 4")
def catalog_filter_by_ap(spark, sf_dir):
    return catalog.EventCatalog(_placed(spark, sf_dir)).filter_by_spatial(ap=4, ml=3).table.select("event_id")


@query("SELECT event_id FROM ev WHERE t > (SELECT median(t) FROM ev) ORDER BY t, event_id LIMIT 1")
def next_event(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return catalog.EventCatalog(ev).following(ev.agg(F.median("t")).first()[0]).select("event_id")


@query("SELECT event_id FROM ev WHERE t < (SELECT median(t) FROM ev) ORDER BY t DESC, event_id DESC LIMIT 1")
def previous_event(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return catalog.EventCatalog(ev).preceding(ev.agg(F.median("t")).first()[0]).select("event_id")


@query("SELECT event_id, user_id FROM ev WHERE event_id = 77")
def event_by_id(spark, sf_dir):
    return catalog.EventCatalog(views.events(spark, sf_dir)).by_id(77).select("event_id", "user_id")


@query(
    """v AS (SELECT event_id, t, t - 1 AS t0, t - 1 + x / 10 AS t1, x / 10 AS duration, CASE WHEN x > 60 THEN NULL ELSE x END AS score FROM ev),
  m AS (SELECT event_id * 2 AS event_id FROM ev)
  SELECT 'finite_t' AS rule, 0::BIGINT AS n UNION ALL SELECT 'finite_t0', 0 UNION ALL SELECT 'finite_t1', 0 UNION ALL SELECT 'finite_duration', 0
  UNION ALL SELECT 'finite_score', count(*) FILTER (score IS NULL) FROM v UNION ALL SELECT 'ends_after_start', count(*) FILTER (NOT t1 > t0) FROM v
  UNION ALL SELECT 't_inside', count(*) FILTER (NOT t BETWEEN t0 AND t1) FROM v UNION ALL SELECT 'duration_agrees', count(*) FILTER (NOT abs(duration - (t1 - t0)) < 1e-6) FROM v
  UNION ALL SELECT 'duplicate_id', 0 UNION ALL SELECT 'unknown_member', count(*) FROM m WHERE event_id NOT IN (SELECT event_id FROM ev)"""
)
def validate_event_catalog(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    v = ev.select("event_id", "t", (F.col("t") - 1).alias("t0"), (F.col("t") - 1 + F.col("x") / 10).alias("t1"), (F.col("x") / 10).alias("duration"), F.when(F.col("x") <= 60, F.col("x")).alias("score"))
    return catalog.violations(v, ev.select((F.col("event_id") * 2).alias("event_id")))


def _trains(spark, sf_dir, keys=("user_id",)):
    ev = views.events(spark, sf_dir)
    a = ev.where("event_type = 'click'").select(*keys, F.col("event_id").alias("ia"), F.col("t").alias("ta"))
    b = ev.where("event_type = 'view'").select(*keys, F.col("event_id").alias("ib"), F.col("t").alias("tb"))
    return a, b


NEAREST = """a AS (SELECT event_id AS ia, t AS ta, user_id FROM ev WHERE event_type = 'click'), b AS (SELECT event_id AS ib, t AS tb, user_id FROM ev WHERE event_type = 'view'),
  p AS (SELECT a.*, ib, tb - ta AS lag, row_number() OVER (PARTITION BY ia ORDER BY abs(tb - ta), tb DESC, CASE WHEN tb >= ta THEN ib ELSE -ib END) AS r FROM a JOIN b USING (user_id) WHERE abs(tb - ta) <= 90000),
  m AS (SELECT * FROM p WHERE r = 1)
"""


def _matches(spark, sf_dir, symmetric=False):
    a, b = _trains(spark, sf_dir)
    f = ranges.nearest_symmetric if symmetric else ranges.nearest
    return f(a, b, ["user_id"], 90000.0, ta="ta", tb="tb", chunk=400000.0)


@query(f"{NEAREST} SELECT user_id, ia, ib, round(lag, 3) AS lag FROM m")
def match_nearest(spark, sf_dir):
    return _matches(spark, sf_dir).select("user_id", "ia", "ib", F.round("lag", 3).alias("lag"))


@query(f"{NEAREST}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, ib ORDER BY abs(lag), ta, ia) AS rb FROM m) SELECT user_id, ia, ib, round(lag, 3) AS lag FROM s WHERE rb = 1")
def match_nearest_symmetric(spark, sf_dir):
    return _matches(spark, sf_dir, True).select("user_id", "ia", "ib", F.round("lag", 3).alias("lag"))


LAGS = """a AS (SELECT t AS ta FROM ev WHERE event_type = 'click'), b AS (SELECT t AS tb FROM ev WHERE event_type = 'purchase'),
  l AS (SELECT tb - ta AS lag FROM a JOIN b ON tb BETWEEN ta - 3600 AND ta + 3600)"""


def _both(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    return ev.where("event_type = 'click'").select(F.col("t").alias("ta")), ev.where("event_type = 'purchase'").select(F.col("t").alias("tb"))


@query(f"{LAGS}, c AS (SELECT least(floor((lag + 3600) / 100), 71)::INT AS bin, count(*) AS n FROM l GROUP BY 1) SELECT k::INT AS bin, coalesce(n, 0) AS n FROM range(72) r(k) LEFT JOIN c ON c.bin = k")
def event_lag_histogram(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return matching.lag_histogram(a, b, [], 3600, 100)


@query(f"{LAGS}, c AS (SELECT least(floor((lag + 3600) / 300), 23)::INT AS bin, count(*) AS n FROM l GROUP BY 1) SELECT k::INT AS bin, -3600 + (k + 0.5::DOUBLE) * 300 AS lag, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT count(*) FROM a) * 300.0::DOUBLE), 9) AS rate FROM range(24) r(k) LEFT JOIN c ON c.bin = k")
def cross_correlogram(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    out = matching.correlogram(a, b, [], 300.0, 3600.0)
    return out.select("bin", "lag", "n", F.round("rate", 9).alias("rate"))


@query(
    """a AS (SELECT t FROM ev WHERE event_type = 'signup'), b0 AS (SELECT t FROM ev WHERE event_type = 'view'), sp AS (SELECT min(t) AS lo, max(t) AS hi FROM ev WHERE event_type IN ('signup', 'view')),
  b AS (SELECT f AS share, lo + (t - lo + f * (hi - lo)) % (hi - lo) AS t FROM b0, sp, (SELECT unnest([0.2::DOUBLE, 0.55::DOUBLE, 0.8::DOUBLE]) AS f)),
  c AS (SELECT share, least(floor((b.t - a.t + 3600) / 300), 23)::INT AS bin, count(*) AS n FROM a JOIN b ON abs(b.t - a.t) <= 3600 GROUP BY ALL)
  SELECT f AS share, k::INT AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT count(*) FROM a) * 300.0::DOUBLE), 9) AS rate FROM range(24) r(k), (SELECT unnest([0.2::DOUBLE, 0.55::DOUBLE, 0.8::DOUBLE]) AS f) LEFT JOIN c ON c.bin = k AND share = f"""
)
def cross_correlogram_surrogates(spark, sf_dir):
    """Correlograms against trains that are shifted around the end by shares of the span."""
    ev = views.events(spark, sf_dir)
    a, b = (ev.where(F.col("event_type") == k).select(F.col("t").alias(n)) for k, n in (("signup", "ta"), ("view", "tb")))
    out = matching.correlogram_surrogates(a, b, [], 300.0, 3600.0, [0.2, 0.55, 0.8])
    return out.select("share", "bin", "n", F.round("rate", 9).alias("rate"))


@query(
    """e AS (SELECT event_id, t FROM ev WHERE event_type = 'signup'), s AS (SELECT t FROM ev WHERE event_type = 'view'),
  c AS (SELECT event_id, least(floor((s.t - e.t + 1000) / 200), 14)::INT AS bin, count(*) / 200.0::DOUBLE AS r FROM e JOIN s ON s.t BETWEEN e.t - 1000 AND e.t + 2000 GROUP BY ALL),
  g AS (SELECT event_id, k::INT AS bin, coalesce(r, 0) AS r FROM e CROSS JOIN range(15) q(k) LEFT JOIN c USING (event_id) WHERE c.bin IS NULL OR true),
  f AS (SELECT e.event_id, k::INT AS bin, coalesce(r, 0) AS r FROM e CROSS JOIN range(15) q(k) LEFT JOIN c ON c.event_id = e.event_id AND c.bin = k)
  SELECT bin, -1000 + (bin + 0.5::DOUBLE) * 200 AS lag, round(avg(r), 9) AS rate, round(stddev_pop(r) / sqrt(count(*)), 9) AS sem FROM f GROUP BY bin"""
)
def peri_event_histogram(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    e = ev.where("event_type = 'signup'").select("event_id", F.col("t").alias("te"))
    s = ev.where("event_type = 'view'").select(F.col("t").alias("ts"))
    out = matching.peri_event_histogram(s, e, [], 200.0, (-1000.0, 2000.0))
    return out.select("bin", "lag", F.round("rate", 9).alias("rate"), F.round("sem", 9).alias("sem"))


@query(
    f"""{NEAREST}, q AS (SELECT min(lag) AS lo, max(lag) AS hi FROM m),
  c AS (SELECT CASE WHEN lag = hi THEN 99 ELSE floor((lag - lo) / ((hi - lo) / 100))::INT END AS k, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM m, q GROUP BY 1)
  SELECT round((SELECT median(lag) FROM m), 3) AS median, round((SELECT avg(lag) FROM m), 3) AS mean, round((SELECT lo + (k + 0.5::DOUBLE) * (hi - lo) / 100 FROM c ORDER BY n DESC, k LIMIT 1), 3) AS mode"""
)
def estimate_lag(spark, sf_dir):
    got = matching.lag_estimates(_matches(spark, sf_dir))
    return got.select(*[F.round(c, 3).alias(c) for c in ("median", "mean", "mode")])


@query(f"{NEAREST} SELECT round(regr_slope(lag, ta - 1.7e9) * 1e6, 3) AS slope_ppm, round(avg(lag), 3) AS level FROM m")
def estimate_drift(spark, sf_dir):
    m = _matches(spark, sf_dir)
    slope, offset = matching.drift(m, 1)
    level = m.agg(F.avg(F.lit(float(offset)) + F.lit(float(slope)) * F.col("ta")).alias("level"))
    return level.select(F.round(F.lit(float(slope) * 1e6), 3).alias("slope_ppm"), F.round("level", 3).alias("level"))


TRUTH = "d AS (SELECT doc_id FROM labels WHERE quality = 0), t AS (SELECT doc_id FROM documents WHERE n_chars < 600)"


@query(f"{TRUTH} SELECT doc_id, 'TP' AS kind FROM d JOIN t USING (doc_id) UNION ALL SELECT doc_id, 'FP' FROM d ANTI JOIN t USING (doc_id) UNION ALL SELECT doc_id, 'FN' FROM t ANTI JOIN d USING (doc_id)")
def classify_detections(spark, sf_dir):
    d = views.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return bursts.classified(d, views.table(spark, sf_dir, "documents").where("n_chars < 600").select("doc_id"), ["doc_id"])


@query(f"{TRUTH}, n AS (SELECT (SELECT count(*) FROM d JOIN t USING (doc_id)) AS tp, (SELECT count(*) FROM d) AS nd, (SELECT count(*) FROM t) AS nt) SELECT round(1 - tp / nt, 9) AS miss, round(tp / nd, 9) AS precision FROM n")
def detection_rates(spark, sf_dir):
    got = bursts.detection_rates(classify_detections(spark, sf_dir))
    return got.select(F.round("miss", 9).alias("miss"), F.round("precision", 9).alias("precision"))


@query("SELECT user_id, round(sum(x) / sqrt(sum(x * x)), 6) AS s FROM sig_ev GROUP BY user_id")
def normalized_sum(spark, sf_dir):
    return views.sig_ev(spark, sf_dir).groupBy("user_id").agg(F.round(bursts.normalized_sum("x"), 6).alias("s"))


BURSTS = f"""{PLACED}, u AS (SELECT event_id AS id, t, AP - 8 AS AP, ML - 4 AS ML, amp,
    CASE WHEN AP = 8 OR ML = 4 THEN NULL ELSE CASE WHEN AP > 8 THEN 'U' ELSE 'D' END || CASE WHEN ML > 4 THEN 'R' ELSE 'L' END END AS quadrant FROM p WHERE event_type = 'error'),
  z AS (SELECT a.id AS id_i, b.id AS id_j, abs(a.t - b.t) AS time_diff, sqrt((a.AP - b.AP) * (a.AP - b.AP) + (a.ML - b.ML) * (a.ML - b.ML)) AS dist, coalesce(a.quadrant = b.quadrant, false) AS colocalized
    FROM u a JOIN u b ON a.id < b.id AND abs(a.t - b.t) <= 700)
"""


MERGE = f"""{BURSTS}, s AS (SELECT vec_id, i, x FROM sig_64 WHERE vec_id < 50), r AS (SELECT a.vec_id AS vi, b.vec_id AS vj, corr(a.x, b.x) AS corr FROM s a JOIN s b USING (i) GROUP BY ALL),
  m AS (SELECT z.*, corr FROM z JOIN r ON vi = id_i % 50 AND vj = id_j % 50 WHERE colocalized AND time_diff < 700 AND corr >= 0.05)"""


def _signals(spark, sf_dir):
    """Each burst has one of fifty signals; one in three pairs or so is alike enough at this threshold."""
    own = views.sig_64(spark, sf_dir).where("vec_id < 50").groupBy(F.col("vec_id").alias("signal")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("x"))
    return _bursts(spark, sf_dir).withColumn("signal", F.col("id") % 50), own


def _duplicates(spark, sf_dir):
    u, own = _signals(spark, sf_dir)
    return bursts.duplicates(u.drop("signal"), u.select("id", "signal").join(own, "signal").select("id", "x"), [], 700.0, 0.05)


def _clusters(spark, sf_dir):
    return bursts.clusters(*_signals(spark, sf_dir), [], 700.0, 0.05)


def _bursts(spark, sf_dir):
    p = _placed(spark, sf_dir).where("event_type = 'error'")
    u = p.select(F.col("event_id").alias("id"), "t", (F.col("AP") - 8).alias("AP"), (F.col("ML") - 4).alias("ML"), "amp")
    return u.withColumn("quadrant", bursts.quadrant())


@query(f"{BURSTS} SELECT id, quadrant FROM u")
def assign_quadrants(spark, sf_dir):
    return _bursts(spark, sf_dir).select("id", "quadrant")


@query(f"{BURSTS} SELECT id_i, id_j, round(time_diff, 3) AS time_diff, round(dist, 6) AS dist, colocalized FROM z")
def burst_pairs(spark, sf_dir):
    got = bursts.pairs(_bursts(spark, sf_dir), [], 700.0)
    return got.withColumn("time_diff", F.round("time_diff", 3)).withColumn("dist", F.round("dist", 6))


@query(f"{MERGE} SELECT id_i, id_j, round(time_diff, 3) AS time_diff, round(dist, 6) AS dist, round(corr, 6) AS corr FROM m")
def filter_pairs_for_merging(spark, sf_dir):
    """Pairs of one quadrant, close in time, whose signals correlate."""
    got = _duplicates(spark, sf_dir)
    return got.select("id_i", "id_j", F.round("time_diff", 3).alias("time_diff"), F.round("dist", 6).alias("dist"), F.round("corr", 6).alias("corr"))


@query(
    f"""{MERGE}, e AS (SELECT id_i AS a, id_j AS b FROM m UNION SELECT id_j, id_i FROM m),
  reach AS (WITH RECURSIVE q(a, r) AS (SELECT a, a FROM e UNION SELECT e.b, q.r FROM q JOIN e ON e.a = q.a) SELECT a, min(r) AS cluster FROM q GROUP BY a)
  SELECT a AS node, cluster FROM reach"""
)
def find_merge_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(
    f"""{MERGE}, e AS (SELECT id_i AS a, id_j AS b FROM m UNION SELECT id_j, id_i FROM m),
  reach AS (WITH RECURSIVE q(a, r) AS (SELECT a, a FROM e UNION SELECT e.b, q.r FROM q JOIN e ON e.a = q.a) SELECT a, min(r) AS cluster FROM q GROUP BY a),
  o AS (SELECT id, coalesce(cluster, id) AS cluster, row_number() OVER (PARTITION BY coalesce(cluster, id) ORDER BY amp DESC, id) AS k FROM u LEFT JOIN reach ON a = id)
  SELECT id, cluster FROM o WHERE k = 1"""
)
def merge_bursts(spark, sf_dir):
    return bursts.strongest(_bursts(spark, sf_dir), _clusters(spark, sf_dir)).select("id", "cluster")


@query(
    f"""{PLACED}, w AS (SELECT event_id AS wave, t AS tw, AP AS APw, ML AS MLw FROM p WHERE event_type = 'signup'), u AS (SELECT event_id AS burst, t, AP, ML FROM p WHERE event_type = 'error')
  SELECT wave, burst, APw - AP AS AP_diff, MLw - ML AS ML_diff FROM w JOIN u ON abs(tw - t) < 300 AND sqrt((APw - AP) * (APw - AP) + (MLw - ML) * (MLw - ML)) < 6"""
)
def burst_concurrent_waves(spark, sf_dir):
    """Waves within 6 electrodes and less than 300 s of a burst."""
    p = _placed(spark, sf_dir)
    w = p.where("event_type = 'signup'").select(F.col("event_id").alias("wave"), F.col("t").alias("tw"), F.col("AP").alias("APw"), F.col("ML").alias("MLw"))
    u = p.where("event_type = 'error'").select(F.col("event_id").alias("burst"), "t", "AP", "ML")
    near = ranges.within(w, u, [], 300.0, "tw", "t").where((F.abs(F.col("tw") - F.col("t")) < 300) & (F.hypot(F.col("APw") - F.col("AP"), F.col("MLw") - F.col("ML")) < 6))
    return near.select("wave", "burst", (F.col("APw") - F.col("AP")).alias("AP_diff"), (F.col("MLw") - F.col("ML")).alias("ML_diff"))


@query(f"{PLACED}, w AS (SELECT event_id AS wave, AP // 4 AS a, ML // 4 AS m, user_id FROM p WHERE event_type = 'signup'), u AS (SELECT event_id AS burst, AP // 4 AS a, ML // 4 AS m, user_id FROM p WHERE event_type = 'error') SELECT wave, burst FROM w JOIN u USING (user_id, a, m)")
def burst_colocalized_bins(spark, sf_dir):
    """Waves and bursts of one user in the same bin of 4 x 4 electrodes."""
    p = _placed(spark, sf_dir).select("event_id", "event_type", "user_id", F.floor(F.col("AP") / 4).alias("a"), F.floor(F.col("ML") / 4).alias("m"))
    w = p.where("event_type = 'signup'").select(F.col("event_id").alias("wave"), "user_id", "a", "m")
    return w.join(p.where("event_type = 'error'").select(F.col("event_id").alias("burst"), "user_id", "a", "m"), ["user_id", "a", "m"]).select("wave", "burst")
