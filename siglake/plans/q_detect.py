"""Detector queries over users' series."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.operators import detect, series
from siglake.plans.registry import query
from siglake.sources import views

K = ["user_id"]


def runs_sql(hit: str, gap: int, source: str = "sig_ev") -> str:
    return f"""h AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM {source} WHERE {hit}),
  r AS (SELECT user_id, min(i) AS i0, max(i) AS i1 FROM h GROUP BY user_id, g),
  b AS (SELECT *, CASE WHEN i0 <= max(i1) OVER (PARTITION BY user_id ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} + 1 THEN 0 ELSE 1 END AS brk FROM r),
  c AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY i0) AS cid FROM b),
  m AS (SELECT user_id, min(i0) AS i0, max(i1) AS i1 FROM c GROUP BY user_id, cid)"""


@query(f"{runs_sql('x >= 15', 0)} SELECT user_id, i0, i1 FROM r")
def find_true_runs(spark, sf_dir):
    return series.true_runs(views.sig_ev(spark, sf_dir), K, "i", F.col("x") >= 15)


@query(f"{runs_sql('x >= 20', 2)} SELECT user_id, i0, i1 FROM m")
def merge_intervals(spark, sf_dir):
    return series.merged_runs(series.true_runs(views.sig_ev(spark, sf_dir), K, "i", F.col("x") >= 20), K, 2)


def _threshold(direction: str, hit: str, best: str) -> None:
    def run(spark, sf_dir):
        centred = views.sig_ev(spark, sf_dir).withColumn("x", F.col("x") - 10)
        out = detect.threshold_events(centred, K, 8.0, direction, 1, 100.0)
        return out.select("user_id", "i0", "i1", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), F.round("t", 3).alias("t"), F.round("value", 6).alias("value"))

    query(
        f"""z AS (SELECT user_id, i, t, x - 10 AS x FROM sig_ev), {runs_sql(hit, 1, "z")}
  SELECT m.user_id, i0, i1, round(min(t), 3) AS t0, round(max(t), 3) AS t1, round(arg_max(t, ({best}, -i)), 3) AS t, round(arg_max(x, ({best}, -i)), 6) AS value
  FROM m JOIN z ON z.user_id = m.user_id AND i BETWEEN i0 AND i1 WHERE i1 > i0 GROUP BY m.user_id, i0, i1 HAVING max(t) - min(t) >= 100""",
        f"threshold_detector_{direction}",
    )(run)


for _d, _h, _b in (("positive", "x >= 8", "x"), ("negative", "x <= -8", "-x"), ("both", "abs(x) >= 8", "abs(x)")):
    _threshold(_d, _h, _b)


@query(
    f"""{runs_sql("x >= 12", 0)}
  SELECT r.user_id, i0, i1, round(arg_max(t, (x, -i)), 3) AS t, round(max(x), 6) AS value FROM r JOIN sig_ev s ON s.user_id = r.user_id AND i BETWEEN i0 AND i1 GROUP BY ALL HAVING max(x) >= 40"""
)
def dual_threshold_events(spark, sf_dir):
    out = detect.dual_threshold_events(views.sig_ev(spark, sf_dir), K, 12, 40)
    return out.select("user_id", "i0", "i1", F.round("t", 3).alias("t"), F.round("value", 6).alias("value"))


@query(
    f"""z AS (SELECT user_id, i, t, 10 - x AS x FROM sig_ev), {runs_sql("x >= 2", 0, "z")}
  SELECT r.user_id, i0, i1, round(arg_max(t, (x, -i)), 3) AS t, round(max(x), 6) AS value FROM r JOIN z s ON s.user_id = r.user_id AND i BETWEEN i0 AND i1 GROUP BY ALL HAVING max(x) >= 9"""
)
def dual_threshold_events_negative(spark, sf_dir):
    centred = views.sig_ev(spark, sf_dir).withColumn("x", F.col("x") - 10)
    out = detect.dual_threshold_events(centred, K, 2, 9, "negative")
    return out.select("user_id", "i0", "i1", F.round("t", 3).alias("t"), F.round("value", 6).alias("value"))


BOUTS = f"""{runs_sql("x >= 12", 0)},
  d AS (SELECT r.user_id, i0, i1 FROM r JOIN sig_ev s ON s.user_id = r.user_id AND i BETWEEN i0 AND i1 GROUP BY ALL HAVING max(x) >= 25),
  st AS (SELECT user_id, round_even(200000.0 / median(dt), 0)::BIGINT AS gap FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM sig_ev) GROUP BY user_id),
  b2 AS (SELECT d.*, CASE WHEN i0 <= max(i1) OVER (PARTITION BY user_id ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + gap + 1 THEN 0 ELSE 1 END AS brk FROM d JOIN st USING (user_id)),
  c2 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY i0) AS cid FROM b2),
  m2 AS (SELECT user_id, min(i0) AS i0, max(i1) AS i1 FROM c2 GROUP BY user_id, cid),
  bouts AS (SELECT m2.user_id, i0, i1, max(t) - min(t) AS duration, max(x) AS value FROM m2 JOIN sig_ev s ON s.user_id = m2.user_id AND i BETWEEN i0 AND i1 GROUP BY ALL HAVING max(t) - min(t) >= 1000)"""


def _bouts(spark, sf_dir):
    return detect.bouts(views.sig_ev(spark, sf_dir), K, 12, 25, 1000.0, 200000.0)


@query(f"{BOUTS} SELECT user_id, i0, i1, round(duration, 3) AS duration, round(value, 6) AS value FROM bouts")
def score_to_bouts(spark, sf_dir):
    return _bouts(spark, sf_dir).select("user_id", "i0", "i1", F.round("duration", 3).alias("duration"), F.round("value", 6).alias("value"))


@query(f"{BOUTS} SELECT user_id, round(least(sum(duration) / 2000000.0, 1), 9) AS occupancy FROM bouts GROUP BY user_id")
def bout_occupancy(spark, sf_dir):
    return detect.occupancy(_bouts(spark, sf_dir), K, 2000000.0).select("user_id", F.round("occupancy", 9).alias("occupancy"))


SUMMARY = """count(*) AS n, round(avg(duration), 3) AS mean, round(median(duration), 3) AS median, round(coalesce(stddev_samp(duration), 0), 3) AS std, round(quantile_cont(duration, 0.05), 3) AS p5, round(quantile_cont(duration, 0.95), 3) AS p95"""


@query(f"{BOUTS} SELECT user_id, {SUMMARY} FROM bouts GROUP BY user_id")
def bout_duration_summary(spark, sf_dir):
    got = detect.duration_summary(_bouts(spark, sf_dir), K)
    return got.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("mean", "median", "std", "p5", "p95")])


FLAGSHIP = f"""z AS (SELECT user_id, i, t, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS x FROM sig_ev WINDOW w AS (PARTITION BY user_id)), {runs_sql("x >= 0.5", 2, "z")},
  e AS (SELECT m.user_id, i0, i1, max(t) - min(t) AS duration FROM m JOIN z ON z.user_id = m.user_id AND i BETWEEN i0 AND i1 WHERE i1 > i0 GROUP BY ALL)
  SELECT user_id, {SUMMARY} FROM e GROUP BY user_id"""


@query(FLAGSHIP)
def detection_flagship(spark, sf_dir):
    """Standard score, threshold runs, merged gaps, summary of durations."""
    z = series.zscored(views.sig_ev(spark, sf_dir), K, "x").select("user_id", "i", "t", F.col("z").alias("x"))
    got = detect.duration_summary(detect.threshold_events(z, K, 0.5, merge_gap=2), K)
    return got.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("mean", "median", "std", "p5", "p95")])


CROSS = """z AS (SELECT vec_id, i, i * 0.5::DOUBLE AS t, x, x >= 0 AS pos FROM sig_64), n AS (SELECT *, lead(pos) OVER (PARTITION BY vec_id ORDER BY i) AS nxt FROM z),
  cr AS (SELECT vec_id, i, pos AS falling FROM n WHERE nxt <> pos)"""


def _waves(spark, sf_dir):
    return views.sig_64(spark, sf_dir).withColumn("t", F.col("i") * 0.5)


@query(f"{CROSS} SELECT vec_id, i, falling FROM cr")
def find_zero_crossings(spark, sf_dir):
    return detect.zero_crossings(_waves(spark, sf_dir), ["vec_id"])


@query(
    f"""{CROSS}, w AS (SELECT vec_id, i AS i0, (SELECT min(i) FROM cr b WHERE b.vec_id = a.vec_id AND b.i > a.i AND NOT b.falling) AS up, coalesce((SELECT min(i) FROM cr b WHERE b.vec_id = a.vec_id AND b.i > a.i AND b.falling), 63) AS e FROM cr a WHERE falling),
  q AS (SELECT w.vec_id, i0, up, e, arg_min(t, (x, i)) AS t, min(x) AS trough, max(x) FILTER (i >= up) AS peak FROM w JOIN z ON z.vec_id = w.vec_id AND i >= i0 AND i < e WHERE up IS NOT NULL GROUP BY ALL),
  g AS (SELECT *, peak - trough AS ptp FROM q WHERE (up - i0) * 0.5 BETWEEN 0.5 AND 2 AND (e - i0) * 0.5 BETWEEN 1 AND 6)
  SELECT vec_id, i0, t, round(trough, 6) AS trough, round(peak, 6) AS peak FROM (SELECT *, quantile_cont(ptp, 0.5) OVER (PARTITION BY vec_id) AS p FROM g) WHERE ptp >= p"""
)
def detect_slow_waves(spark, sf_dir):
    got = detect.slow_waves(_waves(spark, sf_dir), ["vec_id"], (0.5, 2.0), (1.0, 6.0), 50.0)
    return got.select("vec_id", "i0", "t", F.round("trough", 6).alias("trough"), F.round("peak", 6).alias("peak"))


@query(
    f"""z AS (SELECT user_id, i, t, x - 10 AS x FROM sig_ev), {runs_sql("x >= 4", 1, "z")},
  e AS (SELECT m.user_id, i0, i1, x, t, i, sign(x) <> lag(sign(x)) OVER (PARTITION BY m.user_id, i0 ORDER BY i) AS s FROM m JOIN z ON z.user_id = m.user_id AND i BETWEEN i0 AND i1 WHERE i1 > i0),
  a AS (SELECT user_id, avg(x * x) AS p FROM z GROUP BY user_id)
  SELECT e.user_id, i0, round(sum(s::INT) / (2 * (max(t) - min(t))), 9) AS frequency, round(avg(x * x) / any_value(p), 6) AS rel_power, round((arg_max(i, (x, -i)) - i0) / (count(*) - 1), 6) AS symmetry FROM e JOIN a USING (user_id) GROUP BY e.user_id, i0"""
)
def spindle_enrichment(spark, sf_dir):
    z = views.sig_ev(spark, sf_dir).withColumn("x", F.col("x") - 10)
    found = detect.threshold_events(z, K, 4, merge_gap=1).select("user_id", "i0", "i1")
    got = detect.enriched(z, found, K)
    return got.select("user_id", "i0", F.round("frequency", 9).alias("frequency"), F.round("rel_power", 6).alias("rel_power"), F.round("symmetry", 6).alias("symmetry"))


@query(
    """o AS (SELECT user_id, t, x AS value, row_number() OVER (PARTITION BY user_id ORDER BY t, x) AS k FROM sig_ev WHERE x > 20),
  f AS (WITH RECURSIVE w(user_id, k, lt, lv, n) AS (
      SELECT user_id, k, t, value, 1 FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, CASE WHEN o.t - w.lt >= 50000 OR o.value > w.lv THEN o.t ELSE w.lt END, CASE WHEN o.t - w.lt >= 50000 OR o.value > w.lv THEN o.value ELSE w.lv END, CASE WHEN o.t - w.lt >= 50000 THEN w.n + 1 ELSE w.n END
      FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1) SELECT user_id, n, arg_max(lt, k) AS t, arg_max(lv, k) AS value FROM w GROUP BY user_id, n)
  SELECT user_id, round(t, 3) AS t, round(value, 6) AS value FROM f"""
)
def spindle_isolation(spark, sf_dir):
    own = views.sig_ev(spark, sf_dir).where("x > 20").select("user_id", "t", F.col("x").alias("value"))
    return detect.isolated(own, K, 50000.0).select("user_id", F.round("t", 3).alias("t"), F.round("value", 6).alias("value"))
