"""Window queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators import windows
from siglake.plans.registry import query
from siglake.sources import views

K = ["user_id"]
LENGTHS = "n AS (SELECT user_id, count(*) AS n FROM sig_ev GROUP BY user_id), w AS (SELECT user_id, unnest(range(0, (n - 15) // 5 + 1)) AS win FROM n WHERE n >= 15)"


@query(f"{LENGTHS} SELECT user_id, win, win * 5 AS onset, win * 5 + 14 AS last, win * 5 + 7.0::DOUBLE AS midpoint, win * 5 + 7 AS lower, win * 5 + 7 AS upper FROM w")
def window_bounds(spark, sf_dir):
    n = views.sig_ev(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return windows.onsets(n, K, "n", 15, 5)


@query(f"{LENGTHS} SELECT w.user_id, win, round((a.t + b.t) / 2, 3) AS t FROM w JOIN sig_ev a ON a.user_id = w.user_id AND a.i = win * 5 JOIN sig_ev b ON b.user_id = w.user_id AND b.i = win * 5 + 14")
def window_centers_time(spark, sf_dir):
    """Mean of the times of a window's first and last sample."""
    got = windows.running_reduce(views.sig_ev(spark, sf_dir), K, 15, 5, t=(F.min_by("t", "i") + F.max_by("t", "i")) / 2)
    return got.select("user_id", "win", F.round("t", 3).alias("t"))


REDUCED = f"{LENGTHS}, s AS (SELECT w.user_id, win, x, i FROM w JOIN sig_ev s ON s.user_id = w.user_id AND i BETWEEN win * 5 AND win * 5 + 14)"


@query(f"{REDUCED} SELECT user_id, win, i - win * 5 AS k, round(x, 6) AS x FROM s")
def sliding_window(spark, sf_dir):
    got = windows.windowed(views.sig_ev(spark, sf_dir), K, 15, 5)
    return got.select("user_id", "win", (F.col("i") - F.col("win") * 5).alias("k"), F.round("x", 6).alias("x"))


@query(f"{REDUCED} SELECT user_id, win, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(max(x) - min(x), 6) AS amplitude, round(median(x), 6) AS median FROM s GROUP BY ALL")
def running_reduce(spark, sf_dir):
    got = windows.running_reduce(views.sig_ev(spark, sf_dir), K, 15, 5, mean=F.avg("x"), variance=F.var_pop("x"), amplitude=F.max("x") - F.min("x"), median=F.median("x"))
    return got.select("user_id", "win", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "amplitude", "median")])


@query(
    """n AS (SELECT *, max(i) OVER (PARTITION BY user_id) AS n FROM sig_ev),
  m AS (SELECT user_id, i, x, n FROM n UNION ALL SELECT user_id, -i, x, n FROM n WHERE i BETWEEN 1 AND 6 UNION ALL SELECT user_id, 2 * n - i, x, n FROM n WHERE i < n AND i >= n - 6),
  z AS (SELECT user_id, i, n, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING))
  SELECT user_id, i, round(z, 5) AS z FROM z WHERE i BETWEEN 0 AND n"""
)
def rolling_zscore(spark, sf_dir):
    return windows.rolling_zscore(views.sig_ev(spark, sf_dir), K, 6).select("user_id", "i", F.round("z", 5).alias("z"))


@query("SELECT user_id, i, round(quantile_cont(x, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS y FROM sig_ev")
def smooth_median(spark, sf_dir):
    return windows.rolling(views.sig_ev(spark, sf_dir), K, 5).select("user_id", "i", F.round("y", 6).alias("y"))


@query(
    """SELECT user_id, i, CASE WHEN count(x) OVER w >= 4 THEN round(avg(x) OVER w, 6) END AS y FROM sig_ev WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""
)
def smooth_mean_even(spark, sf_dir):
    return windows.rolling(views.sig_ev(spark, sf_dir), K, 4, "mean", 4).select("user_id", "i", F.round("y", 6).alias("y"))


FEATURES = f"{REDUCED}, f AS (SELECT user_id, win, avg(x) AS mean, var_pop(x) AS variance FROM s GROUP BY ALL)"


def _features(spark, sf_dir):
    return windows.running_reduce(views.sig_ev(spark, sf_dir), K, 15, 5, mean=F.avg("x"), variance=F.var_pop("x"))


@query(
    f"""{FEATURES}, m AS (SELECT *, abs(mean - median(mean) OVER (PARTITION BY user_id)) AS d1, abs(variance - median(variance) OVER (PARTITION BY user_id)) AS d2 FROM f)
  SELECT user_id, round(median(mean), 6) AS mean_median, round(median(d1), 6) AS mean_mad, round(max(mean), 6) AS mean_max, round(quantile_cont(mean, 0.95), 6) AS mean_p95,
    round(median(variance), 6) AS variance_median, round(median(d2), 6) AS variance_mad, round(max(variance), 6) AS variance_max, round(quantile_cont(variance, 0.95), 6) AS variance_p95 FROM m GROUP BY user_id"""
)
def summarize_windowed_features(spark, sf_dir):
    got = windows.summarised(_features(spark, sf_dir), K, ["mean", "variance"], ("median", "mad", "max", "p95"))
    return got.select("user_id", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query(
    f"""{FEATURES}, m AS (SELECT *, median(mean) OVER (PARTITION BY user_id) AS med FROM f), d AS (SELECT *, median(abs(mean - med)) OVER (PARTITION BY user_id) AS mad FROM m)
  SELECT user_id, win, round((mean - med) / (1.4826 * mad + 1e-12), 5) AS z FROM d WHERE mad > 0"""
)
def normalize_windowed_features(spark, sf_dir):
    w = W.partitionBy("user_id")
    m = _features(spark, sf_dir).withColumn("med", F.median("mean").over(w)).withColumn("mad", F.median(F.abs(F.col("mean") - F.col("med"))).over(w))
    return m.where("mad > 0").select("user_id", "win", F.round((F.col("mean") - F.col("med")) / (1.4826 * F.col("mad") + 1e-12), 5).alias("z"))


@query("SELECT user_id, i // 7 AS bin, round(avg(i), 6) AS center, min(i) AS low, max(i) AS high, round(avg(x), 6) AS mean FROM sig_ev GROUP BY ALL")
def bin_data(spark, sf_dir):
    got = views.sig_ev(spark, sf_dir).groupBy("user_id", F.floor(F.col("i") / 7).alias("bin"))
    return got.agg(F.round(F.avg("i"), 6).alias("center"), F.min("i").alias("low"), F.max("i").alias("high"), F.round(F.avg("x"), 6).alias("mean"))


@query(
    """p AS (SELECT a.user_id, b.user_id AS other, a.i // 16 AS win, a.x AS x, b.x AS y FROM sig_ev a JOIN sig_ev b ON b.user_id > a.user_id AND b.i = a.i)
  SELECT user_id, other, win, round(corr(x, y), 6) AS r FROM p GROUP BY ALL HAVING count(*) = 16"""
)
def running_corrcoef(spark, sf_dir):
    """Correlation of each two users' series in each complete window of 16 samples; NaN, as in the SQL, if one of them is constant."""
    return windows.pair_correlations(views.sig_ev(spark, sf_dir), "user_id", 16, digits=6)


@query("SELECT DISTINCT window_start, event_type, n, s FROM (SELECT (floor(t / 3600) * 3600)::BIGINT AS window_start, event_type, count(*) AS n, round(sum(x), 4) AS s FROM ev GROUP BY ALL)")
def tumbling_windows(spark, sf_dir):
    from siglake.streaming.hopping import windowed_counts

    got = windowed_counts(views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "1 hour")
    return got.select(F.unix_seconds("start").alias("window_start"), "event_type", "n", F.round("s", 4).alias("s"))


@query(
    """s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800 THEN 0 ELSE 1 END AS brk FROM ev), g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s)
  SELECT user_id, round(min(t), 3) AS t0, round(max(t), 3) AS t1, count(*) AS n FROM g GROUP BY user_id, sid"""
)
def session_windows(spark, sf_dir):
    """Runs of events of a user no more than half an hour apart."""
    ev = views.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = ev.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return got.select("user_id", F.round(F.unix_micros("a") / 1e6, 3).alias("t0"), F.round(F.unix_micros("b") / 1e6, 3).alias("t1"), "n")
