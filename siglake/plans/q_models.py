"""Generator, beamforming, statistics and reshaping queries."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import generators as gen
from siglake.operators.series import over
from siglake.plans import sqltext as st
from siglake.plans.registry import query
from siglake.sources import views


def _time(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") / 500 - 0.5).alias("t"))


T = "tt AS (SELECT i, i / 500.0::DOUBLE - 0.5::DOUBLE AS t FROM range(2000) r(i))"


def _column(name: str, column, sql: str, digits: int = 7) -> None:
    def run(spark, sf_dir):
        return _time(spark).select("i", F.round(column(F.col("t")), digits).alias("y"))

    query(f"{T} SELECT i, round({sql}, {digits}) AS y FROM tt", name)(run)


BI = "CASE WHEN t >= 0.1::DOUBLE THEN 2 * (exp(-3 * (t - 0.1::DOUBLE)) - exp(-8 * (t - 0.1::DOUBLE))) ELSE 0 END"
SMOOTH = "CASE WHEN t < 0.1::DOUBLE THEN 1 WHEN (t - 0.1::DOUBLE) / 2 < 1 THEN 1 - 3 * power((t - 0.1::DOUBLE) / 2, 2) + 2 * power((t - 0.1::DOUBLE) / 2, 3) ELSE 0 END"
TUKEY = "CASE WHEN (t - 0.1::DOUBLE) / 2 < 0 OR (t - 0.1::DOUBLE) / 2 > 1 THEN 0 WHEN (t - 0.1::DOUBLE) / 2 <= 0.25 THEN 1 ELSE 0.5 * (1 + cos(pi() * ((t - 0.1::DOUBLE) / 2 - 0.25) / 0.75)) END"
_column("biexp", lambda t: gen.biexp(t, 2.0, 3.0, 8.0, 0.1), BI)
_column("smoothstep_cutoff", lambda t: gen.smoothstep_cutoff(t, 0.1, 2.0), SMOOTH, 11)
_column("tukey_cutoff", lambda t: gen.tukey_cutoff(t, 0.1, 2.0), TUKEY)
_column("finite_duration_biexp", lambda t: gen.finite_biexp(t, 2.0, 3.0, 8.0, 0.1, 2.0), f"({BI}) * ({SMOOTH})")

G = "gd AS (SELECT id // 64 AS i, (id // 64) / 100.0::DOUBLE AS t, ((id // 8) % 8)::INT AS ap, (id % 8)::INT AS ml FROM range(3200) r(id))"


def _wave(name: str, column, sql: str) -> None:
    def run(spark, sf_dir):
        g = gen.grid(spark, 50, 8, 8, 100.0)
        return g.select("i", "ap", "ml", F.round(column(F.col("t"), F.col("ml"), F.col("ap")), 7).alias("x"))

    query(f"{G} SELECT i, ap, ml, round({sql}, 7) AS x FROM gd", name)(run)


PLANE = "cos(2 * pi() * 5 * (t - (cos(0.7::DOUBLE) * ml + sin(0.7::DOUBLE) * ap) / 80))"
_wave("plane_wave", lambda t, x, y: gen.plane_wave(t, x, y, 0.7, 80.0, 5.0), PLANE)
_wave("spiral_wave", lambda t, x, y: gen.spiral_wave(t, x, y, 3.5, 3.5, 12.0), "cos(12 * t + atan2(ap - 3.5, ml - 3.5))")
_wave("wave_packet", lambda t, x, y: gen.wave_packet(t, x, y, 0.7, 80.0, 5.0, 0.25, 0.1, 3.5, 3.5, 2.0), f"{PLANE} * exp(-power(t - 0.25, 2) / 0.02::DOUBLE - (power(ml - 3.5, 2) + power(ap - 3.5, 2)) / 8)")
_wave("gaussian_mode", lambda t, x, y: gen.gaussian_mode(x, y, 6.5, 1.0, 1.5, 8.0), "exp(-(power(least(abs(ml - 6.5), 8 - abs(ml - 6.5)), 2) + power(least(abs(ap - 1), 8 - abs(ap - 1)), 2)) / 4.5::DOUBLE)")
_wave("monopole", lambda t, x, y: gen.monopole(x, y, F.lit(2.0), 3.0), "3.0::DOUBLE / (ml * ml + ap * ap + 4)")
_wave("dipole", lambda t, x, y: gen.dipole(x, y, F.lit(2.0), 1.0, 3.0), "3.0::DOUBLE / (ml * ml + ap * ap + 2.25) - 3.0::DOUBLE / (ml * ml + ap * ap + 6.25)")


@query(f"{G} SELECT i, ap, ml, round({PLANE} + cos(12 * t + atan2(ap - 3.5, ml - 3.5)), 7) AS x FROM gd")
def multi_wave(spark, sf_dir):
    g = gen.grid(spark, 50, 8, 8, 100.0)
    t, x, y = F.col("t"), F.col("ml"), F.col("ap")
    parts = [g.select("i", "ap", "ml", c.alias("x")) for c in (gen.plane_wave(t, x, y, 0.7, 80.0, 5.0), gen.spiral_wave(t, x, y, 3.5, 3.5, 12.0))]
    return gen.mixed(parts, ["i", "ap", "ml"]).withColumn("x", F.round("x", 7))


def _train(channels: int, rate: float, duration: float, seed: int) -> str:
    """Event times (ch, k, t); more gaps than a channel needs are drawn."""
    most = int(rate * duration + 10 * math.sqrt(rate * duration) + 20)
    return f"""gp AS (SELECT ch, k, -ln(1 - {st.uniform(seed, 'ch', 'k')}) / {rate}::DOUBLE AS gap FROM range({channels}) a(ch), range({most}) b(k)),
  tr AS (SELECT * FROM (SELECT ch, k, sum(gap) OVER (PARTITION BY ch ORDER BY k) AS t FROM gp) WHERE t < {duration})"""


@query(f"{_train(4, 20.0, 30.0, 7)} SELECT ch, k, round(t, 6) AS t FROM tr")
def poisson_process(spark, sf_dir):
    return gen.poisson_process(spark, 4, 20.0, 30.0, 7).withColumn("t", F.round("t", 6))


@query(
    f"""RECURSIVE {_train(4, 5.0, 30.0, 7)}, kp AS (SELECT ch, k, t, TRUE AS own FROM tr WHERE k = 0 UNION ALL SELECT kp.ch, tr.k, CASE WHEN tr.t >= kp.t + 0.2::DOUBLE + 0.1::DOUBLE THEN tr.t ELSE kp.t END, tr.t >= kp.t + 0.2::DOUBLE + 0.1::DOUBLE FROM kp JOIN tr ON tr.ch = kp.ch AND tr.k = kp.k + 1)
  SELECT ch, round(t, 6) AS t0, round(t + 0.2::DOUBLE, 6) AS t1 FROM kp WHERE own"""
)
def poisson_bursts(spark, sf_dir):
    return gen.poisson_bursts(spark, 4, 5.0, 30.0, 0.2, 0.1, 7).withColumn("t0", F.round("t0", 6)).withColumn("t1", F.round("t1", 6))


@query(
    f"""gs AS (SELECT i, ap::INT AS ap, ml::INT AS ml, {st.normal(3, 'i', 'ap', 'ml')} AS x FROM range(20) a(i), range(8) b(ap), range(8) c(ml)), {st.gaussian("g", 1.0)},
  u AS (SELECT a.i, a.ap, a.ml, sum(w * b.x) AS x FROM gs a, g JOIN gs b ON b.i = a.i AND b.ap = a.ap AND b.ml = {st.reflected("a.ml + j", 8)} GROUP BY ALL)
  SELECT a.i, a.ap, a.ml, round(sum(w * b.x), 6) AS y FROM u a, g JOIN u b ON b.i = a.i AND b.ml = a.ml AND b.ap = {st.reflected("a.ap + j", 8)} GROUP BY ALL"""
)
def example_grid_signal(spark, sf_dir):
    """Seeded noise on a grid, smoothed over space."""
    from siglake.operators import spatial

    g = gen.grid(spark, 20, 8, 8, 100.0).withColumn("x", gen.normal(3, "i", "ap", "ml"))
    return spatial.gaussian(g, ["i"], 1.0, 8, 8).withColumn("y", F.round("y", 6))


@query(
    """im AS (SELECT user_id, i, x AS a FROM sig_ev WHERE x > 45), kn AS (SELECT k, exp(-k / 2.0::DOUBLE) AS v FROM range(5) r(k))
  SELECT user_id, i + k AS i, round(sum(a * v), 5) AS x FROM im, kn GROUP BY ALL"""
)
def convolve_impulses(spark, sf_dir):
    im = views.sig_ev(spark, sf_dir).where("x > 45").select("user_id", "i", F.col("x").alias("a"))
    kernel = spark.range(5).select(F.col("id").alias("k"), F.exp(-F.col("id") / 2.0).alias("v"))
    return gen.convolved(im, kernel, ["user_id"]).withColumn("x", F.round("x", 5))


SLOW = """sl AS (SELECT sx / 10.0::DOUBLE AS sx, sy / 10.0::DOUBLE AS sy FROM range(-3, 4) a(sx), range(-3, 4) b(sy)),
  bf AS (SELECT vec_id, sx, sy, power(sum(x * cos(2 * pi() * 4 * (sx * ml + sy * ap) / 8)), 2) + power(sum(x * sin(2 * pi() * 4 * (sx * ml + sy * ap) / 8)), 2) AS p FROM sig_grid, sl GROUP BY ALL)"""


@query(f"{SLOW} SELECT vec_id, sx, sy, round(p / 4096, 8) AS p FROM bf")
def fk_spectrum(spark, sf_dir):
    """Beam power over a slowness grid."""
    axis = F.array(*[F.lit(k / 10.0) for k in range(-3, 4)])
    g = views.sig_grid(spark, sf_dir).withColumn("sx", F.explode(axis)).withColumn("sy", F.explode(axis))
    phase = 2 * math.pi * 4 * (F.col("sx") * F.col("ml") + F.col("sy") * F.col("ap")) / 8
    c, s = F.sum(F.col("x") * F.cos(phase)), F.sum(F.col("x") * F.sin(phase))
    return g.groupBy("vec_id", "sx", "sy").agg(F.round((c * c + s * s) / 4096, 8).alias("p"))


@query(f"{SLOW}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, sx, sy) AS k, sum(p) OVER (PARTITION BY vec_id) AS tot FROM bf WHERE sx <> 0 OR sy <> 0) SELECT vec_id, sx, sy, round(p / tot, 7) AS confidence FROM r WHERE k <= 2")
def kw_peaks(spark, sf_dir):
    """The two strongest bins but the one at 0, with their share of the rest."""
    axis = F.array(*[F.lit(k / 10.0) for k in range(-3, 4)])
    g = views.sig_grid(spark, sf_dir).withColumn("sx", F.explode(axis)).withColumn("sy", F.explode(axis))
    phase = 2 * math.pi * 4 * (F.col("sx") * F.col("ml") + F.col("sy") * F.col("ap")) / 8
    c, s = F.sum(F.col("x") * F.cos(phase)), F.sum(F.col("x") * F.sin(phase))
    p = g.groupBy("vec_id", "sx", "sy").agg((c * c + s * s).alias("p")).where("sx <> 0 or sy <> 0")
    ranked = p.withColumn("k", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("p"), "sx", "sy"))).withColumn("tot", F.sum("p").over(W.partitionBy("vec_id")))
    return ranked.where("k <= 2").select("vec_id", "sx", "sy", F.round(F.col("p") / F.col("tot"), 7).alias("confidence"))


CSD1 = "c AS (SELECT vec_id, ap AS ch, ml AS i, lead(x) OVER w - 2 * x + lag(x) OVER w AS csd FROM sig_grid WINDOW w AS (PARTITION BY vec_id, ml ORDER BY ap))"


@query(f"{CSD1} SELECT vec_id, ch, i, round(csd, 6) AS csd FROM c WHERE csd IS NOT NULL")
def compute_csd(spark, sf_dir):
    """Second differences along channels, rows of the grid."""
    return _csd(spark, sf_dir).withColumn("csd", F.round("csd", 6))


def _csd(spark, sf_dir):
    w = over(["vec_id", "ml"], "ap")
    g = views.sig_grid(spark, sf_dir).withColumn("csd", F.lead("x").over(w) - 2 * F.col("x") + F.lag("x").over(w))
    return g.where("csd is not null").select("vec_id", F.col("ap").alias("ch"), F.col("ml").alias("i"), "csd")


@query(f"{CSD1}, m AS (SELECT *, avg(csd) OVER (PARTITION BY vec_id) + 1.5 * stddev_pop(csd) OVER (PARTITION BY vec_id) AS thr FROM c WHERE csd IS NOT NULL) SELECT vec_id, ch, i, CASE WHEN csd > thr THEN 'sink' ELSE 'source' END AS kind FROM m WHERE csd > thr OR csd < -thr")
def identify_active_regions(spark, sf_dir):
    w = W.partitionBy("vec_id")
    m = _csd(spark, sf_dir).withColumn("thr", F.avg("csd").over(w) + 1.5 * F.stddev_pop("csd").over(w))
    return m.where("csd > thr or csd < -thr").select("vec_id", "ch", "i", F.when(F.col("csd") > F.col("thr"), "sink").otherwise("source").alias("kind"))


@query(
    """r AS (SELECT vec_id, i, x > 0 AS pos, i - row_number() OVER (PARTITION BY vec_id, x > 0 ORDER BY i) AS g, x FROM sig_64)
  SELECT vec_id, min(i) AS on, max(i) + 1 AS off, count(*) AS duration, round(max(x), 6) AS peak, count(*) FILTER (x > m / 2) AS half FROM (SELECT *, max(x) OVER (PARTITION BY vec_id, g) AS m FROM r WHERE pos) GROUP BY vec_id, g""".replace("AS on,", "AS i_on,").replace("AS off,", "AS i_off,")
)
def positive_waves(spark, sf_dir):
    """Runs of positive samples, with those above half their peak."""
    s = views.sig_64(spark, sf_dir).where("x > 0").withColumn("g", F.col("i") - F.row_number().over(over(["vec_id"], "i")))
    m = s.withColumn("m", F.max("x").over(W.partitionBy("vec_id", "g")))
    return m.groupBy("vec_id", "g").agg(F.min("i").alias("i_on"), (F.max("i") + 1).alias("i_off"), F.count("*").alias("duration"), F.round(F.max("x"), 6).alias("peak"), F.count_if(F.col("x") > F.col("m") / 2).alias("half")).drop("g")


CONFUSION = "p AS (SELECT quality = 1 AS truth, toxic = 0 AS said, doc_id FROM labels)"


@query(f"{CONFUSION} SELECT truth, said, count(*) AS n FROM p GROUP BY ALL")
def hit_miss_table(spark, sf_dir):
    p = views.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("said"))
    return p.groupBy("truth", "said").agg(F.count("*").alias("n"))


@query(
    f"""{CONFUSION}, n AS (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (NOT truth AND NOT said) AS tn, count(*) FILTER (truth AND NOT said) AS fn FROM p)
  SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp / (tp + fn) + tn / nullif(tn + fp, 0)) / 2, 9) AS auc FROM n"""
)
def summarize_performance(spark, sf_dir):
    """Of two boolean columns; the area under the curve of a hard decision is the mean of both rates."""
    p = views.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("said"))
    n = p.agg(*[F.count_if(c).alias(k) for k, c in (("tp", F.expr("truth and said")), ("fp", F.expr("not truth and said")), ("tn", F.expr("not truth and not said")), ("fn", F.expr("truth and not said")))])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = F.try_divide
    return n.select("tp", "fp", "tn", "fn", F.round(d(tp + tn, tp + fp + tn + fn), 9).alias("accuracy"), F.round(d(tp, tp + fp), 9).alias("precision"), F.round(d(tp, tp + fn), 9).alias("recall"), F.round(d(2 * tp, 2 * tp + fp + fn), 9).alias("f1"), F.round((d(tp, tp + fn) + d(tn, tn + fp)) / 2, 9).alias("auc"))


@query("SELECT user_id, round(var_pop(x), 6) AS v FROM sig_ev GROUP BY user_id ORDER BY var_pop(x) DESC, user_id LIMIT 12")
def top_n_variance(spark, sf_dir):
    return views.sig_ev(spark, sf_dir).groupBy("user_id").agg(F.var_pop("x").alias("v")).orderBy(F.desc("v"), "user_id").limit(12).withColumn("v", F.round("v", 6))


@query("c AS (SELECT b.vec_id, corr(a.x, b.x) AS r FROM sig_64 a JOIN sig_64 b ON a.vec_id = 5 AND a.i = b.i GROUP BY b.vec_id) SELECT vec_id, round(r, 6) AS r FROM c ORDER BY c.r DESC, vec_id LIMIT 10")
def top_n_correlation(spark, sf_dir):
    """Most correlated with a seed, itself included; the seed's 64 samples are broadcast."""
    s = views.sig_64(spark, sf_dir)
    seed = s.where("vec_id = 5").select("i", F.col("x").alias("y"))
    got = s.join(F.broadcast(seed), "i").groupBy("vec_id").agg(F.corr("x", "y").alias("r"))
    return got.orderBy(F.desc("r"), "vec_id").limit(10).withColumn("r", F.round("r", 6))


@query(
    """c AS (SELECT vec_id AS ch, vec_id // 64 AS probe, vec_id % 7 * 150.0::DOUBLE AS ap, vec_id % 5 * 170.0::DOUBLE AS ml, vec_id % 3 * 90.0::DOUBLE AS dv FROM embeddings)
  SELECT a.ch AS ch_i, b.ch AS ch_j, round(sqrt(power(a.ap - b.ap, 2) + power(a.ml - b.ml, 2) + power(a.dv - b.dv, 2)), 4) AS dist FROM c a JOIN c b ON a.probe = b.probe AND a.ch < b.ch WHERE sqrt(power(a.ap - b.ap, 2) + power(a.ml - b.ml, 2) + power(a.dv - b.dv, 2)) >= 400"""
)
def select_distant_channel_pairs(spark, sf_dir):
    """Pairs of channels at least 400 um apart, of probes of 64 channels each."""
    c = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ch"), F.floor(F.col("vec_id") / 64).alias("probe"), (F.col("vec_id") % 7 * 150.0).alias("ap"), (F.col("vec_id") % 5 * 170.0).alias("ml"), (F.col("vec_id") % 3 * 90.0).alias("dv"))
    b = c.select("probe", F.col("ch").alias("ch_j"), F.col("ap").alias("ap2"), F.col("ml").alias("ml2"), F.col("dv").alias("dv2"))
    d = F.sqrt(F.pow(F.col("ap") - F.col("ap2"), 2) + F.pow(F.col("ml") - F.col("ml2"), 2) + F.pow(F.col("dv") - F.col("dv2"), 2))
    return c.join(b, "probe").where(F.col("ch") < F.col("ch_j")).withColumn("d", d).where("d >= 400").select(F.col("ch").alias("ch_i"), "ch_j", F.round("d", 4).alias("dist"))


@query(
    """w AS (SELECT vec_id % 6 AS ch, vec_id // 6 AS seg, i, x FROM sig_64), p AS (SELECT a.seg, a.ch AS c1, b.ch AS c2, corr(a.x, b.x) AS r FROM w a JOIN w b ON a.seg = b.seg AND a.i = b.i AND b.ch >= a.ch + 3 GROUP BY ALL)
  SELECT seg, round(avg(r), 7) AS emg, round(stddev_pop(r), 7) AS sd FROM p GROUP BY seg"""
)
def compute_emg_proxy(spark, sf_dir):
    """Mean and deviation of distant channels' correlations in each window."""
    w = views.sig_64(spark, sf_dir).select((F.col("vec_id") % 6).alias("ch"), F.floor(F.col("vec_id") / 6).alias("seg"), "i", "x")
    b = w.select(F.col("ch").alias("c2"), "seg", "i", F.col("x").alias("y"))
    p = w.join(b, ["seg", "i"]).where("c2 >= ch + 3").groupBy("seg", "ch", "c2").agg(F.corr("x", "y").alias("r"))
    return p.groupBy("seg").agg(F.round(F.avg("r"), 7).alias("emg"), F.round(F.stddev_pop("r"), 7).alias("sd"))


@query("SELECT user_id, round(1 / median(d), 9) AS fs, round(1 / min(d) FILTER (d > 0), 6) AS most FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS d FROM sig_ev) WHERE d > 0 GROUP BY user_id")
def sampling_frequency(spark, sf_dir):
    """One over the median positive step, and over the least one."""
    d = views.sig_ev(spark, sf_dir).withColumn("d", F.col("t") - F.lag("t").over(over(["user_id"], "i"))).where("d > 0")
    return d.groupBy("user_id").agg(F.round(1 / F.median("d"), 9).alias("fs"), F.round(1 / F.min("d"), 6).alias("most"))


@query("SELECT vec_id, (i // 16)::INT AS a, (i // 4 % 4)::INT AS b, (i % 4)::INT AS c, round(x, 6) AS x FROM sig_64")
def reshape_dimension(spark, sf_dir):
    """One axis of 64 as 4 x 4 x 4, row by row."""
    s = views.sig_64(spark, sf_dir)
    return s.select("vec_id", F.floor(F.col("i") / 16).cast("int").alias("a"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("b"), (F.col("i") % 4).cast("int").alias("c"), F.round("x", 6).alias("x"))


@query('SELECT vec_id, ap, ' + ', '.join(f'round(max(x) FILTER (ml = {k}), 6) AS m{k}' for k in range(8)) + ' FROM sig_grid GROUP BY vec_id, ap')
def unstack(spark, sf_dir):
    got = views.sig_grid(spark, sf_dir).groupBy("vec_id", "ap").pivot("ml", list(range(8))).agg(F.round(F.max("x"), 6))
    return got.toDF("vec_id", "ap", *[f"m{k}" for k in range(8)])


@query("SELECT vec_id, ap * 8 + ml AS row_major, ml * 8 + ap AS column_major, round(x, 6) AS x FROM sig_grid")
def stack_spatial_dims(spark, sf_dir):
    g = views.sig_grid(spark, sf_dir)
    return g.select("vec_id", (F.col("ap") * 8 + F.col("ml")).alias("row_major"), (F.col("ml") * 8 + F.col("ap")).alias("column_major"), F.round("x", 6).alias("x"))


@query("c AS (SELECT vec_id, count(*) * 0.4 AS mid FROM sig_64 GROUP BY vec_id) SELECT vec_id, i, round(x, 6) AS x FROM sig_64 JOIN c USING (vec_id) WHERE i BETWEEN mid - 10 AND mid + 10")
def dur_slice(spark, sf_dir):
    """Samples within 10 of two fifths of the series."""
    mid = F.count("*").over(W.partitionBy("vec_id")) * 0.4
    s = views.sig_64(spark, sf_dir).withColumn("mid", mid)
    return s.where(F.col("i").between(F.col("mid") - 10, F.col("mid") + 10)).select("vec_id", "i", F.round("x", 6).alias("x"))


@query("SELECT round(avg(ap), 6)::DOUBLE AS ap, round(avg(ml), 6)::DOUBLE AS ml, ap // 4 AS a, ml // 4 AS m FROM (SELECT DISTINCT ap, ml FROM sig_grid) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY ap // 4, ml // 4"))
def subgrid_representatives(spark, sf_dir):
    """Mean index of each 4 x 4 block."""
    g = views.sig_grid(spark, sf_dir).select("ap", "ml").distinct()
    return g.groupBy(F.floor(F.col("ap") / 4).alias("a"), F.floor(F.col("ml") / 4).alias("m")).agg(F.round(F.avg("ap"), 6).alias("ap"), F.round(F.avg("ml"), 6).alias("ml")).select("ap", "ml", F.col("a").cast("int").alias("a"), F.col("m").cast("int").alias("m"))


@query("k AS (SELECT a.vec_id, a.ap, a.ml, b.ap - a.ap AS da, b.ml - a.ml AS dm, b.x FROM sig_grid a JOIN sig_grid b ON a.vec_id = b.vec_id AND b.ap - a.ap BETWEEN 0 AND 1 AND b.ml - a.ml BETWEEN 0 AND 2 WHERE a.ap < 7 AND a.ml < 6) SELECT vec_id, ap, ml, da, dm, round(x, 6) AS x FROM k WHERE (ap, ml) NOT IN (SELECT (ap, ml) FROM (VALUES (2, 3), (3, 3)) v(ap, ml))")
def sliding_kernel_windows(spark, sf_dir):
    """2 x 3 windows of each grid but those that begin at bad electrodes."""
    g = views.sig_grid(spark, sf_dir)
    anchors = g.where("ap < 7 and ml < 6").select("vec_id", "ap", "ml").where("not (ml = 3 and ap in (2, 3))")
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("da"), F.lit(m).alias("dm")) for a in range(2) for m in range(3)]))
    sent = anchors.withColumn("o", offsets).select("vec_id", "ap", "ml", "o.da", "o.dm", (F.col("ap") + F.col("o.da")).alias("a2"), (F.col("ml") + F.col("o.dm")).alias("m2"))
    return sent.join(g.select("vec_id", F.col("ap").alias("a2"), F.col("ml").alias("m2"), "x"), ["vec_id", "a2", "m2"]).select("vec_id", "ap", "ml", "da", "dm", F.round("x", 6).alias("x"))
