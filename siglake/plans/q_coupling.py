"""Coupling queries: phase from an embedding's even samples, amplitude from its odd ones; hourly power of event types."""

from __future__ import annotations


from pyspark.sql import functions as F

from siglake.operators import coupling
from siglake.plans.registry import query
from siglake.sources import views

PAIR = "pa AS (SELECT a.vec_id % 20 AS g, a.vec_id, a.i, atan2(b.x, a.x) AS phase, sqrt(a.x * a.x + b.x * b.x) * (1 + abs(a.x)) AS amp FROM sig_64 a JOIN sig_64 b ON b.vec_id = a.vec_id AND b.i = a.i + 1 WHERE a.i < 62)"


def _pairs(spark, sf_dir):
    a = views.sig_64(spark, sf_dir)
    b = a.select("vec_id", (F.col("i") - 1).alias("i"), F.col("x").alias("y"))
    own = a.join(b, ["vec_id", "i"]).where("i < 62")
    return own.select((F.col("vec_id") % 20).alias("g"), "vec_id", "i", F.atan2("y", "x").alias("phase"), (F.hypot("x", "y") * (1 + F.abs("x"))).alias("amp"))


BINS = f"""{PAIR}, b AS (SELECT g, floor((phase + pi()) / (2 * pi() / 18))::INT AS k, avg(amp) AS a FROM pa WHERE phase >= -pi() AND phase < pi() GROUP BY ALL), p AS (SELECT g, a / sum(a) OVER (PARTITION BY g) AS p FROM b)"""


@query(f"{BINS} SELECT g, round(sum(CASE WHEN p > 0 THEN p * ln(p * 18) ELSE 0 END) / ln(18), 9) AS mi FROM p GROUP BY g")
def modulation_index_tort(spark, sf_dir):
    return coupling.tort(_pairs(spark, sf_dir), ["g"]).select("g", F.round("mi", 9).alias("mi"))


RESULTANT = "sqrt(power(avg(amp * cos(phase)), 2) + power(avg(amp * sin(phase)), 2))"


@query(f"{PAIR} SELECT g, round({RESULTANT}, 7) AS mi FROM pa GROUP BY g")
def modulation_index_canolty(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("g").agg(F.round(coupling.canolty(), 7).alias("mi"))


@query(f"{PAIR} SELECT g, round({RESULTANT} / sqrt(avg(amp * amp)), 7) AS mi FROM pa GROUP BY g")
def modulation_index_ozkurt(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("g").agg(F.round(coupling.ozkurt(), 7).alias("mi"))


@query(
    f"""{PAIR} SELECT g, round(atan2(sum(amp * sin(phase)), sum(amp * cos(phase))), 6) AS angle, round(sqrt(power(sum(amp * cos(phase)), 2) + power(sum(amp * sin(phase)), 2)) / sum(amp), 7) AS length,
  round(exp(-(power(sum(cos(phase)), 2) + power(sum(sin(phase)), 2)) / count(*)), 7) AS p FROM pa GROUP BY g"""
)
def preferred_phase(spark, sf_dir):
    got = coupling.preferred_phase(_pairs(spark, sf_dir), ["g"])
    return got.select("g", F.round("angle", 6).alias("angle"), F.round("length", 7).alias("length"), F.round("p", 7).alias("p"))


@query(
    f"""{PAIR}, s AS (SELECT a.vec_id, sh AS shift, a.phase, b.amp FROM pa a, (SELECT unnest([7, 19, 31]) AS sh) JOIN pa b ON b.vec_id = a.vec_id AND b.i = (a.i + sh) % 62)
  SELECT vec_id, shift, round({RESULTANT}, 7) AS mi FROM s GROUP BY ALL"""
)
def surrogate_pac(spark, sf_dir):
    """Indices of circularly shifted surrogates."""
    moved = coupling.circular_surrogates(_pairs(spark, sf_dir), ["vec_id"], [7, 19, 31])
    return moved.groupBy("vec_id", "shift").agg(F.round(coupling.canolty(), 7).alias("mi"))


def _hours(spark, sf_dir, kind):
    return views.sig_hr(spark, sf_dir).where(F.col("event_type") == kind).select("i", "x")


@query(
    """a AS (SELECT i, log10(greatest(x, 0) + 1) AS v FROM sig_hr WHERE event_type = 'click'), b AS (SELECT i, log10(greatest(x, 0) + 1) AS v FROM sig_hr WHERE event_type = 'view'),
  z AS (SELECT i, a.v - (SELECT avg(v) FROM a) AS va, b.v - (SELECT avg(v) FROM b) AS vb FROM a JOIN b USING (i)), l AS (SELECT unnest(range(-6, 7)) AS lag),
  n AS (SELECT sqrt(sum(va * va) * sum(vb * vb)) AS n FROM z)
  SELECT lag::INT AS lag, round(sum(z.va * y.vb) / any_value(n), 8) AS r FROM z, l, n JOIN z y ON y.i = z.i + lag GROUP BY lag"""
)
def spectral_power_xcorr(spark, sf_dir):
    got = coupling.power_xcorr(_hours(spark, sf_dir, "click"), _hours(spark, sf_dir, "view"), [], 6)
    return got.select("lag", F.round("r", 8).alias("r"))


XC = """a AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS va FROM sig_64), p AS (SELECT a.vec_id, a.i, a.va, b.va AS vb FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND b.i = a.i),
  l AS (SELECT unnest(range(-20, 21)) AS lag), c AS (SELECT p.vec_id, lag, sum(p.va * q.vb) AS s FROM p, l JOIN p q ON q.vec_id = p.vec_id AND q.i = p.i + lag GROUP BY ALL), n AS (SELECT vec_id, sqrt(var_pop(va) * var_pop(vb)) AS n FROM p GROUP BY vec_id)"""


def _xc(spark, sf_dir):
    s = views.sig_64(spark, sf_dir)
    return coupling.power_xcorr(s, s.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], 20, False, False), s


@query(f"{XC} SELECT vec_id, round(max(abs(s)) / any_value(n), 6) AS peak FROM c JOIN n USING (vec_id) GROUP BY vec_id")
def cross_corr_peak(spark, sf_dir):
    """Largest absolute cross-correlation, over the root of both variances."""
    c, a = _xc(spark, sf_dir)
    s = views.sig_64(spark, sf_dir).withColumn("vec_id", F.col("vec_id") - 1).groupBy("vec_id").agg(F.var_pop("x").alias("vb"))
    n = a.groupBy("vec_id").agg(F.var_pop("x").alias("va")).join(s, "vec_id")
    got = c.groupBy("vec_id").agg(F.max(F.abs("r")).alias("m")).join(n, "vec_id")
    return got.select("vec_id", F.round(F.col("m") / F.sqrt(F.col("va") * F.col("vb")), 6).alias("peak"))


@query(f"{XC} SELECT vec_id, round(arg_max(lag, (abs(s), -lag)) / 100, 3) AS lag FROM c GROUP BY vec_id")
def cross_corr_lag(spark, sf_dir):
    """Lag of that peak, in seconds at 100 samples a second."""
    c, _ = _xc(spark, sf_dir)
    return c.groupBy("vec_id").agg(F.round(F.max_by("lag", F.struct(F.abs("r"), -F.col("lag"))) / 100, 3).alias("lag"))


