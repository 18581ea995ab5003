"""Temporal measures of each user's series, and comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import temporal
from siglake.operators import series
from siglake.plans.registry import query
from siglake.sources import views

PREPARED = """g AS (SELECT user_id, i, x, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w) AS dx,
    x - lag(x) OVER w AS d, sign(x) - lag(sign(x)) OVER w AS s FROM sig_ev WINDOW w AS (PARTITION BY user_id ORDER BY i)),
  m AS (SELECT *, coalesce((lead(dx) OVER w - lag(dx) OVER w) / 2, lead(dx) OVER w - dx, dx - lag(dx) OVER w) AS ddx,
    abs(x - median(x) OVER (PARTITION BY user_id)) AS dev FROM g WINDOW w AS (PARTITION BY user_id ORDER BY i))
"""
MOB = "sqrt(var_pop(dx) / (var_pop(x) + 1e-12))"
SQL = {
    "relative_variance": "var_pop(x)",
    "deviation": "avg(x)",
    "standard_deviation": "stddev_pop(x)",
    "amplitude": "max(x) - min(x)",
    "time_derivative": "avg(abs(dx))",
    "temporal_stability": "stddev_pop(x) / (abs(avg(x)) + 1e-12)",
    "kurtosis": "kurtosis_pop(x) + 3",
    "skewness": "(avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * power(avg(x), 3)) / power(stddev_pop(x), 3)",
    "hjorth_mobility": MOB,
    "hjorth_complexity": f"sqrt(var_pop(ddx) / (var_pop(dx) + 1e-12)) / ({MOB} + 1e-12)",
    "jump_index": "max(abs(d)) / (median(dev) * 1.4826 + 1e-12)",
    "zero_crossing_rate": "avg((s <> 0)::INT::DOUBLE)",
    "saturation_fraction": "avg((abs(x) > 48.0)::INT::DOUBLE)",
}


def _measure(name: str) -> None:
    more = {"saturation_fraction": lambda: temporal.saturation_fraction(50.0)}

    def run(spark, sf_dir):
        own = {name: more[name]()} if name in more else {}
        got = temporal.measured(views.sig_ev(spark, sf_dir), ["user_id"], "i", "x", [] if own else [name], **own)
        return got.select("user_id", F.round(name, 6).alias(name))

    query(f"{PREPARED} SELECT user_id, round({SQL[name]}, 6) AS {name} FROM m GROUP BY user_id", f"temporal_{name}")(run)


for _name in SQL:
    _measure(_name)


@query("SELECT user_id, i, round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 6) AS z FROM sig_ev WINDOW w AS (PARTITION BY user_id)")
def zscore_1d(spark, sf_dir):
    return series.zscored(views.sig_ev(spark, sf_dir), ["user_id"], "x").select("user_id", "i", F.round("z", 6).alias("z"))


@query("SELECT user_id, i, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-12), 5) AS z FROM sig_ev WINDOW w AS (PARTITION BY user_id)")
def zscorex_mean(spark, sf_dir):
    return series.zscorex(views.sig_ev(spark, sf_dir), ["user_id"], "x").select("user_id", "i", F.round("z", 5).alias("z"))


@query(
    """m AS (SELECT *, median(x) OVER (PARTITION BY user_id) AS med FROM sig_ev),
  d AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY user_id) AS mad FROM m)
  SELECT user_id, i, round((x - med) / (mad * 1.4826 + 1e-12), 5) AS z FROM d"""
)
def zscorex_robust(spark, sf_dir):
    return series.zscorex(views.sig_ev(spark, sf_dir), ["user_id"], "x", robust=True).select("user_id", "i", F.round("z", 5).alias("z"))


@query(
    """m AS (SELECT *, median(x) OVER (PARTITION BY user_id) AS med FROM sig_ev),
  d AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY user_id) / 0.67449 AS mad FROM m)
  SELECT user_id, i, round((x - med) / mad, 5) AS z FROM d WHERE mad > 0"""
)
def robust_zscore(spark, sf_dir):
    """By the median absolute deviation over 0.67449; series without spread give none."""
    w = W.partitionBy("user_id")
    d = views.sig_ev(spark, sf_dir).withColumn("med", F.median("x").over(w)).withColumn("mad", F.median(F.abs(F.col("x") - F.col("med"))).over(w) / 0.67449)
    return d.where("mad > 0").select("user_id", "i", F.round((F.col("x") - F.col("med")) / F.col("mad"), 5).alias("z"))


@query(
    """m AS (SELECT *, median(x) OVER (PARTITION BY user_id) AS med FROM sig_ev)
  SELECT user_id, round(any_value(med) - 1.959963984540054 * 1.4826 * median(abs(x - med)), 6) AS low, round(any_value(med) + 1.959963984540054 * 1.4826 * median(abs(x - med)), 6) AS high FROM m GROUP BY user_id"""
)
def mad_based_outlier_threshold(spark, sf_dir):
    """Median and normal quantile at 1 - 0.05 / 2 times the scaled median absolute deviation."""
    from statistics import NormalDist

    m = views.sig_ev(spark, sf_dir).withColumn("med", F.median("x").over(W.partitionBy("user_id")))
    reach = F.median(F.abs(F.col("x") - F.col("med"))) * (NormalDist().inv_cdf(0.975) * 1.4826)
    got = m.groupBy("user_id").agg(F.first("med").alias("med"), reach.alias("r"))
    return got.select("user_id", F.round(F.col("med") - F.col("r"), 6).alias("low"), F.round(F.col("med") + F.col("r"), 6).alias("high"))


@query(
    """c AS (SELECT user_id, x AS o, x - avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM sig_ev)
  SELECT user_id, round(sum((o - c) * (o - c)) / (sum(o * o) + 1e-30), 6) AS ratio FROM c GROUP BY user_id"""
)
def residual_energy_ratio(spark, sf_dir):
    """Energy that cleaning (here: subtracting a local mean) took, over the original's."""
    local = F.avg("x").over(series.over(["user_id"], "i").rowsBetween(-2, 2))
    c = views.sig_ev(spark, sf_dir).select("user_id", F.col("x").alias("o"), (F.col("x") - local).alias("c"))
    took = F.sum((F.col("o") - F.col("c")) * (F.col("o") - F.col("c")))
    return c.groupBy("user_id").agg(F.round(took / (F.sum(F.col("o") * F.col("o")) + F.lit(1e-30)), 6).alias("ratio"))


@query(
    """c AS (SELECT vec_id, i, x, avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM sig_64)
  SELECT vec_id, round(sqrt(avg((x - y) * (x - y))), 6) AS rms FROM c GROUP BY vec_id"""
)
def waveform_residual_rms(spark, sf_dir):
    smooth = F.avg("x").over(series.over(["vec_id"], "i").rowsBetween(-1, 1))
    c = views.sig_64(spark, sf_dir).select("vec_id", (F.col("x") - smooth).alias("e"))
    return c.groupBy("vec_id").agg(F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rms"))


@query(
    """SELECT user_id, i, CASE WHEN max(x) OVER w = min(x) OVER w THEN 0 ELSE trunc((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 65534 - 32767)::INT END::SMALLINT AS v FROM sig_ev WINDOW w AS (PARTITION BY user_id)"""
)
def to_int16(spark, sf_dir):
    """Each series scaled to +-32767 and truncated; a constant one is 0."""
    w = W.partitionBy("user_id")
    low, high = F.min("x").over(w), F.max("x").over(w)
    scaled = ((F.col("x") - low) / F.nullif(high - low, F.lit(0.0)) * 65534 - 32767).cast("int")
    return views.sig_ev(spark, sf_dir).select("user_id", "i", F.coalesce(scaled, F.lit(0)).cast("short").alias("v"))


@query("SELECT user_id, i, round(x - quantile_cont(x, 0.25) OVER (PARTITION BY user_id), 6) AS y FROM sig_ev")
def quantile_threshold(spark, sf_dir):
    """x less its lower quartile."""
    low = F.percentile("x", 0.25).over(W.partitionBy("user_id"))
    return views.sig_ev(spark, sf_dir).select("user_id", "i", F.round(F.col("x") - low, 6).alias("y"))


@query(
    """s AS (SELECT DISTINCT (l_quantity * 37)::DOUBLE AS n FROM lineitem)
  SELECT n, power(2, round_even(log2(n), 0))::BIGINT AS p FROM s"""
)
def closest_power_of_two(spark, sf_dir):
    """2 to the rounded logarithm, half to even."""
    s = views.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 37).cast("double").alias("n")).distinct()
    return s.select("n", F.pow(F.lit(2.0), F.bround(F.log2("n"), 0)).cast("long").alias("p"))
