"""Event-triggered and regression queries: samples of embeddings about synthetic triggers, and users' series."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.operators import series, triggered
from siglake.plans.registry import query
from siglake.sources import views

K = ["user_id"]
HIT = "e AS (SELECT user_id, i AS event_id, i AS i0 FROM sig_ev WHERE x > 45)"
EPOCHS = f"""{HIT}, ep AS (SELECT e.user_id, e.event_id, l.lag::INT AS lag, s.x FROM e CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag) l LEFT JOIN sig_ev s ON s.user_id = e.user_id AND s.i = e.i0 + l.lag)"""


def _events(spark, sf_dir):
    return views.sig_ev(spark, sf_dir).where("x > 45").select("user_id", F.col("i").alias("event_id"), F.col("i").alias("i0"))


def _epochs(spark, sf_dir):
    return triggered.epochs(views.sig_ev(spark, sf_dir), _events(spark, sf_dir), K, 3, 3)


@query(f"{EPOCHS} SELECT user_id, event_id, lag, round(x, 6) AS x FROM ep")
def perievent_epochs(spark, sf_dir):
    return _epochs(spark, sf_dir).select("user_id", "event_id", "lag", F.round("x", 6).alias("x"))


@query(f"{EPOCHS} SELECT lag, round(avg(x), 6) AS average FROM ep GROUP BY lag")
def triggered_average(spark, sf_dir):
    return triggered.statistics(_epochs(spark, sf_dir), []).select("lag", F.round("average", 6).alias("average"))


@query(f"{EPOCHS} SELECT user_id, lag, round(stddev_samp(x), 6) AS deviation FROM ep GROUP BY user_id, lag")
def triggered_std(spark, sf_dir):
    return triggered.statistics(_epochs(spark, sf_dir), K).select("user_id", "lag", F.round("deviation", 6).alias("deviation"))


@query(f"{EPOCHS} SELECT user_id, lag, round(median(x), 6) AS median FROM ep GROUP BY user_id, lag")
def triggered_median(spark, sf_dir):
    return triggered.statistics(_epochs(spark, sf_dir), K).select("user_id", "lag", F.round("median", 6).alias("median"))


@query(f"{EPOCHS} SELECT lag, round(avg(x) / greatest(stddev_samp(x) / sqrt(count(*)), 1e-12), 5) AS snr, count(*) AS n FROM ep GROUP BY lag")
def triggered_snr(spark, sf_dir):
    return triggered.statistics(_epochs(spark, sf_dir), []).select("lag", F.round("snr", 5).alias("snr"), "n")


def _template(method: str, body: str) -> None:
    def run(spark, sf_dir):
        return triggered.template(_epochs(spark, sf_dir), [], method).select("lag", F.round("template", 6).alias("template"))

    query(f"{EPOCHS}{body}" if body.startswith(",") else f"{EPOCHS} {body}", f"estimate_template_{method}")(run)


_template("mean", "SELECT lag, round(avg(x), 6) AS template FROM ep GROUP BY lag")
_template("median", "SELECT lag, round(median(x), 6) AS template FROM ep GROUP BY lag")
_template(
    "trimmean",
    """, r AS (SELECT lag, x, row_number() OVER (PARTITION BY lag ORDER BY x NULLS FIRST) AS k, count(*) OVER (PARTITION BY lag) AS n FROM ep)
  SELECT lag, round(avg(x), 6) AS template FROM r WHERE k > floor(n * 0.1::DOUBLE) AND k <= n - floor(n * 0.1::DOUBLE) GROUP BY lag""",
)

SCALED = f"{EPOCHS}, tm AS (SELECT user_id, lag, avg(x) AS template FROM ep GROUP BY ALL), sc AS (SELECT ep.user_id, event_id, CASE WHEN sum(template * template) < 1e-30 THEN 0 ELSE sum(x * template) / sum(template * template) END AS scale FROM ep JOIN tm USING (user_id, lag) GROUP BY ALL)"


@query(f"{SCALED} SELECT user_id, event_id, round(scale, 6) AS scale FROM sc")
def fit_scaling(spark, sf_dir):
    ep = _epochs(spark, sf_dir)
    return triggered.scaling(ep, triggered.template(ep, K), K).select("user_id", "event_id", F.round("scale", 6).alias("scale"))


def _without(spark, sf_dir, scaled: bool):
    ep, events = _epochs(spark, sf_dir), _events(spark, sf_dir)
    tm = triggered.template(ep, K)
    events = events.withColumn("start", F.col("i0") - 3)
    if scaled:
        events = events.join(triggered.scaling(ep, tm, K), ["user_id", "event_id"])
    return triggered.without_template(views.sig_ev(spark, sf_dir), events, tm.select("user_id", (F.col("lag") + 3).alias("k"), "template"), K, "start", "scale" if scaled else None)


SUBTRACT = f"""{SCALED}, la AS (SELECT user_id, max(i) AS last FROM sig_ev GROUP BY user_id), ok AS (SELECT e.* FROM e JOIN la USING (user_id) WHERE i0 - 3 >= 0 AND i0 + 3 <= last)"""


@query(f"{SUBTRACT}, p AS (SELECT ok.user_id, i0 + lag AS i, sum(template) AS v FROM ok JOIN tm USING (user_id) GROUP BY ALL) SELECT user_id, i, round(x - coalesce(v, 0), 9) AS x FROM sig_ev LEFT JOIN p USING (user_id, i)")
def subtract_template(spark, sf_dir):
    return _without(spark, sf_dir, False).select("user_id", "i", F.round("x", 9).alias("x"))


@query(
    f"{SUBTRACT}, p AS (SELECT ok.user_id, i0 + lag AS i, sum(scale * template) AS v FROM ok JOIN sc USING (user_id, event_id) JOIN tm USING (user_id) GROUP BY ALL) SELECT user_id, i, round(x - coalesce(v, 0), 9) AS x FROM sig_ev LEFT JOIN p USING (user_id, i)"
)
def artifact_removal(spark, sf_dir):
    """Detect, cut epochs, estimate the template, fit its scale to each event, subtract."""
    return _without(spark, sf_dir, True).select("user_id", "i", F.round("x", 9).alias("x"))


DESIGN = "d AS (SELECT user_id, i, x, coalesce(lag(x, 0) OVER w, 0) AS x0, coalesce(lag(x, 2) OVER w, 0) AS x1, coalesce(lead(x, 1) OVER w, 0) AS x2 FROM sig_ev WINDOW w AS (PARTITION BY user_id ORDER BY i))"


@query(f"{DESIGN} SELECT user_id, i, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM d")
def lagged_design_matrix(spark, sf_dir):
    got = triggered.lagged_design(views.sig_ev(spark, sf_dir), K, [0, 2, -1])
    return got.select("user_id", "i", *[F.round(c, 6).alias(c) for c in ("x0", "x1", "x2")])


@query(
    f"{EPOCHS}, tm AS (SELECT lag + 3 AS k, avg(x) AS template FROM ep GROUP BY lag) SELECT user_id, event_id, i0 - 3 + k AS i, round(template, 6) AS value FROM e, tm WHERE i0 - 3 + k BETWEEN 0 AND 99999"
)
def event_design_matrix(spark, sf_dir):
    tm = triggered.template(_epochs(spark, sf_dir), []).select((F.col("lag") + 3).alias("k"), "template")
    both = triggered.event_design(_events(spark, sf_dir).withColumn("s", F.col("i0") - 3).withColumn("id", F.struct("user_id", "event_id")), tm, [], "s", 100000, "id")
    return both.select("id.user_id", "id.event_id", "i", F.round("value", 6).alias("value"))


OLS = "o AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)"


def _beta(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1.0).alias("one"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return li, triggered.ols_fit(li, ["one", "q"], "p")


@query(f"{OLS} SELECT round(a, 4) AS intercept, round(b, 4) AS slope FROM o")
def ols_fit(spark, sf_dir):
    _, beta = _beta(spark, sf_dir)
    return spark.createDataFrame([tuple(map(float, beta))], "intercept double, slope double").select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))


@query(f"{OLS} SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 3) AS fit FROM lineitem, o")
def ols_predict(spark, sf_dir):
    li, beta = _beta(spark, sf_dir)
    return triggered.ols_predict(li, ["one", "q"], beta).select("l_orderkey", "l_linenumber", F.round("fit", 3).alias("fit"))


@query(f"{OLS} SELECT l_orderkey, l_linenumber, round(l_extendedprice - a - b * l_quantity, 3) AS residual FROM lineitem, o")
def ols_residual(spark, sf_dir):
    li, beta = _beta(spark, sf_dir)
    return triggered.ols_residual(li, ["one", "q"], "p", beta).select("l_orderkey", "l_linenumber", F.round("residual", 3).alias("residual"))


@query(
    f"""{DESIGN} SELECT user_id, round(regr_slope(x0, x1), 6) AS slope, round(regr_intercept(x0, x1), 6) AS intercept FROM d GROUP BY user_id"""
)
def lagged_regression(spark, sf_dir):
    """Regression of each series on itself two samples before."""
    got = triggered.lagged_design(views.sig_ev(spark, sf_dir), K, [2]).withColumnRenamed("x0", "before")
    return got.groupBy("user_id").agg(F.round(F.regr_slope("x", "before"), 6).alias("slope"), F.round(F.regr_intercept("x", "before"), 6).alias("intercept"))


@query(
    """z AS (SELECT user_id, i, x - avg(x) OVER (PARTITION BY user_id) AS z FROM sig_ev), k AS (SELECT unnest(range(0, 5)) AS k)
  SELECT a.user_id, k, round(sum(a.z * b.z), 3) AS c FROM z a, k JOIN z b ON b.user_id = a.user_id AND b.i = a.i + k GROUP BY a.user_id, k"""
)
def lagged_products(spark, sf_dir):
    z = views.sig_ev(spark, sf_dir).withColumn("z", F.col("x") - F.avg("x").over(series.W.partitionBy("user_id")))
    w = series.over(K, "i")
    own = z.select("user_id", "i", "z", *[F.lead("z", k).over(w).alias(f"z{k}") for k in range(5)])
    got = own.groupBy("user_id").agg(*[F.sum(F.col("z") * F.col(f"z{k}")).alias(str(k)) for k in range(5)])
    return got.unpivot("user_id", [str(k) for k in range(5)], "k", "c").select("user_id", F.col("k").cast("long").alias("k"), F.round("c", 3).alias("c"))


@query(
    """o AS (SELECT l_suppkey % 50 AS g, 1 AS one, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem)
  SELECT g, round(regr_intercept(p, q), 3) AS b0, round(regr_slope(p, q), 4) AS b1 FROM o GROUP BY g"""
)
def ols_fit_by_key(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), F.lit(1.0).alias("one"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return triggered.ols_coefficients(li, ["one", "q"], "p", ["g"]).select("g", F.round(F.col("beta")[0], 3).alias("b0"), F.round(F.col("beta")[1], 4).alias("b1"))
