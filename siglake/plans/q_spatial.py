"""Spatial queries: each embedding as an 8 x 8 grid."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators import spatial
from siglake.plans.registry import query
from siglake.sources import views

K = ["vec_id"]
NEAR = {
    "queen": "abs(a.ap - b.ap) <= 1 AND abs(a.ml - b.ml) <= 1 AND (a.ap <> b.ap OR a.ml <> b.ml)",
    "rook": "abs(a.ap - b.ap) + abs(a.ml - b.ml) = 1",
    "ap_only": "abs(a.ap - b.ap) = 1 AND a.ml = b.ml",
    "ml_only": "abs(a.ml - b.ml) = 1 AND a.ap = b.ap",
}


def _grid(spark, sf_dir):
    return views.sig_grid(spark, sf_dir)


def _moran(kind: str) -> None:
    def run(spark, sf_dir):
        return spatial.moran(_grid(spark, sf_dir), K, kind).select("vec_id", F.round("moran", 8).alias("moran"))

    query(
        f"""c AS (SELECT vec_id, ap, ml, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM sig_grid), t AS (SELECT vec_id, count(*) AS n, sum(x * x) AS q FROM c GROUP BY vec_id),
  s AS (SELECT a.vec_id, sum(a.x * b.x) AS s, count(*) AS w FROM c a JOIN c b ON a.vec_id = b.vec_id AND {NEAR[kind]} GROUP BY a.vec_id)
  SELECT vec_id, round(n / w * s / (q + 1e-12), 8) AS moran FROM t JOIN s USING (vec_id)""",
        f"moran_i_{kind}",
    )(run)


for _k in NEAR:
    _moran(_k)


def _adjacency(kind: str) -> None:
    def run(spark, sf_dir):
        return spatial.edges(_grid(spark, sf_dir), spatial.ADJACENCY[kind])

    query(f"g AS (SELECT DISTINCT ap, ml FROM sig_grid) SELECT a.ap, a.ml, b.ap AS ap_to, b.ml AS ml_to FROM g a, g b WHERE {NEAR[kind]}", f"adjacency_edges_{kind}")(run)


for _k in NEAR:
    _adjacency(_k)


@query("g AS (SELECT DISTINCT ap, ml FROM sig_grid) SELECT a.ap, a.ml, b.ap AS ap_to, b.ml AS ml_to FROM g a, g b WHERE abs(a.ap - b.ap) + abs(a.ml - b.ml) BETWEEN 1 AND 2")
def footprint_edges(spark, sf_dir):
    return spatial.edges(_grid(spark, sf_dir), spatial.footprint(2))


@query("g AS (SELECT DISTINCT ap, ml, (ap // 4) AS l FROM sig_grid) SELECT a.ap, a.ml, b.ap AS ap_to, b.ml AS ml_to FROM g a, g b WHERE a.l = b.l AND abs(a.ap - b.ap) + abs(a.ml - b.ml) = 1")
def grouped_grid_adjacency(spark, sf_dir):
    labelled = _grid(spark, sf_dir).withColumn("l", F.floor(F.col("ap") / 4))
    return spatial.edges(labelled, spatial.ADJACENCY["rook"], "l")


@query(
    """SELECT g.vec_id, g.ap, g.ml, round(-(a.x + b.x + c.x + d.x - 4 * g.x) / 4, 6) AS csd FROM sig_grid g
  LEFT JOIN sig_grid a ON a.vec_id = g.vec_id AND a.ap = g.ap - 1 AND a.ml = g.ml LEFT JOIN sig_grid b ON b.vec_id = g.vec_id AND b.ap = g.ap + 1 AND b.ml = g.ml
  LEFT JOIN sig_grid c ON c.vec_id = g.vec_id AND c.ap = g.ap AND c.ml = g.ml - 1 LEFT JOIN sig_grid d ON d.vec_id = g.vec_id AND d.ap = g.ap AND d.ml = g.ml + 1"""
)
def csd_power(spark, sf_dir):
    return spatial.csd_power(_grid(spark, sf_dir), K, 2.0).select("vec_id", "ap", "ml", F.round("csd", 6).alias("csd"))


def _marginal(axis: str) -> None:
    def run(spark, sf_dir):
        got = spatial.marginal_energy_outlier(_grid(spark, sf_dir), K, axis)
        return got.select("vec_id", axis, F.round("energy", 6).alias("energy"), F.round("z", 5).alias("z"), "outlier")

    query(
        f"""e AS (SELECT vec_id, {axis}, sum(x * x) AS energy FROM sig_grid GROUP BY ALL), m AS (SELECT *, median(energy) OVER (PARTITION BY vec_id) AS m FROM e),
  s AS (SELECT *, (energy - m) / (1.4826 * median(abs(energy - m)) OVER (PARTITION BY vec_id) + 1e-12) AS z FROM m)
  SELECT vec_id, {axis}, round(energy, 6) AS energy, round(z, 5) AS z, abs(z) > 3 AS outlier FROM s""",
        f"marginal_energy_outlier_{axis}",
    )(run)


_marginal("ap")
_marginal("ml")


@query(
    """d AS (SELECT vec_id, abs(lead(x) OVER (PARTITION BY vec_id, ml ORDER BY ap) - x) AS da, abs(lead(x) OVER (PARTITION BY vec_id, ap ORDER BY ml) - x) AS dm FROM sig_grid)
  SELECT vec_id, round(log2((avg(da) + 1e-12) / (avg(dm) + 1e-12)), 8) AS anisotropy FROM d GROUP BY vec_id"""
)
def gradient_anisotropy(spark, sf_dir):
    return spatial.gradient_anisotropy(_grid(spark, sf_dir), K).select("vec_id", F.round("anisotropy", 8).alias("anisotropy"))


@query("SELECT vec_id, round(kurtosis_pop(x), 6) AS kurtosis FROM sig_grid GROUP BY vec_id")
def spatial_kurtosis(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("vec_id").agg(F.round(spatial.spatial_kurtosis(), 6).alias("kurtosis"))


@query("r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x * x DESC) AS r FROM sig_grid) SELECT vec_id, round(sum(x * x) FILTER (r <= 3) / (sum(x * x) + 1e-12), 8) AS concentration FROM r GROUP BY vec_id")
def spatial_noise_concentration(spark, sf_dir):
    return spatial.noise_concentration(_grid(spark, sf_dir), K, 3).select("vec_id", F.round("concentration", 8).alias("concentration"))


HOOD = f"""h AS (SELECT a.vec_id, a.ap, a.ml, a.x, b.x AS y, median(b.x) OVER (PARTITION BY a.vec_id, a.ap, a.ml) AS m FROM sig_grid a JOIN sig_grid b ON a.vec_id = b.vec_id AND {NEAR["queen"]}),
  n AS (SELECT vec_id, ap, ml, any_value(x) AS x, any_value(m) AS med, median(abs(y - m)) AS mad FROM h GROUP BY ALL)"""


def _hood(spark, sf_dir):
    return spatial.neighborhood(_grid(spark, sf_dir), K, spatial.ADJACENCY["queen"])


@query(f"{HOOD} SELECT vec_id, ap, ml, round(med, 6) AS med FROM n")
def neighborhood_median(spark, sf_dir):
    return _hood(spark, sf_dir).select("vec_id", "ap", "ml", F.round("med", 6).alias("med"))


@query(f"{HOOD} SELECT vec_id, ap, ml, round(mad, 6) AS mad FROM n")
def neighborhood_mad(spark, sf_dir):
    return _hood(spark, sf_dir).select("vec_id", "ap", "ml", F.round("mad", 6).alias("mad"))


@query(f"{HOOD} SELECT vec_id, ap, ml, round(x - med, 6) AS v FROM n")
def normalize_difference(spark, sf_dir):
    return _hood(spark, sf_dir).select("vec_id", "ap", "ml", F.round(spatial.normalize_difference(), 6).alias("v"))


@query(f"{HOOD} SELECT vec_id, ap, ml, CASE WHEN mad > 0 THEN round(0.67449 * (x - med) / (mad + 1e-12), 5) END AS v FROM n")
def normalize_robust_z(spark, sf_dir):
    return _hood(spark, sf_dir).select("vec_id", "ap", "ml", F.round(spatial.normalize_robust_z(), 5).alias("v"))


@query(f"{HOOD} SELECT vec_id, ap, ml, round(abs(x) / (abs(med) + 1e-12), 3) AS v FROM n WHERE abs(med) > 0.01")
def normalize_ratio(spark, sf_dir):
    own = _hood(spark, sf_dir).where("abs(med) > 0.01").withColumn("x", F.abs("x")).withColumn("med", F.abs("med"))
    return own.select("vec_id", "ap", "ml", F.round(spatial.normalize_ratio(), 3).alias("v"))


@query(
    f"""s AS (SELECT ap * 8 + ml AS ch, ap, ml, vec_id AS i, x FROM sig_grid), c AS (SELECT a.ap, a.ml, coalesce(corr(a.x, b.x), 0) AS r FROM s a JOIN s b ON a.i = b.i AND {NEAR["queen"]} GROUP BY a.ap, a.ml, b.ap, b.ml)
  SELECT ap, ml, round(1 - median(r), 6) AS anticorrelation FROM c GROUP BY ap, ml"""
)
def anticorrelation(spark, sf_dir):
    """One less the median correlation with neighbours, vectors taken as samples."""
    s = _grid(spark, sf_dir)
    pairs = s.select("vec_id", F.col("ap").alias("ap_to"), F.col("ml").alias("ml_to"), F.col("x").alias("y"))
    e = spatial.edges(s, spatial.ADJACENCY["queen"])
    r = s.join(F.broadcast(e), ["ap", "ml"]).join(pairs, ["vec_id", "ap_to", "ml_to"]).groupBy("ap", "ml", "ap_to", "ml_to").agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("r"))
    return r.groupBy("ap", "ml").agg(F.round(1 - F.median("r"), 6).alias("anticorrelation"))


@query(
    """h AS (SELECT a.vec_id, a.ap, a.ml, a.x, b.x AS y, median(b.x) OVER (PARTITION BY a.vec_id, a.ap, a.ml) AS m FROM sig_grid a JOIN sig_grid b ON a.vec_id = b.vec_id AND abs(a.ap - b.ap) + abs(a.ml - b.ml) <= 1)
  SELECT vec_id, ap, ml, round(0.67449 * (any_value(x) - any_value(m)) / (median(abs(y - m)) + 1e-12), 5) AS z FROM h GROUP BY vec_id, ap, ml HAVING median(abs(y - m)) > 0"""
)
def local_robust_zscore(spark, sf_dir):
    """By the median and its deviation over a cross that holds the electrode itself."""
    own = spatial.neighborhood(_grid(spark, sf_dir), K, spatial.footprint(1, exclude_center=False)).where("mad > 0")
    return own.select("vec_id", "ap", "ml", F.round(spatial.normalize_robust_z(), 5).alias("z"))


MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(
    f"""o AS (SELECT a, m, CASE WHEN a = 0 AND m = 0 THEN -20 WHEN a = 0 OR m = 0 THEN 4 ELSE 1 END AS w FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS m))
  SELECT g.vec_id, g.ap, g.ml, round(abs(sum(w * b.x)), 6) AS laplacian FROM sig_grid g, o JOIN sig_grid b ON b.vec_id = g.vec_id AND b.ap = {MIRROR.format("g.ap + a")} AND b.ml = {MIRROR.format("g.ml + m")} GROUP BY ALL"""
)
def temporal_mean_laplacian(spark, sf_dir):
    return spatial.mean_laplacian(_grid(spark, sf_dir), K, 8, 8).select("vec_id", "ap", "ml", F.round("laplacian", 6).alias("laplacian"))


REFLECT = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


@query(
    f"""k AS (SELECT a, exp(-a * a / 2.0::DOUBLE) AS e FROM (SELECT unnest(range(-4, 5)) AS a)), o AS (SELECT x.a, y.a AS m, x.e * y.e / power((SELECT sum(e) FROM k), 2) AS w FROM k x, k y)
  SELECT g.vec_id, g.ap, g.ml, round(sum(w * b.x), 6) AS y FROM sig_grid g, o JOIN sig_grid b ON b.vec_id = g.vec_id AND b.ap = {REFLECT.format("g.ap + a")} AND b.ml = {REFLECT.format("g.ml + m")} GROUP BY ALL"""
)
def gaussian_spatial(spark, sf_dir):
    return spatial.gaussian(_grid(spark, sf_dir), K, 1.0, 8, 8).select("vec_id", "ap", "ml", F.round("y", 6).alias("y"))


@query(
    f"""o AS (SELECT a, m FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS m))
  SELECT g.vec_id, g.ap, g.ml, round(median(b.x), 6) AS y FROM sig_grid g, o JOIN sig_grid b ON b.vec_id = g.vec_id AND b.ap = {REFLECT.format("g.ap + a")} AND b.ml = {REFLECT.format("g.ml + m")} GROUP BY ALL"""
)
def median_spatial(spark, sf_dir):
    return spatial.median_filter(_grid(spark, sf_dir), K, 3, 8, 8).select("vec_id", "ap", "ml", F.round("y", 6).alias("y"))


@query("SELECT vec_id, ap, ml, round(x - median(x) OVER (PARTITION BY vec_id), 6) AS y FROM sig_grid")
def median_subtract(spark, sf_dir):
    return _grid(spark, sf_dir).select("vec_id", "ap", "ml", F.round(F.col("x") - F.median("x").over(W.partitionBy("vec_id")), 6).alias("y"))


def _extrema(name: str, minima: bool) -> None:
    def run(spark, sf_dir):
        return spatial.extrema(_grid(spark, sf_dir), K, spatial.ADJACENCY["queen"], minima).select("vec_id", "ap", "ml")

    cmp = "b.x < a.x" if minima else "b.x > a.x"
    query(f"SELECT vec_id, ap, ml FROM sig_grid a WHERE NOT EXISTS (SELECT 1 FROM sig_grid b WHERE a.vec_id = b.vec_id AND {NEAR['queen']} AND {cmp})", name)(run)


_extrema("detect_minima", True)
_extrema("detect_maxima", False)


def _bad(spark, sf_dir):
    return _grid(spark, sf_dir).withColumn("bad", (F.col("ap") * 8 + F.col("ml") + F.col("vec_id")) % 11 == 0)


BAD = "q AS (SELECT *, (ap * 8 + ml + vec_id) % 11 = 0 AS bad FROM sig_grid)"


@query(f"{BAD} SELECT vec_id, ap, ml, CASE WHEN NOT bad THEN round(x, 6) END AS x FROM q")
def bad_to_null(spark, sf_dir):
    return _bad(spark, sf_dir).select("vec_id", "ap", "ml", F.when(~F.col("bad"), F.round("x", 6)).alias("x"))


def _extrapolate(name: str, median: bool) -> None:
    def run(spark, sf_dir):
        bad = lambda r: r.withField("bad", (r["ap"] * 8 + r["ml"] + F.col("vec_id")) % 11 == 0)
        frames = views.frames(spark, sf_dir).withColumn("r", F.transform("r", bad))
        return spatial.interpolated_by_neighbors(frames, K, "bad", spatial.footprint(2), median).select("vec_id", "ap", "ml", F.round("x", 6).alias("x"))

    query(
        f"""{BAD}, f AS (SELECT a.vec_id, a.ap, a.ml, {"median" if median else "avg"}(b.x) FILTER (NOT b.bad) AS f FROM q a JOIN q b ON a.vec_id = b.vec_id AND abs(a.ap - b.ap) + abs(a.ml - b.ml) BETWEEN 1 AND 2 WHERE a.bad GROUP BY ALL)
  SELECT vec_id, ap, ml, round(CASE WHEN bad THEN f ELSE x END, 6) AS x FROM q LEFT JOIN f USING (vec_id, ap, ml)""",
        name,
    )(run)


_extrapolate("extrapolate_bads_mean", False)
_extrapolate("extrapolate_bads_median", True)


@query(
    f"""{BAD}, s AS (SELECT vec_id, ap * 8 + ml AS p, x, bad FROM q), g AS (SELECT * FROM s WHERE NOT bad),
  n AS (SELECT s.*, (SELECT max(p) FROM g WHERE g.vec_id = s.vec_id AND g.p < s.p) AS pa, (SELECT min(p) FROM g WHERE g.vec_id = s.vec_id AND g.p > s.p) AS pb FROM s)
  SELECT n.vec_id, n.p, round(CASE WHEN NOT n.bad THEN n.x ELSE coalesce(a.x + (b.x - a.x) * (n.p - pa) / (pb - pa), a.x, b.x) END, 6) AS x FROM n LEFT JOIN g a ON a.vec_id = n.vec_id AND a.p = pa LEFT JOIN g b ON b.vec_id = n.vec_id AND b.p = pb"""
)
def interpolate_bads_1d(spark, sf_dir):
    s = _bad(spark, sf_dir).select("vec_id", (F.col("ap") * 8 + F.col("ml")).alias("p"), "x", "bad")
    return spatial.interpolated_1d(s, K, "p", "bad").select("vec_id", "p", F.round("x", 6).alias("x"))


@query(f"{BAD} SELECT ap, ml, bool_and(bad) AS always, bool_or(bad) AS ever FROM q GROUP BY ap, ml")
def infer_bad_mask(spark, sf_dir):
    return _bad(spark, sf_dir).groupBy("ap", "ml").agg(F.bool_and("bad").alias("always"), F.bool_or("bad").alias("ever"))


@query("SELECT vec_id, ml AS i, ap AS ch, round(x - median(x) OVER (PARTITION BY vec_id, ml), 6) AS y FROM sig_grid")
def common_median_reference(spark, sf_dir):
    """Rows as channels, columns as samples: each sample less the median over channels."""
    w = W.partitionBy("vec_id", "ml")
    return _grid(spark, sf_dir).select("vec_id", F.col("ml").alias("i"), F.col("ap").alias("ch"), F.round(F.col("x") - F.median("x").over(w), 6).alias("y"))


FLOW = """v AS (SELECT a.vec_id, a.ap, a.ml, a.x AS u, b.x AS v FROM sig_grid a JOIN sig_grid b ON b.vec_id = a.vec_id + 1 AND b.ap = a.ap AND b.ml = a.ml),
  g AS (SELECT *, coalesce((lead(u) OVER m - lag(u) OVER m) / 2, lead(u) OVER m - u, u - lag(u) OVER m) AS du_ml, coalesce((lead(v) OVER m - lag(v) OVER m) / 2, lead(v) OVER m - v, v - lag(v) OVER m) AS dv_ml,
    coalesce((lead(u) OVER a - lag(u) OVER a) / 2, lead(u) OVER a - u, u - lag(u) OVER a) AS du_ap, coalesce((lead(v) OVER a - lag(v) OVER a) / 2, lead(v) OVER a - v, v - lag(v) OVER a) AS dv_ap
    FROM v WINDOW m AS (PARTITION BY vec_id, ap ORDER BY ml), a AS (PARTITION BY vec_id, ml ORDER BY ap))"""


def _flow(spark, sf_dir):
    g = _grid(spark, sf_dir)
    u = g.withColumnRenamed("x", "u")
    v = u.join(g.select((F.col("vec_id") - 1).alias("vec_id"), "ap", "ml", F.col("x").alias("v")), ["vec_id", "ap", "ml"])
    a = spatial.gradients(v, K, "u").withColumnRenamed("g_ap", "du_ap").withColumnRenamed("g_ml", "du_ml")
    return spatial.gradients(a, K, "v").withColumnRenamed("g_ap", "dv_ap").withColumnRenamed("g_ml", "dv_ml")


@query(f"{FLOW} SELECT vec_id, ap, ml, round(du_ml + dv_ap, 6) AS divergence FROM g")
def divergence(spark, sf_dir):
    return _flow(spark, sf_dir).select("vec_id", "ap", "ml", F.round(F.col("du_ml") + F.col("dv_ap"), 6).alias("divergence"))


@query(f"{FLOW} SELECT vec_id, ap, ml, round(dv_ml - du_ap, 6) AS curl FROM g")
def curl(spark, sf_dir):
    return _flow(spark, sf_dir).select("vec_id", "ap", "ml", F.round(F.col("dv_ml") - F.col("du_ap"), 6).alias("curl"))


@query(f"{FLOW} SELECT vec_id, ap, ml, round(sqrt(u * u + v * v), 6) AS speed, round(atan2(v, u), 6) AS direction FROM v")
def flow_to_speed_direction(spark, sf_dir):
    return _flow(spark, sf_dir).select("vec_id", "ap", "ml", F.round(F.hypot("u", "v"), 6).alias("speed"), F.round(F.atan2("v", "u"), 6).alias("direction"))


@query(
    f"""{FLOW}, s AS (SELECT *, u * u + v * v AS sp, du_ml + dv_ap AS tr, du_ml * dv_ap - du_ap * dv_ml AS det FROM g)
  SELECT vec_id, ap, ml, CASE WHEN det < 0 THEN 'saddle' WHEN tr * tr - 4 * det < 0 THEN CASE WHEN tr > 0 THEN 'spiral_out' ELSE 'spiral_in' END WHEN tr > 0 THEN 'source' ELSE 'sink' END AS kind FROM s a
  WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.vec_id = b.vec_id AND {NEAR["queen"]} AND b.sp < a.sp)"""
)
def critical_points(spark, sf_dir):
    """Minima of speed, by trace and determinant of the Jacobian."""
    g = _flow(spark, sf_dir).withColumn("x", F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    low = spatial.extrema(g.select("vec_id", "ap", "ml", "x"), K, spatial.ADJACENCY["queen"]).select("vec_id", "ap", "ml")
    tr, det = F.col("du_ml") + F.col("dv_ap"), F.col("du_ml") * F.col("dv_ap") - F.col("du_ap") * F.col("dv_ml")
    spiral = F.when(tr > 0, "spiral_out").otherwise("spiral_in")
    kind = F.when(det < 0, "saddle").when(tr * tr - 4 * det < 0, spiral).when(tr > 0, "source").otherwise("sink")
    return g.join(low, ["vec_id", "ap", "ml"]).select("vec_id", "ap", "ml", kind.alias("kind"))


@query(
    f"""{FLOW}, p AS (SELECT vec_id, sqrt(power(avg(u / sqrt(u * u + v * v)), 2) + power(avg(v / sqrt(u * u + v * v)), 2)) AS coherence, avg(du_ml + dv_ap) AS div, avg(dv_ml - du_ap) AS rot FROM g GROUP BY vec_id)
  SELECT vec_id, round(coherence, 6) AS coherence, CASE WHEN coherence > 0.3 THEN 'plane' WHEN abs(div) > abs(rot) THEN CASE WHEN div > 0 THEN 'source' ELSE 'sink' END ELSE 'rotating' END AS pattern FROM p"""
)
def classify_pattern(spark, sf_dir):
    g, n = _flow(spark, sf_dir), F.hypot("u", "v")
    p = g.groupBy("vec_id").agg(F.hypot(F.avg(F.col("u") / n), F.avg(F.col("v") / n)).alias("c"), F.avg(F.col("du_ml") + F.col("dv_ap")).alias("d"), F.avg(F.col("dv_ml") - F.col("du_ap")).alias("r"))
    kind = F.when(F.col("c") > 0.3, "plane").when(F.abs("d") > F.abs("r"), F.when(F.col("d") > 0, "source").otherwise("sink")).otherwise("rotating")
    return p.select("vec_id", F.round("c", 6).alias("coherence"), kind.alias("pattern"))


@query(
    """SELECT vec_id, ap, ml, round(g_ap, 6) AS g_ap, round(g_ml, 6) AS g_ml FROM (SELECT *, coalesce((lead(x) OVER a - lag(x) OVER a) / 2, lead(x) OVER a - x, x - lag(x) OVER a) AS g_ap, coalesce((lead(x) OVER m - lag(x) OVER m) / 2, lead(x) OVER m - x, x - lag(x) OVER m) AS g_ml
  FROM sig_grid WINDOW m AS (PARTITION BY vec_id, ap ORDER BY ml), a AS (PARTITION BY vec_id, ml ORDER BY ap))"""
)
def phase_gradient(spark, sf_dir):
    return spatial.gradients(_grid(spark, sf_dir), K, "x").select("vec_id", "ap", "ml", F.round("g_ap", 6).alias("g_ap"), F.round("g_ml", 6).alias("g_ml"))


@query(
    """g AS (SELECT vec_id, coalesce((lead(x) OVER a - lag(x) OVER a) / 2, lead(x) OVER a - x, x - lag(x) OVER a) AS ga, coalesce((lead(x) OVER m - lag(x) OVER m) / 2, lead(x) OVER m - x, x - lag(x) OVER m) AS gm
    FROM sig_grid WINDOW m AS (PARTITION BY vec_id, ap ORDER BY ml), a AS (PARTITION BY vec_id, ml ORDER BY ap))
  SELECT vec_id, round(sqrt(power(avg(ga / sqrt(ga * ga + gm * gm)), 2) + power(avg(gm / sqrt(ga * ga + gm * gm)), 2)), 6) AS pgd FROM g GROUP BY vec_id"""
)
def pgd(spark, sf_dir):
    """Length of the mean unit gradient."""
    g = spatial.gradients(_grid(spark, sf_dir), K, "x")
    n = F.hypot("g_ap", "g_ml")
    return g.groupBy("vec_id").agg(F.round(F.hypot(F.avg(F.col("g_ap") / n), F.avg(F.col("g_ml") / n)), 6).alias("pgd"))


@query(
    """s AS (SELECT vec_id, sum((ap - 3.5::DOUBLE) * x) / 336 AS ky, sum((ml - 3.5::DOUBLE) * x) / 336 AS kx, avg(x) AS b, var_pop(x) * 64 AS tot FROM sig_grid GROUP BY vec_id)
  SELECT vec_id, round(kx, 7) AS kx, round(ky, 7) AS ky, round(atan2(ky, kx), 6) AS direction, round(2 * pi() * 5 / sqrt(kx * kx + ky * ky), 4) AS speed, round(least(greatest((kx * kx + ky * ky) * 336 / tot, 0), 1), 7) AS r2 FROM s"""
)
def plane_wave_fit(spark, sf_dir):
    """Least-squares plane of each frame on the centred grid, whose sums of squares are 336, at 5 Hz."""
    s = _grid(spark, sf_dir).groupBy("vec_id").agg((F.sum((F.col("ml") - 3.5) * F.col("x")) / 336).alias("kx"), (F.sum((F.col("ap") - 3.5) * F.col("x")) / 336).alias("ky"), (F.var_pop("x") * 64).alias("tot"))
    k2 = F.col("kx") * F.col("kx") + F.col("ky") * F.col("ky")
    r2 = F.least(F.greatest(k2 * 336 / F.col("tot"), F.lit(0.0)), F.lit(1.0))
    return s.select("vec_id", F.round("kx", 7).alias("kx"), F.round("ky", 7).alias("ky"), F.round(F.atan2("ky", "kx"), 6).alias("direction"), F.round(2 * F.pi() * 5 / F.sqrt(k2), 4).alias("speed"), F.round(r2, 7).alias("r2"))
