"""Decomposition queries over embeddings, whose labels take the place of recordings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siglake.operators import decomposition as dec
from siglake.plans.registry import query
from siglake.sources import views


def _vectors(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT a.i::INT AS a, b.i::INT AS b, round(covar_samp(a.x, b.x), 8) AS c FROM sig_64 a JOIN sig_64 b USING (vec_id) GROUP BY a.i, b.i")
def covariance(spark, sf_dir):
    _, cov, _ = dec.covariance(_vectors(spark, sf_dir), "v")
    rows = [(i, j, float(cov[i, j])) for i in range(64) for j in range(64)]
    return spark.createDataFrame(rows, "a int, b int, c double").withColumn("c", F.round("c", 8))


@query()
def erp_pca_loadings(spark, sf_dir):
    f = dec.erp_pca(_vectors(spark, sf_dir), "v", 6)
    rows = [(j, i, float(np.round(f.loadings[i, j], 6))) for j in range(f.loadings.shape[1]) for i in range(64)]
    return spark.createDataFrame(rows, "factor int, pos int, v double")


@query()
def erp_pca_scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    got = dec.erp_pca(v, "v", 4).scores(v, "v", ["vec_id"])
    return got.select("vec_id", *[F.round(c, 5).alias(c) for c in got.columns[1:]])


LOAD = "l AS (SELECT label::INT AS f, i // 8 AS ap, i % 8 AS ml, i, avg(x) AS v FROM sig_64 JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY ALL)"


def _loads(spark, sf_dir):
    s = views.sig_64(spark, sf_dir).join(views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("f")), "vec_id")
    return s.groupBy("f", F.floor(F.col("i") / 8).alias("ap"), (F.col("i") % 8).alias("ml"), "i").agg(F.avg("x").alias("v"))


@query(f"{LOAD} SELECT f, i, round(CASE WHEN abs(max(v) OVER w) < abs(min(v) OVER w) THEN -v ELSE v END, 7) AS v FROM l WINDOW w AS (PARTITION BY f)")
def redirect_loadings(spark, sf_dir):
    return dec.redirect(_loads(spark, sf_dir), ["f"], "v").select("f", "i", F.round("v", 7).alias("v"))


@query(f"{LOAD} SELECT f, round(sqrt(sum(v * v)), 7) AS norm FROM l GROUP BY f")
def get_norm(spark, sf_dir):
    return _loads(spark, sf_dir).groupBy("f").agg(F.round(dec.norm("v"), 7).alias("norm"))


@query(
    f"""{LOAD}, q AS (SELECT f, ml AS freq, avg(v) AS m FROM l GROUP BY ALL), b AS (SELECT f, arg_max(freq, (m, -freq)) AS freq FROM q GROUP BY f)
  SELECT f, b.freq, arg_max(ap, (v, -ap)) AS ap, round((SELECT sqrt(sum(v * v)) FROM l x WHERE x.f = l.f), 7) AS norm FROM l JOIN b USING (f) WHERE l.ml = b.freq GROUP BY f, b.freq"""
)
def loading_peaks(spark, sf_dir):
    """Columns of the grid as frequencies."""
    own = _loads(spark, sf_dir).select("f", "ap", F.lit(0).cast("long").alias("ml"), F.col("ml").alias("freq"), "v")
    return dec.peaks(own, ["f"]).select("f", "freq", "ap", F.round("norm", 7).alias("norm"))


SIM = f"""{LOAD}, s AS (SELECT a.f AS fa, b.f AS fb, CASE WHEN abs(a.f - b.f) > 3 THEN 0 ELSE corr(a.v, b.v) END AS r FROM l a JOIN l b ON a.i = b.i WHERE a.f < 5 AND b.f >= 5 GROUP BY a.f, b.f)"""


def _similar(spark, sf_dir):
    own = _loads(spark, sf_dir).select("f", F.col("f").alias("freq"), F.col("i").alias("pos"), "v")
    return dec.similarity(own.where("f < 5"), own.where("f >= 5"), 3)


@query(f"{SIM} SELECT fa, fb, round(r, 7) AS r FROM s")
def similarity_matrix(spark, sf_dir):
    return _similar(spark, sf_dir).select("fa", "fb", F.round("r", 7).alias("r"))


@query(
    f"""{SIM}, c AS (SELECT a.fb AS b0, b.fb AS b1, c.fb AS b2, d.fb AS b3, e.fb AS b4, a.r + b.r + c.r + d.r + e.r AS total FROM s a, s b, s c, s d, s e
    WHERE a.fa = 0 AND b.fa = 1 AND c.fa = 2 AND d.fa = 3 AND e.fa = 4 AND len(list_distinct([a.fb, b.fb, c.fb, d.fb, e.fb])) = 5)
  SELECT round(max(total), 6) AS total FROM c"""
)
def match_factors(spark, sf_dir):
    """Total similarity of the best assignment."""
    return dec.remapping(_similar(spark, sf_dir)).agg(F.round(F.sum("r"), 6).alias("total"))


@query(f"{SIM} SELECT fa, round(avg(1 - CASE WHEN 1 - r < 0.3 THEN power(1 - r, 2) ELSE 1 END), 7) AS fit FROM s GROUP BY fa")
def optimal_reference(spark, sf_dir):
    return _similar(spark, sf_dir).groupBy("fa").agg(F.round(F.avg(1 - dec.mismatch(F.col("r"))), 7).alias("fit"))


@query(f"{SIM} SELECT fa, fb, round(r, 7) AS r FROM s WHERE r > 0.05")
def cutoff_low_similarity(spark, sf_dir):
    return _similar(spark, sf_dir).where("r > 0.05").select("fa", "fb", F.round("r", 7).alias("r"))


@query(
    """s AS (SELECT *, x > lag(x) OVER w AND x > lead(x) OVER w AS top FROM sig_64 WINDOW w AS (PARTITION BY vec_id ORDER BY i))
  SELECT a.vec_id, a.i, round(a.x, 6) AS amp, count(*) FILTER (b.x > a.x / 2)::INT AS width FROM s a JOIN s b ON a.vec_id = b.vec_id AND abs(a.i - b.i) <= 4 WHERE a.top GROUP BY a.vec_id, a.i, a.x"""
)
def score_spikes(spark, sf_dir):
    return dec.spikes(views.sig_64(spark, sf_dir), ["vec_id"], 4).select("vec_id", "i", F.round("amp", 6).alias("amp"), "width")


@query(
    """d AS (SELECT vec_id, i, log10(CASE WHEN x = 0 THEN 1e-10 ELSE abs(x) END) AS x FROM sig_64)
  SELECT vec_id, string_agg(round(x, 3)::VARCHAR, ',' ORDER BY i) AS row FROM d GROUP BY vec_id"""
)
def design_matrix(spark, sf_dir):
    """Variables of a row side by side, in logarithms; zeros count as 1e-10."""
    x = F.log10(F.when(F.col("x") == 0, 1e-10).otherwise(F.abs("x")))
    d = views.sig_64(spark, sf_dir).select("vec_id", F.struct("i", F.format_string("%.3f", F.round(x, 3)).alias("s")).alias("p"))
    got = d.groupBy("vec_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return got.select("vec_id", F.array_join(F.transform("p", lambda p: F.regexp_replace(F.regexp_replace(p["s"], r"(\.\d*?)0+$", "$1"), r"\.$", ".0")), ",").alias("row"))


@query(f"{LOAD} SELECT e.vec_id, f, round(sum(x * v), 6) AS s FROM sig_64 e JOIN l USING (i) GROUP BY e.vec_id, f")
def project_to_loadings(spark, sf_dir):
    own = _loads(spark, sf_dir).select("f", "i", "v")
    return views.sig_64(spark, sf_dir).join(F.broadcast(own), "i").groupBy("vec_id", "f").agg(F.round(F.sum(F.col("x") * F.col("v")), 6).alias("s"))


@query(f"{LOAD}, p AS (SELECT e.vec_id, f, sum(x * v) AS s FROM sig_64 e JOIN l USING (i) GROUP BY ALL) SELECT vec_id, i, round(sum(s * v), 6) AS x FROM p JOIN l USING (f) GROUP BY vec_id, i")
def reconstruct(spark, sf_dir):
    """Loadings times scores."""
    own = _loads(spark, sf_dir).select("f", "i", "v")
    s = views.sig_64(spark, sf_dir).join(F.broadcast(own), "i").groupBy("vec_id", "f").agg(F.sum(F.col("x") * F.col("v")).alias("s"))
    return s.join(F.broadcast(own), "f").groupBy("vec_id", "i").agg(F.round(F.sum(F.col("s") * F.col("v")), 6).alias("x"))
