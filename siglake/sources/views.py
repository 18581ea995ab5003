"""Signal, grid, point-process and interval views over the star-schema tables, and the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> F.Column:
    """Seconds since the epoch of a timestamp, in UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("t"), F.col("value").alias("x"))


def sig_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i, t, x: each user's values as a series, by time."""
    i = F.row_number().over(W.partitionBy("user_id").orderBy("t", "event_id")).cast("long") - 1
    return events(spark, sf_dir).select("user_id", i.alias("i"), "t", "x")


def sig_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, ap, ml, x: each embedding as an 8 x 8 grid."""
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return flat.select("vec_id", F.floor(F.col("pos") / 8).cast("int").alias("ap"), (F.col("pos") % 8).cast("int").alias("ml"), F.col("v").cast("double").alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding: each frame of sig_grid as it is stored; dealt out, as one file may hold all."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition("vec_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, r: the rows (ap, ml, x) of each of `vectors`."""
    own = vectors(spark, sf_dir)
    row = lambda v, i: F.struct(F.floor(i / 8).cast("int").alias("ap"), (i % 8).cast("int").alias("ml"), v.cast("double").alias("x"))
    return own.select("vec_id", F.transform("embedding", row).alias("r"))


def sig_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, i, x: each embedding as a series of 64 samples."""
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return flat.select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("x"))


def sig_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, i, x: mean value of each hour, 0 in hours without an event."""
    hourly = events(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600).cast("long")).groupBy("event_type", "h").agg(F.avg("x").alias("x"))
    span = hourly.agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    axis = hourly.select("event_type").distinct().join(F.broadcast(span)).select("event_type", "h0", F.explode(F.sequence("h0", "h1")).alias("h"))
    return axis.join(hourly, ["event_type", "h"], "left").select("event_type", (F.col("h") - F.col("h0")).alias("i"), F.coalesce("x", F.lit(0.0)).alias("x"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, event_id, t, x: five point processes."""
    return events(spark, sf_dir).select("event_type", "event_id", "t", "x")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, state, iseg, t0, t1: runs of one event type of a user; a run lasts until the next one begins."""
    by_time = W.partitionBy("user_id").orderBy("t", "event_id")
    new = F.when(F.lag("event_type").over(by_time) == F.col("event_type"), 0).otherwise(1)
    starts = events(spark, sf_dir).withColumn("new", new).withColumn("end", F.max("t").over(W.partitionBy("user_id"))).where("new = 1")
    runs = starts.select("user_id", F.col("event_type").alias("state"), F.col("t").alias("t0"), F.coalesce(F.lead("t").over(by_time), F.col("end")).alias("t1"), "event_id")
    iseg = F.row_number().over(W.partitionBy("user_id", "state").orderBy("t0", "event_id")).cast("long") - 1
    return runs.select("user_id", "state", iseg.alias("iseg"), "t0", "t1")


SQL = {
    "ev": "SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, value AS x FROM events",
    "sig_ev": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, t, x FROM ev",
    "sig_flat": "SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "sig_grid": "SELECT vec_id, (i // 8)::INT AS ap, (i % 8)::INT AS ml, x FROM sig_flat",
    "sig_64": "SELECT vec_id, i, x FROM sig_flat",
    "hourly": "SELECT event_type, floor(t / 3600)::BIGINT AS h, avg(x) AS x FROM ev GROUP BY ALL",
    "sig_hr": "SELECT event_type, h - h0 AS i, coalesce(x, 0) AS x FROM (SELECT DISTINCT event_type FROM hourly) CROSS JOIN (SELECT min(h) AS h0, unnest(range(min(h), max(h) + 1)) AS h FROM hourly) LEFT JOIN hourly USING (event_type, h)",
    "points": "SELECT event_type, event_id, t, x FROM ev",
    "intervals": """SELECT user_id, state, row_number() OVER (PARTITION BY user_id, state ORDER BY t0, event_id) - 1 AS iseg, t0, t1 FROM (
      SELECT user_id, event_type AS state, t AS t0, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), last_t) AS t1, event_id FROM (
        SELECT *, max(t) OVER (PARTITION BY user_id) AS last_t, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM ev)
      WHERE prev IS DISTINCT FROM event_type)""",
}
NEEDS = {"sig_ev": ["ev"], "sig_grid": ["sig_flat"], "sig_64": ["sig_flat"], "hourly": ["ev"], "sig_hr": ["hourly"], "points": ["ev"], "intervals": ["ev"]}
