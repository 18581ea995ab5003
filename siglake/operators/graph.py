"""Connected components of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.session import shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Nodes that a task of `forest` holds at once.
MOST_NODES = 500_000


def forest(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: fewer pairs that reach the same nodes, one for each node of a task and component, without those that close a circle in it.

    Nodes meet again in other tasks, so this is no `components`; it is what needn't be shuffled for them.
    """
    import pyarrow as pa

    def run(batches):
        up, schema = {}, None

        def root(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def kept():
            rows = [(x, y) for x in up if (y := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in (0, 1)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i, j = root(up.setdefault(i, i)), root(up.setdefault(j, j))
                if i != j:
                    up[max(i, j)] = min(i, j)
            if len(up) > MOST_NODES:
                yield kept()
                up.clear()
        if up:
            yield kept()

    own = pairs.select(a, b).where(F.col(a) != F.col(b))
    return own.mapInArrow(run, own.schema)


def components(pairs: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, cluster: the smallest node that each node of the pairs reaches, by alternating star contractions.

    A round is two aggregates and two joins on the edges alone; one count and checksum reaches the driver.
    """
    edges = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    nodes = pairs.select(F.col(a).alias("node")).union(pairs.select(F.col(b))).distinct()
    edges, before = checkpointed(edges), None
    for _ in range(most_rounds):
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m").distinct()
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(low, "u").select(F.when(F.col("m") == F.col("low"), F.col("u")).otherwise(F.col("m")).alias("hi"), F.col("low").alias("lo"))
        edges = checkpointed(small.where("hi <> lo").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            return nodes.join(edges.withColumnRenamed("hi", "node"), "node", "left").select("node", F.coalesce("lo", "node").alias("cluster"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
