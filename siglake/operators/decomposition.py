"""Factor decomposition: gram sums are distributed aggregates, the small eigenproblem is solved on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import complexity
from siglake.operators.spatial import with_neighbors

#: Variables up to which a dense covariance goes to the driver (72 MB); beyond, factors come from a randomised basis.
MOST_VARIABLES = 3000
#: Directions of that basis beyond the factors wanted, and its passes over the rows.
SPARE, PASSES = 10, 4


def _summed(df: DataFrame, vector: str, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a kernel of (rows, variables) that gives numbers of one size: by partition, by groups of partitions, then all.

    There are as many parts as the cluster has cores, 64 at least, and the driver gets one.
    """
    import pandas as pd

    context = df.sparkSession.sparkContext
    own = df.select(vector).coalesce(max(64, context.defaultParallelism))

    def partial(parts):
        total = None
        for p in parts:
            if len(p):
                got = kernel(np.stack(p[vector].to_list()).astype(float))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    def merged(parts):
        total = None
        for p in parts:
            for one in p["s"]:
                got = np.frombuffer(one)
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    sums = own.mapInPandas(partial, "s binary").repartition(8).mapInPandas(merged, "s binary").repartition(1).mapInPandas(merged, "s binary").first()
    if sums is None:
        raise ValueError("no rows to sum over")
    return np.frombuffer(sums["s"])


def _size(df: DataFrame, vector: str) -> int:
    row = df.select(vector).first()
    if row is None:
        raise ValueError("no rows to sum over")
    return len(row[0])


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, sample covariance, rows) of an array column, by partial sums of each Arrow batch."""
    size = _size(df, vector)
    if size > MOST_VARIABLES:
        raise ValueError(f"{size} variables are too many for a dense covariance; erp_pca takes them by a randomised basis")
    got = _summed(df, vector, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    n, s, g = got[0], got[1 : size + 1], got[size + 1 :].reshape(size, size)
    mean = s / n
    return mean, (g - n * np.outer(mean, mean)) / (n - 1), int(n)


def randomised(df: DataFrame, vector: str, k: int, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, k largest eigenvalues of the covariance, their vectors) by subspace iteration.

    A pass multiplies the covariance by k + SPARE directions without forming it, as sums of (variables, directions).
    """
    size = _size(df, vector)
    got = _summed(df, vector, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    n, mean = got[0], got[1 : size + 1] / got[0]
    sd = np.sqrt(np.maximum(got[size + 1 :] - n * mean**2, 0) / (n - 1))
    width = min(k + SPARE, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for last in [False] * passes + [True]:
        sent = df.sparkSession.sparkContext.broadcast((mean, q))  # variables x directions

        def product(x: np.ndarray, sent=sent) -> np.ndarray:
            mean, q = sent.value
            return ((x - mean).T @ ((x - mean) @ q)).ravel()

        y = _summed(df, vector, product).reshape(size, width) / (n - 1)
        sent.unpersist()
        if not last:
            q = np.linalg.qr(y)[0]
    values, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    return mean, sd, values[::-1][:k], (q @ vectors)[:, ::-1][:, :k]


@dataclass
class Factors:
    """Rotated loadings (variables, factors), explained variances, and the projection that gives scores."""

    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    projection: np.ndarray

    def scores(self, df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
        """keep and f0, f1, ...: standardised rows times the projection, as dot products with literal arrays."""
        z = lambda j: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in self.projection[:, j] / self.sd]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        shift = self.mean / self.sd @ self.projection
        return df.select(*keep, *[(z(j) - float(shift[j])).alias(f"f{j}") for j in range(self.projection.shape[1])])


def erp_pca(df: DataFrame, vector: str, n_factors: int | None = None, tol: float = 1e-4) -> Factors:
    """Covariance, eigenvectors, varimax, order by rotated variance, sign by the larger extreme.

    Over MOST_VARIABLES the eigenvectors come from a randomised basis, for which n_factors has to be given.
    """
    if _size(df, vector) > MOST_VARIABLES:
        if n_factors is None:
            raise ValueError("a randomised basis needs the number of factors")
        mean, sd, values, vectors = randomised(df, vector, n_factors)
    else:
        mean, cov, _ = covariance(df, vector)
        sd = np.sqrt(np.diag(cov))
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > tol * max(values[0], 1e-300)).sum())
    k = min(rank, n_factors or rank)
    rotated, _ = complexity.varimax(vectors[:, :k] * np.sqrt(values[:k]))
    variance = (rotated**2).sum(0)
    order = np.argsort(-variance)
    rotated, variance = redirected(rotated[:, order]), variance[order]
    sd = np.where(sd > 0, sd, 1)
    return Factors(mean, sd, rotated, variance, np.linalg.pinv((rotated / sd[:, None]).T))


def redirected(loadings: np.ndarray) -> np.ndarray:
    """Columns whose largest value is smaller in size than their least one change sign."""
    return np.where(np.abs(loadings.max(0)) < np.abs(loadings.min(0)), -1, 1) * loadings


def redirect(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same on long tables."""
    w = W.partitionBy(*keys)
    flip = F.abs(F.max(value).over(w)) < F.abs(F.min(value).over(w))
    return df.withColumn(value, F.when(flip, -F.col(value)).otherwise(F.col(value)))


def norm(value: str) -> Column:
    return F.sqrt(F.sum(F.col(value) * F.col(value)))


def peaks(loadings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, freq, ap, ml, norm: of loadings (keys, ap, ml, freq, v) the frequency of the largest mean, where it peaks, and the norm."""
    by_freq = loadings.groupBy(*keys, "freq").agg(F.avg("v").alias("m")).groupBy(*keys).agg(F.max_by("freq", F.struct("m", -F.col("freq"))).alias("freq"))
    at = loadings.join(by_freq, [*keys, "freq"]).groupBy(*keys, "freq").agg(F.max_by(F.struct("ap", "ml"), F.struct("v", -F.col("ap"), -F.col("ml"))).alias("at"))
    return at.join(loadings.groupBy(*keys).agg(norm("v").alias("norm")), keys).select(*keys, "freq", "at.ap", "at.ml", "norm")


def similarity(a: DataFrame, b: DataFrame, freq_threshold: float) -> DataFrame:
    """fa, fb, r: correlation of factors' spatial slices (f, freq, pos, v), 0 where frequencies differ by more than the threshold."""
    both = a.select(F.col("f").alias("fa"), F.col("freq").alias("qa"), "pos", F.col("v").alias("va")).join(b.select(F.col("f").alias("fb"), F.col("freq").alias("qb"), "pos", F.col("v").alias("vb")), "pos")
    r = F.when(F.abs(F.first("qa") - F.first("qb")) > freq_threshold, F.lit(0.0)).otherwise(F.corr("va", "vb"))
    return both.groupBy("fa", "fb").agg(r.alias("r"))


def remapping(similar: DataFrame) -> DataFrame:
    """fa, fb, r of the assignment of greatest total similarity; factors are few, so it is solved on the driver."""
    rows = similar.orderBy("fa", "fb").collect()
    fa, fb = sorted({r["fa"] for r in rows}), sorted({r["fb"] for r in rows})
    m = np.zeros((len(fa), len(fb)))
    for r in rows:
        m[fa.index(r["fa"]), fb.index(r["fb"])] = r["r"] or 0.0
    own = complexity.hungarian(-m) if len(fa) <= len(fb) else None
    pairs = [(i, int(j)) for i, j in enumerate(own)] if own is not None else [(int(i), j) for j, i in enumerate(complexity.hungarian(-m.T))]
    return similar.sparkSession.createDataFrame([(fa[i], fb[j], float(m[i, j])) for i, j in pairs], "fa int, fb int, r double")


def mismatch(r: Column, eps: float = 0.3) -> Column:
    """(1 - r)^2 where that is close, else 1."""
    return F.when(1 - r < eps, (1 - r) * (1 - r)).otherwise(F.lit(1.0))


def spikes(scores: DataFrame, keys: list[str], half: int) -> DataFrame:
    """keys, i, amp, width: strict local maxima, with the samples over half their height within `half` samples."""
    from siglake.operators.series import over

    w = over(keys, "i")
    top = (F.col("x") > F.lag("x").over(w)) & (F.col("x") > F.lead("x").over(w))
    around = F.collect_list("x").over(w.rowsBetween(-half, half))
    own = scores.withColumn("__top", top).withColumn("width", F.size(F.filter(around, lambda v: v > F.col("x") / 2)))
    return own.where("__top").select(*keys, "i", F.col("x").alias("amp"), F.col("width").cast("int").alias("width"))


def in_band(peaks: DataFrame, name: str, low: float, high: float, freq: str = "freq") -> DataFrame:
    """is_<name>: whether a factor's peak frequency is in [low, high)."""
    return peaks.withColumn(f"is_{name}", F.coalesce((F.col(freq) >= low) & (F.col(freq) < high), F.lit(False)))


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several recordings as one, with their names as rec."""
    out = None
    for rec, df in parts.items():
        own = df.withColumn("rec", F.lit(rec))
        out = own if out is None else out.unionByName(own)
    return out


def embedded(grid: DataFrame, keys: list[str], bad: str, half: int) -> DataFrame:
    """The electrodes whose square window of 2 half + 1 lies within the grid and holds no bad one."""
    reach = range(-half, half + 1)
    near = with_neighbors(grid.select(*keys, "ap", "ml", bad), keys, [(a, m) for a in reach for m in reach], bad, "__bad")
    whole = near.groupBy(*keys, "ap", "ml").agg(F.count("*").alias("__n"), F.bool_or("__bad").alias("__any"))
    return whole.where((F.col("__n") == (2 * half + 1) ** 2) & ~F.col("__any")).drop("__n", "__any")
