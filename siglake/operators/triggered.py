"""Event-triggered epochs, templates and their removal; regression on lagged references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.operators.series import over

TINY = 1e-30


def epochs(samples: DataFrame, events: DataFrame, keys: list[str], n_pre: int, n_post: int, event: str = "event_id", center: str = "i0") -> DataFrame:
    """keys, event, lag, x: the samples about each event (keys, event, center: a sample index); null where there is none."""
    wanted = events.select(*keys, event, F.explode(F.sequence(F.lit(-n_pre), F.lit(n_post))).alias("lag"), F.col(center).alias("__c"))
    wanted = wanted.select(*keys, event, "lag", (F.col("__c") + F.col("lag")).cast("long").alias("i"))
    return wanted.join(samples.select(*keys, F.col("i").cast("long").alias("i"), F.nanvl("x", F.lit(None)).alias("x")), [*keys, "i"], "left").drop("i")


def perievent(samples: DataFrame, events: DataFrame, keys: list[str], fs: float, pre: float, post: float, event: str = "event_id", t: str = "t") -> DataFrame:
    """Epochs of regular series (sample i at i / fs) about event times; the later of two equally near samples is the centre."""
    center = F.floor(F.col(t) * fs + 0.5).cast("long")
    return epochs(samples, events.withColumn("__i", center), keys, round(pre * fs), round(post * fs), event, "__i")


def statistics(ep: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lag with average, deviation (n - 1), median and signal-to-noise over events; n counts all events for the last."""
    avg, sd = F.avg("x"), F.stddev_samp("x")
    snr = avg / F.greatest(sd / F.sqrt(F.count("*")), F.lit(1e-12))
    return ep.groupBy(*keys, "lag").agg(avg.alias("average"), sd.alias("deviation"), F.median("x").alias("median"), snr.alias("snr"), F.count("*").alias("n"))


def template(ep: DataFrame, keys: list[str], method: str = "mean", trim: float = 0.1) -> DataFrame:
    """keys, lag, template by mean, median or trimmed mean (a tenth off both ends, whole samples)."""
    if method != "trimmean":
        return ep.groupBy(*keys, "lag").agg((F.avg if method == "mean" else F.median)("x").alias("template"))
    w = W.partitionBy(*keys, "lag")
    cut = F.floor(F.count("*").over(w) * trim)
    ranked = ep.withColumn("__cut", cut).withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("x")))
    return ranked.where("__r > __cut and __r <= __n - __cut").groupBy(*keys, "lag").agg(F.avg("x").alias("template"))


def scaling(ep: DataFrame, tmpl: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """keys, event, scale: least-squares factor of the template in each epoch; 0 for a template of no energy."""
    both = ep.join(tmpl, [*keys, "lag"])
    energy = F.sum(F.col("template") * F.col("template"))
    return both.groupBy(*keys, event).agg(F.when(energy < TINY, F.lit(0.0)).otherwise(F.sum(F.col("x") * F.col("template")) / F.nullif(energy, F.lit(0.0))).alias("scale"))


def laid(events: DataFrame, tmpl: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once for each sample k of its keys' template; without keys, of the one template, met sample by sample."""
    if keys:
        return events.join(tmpl, keys)
    ends = tmpl.agg(F.coalesce(F.min("k"), F.lit(0)).alias("a"), F.coalesce(F.max("k"), F.lit(0)).alias("b")).first()
    return events.withColumn("k", F.explode(F.sequence(F.lit(ends["a"]), F.lit(ends["b"])))).join(tmpl, "k")


def placed(events: DataFrame, tmpl: DataFrame, keys: list[str], start: str, scale: str | None = None) -> DataFrame:
    """keys, i, add: templates (keys, k from 0, template) laid down at each event's start, overlaps summed."""
    factor = F.col(scale) if scale else F.lit(1.0)
    out = laid(events, tmpl, keys)
    return out.select(*keys, (F.col(start) + F.col("k")).cast("long").alias("i"), (factor * F.col("template")).alias("__v")).groupBy(*keys, "i").agg(F.sum("__v").alias("add"))


def without_template(samples: DataFrame, events: DataFrame, tmpl: DataFrame, keys: list[str], start: str, scale: str | None = None) -> DataFrame:
    """samples with x less the templates at each event; events whose template would cross an edge are left out."""
    bounds = samples.groupBy(*keys).agg(F.max("i").alias("__last"))
    length = tmpl.groupBy(*keys).agg(F.max("k").alias("__k"))
    own = events.join(bounds, keys).join(length, keys).where((F.col(start) >= 0) & (F.col(start) + F.col("__k") <= F.col("__last"))).drop("__last", "__k")
    return samples.join(placed(own, tmpl, keys, start, scale), [*keys, "i"], "left").withColumn("x", F.col("x") - F.coalesce("add", F.lit(0.0))).drop("add")


def lagged(x: str, lags: list[int], w: W) -> list[Column]:
    """Columns x0, x1, ... with x a lag before, 0 beyond the ends."""
    return [F.coalesce(F.lag(x, k).over(w) if k >= 0 else F.lead(x, -k).over(w), F.lit(0.0)).alias(f"x{j}") for j, k in enumerate(lags)]


def lagged_design(samples: DataFrame, keys: list[str], lags: list[int], value: str = "x", intercept: bool = True) -> DataFrame:
    own = samples.select(*samples.columns, *lagged(value, lags, over(keys, "i")))
    return own.withColumn("one", F.lit(1.0)) if intercept else own


def event_design(events: DataFrame, tmpl: DataFrame, keys: list[str], start: str, n_time: int, event: str = "event_id") -> DataFrame:
    """keys, i, event, value: a sparse design with a column for each event, the template cut at the ends."""
    out = laid(events, tmpl, keys)
    return out.select(*keys, (F.col(start) + F.col("k")).cast("long").alias("i"), event, F.col("template").alias("value")).where((F.col("i") >= 0) & (F.col("i") < n_time))


def ols_coefficients(df: DataFrame, x: list[str], y: str, keys: list[str]) -> DataFrame:
    """keys, beta: least-squares coefficients of minimum norm of each key, solved where its one row of gram sums is."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"__g{i}_{j}") for i, j in pairs] + [F.sum(F.col(a) * F.col(y)).alias(f"__y{i}") for i, a in enumerate(x)]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            g = np.zeros((len(p), len(x), len(x)))
            for i, j in pairs:
                g[:, i, j] = g[:, j, i] = p[f"__g{i}_{j}"].astype(float)
            of = p[[f"__y{i}" for i in range(len(x))]].to_numpy(dtype=float)
            yield p[keys].assign(beta=[np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(g, of, strict=True)])

    schema = ", ".join([*(f"{k} {kind[k]}" for k in keys), "beta array<double>"])
    return df.groupBy(*keys).agg(*sums).mapInPandas(solve, schema)


def ols_fit(df: DataFrame, x: list[str], y: str) -> np.ndarray:
    """Coefficients over all rows."""
    return np.array(ols_coefficients(df, x, y, []).first()["beta"])


def ols_predict(df: DataFrame, x: list[str], beta: np.ndarray, out: str = "fit") -> DataFrame:
    total = F.lit(0.0)
    for c, b in zip(x, beta, strict=True):
        total = total + F.col(c) * float(b)
    return df.withColumn(out, total)


def ols_residual(df: DataFrame, x: list[str], y: str, beta: np.ndarray, out: str = "residual") -> DataFrame:
    return ols_predict(df, x, beta, "__fit").withColumn(out, F.col(y) - F.col("__fit")).drop("__fit")
