"""The processing chain of a window of a grid signal: samples (ap, ml, i, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siglake.functions import dsp
from siglake.operators import kernels, series, spatial

PLACES = ["ap", "ml"]


def window(
    samples: DataFrame, fs: float, i0: int, i1: int, shape: tuple[int, int], reference: bool = True, band: tuple[float, float] | None = None,
    notches: list[float] | None = None, median: int | None = None, zscore: bool = True, channels: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """ap, ml, i, x of the closed window: less the common median, band-passed, notched, smoothed by a spatial median, standardised.

    Steps are in this order, each left out by its argument. Channels are picked last, as the others take part until then.
    """
    out = samples.where(F.col("i").between(i0, i1)).select(*PLACES, "i", "x")
    if reference:
        out = out.withColumn("x", F.col("x") - F.median("x").over(W.partitionBy("i")))
    if band or notches:
        def filtered(x):
            x = dsp.bandpass(x, fs, *band) if band else x
            return dsp.notches(x, fs, notches) if notches else x

        out = kernels.transformed(out, PLACES, filtered).withColumnRenamed("y", "x")
    if median:
        out = spatial.median_filter(out, ["i"], median, *shape).select(*PLACES, "i", F.col("y").alias("x"))
    if zscore:
        out = series.zscorex(out, PLACES, "x").drop("x").withColumnRenamed("z", "x")
    return out if channels is None else out.where(F.struct(*PLACES).isin([F.struct(F.lit(a), F.lit(m)) for a, m in channels]))


def described(reference: bool = True, band: tuple[float, float] | None = None, notches: list[float] | None = None, median: int | None = None, zscore: bool = True) -> str:
    """The active steps in words."""
    steps = [("common median reference", reference), (f"band-pass {band}", band), (f"notches {notches}", notches), (f"spatial median {median}", median), ("z-score", zscore)]
    return ", ".join(s for s, on in steps if on) or "raw"
