"""Table kinds, their columns, and checks at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of each kind of table, with their types.
KINDS: dict[str, dict[str, str]] = {
    "grid_signal": {"i": "bigint", "t": "double", "ap": "int", "ml": "int", "x": "double"},
    "flat_signal": {"i": "bigint", "t": "double", "ch": "int", "x": "double"},
    "multichannel": {"ch": "int", "i": "bigint", "t": "double", "x": "double"},
    "grid_windowed": {"win": "bigint", "t_win": "double", "ap": "int", "ml": "int"},
    "multichannel_windowed": {"win": "bigint", "t_win": "double", "ch": "int"},
    "time_channel": {"i": "bigint", "t": "double", "ch": "int", "ap": "int", "ml": "int", "x": "double"},
    "spectrogram4d": {"ml": "int", "ap": "int", "t": "double", "freq": "double", "p": "double"},
    "grid_windowed_spectrum": {"t_win": "double", "ap": "int", "ml": "int", "freq": "double", "p": "double"},
    "burst_peaks": {"burst_id": "string", "x": "double", "y": "double", "t": "double", "z": "double", "value": "double"},
    "event": {"event_id": "string", "t": "double"},
    "interval_event": {"event_id": "string", "t": "double", "t0": "double", "t1": "double", "duration": "double"},
    "interval": {"state": "string", "iseg": "bigint", "t0": "double", "t1": "double"},
}
#: Other names that columns go by.
ALIASES = {"AP": "ap", "ML": "ml", "time": "t", "time_win": "t_win", "channel": "ch", "frequency": "freq"}


def validate(df: DataFrame, kind: str, required: tuple[str, ...] = (), metadata: dict | None = None) -> None:
    """Raises unless df has the kind's columns with their types, and the metadata its required keys."""
    have = dict(df.dtypes)
    missing = [c for c in KINDS[kind] if c not in have]
    wrong = [f"{c} is {have[c]}, not {t}" for c, t in KINDS[kind].items() if c in have and have[c] != t]
    lost = [k for k in required if k not in (metadata or {})]
    if missing or wrong or lost:
        raise ValueError(f"no {kind}: missing {missing}, {'; '.join(wrong)}, metadata without {lost}")


def coerce(df: DataFrame, kind: str) -> DataFrame:
    """df with the kind's names, types and order of columns; others follow."""
    df = df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b in KINDS[kind] and b not in df.columns})
    first = [F.col(c).cast(t).alias(c) for c, t in KINDS[kind].items()]
    return df.select(*first, *[c for c in df.columns if c not in KINDS[kind]])


def with_time(df: DataFrame, fs: float) -> DataFrame:
    """t = i / fs where there is no t."""
    if fs <= 0:
        raise ValueError("fs must be positive")
    return df if "t" in df.columns else df.withColumn("t", F.col("i") / float(fs))


def sampling_frequency(df: DataFrame, keys: list[str], metadata: dict | None = None) -> float:
    """From the metadata, else one over the median positive step."""
    if metadata and metadata.get("fs"):
        return float(metadata["fs"])
    step = df.select((F.lead("t").over(W.partitionBy(*keys).orderBy("i")) - F.col("t")).alias("d")).where("d > 0")
    return 1 / step.agg(F.median("d")).first()[0]


def not_increasing(df: DataFrame, keys: list[str], order: str = "i", t: str = "t") -> DataFrame:
    """keys, n: how often time doesn't increase; keys without a fault give none."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("__n", F.lead(t).over(w)).where(F.col("__n") <= F.col(t)).groupBy(*keys).agg(F.count("*").alias("n"))


def save(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Parquet, partitioned by recording and channel, so that filters on them prune folders."""
    df.write.mode(mode).partitionBy(*keys).parquet(path)
