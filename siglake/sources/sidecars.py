"""Metadata beside recordings: JSON and tab-separated sidecars, XML descriptions, channel maps, units."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siglake.sources.binary import opened

# Fixed values of the sidecar format: the keys that count channels by type.
COUNT_KEYS = ("ECOGChannelCount", "SEEGChannelCount", "EEGChannelCount", "EOGChannelCount", "ECGChannelCount", "EMGChannelCount", "MiscChannelCount", "TriggerChannelCount")


def read_json_metadata(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    row = spark.read.json(path, multiLine=True).first()
    meta = {k: v for k, v in row.asDict(recursive=True).items() if v is not None} if row else {}
    if missing := [k for k in required if k not in meta]:
        raise KeyError(f"{path} lacks {missing}")
    return meta


def write_json_metadata(path: str, meta: dict) -> None:
    store, inner = opened(path)
    with store.open_output_stream(inner) as out:
        out.write((json.dumps(meta, indent=2) + "\n").encode())


def with_sampling_frequency(meta: dict, fs: float, extra: dict | None = None) -> dict:
    return {**meta, "SamplingFrequency": float(fs), **(extra or {})}


def channel_count(meta: dict) -> int:
    """Sum of the counts by type, else the one old key."""
    own = [int(meta[k]) for k in COUNT_KEYS if meta.get(k) is not None]
    if own:
        return sum(own)
    if meta.get("ChannelCount") is not None:
        return int(meta["ChannelCount"])
    raise KeyError("no channel count")


def sidecar_paths(recording: str, datatypes: tuple[str, ...] = ("ieeg", "lfp", "ecephys")) -> dict[str, str]:
    """Paths of the sidecars of a recording, whose name may end in a data type."""
    stem = recording.rsplit(".", 1)[0]
    base = next((stem[: -len(d) - 1] for d in datatypes if stem.endswith(f"_{d}")), stem)
    return {"json": f"{stem}.json", "channels": f"{base}_channels.tsv", "electrodes": f"{base}_electrodes.tsv", "xml": f"{stem}.xml"}


def sidecar_columns(recording: Column, datatypes: tuple[str, ...] = ("ieeg", "lfp", "ecephys")) -> list[Column]:
    """The same paths, for a column of recordings."""
    stem = F.regexp_replace(recording, r"\.[^.]*$", "")
    base = F.regexp_replace(stem, f"_({'|'.join(datatypes)})$", "")
    named = {"json": (stem, ".json"), "channels": (base, "_channels.tsv"), "electrodes": (base, "_electrodes.tsv"), "xml": (stem, ".xml")}
    return [F.concat(c, F.lit(end)).alias(kind) for kind, (c, end) in named.items()]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, nullValue="n/a")


def channel_dtype(channels: DataFrame) -> str | None:
    """First data type that a channel names."""
    return channels.agg(F.first("dtype", True)).first()[0] if "dtype" in channels.columns else None


def electrode_axis(electrodes: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """by, value: mean coordinate of each row or column, null where none has one, for all n."""
    axis = electrodes.sparkSession.range(n).select(F.col("id").cast("int").alias(by))
    own = electrodes.groupBy(F.col(by).cast("int").alias(by)).agg(F.avg(F.col(value).cast("double")).alias(value))
    return axis.join(own, by, "left")


def volts(x: Column, unit: Column | str) -> Column:
    """Microvolts scaled, volts as they are; any other unit fails the query."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    wrong = F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(unit, F.lit("null")))).cast("double")
    return F.when(unit.isin("uV", "µV", "μV"), x * 1e-6).when(unit == "V", x).otherwise(wrong)


def parse_xml(text: str) -> dict:
    """fs, n_channels, dtype and anatomical groups of an acquisition description."""
    root = ET.fromstring(text)
    acquisition = root.find("acquisitionSystem")
    bits, channels, fs = (acquisition.findtext(k) for k in ("nBits", "nChannels", "samplingRate"))
    groups = [[(int(c.text), int(c.get("skip", "0"))) for c in g.findall("channel")] for g in root.findall("anatomicalDescription/channelGroups/group")]
    return {"fs": float(fs), "n_channels": int(channels), "dtype": f"int{int(bits)}", "ncol": len(groups), "nrow": max(map(len, groups), default=0), "groups": groups}


def anatomical_map(spark: SparkSession, meta: dict) -> DataFrame:
    """ap, ml, ch, skip: a column of the grid for each group."""
    rows = [(a, m, ch, bool(skip)) for m, g in enumerate(meta["groups"]) for a, (ch, skip) in enumerate(g)]
    return spark.createDataFrame(rows, "ap int, ml int, ch int, skip boolean")


def with_skipped(anat: DataFrame, bad: list[int]) -> DataFrame:
    return anat.withColumn("skip", F.col("ch").isin(bad))


def map_order(anat: DataFrame) -> str | None:
    """C if channels rise row by row, F if column by column, else None."""
    from pyspark.sql import Window as W

    rises = lambda *order: F.bool_and(F.coalesce(F.col(f"n_{order[0]}") > F.col("ch"), F.lit(True)))
    own = anat.withColumn("n_ap", F.lead("ch").over(W.partitionBy(F.lit(1)).orderBy("ap", "ml"))).withColumn("n_ml", F.lead("ch").over(W.partitionBy(F.lit(1)).orderBy("ml", "ap")))
    c, f = own.agg(rises("ap"), rises("ml")).first()
    return "C" if c else "F" if f else None


def remapped(samples: DataFrame, anat: DataFrame) -> DataFrame:
    """samples (i, ch, x) with ap and ml by a channel map of one grid."""
    return samples.drop("ap", "ml").join(F.broadcast(anat.select("ch", "ap", "ml")), "ch")


def free_name(folder_names: set[str], name: str, suffix: str, overwrite: bool = False) -> str:
    """name_suffix, with (1), (2) and so on where that is taken."""
    stem, dot, ext = name.partition(".")
    out, k = f"{stem}_{suffix}{dot}{ext}", 0
    while not overwrite and out in folder_names:
        k += 1
        out = f"{stem}_{suffix}({k}){dot}{ext}"
    return out
