"""Queries of sources, sidecars and kinds of tables: files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.operators import windows
from siglake.plans.registry import query
from siglake.session import own_path
from siglake.sources import binary, schema, sidecars, views

FS = 1000.0

# A recording of 64 channels, whose frames are the vectors.
REC = "rec AS (SELECT vec_id AS i, i::INT AS ch, round(x * 1000)::SMALLINT::DOUBLE AS x FROM sig_64)"


def _recording(spark, sf_dir):
    return views.sig_64(spark, sf_dir).select(F.col("vec_id").alias("i"), F.col("i").cast("int").alias("ch"), F.round(F.col("x") * 1000).alias("x"))


def _saved(spark, sf_dir, dtype="int16", samples=None) -> str:
    """A folder that holds the recording as flat binary parts."""
    path = own_path(spark, "recording")
    samples = _recording(spark, sf_dir) if samples is None else samples
    binary.write(samples, path, 64, dtype).agg(F.sum("frames")).first()
    return path


@query(f"{REC} SELECT i, i / 1000::DOUBLE AS t, ch, (ch % 8)::INT AS ap, (ch // 8)::INT AS ml, x FROM rec")
def flat_binary_grid(spark, sf_dir):
    """int16 frames on a grid, read by ranges of frames of each part."""
    return binary.read(spark, _saved(spark, sf_dir), rows=8, cols=8, fs=FS, task_samples=10_000)


@query("SELECT vec_id AS i, vec_id / 1000::DOUBLE AS t, i::INT AS ch, x FROM sig_64")
def flat_binary_channels(spark, sf_dir):
    """float32 frames of channels without a grid."""
    own = views.sig_64(spark, sf_dir).select(F.col("vec_id").alias("i"), F.col("i").cast("int").alias("ch"), "x")
    return binary.read(spark, _saved(spark, sf_dir, "float32", own), channels=64, dtype="float32", fs=FS).drop("ap", "ml")


@query(f"{REC} SELECT CASE WHEN ch < 48 THEN 'grid' ELSE 'probe' END AS device, i, (CASE WHEN ch < 48 THEN ch ELSE ch - 48 END)::INT AS ch, x FROM rec")
def split_recording(spark, sf_dir):
    """A combined recording's grid and probe."""
    grid, probe = binary.split_channels(binary.read(spark, _saved(spark, sf_dir), channels=64), 48)
    return grid.withColumn("device", F.lit("grid")).unionByName(probe.withColumn("device", F.lit("probe"))).select("device", "i", "ch", "x")


@query(f"{REC} SELECT ch, i, x FROM rec WHERE ch IN (3, 9)")
def recording_by_channel(spark, sf_dir):
    """A flat recording saved as Parquet by channel; two channels read back, so that the other folders are pruned."""
    path = own_path(spark, "by-channel")
    schema.save(binary.read(spark, _saved(spark, sf_dir), channels=64).select("ch", "i", "x"), path, ["ch"])
    return spark.read.parquet(path).where("ch in (3, 9)").select("ch", "i", "x")


@query("SELECT count(DISTINCT user_id) + count(DISTINCT event_type) AS n_channels, 1250::DOUBLE AS fs FROM ev")
def sidecar_metadata(spark, sf_dir):
    """A JSON sidecar written, its sampling frequency set, and read back; counts by type go before the old key."""
    n = views.events(spark, sf_dir).agg(F.count_distinct("user_id"), F.count_distinct("event_type")).first()
    path = own_path(spark, "sidecar") + ".json"
    sidecars.write_json_metadata(path, sidecars.with_sampling_frequency({"ECOGChannelCount": n[0], "MiscChannelCount": n[1], "ChannelCount": 1}, 1250))
    meta = sidecars.read_json_metadata(spark, path, ("SamplingFrequency",))
    return spark.createDataFrame([(sidecars.channel_count(meta), meta["SamplingFrequency"])], "n_channels long, fs double")


@query(
    """p AS (SELECT DISTINCT user_id, 'sub-' || user_id || '/run.1' AS base, CASE user_id % 3 WHEN 0 THEN '_ieeg' WHEN 1 THEN '_lfp' ELSE '_raw' END AS kind FROM ev), s AS (SELECT user_id, base || kind AS stem, CASE user_id % 3 WHEN 2 THEN base || kind ELSE base END AS own FROM p)
  SELECT user_id, stem || '.json' AS json, stem || '.xml' AS xml, own || '_channels.tsv' AS channels, own || '_electrodes.tsv' AS electrodes FROM s"""
)
def resolve_sidecars(spark, sf_dir):
    """Paths of the sidecars of each user's recording."""
    kind = F.when(F.col("user_id") % 3 == 0, "_ieeg").when(F.col("user_id") % 3 == 1, "_lfp").otherwise("_raw")
    own = views.events(spark, sf_dir).select("user_id").distinct().withColumn("path", F.concat(F.lit("sub-"), F.col("user_id").cast("string"), F.lit("/run.1"), kind, F.lit(".dat")))
    return own.select("user_id", *sidecars.sidecar_columns(F.col("path")))


@query(
    """e AS (SELECT ap, ml, round(avg(x) * 1000, 3) AS v FROM sig_grid GROUP BY ap, ml)
  SELECT k::INT AS row, (SELECT round(avg(v), 6) FROM e WHERE ap = k AND ap <> 5) AS AP FROM range(9) r(k)"""
)
def electrode_axis(spark, sf_dir):
    """Mean coordinate of each row of a grid by a tab-separated sidecar, null where no electrode has one."""
    e = views.sig_grid(spark, sf_dir).groupBy(F.col("ap").alias("row"), F.col("ml").alias("col")).agg(F.round(F.avg("x") * 1000, 3).alias("AP"))
    path = own_path(spark, "electrodes")
    e.withColumn("AP", F.when(F.col("row") != 5, F.col("AP"))).write.csv(path, sep="\t", header=True, nullValue="n/a")
    return sidecars.electrode_axis(sidecars.read_tsv(spark, path), "row", "AP", 9).withColumn("AP", F.round("AP", 6))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN x ELSE x * 1e-6 END AS v FROM ev")
def scale_to_volts(spark, sf_dir):
    unit = F.when(F.col("event_type") == "error", "V").when(F.col("event_type") == "view", "µV").otherwise("uV")
    return views.events(spark, sf_dir).select("event_id", sidecars.volts(F.col("x"), unit).alias("v"))


#: Channel of each place, in order of place; a column of the grid after another.
PLACED = [(k * 37 + 5) % 64 for k in range(64)]
MAP = "am AS (SELECT (k % 8)::INT AS ap, (k // 8)::INT AS ml, ((k * 37 + 5) % 64)::INT AS ch FROM range(64) r(k))"


def _map(spark):
    """A channel map, by way of the XML that describes it."""
    groups = "".join("<group>" + "".join(f'<channel skip="{int(ch % 10 == 3)}">{ch}</channel>' for ch in PLACED[m * 8 : m * 8 + 8]) + "</group>" for m in range(8))
    head = "<acquisitionSystem><nBits>16</nBits><nChannels>64</nChannels><samplingRate>1250</samplingRate></acquisitionSystem>"
    return sidecars.anatomical_map(spark, sidecars.parse_xml(f"<parameters>{head}<anatomicalDescription><channelGroups>{groups}</channelGroups></anatomicalDescription></parameters>"))


@query(f"{MAP} SELECT ap, ml, ch, ch % 10 = 3 AS skip FROM am")
def anatomical_map(spark, sf_dir):
    return _map(spark)


@query(f"{MAP} SELECT ap, ml, ch, ch IN (5, 17) AS skip FROM am")
def update_anatomical_map(spark, sf_dir):
    return sidecars.with_skipped(_map(spark), [5, 17])


@query(f"{REC}, {MAP} SELECT i, ch, ap, ml, x FROM rec JOIN am USING (ch)")
def remap_channels(spark, sf_dir):
    """Channels of a flat recording put in their places."""
    own = binary.read(spark, _saved(spark, sf_dir), channels=64)
    return sidecars.remapped(own, _map(spark)).select("i", "ch", "ap", "ml", "x")


@query("SELECT vec_id, i, i / 100::DOUBLE AS t, x FROM sig_64")
def ensure_time_coord(spark, sf_dir):
    return schema.with_time(views.sig_64(spark, sf_dir), 100).select("vec_id", "i", "t", "x")


@query("s AS (SELECT user_id, floor(t / 20000) AS t, lead(floor(t / 20000)) OVER (PARTITION BY user_id ORDER BY i) AS n FROM sig_ev) SELECT user_id, count(*) AS n FROM s WHERE n <= t GROUP BY user_id")
def time_not_increasing(spark, sf_dir):
    """How often the time of a series of coarse time stamps doesn't increase."""
    return schema.not_increasing(views.sig_ev(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 20000)), ["user_id"])


def _kind(kind: str, table, columns: str) -> None:
    """A query that brings a table under other names and types into a kind, and checks it."""

    def run(spark, sf_dir):
        own = schema.coerce(table(spark, sf_dir), kind)
        schema.validate(own, kind)
        return own

    query(columns, f"coerce_{kind}")(run)


def _grid(spark, sf_dir):
    return views.sig_grid(spark, sf_dir).select(F.col("vec_id").cast("string").alias("i"), (F.col("vec_id") / 100).alias("time"), F.col("ap").cast("long").alias("AP"), F.col("ml").cast("string").alias("ML"), "x")


def _flat(spark, sf_dir):
    return views.sig_64(spark, sf_dir).select(F.col("i").alias("channel"), F.col("vec_id").alias("i"), (F.col("vec_id") / 100).cast("string").alias("time"), "x")


def _windowed(spark, sf_dir):
    own = views.sig_grid(spark, sf_dir).select("ap", "ml", F.col("vec_id").alias("n"), "x")
    got = windows.running_reduce(own, ["ap", "ml"], 50, 25, "n", m=F.max("x"))
    return got.select(F.col("win").cast("int").alias("win"), ((F.col("win") * 25 + 24.5) / 100).alias("time_win"), F.col("ap").cast("long").alias("AP"), F.col("ml").cast("long").alias("ML"), "m")


WINDOWED = "w AS (SELECT win, (win * 25 + 24.5::DOUBLE) / 100 AS t_win, ap, ml, max(x) AS m FROM sig_grid JOIN (SELECT unnest(range(0, (max(vec_id) + 1 - 50) // 25 + 1)) AS win FROM sig_grid) ON vec_id >= win * 25 AND vec_id < win * 25 + 50 GROUP BY ALL)"


def _spectrum(time: str):
    def table(spark, sf_dir):
        return views.sig_grid(spark, sf_dir).select((F.col("vec_id") / 10).alias(time), F.lit("0").alias("AP"), F.col("ml").alias("ML"), F.col("ap").alias("frequency"), F.pow("x", F.lit(2)).alias("p"))

    return table


_kind("grid_signal", _grid, "SELECT vec_id AS i, vec_id / 100::DOUBLE AS t, ap, ml, x FROM sig_grid")
_kind("flat_signal", _flat, "SELECT vec_id AS i, vec_id / 100::DOUBLE AS t, i::INT AS ch, x FROM sig_64")
_kind("multichannel", _flat, "SELECT i::INT AS ch, vec_id AS i, vec_id / 100::DOUBLE AS t, x FROM sig_64")
_kind("time_channel", lambda s, d: _flat(s, d).withColumn("AP", F.floor(F.col("channel") / 8)).withColumn("ML", F.col("channel") % 8), "SELECT vec_id AS i, vec_id / 100::DOUBLE AS t, i::INT AS ch, (i // 8)::INT AS ap, (i % 8)::INT AS ml, x FROM sig_64")
_kind("grid_windowed", _windowed, f"{WINDOWED} SELECT win, t_win, ap, ml, m FROM w")
_kind("multichannel_windowed", lambda s, d: _windowed(s, d).withColumn("channel", F.col("AP") * 8 + F.col("ML")).drop("AP", "ML"), f"{WINDOWED} SELECT win, t_win, (ap * 8 + ml)::INT AS ch, m FROM w")
_kind("spectrogram4d", _spectrum("time"), "SELECT ml, 0 AS ap, vec_id / 10::DOUBLE AS t, ap::DOUBLE AS freq, power(x, 2) AS p FROM sig_grid")
_kind("grid_windowed_spectrum", _spectrum("time_win"), "SELECT vec_id / 10::DOUBLE AS t_win, 0 AS ap, ml, ap::DOUBLE AS freq, power(x, 2) AS p FROM sig_grid")
_kind(
    "burst_peaks",
    lambda s, d: views.sig_grid(s, d).where("abs(x) > 0.2").select(F.concat_ws("-", "vec_id", "ap", "ml").alias("burst_id"), F.col("ml").alias("x"), F.col("ap").alias("y"), (F.col("vec_id") / 10).alias("time"), F.lit(1).alias("z"), F.col("x").alias("value")),
    "SELECT vec_id || '-' || ap || '-' || ml AS burst_id, ml::DOUBLE AS x, ap::DOUBLE AS y, vec_id / 10::DOUBLE AS t, 1::DOUBLE AS z, x AS value FROM sig_grid WHERE abs(x) > 0.2",
)
_kind("event", lambda s, d: views.events(s, d).select("event_id", F.col("t").alias("time"), "event_type"), "SELECT event_id::VARCHAR AS event_id, t, event_type FROM ev")
_kind(
    "interval_event",
    lambda s, d: views.intervals(s, d).select(F.concat_ws("-", "user_id", "state", "iseg").alias("event_id"), ((F.col("t0") + F.col("t1")) / 2).alias("time"), "t0", "t1", F.round(F.col("t1") - F.col("t0"), 6).alias("duration")),
    "SELECT user_id || '-' || state || '-' || iseg AS event_id, (t0 + t1) / 2 AS t, t0, t1, round(t1 - t0, 6) AS duration FROM intervals",
)
_kind("interval", lambda s, d: views.intervals(s, d).withColumn("iseg", F.col("iseg").cast("int")), "SELECT state, iseg, t0, t1, user_id FROM intervals")
