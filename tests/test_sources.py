import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.sources import binary, schema, sidecars
from siglake.streaming import hopping


def test_flat_binary_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).integers(-1000, 1000, (50, 6)).astype("int16")
    path = tmp_path / "a.dat"
    x.tofile(path)
    df = binary.read(spark, str(path), channels=6, fs=100, task_samples=60)
    got = df.orderBy("i", "ch").toPandas()
    assert (got["x"].to_numpy().reshape(50, 6) == x).all() and got["t"].iloc[-1] == 0.49 and got["ap"].isna().all()
    assert df.rdd.getNumPartitions() == 5
    grid = binary.read(spark, f"file://{path}", rows=3, cols=2)
    assert sorted({(r["ch"], r["ap"], r["ml"]) for r in grid.where("i = 0").collect()}) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 1), (4, 1, 1), (5, 2, 1)]
    parts = binary.write(df, str(tmp_path / "out"), 6, parts=4).collect()
    assert sum(r["frames"] for r in parts) == 50
    back = np.concatenate([np.fromfile(f, dtype="int16") for f in sorted((tmp_path / "out").iterdir())])
    assert (back.reshape(50, 6) == x).all()
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(Exception, match="no whole frames"):
        binary.read(spark, str(path), channels=6).count()


def test_sidecars(spark, tmp_path):
    meta = {"SamplingFrequency": 1250, "ECOGChannelCount": 4, "EEGChannelCount": 2, "ChannelCount": 99}
    sidecars.write_json_metadata(f"{tmp_path}/a.json", meta)
    own = sidecars.read_json_metadata(spark, f"{tmp_path}/a.json", ("SamplingFrequency",))
    assert own == meta and sidecars.channel_count(own) == 6 and sidecars.channel_count({"ChannelCount": 3}) == 3
    with pytest.raises(KeyError):
        sidecars.channel_count({})
    with pytest.raises(KeyError):
        sidecars.read_json_metadata(spark, f"{tmp_path}/a.json", ("None",))
    assert json.dumps(sidecars.with_sampling_frequency(meta, 500.0))
    (tmp_path / "e.tsv").write_text("row\tcol\tAP\n0\t0\t1.0\n0\t1\t3.0\n2\t0\tn/a\n")
    axis = sidecars.electrode_axis(sidecars.read_tsv(spark, f"{tmp_path}/e.tsv"), "row", "AP", 3).orderBy("row").collect()
    assert [r["AP"] for r in axis] == [2.0, None, None]
    assert sidecars.sidecar_paths("/d/s_ieeg.dat")["channels"] == "/d/s_channels.tsv"
    assert sidecars.free_name({"a_x.dat", "a_x(1).dat"}, "a.dat", "x") == "a_x(2).dat"
    v = spark.createDataFrame([(2.0, "uV"), (2.0, "V")], "x double, unit string").select(sidecars.volts(F.col("x"), F.col("unit")).alias("v"))
    assert [r["v"] for r in v.collect()] == [2e-6, 2.0]
    with pytest.raises(Exception, match="unknown unit"):
        spark.range(1).select(sidecars.volts(F.lit(1.0), "mV")).collect()


XML = """<parameters><acquisitionSystem><nBits>16</nBits><nChannels>4</nChannels><samplingRate>1250</samplingRate></acquisitionSystem>
<anatomicalDescription><channelGroups><group><channel skip="0">0</channel><channel skip="1">1</channel></group><group><channel skip="0">2</channel><channel skip="0">3</channel></group></channelGroups></anatomicalDescription></parameters>"""


def test_xml_map(spark):
    meta = sidecars.parse_xml(XML)
    assert (meta["fs"], meta["n_channels"], meta["dtype"], meta["nrow"], meta["ncol"]) == (1250, 4, "int16", 2, 2)
    anat = sidecars.anatomical_map(spark, meta)
    assert sidecars.map_order(anat) == "F" and anat.where("skip").first()["ch"] == 1
    assert sidecars.with_skipped(anat, [2, 3]).where("skip").count() == 2


def test_schema(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.0, 1, 2, 5.0)], "i long, time double, AP int, ML int, x double")
    own = schema.coerce(df, "grid_signal")
    schema.validate(own, "grid_signal")
    with pytest.raises(ValueError, match="missing"):
        schema.validate(df, "grid_signal")
    with pytest.raises(ValueError, match="fs"):
        schema.validate(own, "grid_signal", ("fs",))
    flat = spark.createDataFrame([(1, i, i * 0.01) for i in range(10)], "ch int, i long, t double")
    assert abs(schema.sampling_frequency(flat, ["ch"]) - 100) < 1e-6 and schema.sampling_frequency(flat, ["ch"], {"fs": 7}) == 7
    assert schema.not_increasing(flat, ["ch"]).count() == 0 and schema.not_increasing(flat.withColumn("t", -F.col("t")), ["ch"]).first()["n"] == 9
    schema.save(flat, f"{tmp_path}/s", ["ch"])
    assert (tmp_path / "s" / "ch=1").exists()


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:{m:02d}:00", "view", float((m * 7 + u) % 11)) for m in range(40) for u in (1, 2)]
    batch = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.checkpointLocation", f"{tmp_path}/cp")
    q = hopping.windowed_counts(stream, "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("hops").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, hopping.windowed_counts(batch, "10 minutes", "5 minutes").collect()))
    assert sorted(map(tuple, spark.table("hops").collect())) == want
    q = hopping.threshold_runs(stream, 5.0).writeStream.outputMode("append").format("memory").queryName("runs").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("runs")
    brute = []
    for u in (1, 2):
        run = []
        for _, _, _, v in sorted(r for r in rows if r[0] == u):
            if v >= 5:
                run.append(v)
            elif run:
                brute.append((u, len(run)))
                run = []
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == sorted(brute)
    spark.conf.unset("spark.sql.streaming.checkpointLocation")
