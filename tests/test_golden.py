"""Exact values on tiny inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.operators import bursts, catalog, detect, intervals, matching, ranges, series, spatial, triggered, windows
from siglake.operators.graph import components

STATES = [("SWS", 0, 10.0, 20.0), ("SWS", 1, 30.0, 40.0), ("REM", 0, 20.0, 30.0), ("REM", 1, 40.0, 50.0)]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame([("r", *x) for x in STATES], "rec string, state string, iseg long, t0 double, t1 double")


def iv(spark, pairs):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(pairs)], "k long, t0 double, t1 double")


def pts(spark, times, name="t", idx="k"):
    return spark.createDataFrame([(k, float(t)) for k, t in enumerate(times)], f"{idx} long, {name} double")


def pairs(df, a="t0", b="t1"):
    return sorted((r[a], r[b]) for r in df.collect())


@pytest.mark.parametrize(("own", "want"), [([(1, 3), (4, 6), (7, 9)], True), ([(1, 3), (2, 4), (3, 5)], False), ([(1, 2), (2, 3)], True)])
def test_disjoint(spark, own, want):
    assert intervals.disjoint(iv(spark, own).withColumn("g", F.lit(1)), ["g"]).first()["disjoint"] is want


def test_map_numbers(spark):
    got = intervals.mapped(pts(spark, [1, 2, 3, 4, 5], idx="p"), iv(spark, [(1, 3), (2, 4), (3, 5), (4, 6), (5, 7)]), [], "k", 2.0, "p")
    assert {r["p"]: r["found"] for r in got.collect()} == {0: [0], 1: [0, 1], 2: [1, 2], 3: [2, 3], 4: [3, 4]}
    got = intervals.mapped_disjoint(pts(spark, [1, 2, 3, 4, 5], idx="p"), iv(spark, [(1, 3), (4, 6)]), [], "k", 2.0)
    assert [r["found"] for r in got.orderBy("p").collect()] == [0, 0, -1, 1, 1]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([(5, 8), (18, 22)], [(1, 10), (15, 20), (25, 30)], [(1, 5), (8, 10), (15, 18), (25, 30)]),
        ([(0, 100)], [(1, 2)], []),
        ([], [(1, 2)], [(1, 2)]),
        ([(1, 3), (2, 4)], [(0, 10)], [(0, 1), (4, 10)]),
        ([(15, 23), (35, 37), (55, 57)], [(10, 20), (30, 40), (50, 60)], [(10, 15), (30, 35), (37, 40), (50, 55), (57, 60)]),
    ],
)
@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_subtract(spark, a, b, want, width):
    assert pairs(intervals.subtracted(iv(spark, a), iv(spark, b), [], width)) == want


def test_states(spark, states):
    assert {r["state"]: r["duration"] for r in intervals.durations(states).collect()} == {"SWS": 20, "REM": 20}
    assert [tuple(r)[1:] for r in intervals.transitions(states, ["rec"]).orderBy("t").collect()] == [(20, "SWS", "REM"), (30, "REM", "SWS"), (40, "SWS", "REM")]
    assert pairs(intervals.transition_intervals(states, ["rec"], "SWS", "REM", 5, 5)) == [(15, 25), (35, 45)]
    assert pairs(intervals.intermediate_intervals(states, ["rec"], "SWS", "REM", 5, [])) == [(15, 20), (35, 40)]
    got = intervals.labelled(pts(spark, [5, 15, 25, 35, 45]).withColumn("rec", F.lit("r")), states, ["rec"], ["SWS", "REM"], 10.0).orderBy("k").collect()
    assert [(r["SWS"], r["REM"]) for r in got] == [(-1, -1), (0, -1), (-1, 0), (1, -1), (-1, 1)]
    more = intervals.without_corrupt(states.unionByName(states.limit(1).withColumn("t0", F.lit(99.0))))
    assert more.count() == 4
    check = spark.createDataFrame([("r", "SWS", 0, 10.0, 20.0), ("r", "SWS", 1, 25.0, 30.0), ("r", "REM", 0, 20.0, 25.0), ("r", "REM", 1, 30.0, 35.0), ("r", "IS", 0, 18.0, 19.0)], states.schema)
    clash = {(r["state"], r["other"]) for r in intervals.disjoint_states(check, ["rec"], 5.0).where("not disjoint").collect()}
    assert clash == {("SWS", "IS"), ("IS", "SWS")}


def test_purify(spark):
    rows = [("r", s, a, b) for s, own in {"SWS": [(10, 20), (30, 40), (50, 60)], "REM": [(20, 30), (40, 50)], "MicroA": [(15, 17), (35, 37)], "HVS": [(55, 57)], "other": [(1, 2)]}.items() for a, b in own]
    df = spark.createDataFrame([(r, s, float(a), float(b)) for r, s, a, b in rows], "rec string, state string, t0 double, t1 double")
    got = intervals.purified(df, ["rec"], ["SWS", "REM"], ["MicroA", "HVS"], 10.0)
    assert pairs(got.where("state = 'SWS'")) == [(10, 15), (17, 20), (30, 35), (37, 40), (50, 55), (57, 60)]
    assert pairs(got.where("state = 'REM'")) == [(20, 30), (40, 50)] and got.where("state = 'other'").count() == 0


def test_overlaps(spark):
    a = iv(spark, [(0.8, 1.6), (1.2, 1.9), (2.8, 3.3)])
    b = a.select(F.col("k").alias("j"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    got = ranges.overlapping(a, b, [], 0.25, "t0", "t1", "b0", "b1").where("k < j").collect()
    assert [(r["k"], r["j"], r["b0"], min(r["t1"], r["b1"])) for r in got] == [(0, 1, 1.2, 1.6)]


@pytest.mark.parametrize("chunk", [None, 0.1, 3.0])
def test_nearest(spark, chunk):
    a, b = pts(spark, [1, 2, 3, 4], "ta", "ia"), pts(spark, [1, 2, 3, 4], "tb", "ib")
    own = dict(ta="ta", tb="tb", chunk=chunk)
    assert sorted((r["ia"], r["ib"], r["lag"]) for r in ranges.nearest(a, b, [], 0.1, **own).collect()) == [(k, k, 0) for k in range(4)]
    a, b = pts(spark, [1.0, 1.005, 1.01], "ta", "ia"), pts(spark, [1.006], "tb", "ib")
    assert [r["ia"] for r in ranges.nearest_symmetric(a, b, [], 0.01, **own).collect()] == [1]
    tie = ranges.nearest(pts(spark, [2.0], "ta", "ia"), pts(spark, [1.5, 2.5], "tb", "ib"), [], 1.0, **own).first()
    assert (tie["ib"], tie["lag"]) == (1, 0.5)


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(0)
    x, y = np.sort(r.uniform(0, 100, 700)), np.sort(r.uniform(0, 100, 600))
    got = {m["ia"]: m["ib"] for m in ranges.nearest(pts(spark, x, "ta", "ia"), pts(spark, y, "tb", "ib"), [], 0.05, ta="ta", tb="tb").collect()}
    d = np.abs(x[:, None] - y[None])
    want = {i: int(d[i].argmin()) for i in range(len(x)) if d[i].min() <= 0.05}
    assert got == want


def test_lags(spark):
    a, b = pts(spark, [1, 2, 3, 4, 5], "ta", "ia"), pts(spark, [1.05, 2.05, 3.05, 4.05, 5.05], "tb", "ib")
    m = ranges.nearest(a, b, [], 0.1, ta="ta", tb="tb")
    got = matching.lag_estimates(m).first()
    assert abs(got["median"] - 0.05) < 1e-9 and abs(got["mean"] - 0.05) < 1e-9
    assert np.allclose(matching.drift(m.withColumn("lag", 2 * F.col("ta") + 1)), [2, 1]) and np.isnan(matching.drift(m.limit(1))).all()
    assert matching.lag_histogram(a, b, [], 0.1, 0.05).agg(F.sum("n")).first()[0] == 5
    assert np.allclose(matching.drift(m.withColumn("lag", F.col("ta") * F.col("ta")), 2), [1, 0, 0], atol=1e-8)


def samples(spark, x, fs=10.0):
    return spark.createDataFrame([(1, i, i / fs, float(v)) for i, v in enumerate(x)], "ch int, i long, t double, x double")


def two_bouts(gap):
    x = np.zeros(200)
    x[20:41], x[28:33] = 3.0, 6.0
    x[41 + gap : 62 + gap], x[49 + gap : 54 + gap] = 3.0, 6.0
    return x


def test_bouts(spark):
    own = samples(spark, two_bouts(5))
    assert detect.bouts(own, ["ch"], 2, 5).count() == 2
    one = detect.bouts(own, ["ch"], 2, 5, merge_gap=1.0).collect()
    assert len(one) == 1 and (one[0]["i0"], one[0]["i1"]) == (20, 66)
    assert detect.bouts(own, ["ch"], 2, 5, min_duration=99).count() == 0
    found = spark.createDataFrame([(1, 15.0)], "ch int, duration double")
    assert detect.occupancy(found, ["ch"], 10.0).first()["occupancy"] == 1.0
    with pytest.raises(ValueError, match="positive"):
        detect.occupancy(found, ["ch"], 0.0)


def test_threshold_detector(spark):
    x = np.zeros(1000)
    x[200:250], x[500:550], x[800:850], x[900] = 10, 8, 12, 20
    got = detect.threshold_events(samples(spark, x), ["ch"], 5.0).orderBy("i0").collect()
    assert [(r["i0"], r["i1"], r["value"]) for r in got] == [(200, 249, 10), (500, 549, 8), (800, 849, 12)]
    assert detect.threshold_events(samples(spark, -x), ["ch"], 5.0, "negative").count() == 3
    assert detect.threshold_events(samples(spark, x), ["ch"], 50.0).count() == 0


def test_greedy_isolation(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.4, 3.0), (1, 0.8, 2.0), (1, 2.0, 1.0)], "ch int, t double, value double")
    assert [(r["t"], r["value"]) for r in detect.isolated(df, ["ch"], 0.5).orderBy("t").collect()] == [(0.4, 3.0), (2.0, 1.0)]


def test_perievent_edges(spark):
    ep = triggered.perievent(samples(spark, range(20)), spark.createDataFrame([(1, 7, 0.1)], "ch int, event_id long, t double"), ["ch"], 10.0, 0.5, 0.5)
    rows = ep.orderBy("lag").collect()
    assert [r["lag"] for r in rows] == list(range(-5, 6)) and [r["x"] for r in rows] == [None] * 4 + [0, 1, 2, 3, 4, 5, 6]


def test_lagged_design(spark):
    own = samples(spark, [10, 20, 30, 40, 50])
    got = triggered.lagged_design(own, ["ch"], [2, -1]).orderBy("i").collect()
    assert [r["x0"] for r in got] == [0, 0, 10, 20, 30] and [r["x1"] for r in got] == [20, 30, 40, 50, 0]


def test_template_round_trip(spark):
    r = np.random.default_rng(1)
    base, tm, starts = r.standard_normal(200), np.array([1.0, 4, 2]), [10, 60, 61, 150, 199]
    x = base.copy()
    for s in starts[:-1]:
        x[s : s + 3] += tm
    events = spark.createDataFrame([(1, s) for s in starts], "ch int, s long")
    tmpl = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(tm)], "ch int, k int, template double")
    got = triggered.without_template(samples(spark, x), events, tmpl, ["ch"], "s").orderBy("i").toPandas()["x"]
    assert np.allclose(got, base)


def test_ols(spark):
    r = np.random.default_rng(2)
    a = r.standard_normal((50, 2))
    df = spark.createDataFrame([(1.0, *map(float, v), float(3 + v @ [2, -1])) for v in a], "one double, a double, b double, y double")
    beta = triggered.ols_fit(df, ["one", "a", "b"], "y")
    assert np.allclose(beta, [3, 2, -1])
    assert triggered.ols_residual(df, ["one", "a", "b"], "y", beta).agg(F.max(F.abs("residual"))).first()[0] < 1e-9


def test_classify_and_merge(spark):
    d, t = (spark.createDataFrame([(v,) for v in x], "k int") for x in ([1, 2, 3], [2, 3, 4]))
    assert sorted((r["k"], r["kind"]) for r in bursts.classified(d, t, ["k"]).collect()) == [(1, "FP"), (2, "TP"), (3, "TP"), (4, "FN")]
    rates = bursts.detection_rates(bursts.classified(d, t, ["k"])).first()
    assert (round(rates["miss"], 6), round(rates["precision"], 6)) == (0.333333, 0.666667)
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (3, 9)], "a long, b long")
    assert {r["node"]: r["cluster"] for r in components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["cluster"] for r in components(chain, "a", "b").collect()} == {0}
    own = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0), (4, 1.0)], "id long, amp double")
    kept = bursts.merged(own, spark.createDataFrame([(1, 2), (2, 3)], "id_i long, id_j long"))
    assert sorted(r["id"] for r in kept.collect()) == [2, 4]


def test_catalog(spark):
    c = catalog.EventCatalog(spark.createDataFrame([("a", 1.0, 0.5, 2.0, 1, 0, 0), ("b", 3.0, 2.5, 3.5, 2, 3, 4)], "event_id string, t double, t0 double, t1 double, channel int, AP int, ML int"))
    assert [r["duration"] for r in c.table.orderBy("t").collect()] == [1.5, 1.0]
    assert c.filter_by_time(3.0, 1.0).table.count() == 2 and c.filter_by_spatial(0, 0, 4.9).table.count() == 1 and c.filter_by_spatial(0, 0, 5.0).table.count() == 2
    assert c.filter_by_channel([2]).to_point_intervals(1).first().asDict() == {"t0": 2.0, "t1": 4.0}
    assert c.following(1.0).first()["event_id"] == "b" and c.preceding(1.0).count() == 0
    with pytest.raises(ValueError, match="event_id"):
        catalog.EventCatalog(c.table.drop("event_id"))


def test_windows(spark):
    n = spark.createDataFrame([(1, 10), (2, 3)], "ch int, n long")
    got = windows.onsets(n, ["ch"], "n", 4, 3).collect()
    assert [(r["onset"], r["last"], r["midpoint"], r["lower"], r["upper"]) for r in got] == [(0, 3, 1.5, 1, 2), (3, 6, 4.5, 4, 5), (6, 9, 7.5, 7, 8)]
    own = samples(spark, range(10))
    assert [r["m"] for r in windows.running_reduce(own, ["ch"], 4, 3, m=F.avg("x")).orderBy("win").collect()] == [1.5, 4.5, 7.5]
    held = windows.chunked(own, ["ch"], 4, 3, 6)
    by = {}
    for r in held.collect():
        by.setdefault(r["chunk"], []).append(r["i"])
    assert sorted(by[0]) == list(range(9)) and sorted(by[1]) == [6, 7, 8, 9]


def test_spatial(spark):
    def grid(f):
        return spark.createDataFrame([(0, a, m, float(f(a, m))) for a in range(8) for m in range(8)], "g int, ap int, ml int, x double")

    board = spatial.moran(grid(lambda a, m: (a + m) % 2 * 10 + 1), ["g"], "rook").first()["moran"]
    assert abs(board + 1) < 1e-9
    assert spatial.moran(grid(lambda a, m: 1), ["g"]).first()["moran"] is None
    csd = spatial.csd_power(grid(lambda a, m: 2 * a + 3 * m), ["g"])
    assert csd.where("csd is not null").agg(F.max(F.abs("csd"))).first()[0] == 0 and csd.where("csd is null").count() == 28
    rows = spatial.marginal_energy_outlier(grid(lambda a, m: 100 if m == 3 else 1), ["g"], "ml").where("outlier").collect()
    assert [r["ml"] for r in rows] == [3]
    assert spatial.gradient_anisotropy(grid(lambda a, m: a % 2), ["g"]).first()["anisotropy"] > 20
    bad = grid(lambda a, m: 2 * a + 3 * m).withColumn("bad", (F.col("ap") == 3) & (F.col("ml") == 4))
    fixed = spatial.interpolated_by_neighbors(bad.withColumn("x", F.when(F.col("bad"), -99.0).otherwise(F.col("x"))), ["g"], "bad", spatial.ADJACENCY["rook"])
    assert fixed.where("bad").first()["x"] == 18
    assert (len(spatial.footprint(2)), len(spatial.footprint(spatial.dilated_radius(3)))) == (12, 40)


def test_merge_gap(spark):
    runs = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 12, 13), (1, 17, 18)], "ch int, i0 long, i1 long")
    assert pairs(series.merged_runs(runs, ["ch"], 1), "i0", "i1") == [(0, 13), (17, 18)]
