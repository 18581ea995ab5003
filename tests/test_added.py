"""Parameters, Granger influence, the processing chain, catalogs and tables of several recordings."""

import json

import numpy as np
import pandas as pd
import pytest

from siglake.functions import complexity, dsp, extra, granger, parameters
from siglake.operators import catalog, chain, decomposition, kernels, pipeline, spatial


def test_parameters():
    assert (parameters.samples(7, 100.0), parameters.samples(0.5, 100.0), parameters.samples(0.999, 10)) == (7, 50, 9)
    assert (parameters.cycles_length(10, 1000), parameters.cycles_length(10, 1000, power_of_two=False)) == (512, 700)
    own = parameters.tapers_of_bandwidth(8.0, 1000.0, 256, 64)
    assert own == {"nw": 2.048, "fs": 1000.0, "size": 256, "step": 192}
    assert parameters.bandwidth_of_tapers(**own) == {"bandwidth": 8.0, "fs": 1000.0, "nperseg": 256, "noverlap": 64}
    least, most = parameters.sigma_bounds({"t": (0.001, 0.5), "ap": (1.0, 1.0)}, {"t": 100.0, "ap": 2.0})
    assert (least, most) == ({"t": 1, "ap": 2}, {"t": 50, "ap": 4})


def test_bandpass_polynomials():
    b, a = dsp.bandpass_polynomials(1000.0, 20.0, 80.0)
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 1000)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 1000)))
    assert len(b) == len(a) == 9 and abs(gain(40) - 1) < 1e-3 and abs(gain(20) - 0.5**0.5) < 1e-6 and abs(gain(80) - 0.5**0.5) < 1e-6 and gain(300) < 1e-3


@pytest.mark.parametrize("n", [256, 501])
def test_granger_of_a_known_model(n):
    one, two, noise = np.array([[0.5, 0.0], [0.4, 0.3]]), np.array([[-0.6, 0.0], [0.1, -0.5]]), np.array([[1.0, 0.2], [0.2, 0.7]])
    z = np.exp(-2j * np.pi * np.arange(n) / n)[:, None, None]
    h = np.linalg.inv(np.eye(2) - one * z - two * z**2)
    s = h @ noise @ h.conj().swapaxes(1, 2)
    got, own = granger.factored(s)
    assert np.allclose(got, h, atol=1e-8) and np.allclose(own, noise, atol=1e-8)
    there, back = granger.influence(s)
    want = np.log(s[:, 1, 1].real / (s[:, 1, 1].real - (1.0 - 0.2**2 / 0.7) * np.abs(h[:, 1, 0]) ** 2))
    assert np.allclose(there, want, atol=1e-8) and np.allclose(back, 0, atol=1e-8)


def test_granger_of_series():
    r = np.random.default_rng(3)
    x, y = np.zeros(4000), np.zeros(4000)
    for t in range(1, 4000):
        x[t], y[t] = 0.5 * x[t - 1] + r.standard_normal(), 0.6 * x[t - 1] + 0.3 * y[t - 1] + r.standard_normal()
    freq, there, back = granger.spectral(x, y, 100.0, 40)
    assert len(freq) == 2001 and freq[-1] == 50.0 and there.mean() > 10 * back.mean()


def test_processing_chain(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((4, 3, 200))
    rows = [(a, m, i, float(x[a, m, i])) for a in range(4) for m in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "ap int, ml int, i long, x double").repartition(5)
    got = chain.window(df, 100.0, 10, 159, (4, 3), band=(5.0, 30.0), notches=[25.0], median=3, channels=[(0, 0), (3, 1)]).collect()
    own = x[..., 10:160]
    own = own - np.median(own.reshape(12, -1), axis=0)
    own = dsp.notches(dsp.bandpass(own, 100.0, 5.0, 30.0), 100.0, [25.0])
    own = dsp.median_filter(own, (3, 3, 1))
    own = (own - own.mean(-1, keepdims=True)) / (own.std(-1, keepdims=True) + 1e-12)
    assert len(got) == 300 and {(g["ap"], g["ml"]) for g in got} == {(0, 0), (3, 1)}
    assert np.allclose([g["x"] for g in got], [own[g["ap"], g["ml"], g["i"] - 10] for g in got], atol=1e-9)
    plain = chain.window(df, 100.0, 10, 159, (4, 3), reference=False, zscore=False).collect()
    assert len(plain) == 12 * 150 and all(g["x"] == x[g["ap"], g["ml"], g["i"]] for g in plain)
    assert chain.described(median=3) == "common median reference, spatial median 3, z-score" and chain.described(False, zscore=False) == "raw"


def test_spectrogram_transform(spark):
    t = np.arange(1024) / 256
    df = spark.createDataFrame([(1, i, float(t[i]), float(np.cos(2 * np.pi * 40 * t[i]))) for i in range(1024)], "ch int, i long, t double, x double")
    p = pipeline.TRANSFORMS["Spectrogram"](fs=256.0, nperseg=128, bandwidth=2.0).compute(df, ["ch"]).toPandas()
    assert sorted(p["i"].unique()) == list(range(15))  # windows start every 64 samples
    assert abs(p.loc[p.groupby("i")["x"].idxmax(), "freq"] - 40).max() <= 4


def test_catalog_records_and_stacks(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 2.0, 5.0), (3.0, 3.5, 4.0, 6.0)], "start double, peak double, end double, peak_amplitude double")
    own = catalog.from_start_peak_end(rows, "ripple")
    got = own.table.orderBy("t0").collect()
    assert [(g["event_id"], g["t"], g["duration"], g["value"], g["label"]) for g in got] == [("ripple_000000", 1.0, 2.0, 5.0, "ripple"), ("ripple_000001", 3.5, 1.0, 6.0, "ripple")]
    assert {json.loads(r["record"])["event_id"] for r in own.to_records().collect()} == {"ripple_000000", "ripple_000001"}
    assert own.to_records(1).count() == 0
    with pytest.raises(ValueError):
        catalog.from_start_peak_end(rows.drop("peak"))
    both = decomposition.stacked({"a": rows, "b": rows.limit(1)})
    assert sorted((r["rec"], r["count"]) for r in both.groupBy("rec").count().collect()) == [("a", 2), ("b", 1)]


def test_randomised_basis_finds_the_factors(spark, monkeypatch):
    """Beyond MOST_VARIABLES the same factors come without a covariance."""
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 4)) * [6, 4, 3, 2] @ np.linalg.qr(r.standard_normal((40, 4)))[0].T + 0.05 * r.standard_normal((300, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(5)
    want = decomposition.erp_pca(df, "v", 4)
    monkeypatch.setattr(decomposition, "MOST_VARIABLES", 39)
    with pytest.raises(ValueError, match="factors"):
        decomposition.erp_pca(df, "v")
    got = decomposition.erp_pca(df, "v", 4)
    assert np.allclose(got.variance, want.variance, rtol=1e-6) and np.allclose(got.loadings, want.loadings, atol=1e-4) and np.allclose(got.sd, want.sd)


def test_chunks_give_what_whole_series_give(spark):
    r = np.random.default_rng(6)
    x = {c: r.standard_normal(n) for c, n in ((1, 5000), (2, 2999), (3, 1))}
    df = spark.createDataFrame([(c, i, float(v)) for c in x for i, v in enumerate(x[c])], "ch int, i long, x double")
    for kernel, margin in ((lambda v: dsp.gaussian_filter(v, 3.0), 12), (lambda v: dsp.bandpass(v, 100.0, 10, 30), 3 * dsp.settling(dsp.butter(4, (10, 30), "band", 100.0)))):
        cut = kernels.transformed(df, ["ch"], kernel, chunk=1000, margin=margin).orderBy("ch", "i").toPandas()
        assert len(cut) == 8000 and not cut.duplicated(["ch", "i"]).any()
        for c in (1, 2):
            assert np.abs(cut[cut["ch"] == c]["y"].to_numpy() - kernel(x[c][None])[0]).max() < 1e-9
    with pytest.raises(ValueError, match="margin"):
        kernels.in_chunks(df, 10, 11)


def test_distances_and_outliers_by_blocks(spark):
    r = np.random.default_rng(7)
    x = np.vstack([r.standard_normal((60, 2)), [[9.0, 9.0]], [[np.nan, 0.0]]])
    far = np.sqrt(((x[:61, None] - x[None, :61]) ** 2).sum(-1))
    got = spatial.median_distances(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "c int, a double, b double").replace(float("nan"), None), ["c"], ["a", "b"], 16).orderBy("c").toPandas()
    assert np.allclose(got["d"], [np.median(np.delete(far[i], i)) for i in range(61)])
    assert spatial.median_distances(spark.createDataFrame([(1, 2.0)], "c int, a double"), ["c"], ["a"]).first()["d"] is None
    assert (complexity.dbscan_outliers(x, block=7) == complexity.dbscan_outliers(x, block=1000)).all() and complexity.dbscan_outliers(x)[60]


def test_extrema_keep_their_label_from_frame_to_frame():
    rows = pd.DataFrame([(0, 1, 1), (0, 6, 6), (1, 2, 1), (1, 4, 6), (2, 2, 2), (2, 4, 5), (4, 2, 3)], columns=["vec_id", "ap", "ml"])
    assert extra.tracked(rows, 1)["wave"].tolist() == [0, 1, 0, 2, 0, 2, 0]


@pytest.mark.parametrize("flow", [extra.flow_tvl1, extra.flow_ilk])
@pytest.mark.parametrize("shift", [(0.6, -0.4), (1.5, 1.0), (0.0, 0.0)])
def test_flow_follows_a_moving_pattern(flow, shift):
    a, m = np.indices((32, 32), dtype=float)
    frame = lambda k: np.sin((a - k * shift[0]) / 3.0) + np.cos((m - k * shift[1]) / 3.5)
    u, v = flow(np.array([frame(k) for k in range(4)]))
    assert u.shape == (3, 32, 32)
    inner = np.s_[:, 6:-6, 6:-6]
    assert np.abs(np.median(u[inner]) - shift[0]) < 0.1 and np.abs(np.median(v[inner]) - shift[1]) < 0.1
    assert np.quantile(np.hypot(u[inner] - shift[0], v[inner] - shift[1]), 0.9) < 0.3


def test_flow_of_a_constant_is_none():
    for flow in (extra.flow_tvl1, extra.flow_ilk):
        assert not np.array(flow(np.ones((3, 8, 8)))).any()
