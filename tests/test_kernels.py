"""Kernels against known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siglake.functions import complexity, dsp
from siglake.functions import generators as gen
from siglake.operators import decomposition, kernels, pipeline, spectral

FS = 1000.0
T = np.arange(4000) / FS


def response(sos, f):
    z = np.exp(2j * np.pi * f / FS)
    return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos]))


@pytest.mark.parametrize(("kind", "cut", "passed", "stopped"), [("low", 50, 1, 450), ("high", 50, 450, 1), ("band", (20, 80), 40, 300), ("stop", (20, 80), 300, 40)])
@pytest.mark.parametrize("order", [2, 3, 4])
def test_butterworth(kind, cut, passed, stopped, order):
    sos = dsp.butter(order, cut, kind, FS)
    assert all(abs(response(sos, f) - np.sqrt(0.5)) < 1e-6 for f in np.atleast_1d(cut))
    assert abs(response(sos, passed) - 1) < 0.01 and response(sos, stopped) < 0.1
    assert all((np.abs(np.roots(s[3:])) < 1).all() for s in sos)


def test_zero_phase():
    x = np.sin(2 * np.pi * 50 * T) + np.sin(2 * np.pi * 5 * T)
    inner = slice(500, -500)
    assert np.abs(dsp.bandpass(x, FS, 30, 80) - np.sin(2 * np.pi * 50 * T))[inner].max() < 1e-3
    assert np.abs(dsp.lowpass(x, FS, 20) - np.sin(2 * np.pi * 5 * T))[inner].max() < 1e-3
    assert np.abs(dsp.notches(x, FS, [50.0]) - np.sin(2 * np.pi * 5 * T))[1000:-1000].max() < 0.01
    assert dsp.notches(x, FS, []) is x
    with pytest.raises(ValueError, match="not within"):
        dsp.notches(x, FS, [600.0])
    assert np.allclose(dsp.sosfilt(dsp.butter(2, 50, "low", FS), np.ones(50), dsp.sosfilt_zi(dsp.butter(2, 50, "low", FS))), 1)


def test_hilbert_and_phase():
    x = 2 * np.cos(2 * np.pi * 10 * T)
    assert np.allclose(dsp.envelope(x), 2) and np.allclose(np.diff(dsp.unwrapped_phase(x)), 2 * np.pi * 10 / FS)
    noisy = dsp.generalized_phase(x + 0.2 * np.random.default_rng(0).standard_normal(len(x)))
    assert np.abs(noisy - 2 * np.pi * 10 * T).max() < 0.6 and (np.diff(noisy) < 0).any()  # noise turns it back at times, which isn't bridged


def test_spectra():
    x = np.sin(2 * np.pi * 125 * T)
    f, p = dsp.welch(x, FS)
    assert f[p.argmax()] == 125 and abs(p.sum() * (f[1] - f[0]) - 0.5) < 1e-6
    noise = np.random.default_rng(1).standard_normal(200_000)
    assert abs(dsp.welch(noise, FS)[1].mean() * FS / 2 - 1) < 0.02 and abs(dsp.psd_multitaper(noise[:20_000], FS)[1].mean() * FS * 20_000 - 1) < 0.05
    tapers, share = dsp.dpss(128, 4, 7)
    assert np.allclose(tapers @ tapers.T, np.eye(7)) and share[0] > 0.9999 and (np.diff(share) < 0).all()
    f, stat, threshold = dsp.ftest(x + noise[:4000], FS)
    assert f[stat.argmax()] == 125 and stat.max() > 10 * threshold and abs(threshold - 3.8853) < 1e-3


def test_resampling():
    x = np.sin(2 * np.pi * 5 * T)
    assert np.abs(dsp.resample_poly(x, 1, 4) - x[::4])[50:-50].max() < 1e-2
    assert np.abs(dsp.resample_poly(x, 3, 2) - np.sin(2 * np.pi * 5 * np.arange(6000) / 1500))[50:-50].max() < 1e-2
    assert np.abs(dsp.decimate(x, 4) - x[::4])[50:-50].max() < 0.02 and len(dsp.decimate(x, 4)) == 1000


def test_peaks_and_maxima():
    x = np.array([0, 1, 0, 3, 2.5, 2.8, 0, 1, 1, 0])
    assert dsp.find_peaks(x).tolist() == [1, 3, 5, 7] and dsp.find_peaks(x, prominence=0.5).tolist() == [1, 3, 7] and dsp.find_peaks(x, distance=3).tolist() == [3, 7]
    g = np.zeros((9, 9))
    g[2, 2], g[6, 6], g[6, 7], g[0, 8] = 5, 3, 2.9, 0.5
    assert np.argwhere(dsp.h_maxima(g, 1)).tolist() == [[2, 2], [6, 6]] and not dsp.h_maxima(g, 10).any()


def test_complexity():
    r = np.random.default_rng(2)
    noise, walk = r.standard_normal(4000), np.cumsum(r.standard_normal(4000))
    assert abs(complexity.dfa(noise) - 0.5) < 0.08 and complexity.dfa(walk) > 1.3
    assert complexity.hurst(noise) < 0.65 < 0.85 < complexity.hurst(walk)
    assert complexity.sample_entropy(noise[:500]) > complexity.sample_entropy(np.sin(np.arange(500) / 5))
    assert complexity.lempel_ziv(noise[:1000]) > 0.9 > 0.2 > complexity.lempel_ziv(np.sin(np.arange(1000) / 50))
    cost = r.uniform(size=(5, 5))
    import itertools

    own = complexity.hungarian(cost)
    assert sorted(own) == list(range(5)) and abs(cost[range(5), own].sum() - min(cost[range(5), list(p)].sum() for p in itertools.permutations(range(5)))) < 1e-12
    x = np.vstack([r.standard_normal((60, 2)), [[20, 20]]])
    assert complexity.dbscan_outliers(x)[-1] and complexity.dbscan_outliers(x).sum() < 15
    t = np.linspace(0, 1, 6)
    assert np.allclose(complexity.pchip(t, t, np.linspace(0, 1, 50)), np.linspace(0, 1, 50))
    own = complexity.spread_points(x, 1.0, 0)
    assert min(np.linalg.norm(x[i] - x[j]) for i, j in itertools.combinations(own, 2)) > 1


def test_ica_and_varimax():
    r = np.random.default_rng(3)
    s = np.vstack([np.sign(np.sin(T * 20)), np.sin(T * 33), r.uniform(-1, 1, len(T))])
    found, mixing = complexity.fast_ica(r.standard_normal((5, 3)) @ s, 3)
    assert (np.abs(np.corrcoef(np.vstack([found, s]))[:3, 3:]).max(0) > 0.95).all() and mixing.shape == (5, 3)
    simple = np.kron(np.eye(3), np.ones((4, 1)))
    turned = simple @ np.linalg.qr(r.standard_normal((3, 3)))[0]
    rotated, rotation = complexity.varimax(turned)
    assert np.allclose(np.sort(np.abs(rotated), axis=1)[:, :2], 0, atol=1e-3) and np.allclose(rotation @ rotation.T, np.eye(3))
    assert complexity.simplicity(rotated) > complexity.simplicity(turned)


def test_series_kernels(spark):
    rows = [(k, i, float(np.sin(i / 3 + k))) for k in range(5) for i in range(40 + k % 2)]
    df = spark.createDataFrame(rows, "ch int, i long, x double").repartition(3)
    got = kernels.transformed(df, ["ch"], lambda x: np.cumsum(x, axis=-1)).orderBy("ch", "i").collect()
    want = [v for k in range(5) for v in np.cumsum([x for c, _, x in rows if c == k])]
    assert np.allclose([r["y"] for r in got], want)


def test_pca_finds_the_latent_space(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((200, 3)) @ r.standard_normal((3, 10)) + 0.01 * r.standard_normal((200, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    mean, cov, n = decomposition.covariance(df, "v")
    assert n == 200 and np.allclose(cov, np.cov(x.T)) and np.allclose(mean, x.mean(0))
    f = decomposition.erp_pca(df, "v", 3)
    assert f.loadings.shape == (10, 3) and abs(f.variance.sum() / np.trace(cov) - 1) < 0.01 and (np.diff(f.variance) <= 0).all()
    s = np.array([list(q)[1:] for q in f.scores(df, "v", ["i"]).orderBy("i").collect()])
    assert np.allclose(s @ f.loadings.T, x - x.mean(0), atol=0.2)


def ripple_lfp():
    x = 0.05 * np.random.default_rng(0).standard_normal(10_000)
    for s in (2000, 5000, 8000):
        x[s : s + 80] += 3 * np.sin(2 * np.pi * 150 * np.arange(80) / FS)
    return x


def as_samples(spark, x):
    return spark.createDataFrame([(1, i, i / FS, float(v)) for i, v in enumerate(x)], "ch int, i long, t double, x double")


def test_ripples(spark):
    own = as_samples(spark, ripple_lfp())
    got = pipeline.Ripple().detect(own, ["ch"]).orderBy("t").collect()
    assert len(got) == 3 and all(abs(r["t"] - t) < 0.1 for r, t in zip(got, (2, 5, 8), strict=True))
    found = pipeline.RIPPLE.run(own, ["ch"])
    assert found.table.count() == 3 and found.metadata["pipeline"] == "ripple"
    again = pipeline.DetectionPipeline.from_dict(pipeline.RIPPLE.to_dict())
    assert again.to_dict() == pipeline.RIPPLE.to_dict()
    with pytest.raises(ValueError, match="has no"):
        pipeline.Threshold(wrong=1)


def test_slow_waves(spark):
    t = np.arange(20_000) / FS
    x = 5 * np.sin(2 * np.pi * t) + 0.3 * np.random.default_rng(42).standard_normal(len(t))
    got = pipeline.SlowWave().detect(as_samples(spark, x), ["ch"]).collect()
    assert 8 <= len(got) <= 20 and all(abs(r["trough"] + 5) < 0.6 and r["ptp"] > 9 for r in got)


def test_spectral_line(spark):
    x = 0.1 * np.random.default_rng(5).standard_normal(1024) + np.sin(2 * np.pi * 250 * np.arange(1024) / FS)
    psd = spectral.psd_welch(as_samples(spark, x).drop("t"), ["ch"], FS)
    assert psd.agg(F.max_by("freq", "p")).first()[0] == 250
    assert psd.groupBy("ch").agg(spectral.line_noise_ratio(250, 4).alias("r")).first()["r"] > 50
    assert spectral.narrowband_ratio(psd, ["ch"], 20.0).agg(F.max_by("freq", "ratio")).first()[0] == 250


def test_ar(spark):
    r, x = np.random.default_rng(6), np.zeros(4000)
    for i in range(2, 4000):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + r.standard_normal()
    own = as_samples(spark, x).drop("t")
    a = spectral.ar_yule(own, ["ch"], 2).first()
    assert abs(a["a1"] - 0.6) < 0.05 and abs(a["a2"] + 0.3) < 0.05
    assert abs(spectral.whitened(own, ["ch"], [0.6, -0.3]).agg(F.stddev("y")).first()[0] - 1) < 0.05


def test_generators(spark):
    p = gen.poisson_process(spark, 3, 50.0, 40.0, 1)
    assert all(abs(r["n"] - 2000) < 250 for r in p.groupBy("ch").agg(F.count("*").alias("n")).collect())
    a, b = (sorted(map(tuple, df.collect())) for df in (p, gen.poisson_process(spark, 3, 50.0, 40.0, 1).repartition(7)))
    assert a == b
    z = spark.range(20_000).select(gen.normal(3, "id").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_triangle_weights_reproduce_a_plane():
    from siglake.functions import extra

    r = np.random.default_rng(7)
    xy = np.array([(m, a) for a in range(6) for m in range(6)], dtype=float) + 0.2 * r.uniform(-1, 1, (36, 2))
    bad = np.zeros(36, dtype=bool)
    bad[[14, 15, 21, 0]] = True
    got = {}
    for b, g, w in extra.linear_weights(xy, bad):
        got.setdefault(b, []).append((g, w))
    plane = xy @ [2, 3]
    for b in (14, 15, 21):
        assert abs(sum(w * plane[g] for g, w in got[b]) - plane[b]) < 1e-6
    assert len(got[0]) == 1 and got[0][0][1] == 1.0


def test_waves():
    from siglake.functions import extra

    t, y, x = np.meshgrid(np.arange(64) / 100, np.arange(8), np.arange(8), indexing="ij")
    wave = np.cos(2 * np.pi * (12.5 * t - 0.25 * x))
    for tapers in (None, (2.0, 1.0)):
        f, ky, kx, s = extra.kw_spectrum(wave, 100.0, tapers)
        a, b, c = np.unravel_index(s.argmax(), s.shape)
        assert abs(f[a] - 12.5) < 3.2 and abs(abs(kx[c]) - 0.25) < 0.13 and abs(ky[b]) < 0.13
    noisy = wave + 0.1 * np.random.default_rng(8).standard_normal(wave.shape)
    beams = extra.capon(noisy, 100.0, 12.5, np.arange(-4, 5) / 100)
    sx, sy, _ = max(beams, key=lambda v: v[2])
    assert abs(abs(sx) - 0.02) < 1e-9 and abs(sy) < 1e-9
    blob = lambda cx: np.exp(-((x[0] - cx) ** 2 + (y[0] - 3.5) ** 2) / 4)
    u, v = extra.lucas_kanade(np.array([blob(3.0), blob(3.3)]))
    assert abs(u[0, 3:5, 2:5].mean() - 0.3) < 0.1 and abs(v[0, 3:5, 2:5].mean()) < 0.05
    rows = extra.log_blobs(blob(4.0), (0.8, 1.4))
    assert any((a, b) in {(3, 4), (4, 4)} for a, b, _, _ in rows)


def test_line_removal_and_shoulder():
    from siglake.functions import extra

    x = 0.1 * np.random.default_rng(9).standard_normal(1024)
    line = np.sin(2 * np.pi * 125 * np.arange(1024) / FS)
    got, found = extra.without_line(x + line, FS, 125.0)
    assert found and np.abs(got - x).max() < 0.05 and not extra.without_line(x, FS, 125.0, p=1e-6)[1]
    y = extra.shoulder_bandpass(np.sin(2 * np.pi * 400 * T) + np.sin(2 * np.pi * 20 * T), FS, 300, 450)
    assert np.abs(y - np.sin(2 * np.pi * 400 * T))[500:-500].max() < 0.02

def test_numbers_without_keys_follow_the_order(spark):
    from siglake.operators.catalog import numbered

    rows = [(float(i * 37 % 500), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "t double, src long").repartition(7), "peak", ["t", "src"]).collect()
    assert {r["src"]: r["event_id"] for r in got} == {i: f"peak_{k:06d}" for k, (_, i) in enumerate(sorted(rows))}


def test_generalized_phase_of_known_signals():
    t = np.arange(400) / 400
    turn = 2 * np.pi * 12 * t
    phase = dsp.generalized_phase(np.stack([3 + np.cos(turn), np.cos(turn + 1)]))
    assert np.allclose(phase[0], turn, atol=1e-9) and np.allclose(phase[1], turn + 1, atol=1e-9)
    x = np.cos(turn) + 0.6 * np.cos(5 * turn)  # its frequency turns negative at times, which is not bridged
    assert (np.diff(dsp.generalized_phase(x)) < 0).any()
    assert np.allclose(dsp.generalized_phase(x), dsp.generalized_phase(x + 7))


def test_surrogates_keep_what_they_should(spark):
    from siglake import plans
    from siglake.plans import registry

    plans.load()
    d = "/root/testdata/sf0.001"
    own = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(own["embedding"].to_list()).astype(float)
    got = registry.QUERIES["phase_randomize"](spark, d).orderBy("vec_id", "i").toPandas()
    y = got["y"].to_numpy().reshape(len(x), -1)
    assert np.allclose(np.abs(np.fft.rfft(x, axis=1)), np.abs(np.fft.rfft(y, axis=1)), atol=1e-3) and not np.allclose(x, y, atol=0.1)
    moved = registry.QUERIES["spatial_shuffle"](spark, d).orderBy("vec_id", "ap", "ml").toPandas()["x"].to_numpy().reshape(len(x), -1)
    assert np.allclose(np.sort(x, axis=1), np.sort(moved, axis=1)) and (x != moved).mean() > 0.9
