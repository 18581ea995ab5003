"""Detection pipelines: named transforms in order, then a detector; each rebuilds from its configuration."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.functions import dsp
from siglake.operators import detect, kernels, series, spectral
from siglake.operators.catalog import EventCatalog, numbered

TRANSFORMS: dict[str, type[Transform]] = {}
DETECTORS: dict[str, type[Detector]] = {}


class Configured(ABC):
    def __init__(self, **params) -> None:
        self.params = {**self.defaults, **params}
        if unknown := set(params) - set(self.defaults):
            raise ValueError(f"{type(self).__name__} has no {sorted(unknown)}")

    defaults: dict = {}

    def to_dict(self) -> dict:
        return {"name": type(self).__name__, "params": dict(self.params)}

    def __getattr__(self, name: str):
        try:
            return self.__dict__["params"][name]
        except KeyError:
            raise AttributeError(name) from None


class Transform(Configured):
    """Samples (keys, i, t, x) to samples."""

    def __init_subclass__(cls) -> None:
        TRANSFORMS[cls.__name__] = cls

    @abstractmethod
    def compute(self, samples: DataFrame, keys: list[str]) -> DataFrame: ...


class Detector(Configured):
    """Samples (keys, i, t, x) to events."""

    label = "event"

    def __init_subclass__(cls) -> None:
        DETECTORS[cls.__name__] = cls

    @abstractmethod
    def detect(self, samples: DataFrame, keys: list[str]) -> DataFrame: ...


#: Samples of a series that a filter takes at once.
CHUNK = 1_000_000


def _kernel(samples: DataFrame, keys: list[str], f, margin: int | None = None) -> DataFrame:
    """x by a kernel; one that reaches only `margin` samples takes long series by chunks."""
    y = kernels.transformed(samples, keys, f) if margin is None or margin > CHUNK else kernels.transformed(samples, keys, f, chunk=CHUNK, margin=margin)
    return samples.join(y, [*keys, "i"]).drop("x").withColumnRenamed("y", "x")


def _reach(sos: np.ndarray) -> int:
    """Samples to either side on which a filter's values rest: forward and back, and the extension at a chunk's end."""
    return 3 * dsp.settling(sos)


class Bandpass(Transform):
    defaults = {"fs": 1000.0, "low": 1.0, "high": 40.0, "order": 4}

    def compute(self, samples, keys):
        fs, low, high, order = self.fs, self.low, self.high, self.order
        return _kernel(samples, keys, lambda x: dsp.bandpass(x, fs, low, high, order), _reach(dsp.butter(order, (low, min(high, fs / 2 - 0.1)), "band", fs)))


class Highpass(Transform):
    defaults = {"fs": 1000.0, "cut": 1.0, "order": 4}

    def compute(self, samples, keys):
        fs, cut, order = self.fs, self.cut, self.order
        return _kernel(samples, keys, lambda x: dsp.highpass(x, fs, cut, order), _reach(dsp.butter(order, cut, "high", fs)))


class Lowpass(Transform):
    defaults = {"fs": 1000.0, "cut": 40.0, "order": 4}

    def compute(self, samples, keys):
        fs, cut, order = self.fs, self.cut, self.order
        return _kernel(samples, keys, lambda x: dsp.lowpass(x, fs, cut, order), _reach(dsp.butter(order, cut, "low", fs)))


class Envelope(Transform):
    def compute(self, samples, keys):
        return _kernel(samples, keys, dsp.envelope)


class ZScore(Transform):
    def compute(self, samples, keys):
        return series.zscored(samples, keys, "x").drop("x").withColumnRenamed("z", "x")


class Spectrogram(Transform):
    """Samples to power by frequency (keys, freq, i, t, x): windows of nperseg samples, half of them shared by default."""

    defaults = {"fs": 1000.0, "nperseg": 256, "noverlap": None, "bandwidth": 4.0}

    def compute(self, samples, keys):
        half = self.nperseg // 2 if self.noverlap is None else self.noverlap
        p = spectral.spectrogram(samples, keys, self.fs, self.nperseg, half, self.bandwidth)
        return p.select(*keys, "freq", F.col("win").cast("long").alias("i"), "t", F.col("p").alias("x"))


class Threshold(Detector):
    defaults = {"threshold": 3.0, "direction": "positive", "merge_gap": 0, "min_duration": 0.0}
    label = "thresh"

    def detect(self, samples, keys):
        return detect.threshold_events(samples, keys, **self.params)


class Ripple(Detector):
    """Band, envelope, standard score, dual threshold, durations."""

    defaults = {"fs": 1000.0, "low": 100.0, "high": 250.0, "threshold_low": 2.0, "threshold_high": 3.0, "min_duration": 0.02, "max_duration": 0.2}
    label = "ripple"

    def score(self, samples, keys):
        for step in (Bandpass(fs=self.fs, low=self.low, high=self.high), Envelope(), ZScore()):
            samples = step.compute(samples, keys)
        return samples

    def detect(self, samples, keys):
        found = detect.dual_threshold_events(self.score(samples, keys), keys, self.threshold_low, self.threshold_high)
        return found.withColumn("duration", F.col("t1") - F.col("t0")).where(F.col("duration").between(self.min_duration, self.max_duration))


class Spindle(Ripple):
    """The same for 11 to 16 Hz and 0.5 to 3 s, with frequency, relative power, symmetry and greedy isolation."""

    defaults = {**Ripple.defaults, "low": 11.0, "high": 16.0, "min_duration": 0.5, "max_duration": 3.0, "min_isolation": 0.0}
    label = "spindle"

    def detect(self, samples, keys):
        band = Bandpass(fs=self.fs, low=self.low, high=self.high).compute(samples, keys)
        found = detect.enriched(band, super().detect(samples, keys), keys)
        return detect.isolated(found, keys, self.min_isolation) if self.min_isolation > 0 else found


class SlowWave(Detector):
    defaults = {"fs": 1000.0, "low": 0.5, "high": 4.0, "order": 2, "neg": (0.125, 1.5), "cycle": (0.25, 3.0), "percentile": 25.0}
    label = "slow_wave"

    def detect(self, samples, keys):
        band = Bandpass(fs=self.fs, low=self.low, high=self.high, order=self.order).compute(samples, keys)
        return detect.slow_waves(band, keys, tuple(self.neg), tuple(self.cycle), self.percentile)


class Burst(Detector):
    """h-maxima of each series' spectrogram."""

    defaults = {"fs": 1000.0, "nperseg": 256, "noverlap": 128, "bandwidth": 4.0, "h_quantile": 0.9}
    label = "burst"

    def detect(self, samples, keys):
        fs, size, overlap, nw, quantile = self.fs, self.nperseg, self.noverlap, self.bandwidth * self.nperseg / self.fs, self.h_quantile

        def run(x: np.ndarray) -> pd.DataFrame:
            f, t, p = dsp.spectrogram(x, fs, size, overlap, max(nw, 1.0))
            at = dsp.detect_hmaxima(p, quantile)
            return pd.DataFrame({"t": t[at[:, 0]], "freq": f[at[:, 1]], "value": p[at[:, 0], at[:, 1]]})

        return kernels.expanded(samples, keys, run, "t double, freq double, value double")


class DetectionPipeline:
    def __init__(self, name: str, transforms: list[Transform], detector: Detector) -> None:
        self.name, self.transforms, self.detector = name, transforms, detector

    def run(self, samples: DataFrame, keys: list[str]) -> EventCatalog:
        for step in self.transforms:
            samples = step.compute(samples, keys)
        found = numbered(self.detector.detect(samples, keys).withColumn("label", F.lit(self.detector.label)), self.detector.label, ["t"], keys)
        return EventCatalog(found, {"pipeline": self.name, "transforms": [t.to_dict() for t in self.transforms], "detector": self.detector.to_dict()})

    def to_dict(self) -> dict:
        return {"name": self.name, "transforms": [t.to_dict() for t in self.transforms], "detector": self.detector.to_dict()}

    @classmethod
    def from_dict(cls, config: dict) -> DetectionPipeline:
        made = [TRANSFORMS[t["name"]](**t["params"]) for t in config["transforms"]]
        return cls(config["name"], made, DETECTORS[config["detector"]["name"]](**config["detector"]["params"]))


RIPPLE = DetectionPipeline("ripple", [Bandpass(low=100.0, high=250.0), Envelope(), ZScore()], Threshold(threshold=3.0))
GAMMA = DetectionPipeline("gamma", [Bandpass(low=30.0, high=80.0), Envelope(), ZScore()], Threshold(threshold=2.5))


def gamma_validated(samples: DataFrame, found: DataFrame, keys: list[str], fs: float, band: tuple[float, float] = (30.0, 140.0), smooth_ms: float = 50.0) -> DataFrame:
    """found (keys, t) with gamma_z, the smoothed standard score of the gamma envelope at the nearest sample, and valid, if below 0."""
    sigma = max(1.0, smooth_ms / 1000 * fs / 2.35)
    z = _kernel(samples, keys, lambda x: dsp.gaussian_filter(dsp.envelope(dsp.bandpass(x, fs, *band)), sigma))
    z = series.zscored(z, keys, "x").select(*keys, "i", F.col("z").alias("gamma_z"))
    at = found.withColumn("i", F.floor(F.col("t") * fs + 0.5).cast("long"))
    return at.join(z, [*keys, "i"], "left").drop("i").withColumn("valid", F.col("gamma_z") < 0)
