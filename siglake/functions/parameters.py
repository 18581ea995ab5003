"""Conversions of parameters, on the driver."""

from __future__ import annotations

import math


def samples(x: float, fs: float) -> int:
    """Whole numbers are samples already; others are seconds, cut down to whole samples."""
    return x if isinstance(x, int) else int(float(x) * fs)


def cycles_length(center: float, fs: float = 1.0, cycles: float = 7, power_of_two: bool = True) -> int:
    """Samples of so many cycles, or the power of two that is nearest on a log scale."""
    n = int(fs * cycles / center)
    return 2 ** round(math.log2(n)) if power_of_two else n


def tapers_of_bandwidth(bandwidth: float, fs: float, nperseg: int, noverlap: int) -> dict[str, float]:
    return {"nw": bandwidth * nperseg / fs, "fs": fs, "size": nperseg, "step": nperseg - noverlap}


def bandwidth_of_tapers(nw: float, fs: float, size: int, step: int) -> dict[str, float]:
    return {"bandwidth": nw * fs / size, "fs": fs, "nperseg": size, "noverlap": size - step}


def sigma_bounds(sigmas: dict[str, tuple[float, float]], rates: dict[str, float]) -> tuple[dict[str, int], dict[str, int]]:
    """Least and most sigma of each dimension in samples: at least 1, and more than the least or else twice that."""
    least = {d: max(1, int(lo * rates[d])) for d, (lo, _) in sigmas.items()}
    most = {d: k if (k := int(hi * rates[d])) > least[d] else 2 * least[d] for d, (_, hi) in sigmas.items()}
    return least, most
