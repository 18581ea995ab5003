"""Further kernels: shoulder filters, triangle weights, line removal, blobs, wavenumber spectra, beams, flow, tracking."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd

from siglake.functions import dsp


def butter_order(pass_: tuple[float, float], stop: tuple[float, float], fs: float, rp: float, rs: float) -> int:
    """Least order of a band-pass with rp dB at most within pass_ and rs dB at least outside stop."""
    w = [math.tan(math.pi * f / fs) for f in (*pass_, *stop)]
    own = min(abs((s * s - w[0] * w[1]) / (s * (w[1] - w[0]))) for s in w[2:])
    return max(1, math.ceil(math.log10((10 ** (rs / 10) - 1) / (10 ** (rp / 10) - 1)) / (2 * math.log10(max(own, 1.0001)))))


def shoulder_sos(fs: float, low: float, high: float, shoulder: float = 25.0, rp: float = 1.0, rs: float = 40.0) -> np.ndarray:
    """Sections of the band-pass whose order its shoulders ask for, 12 at most."""
    order = min(butter_order((low, high), (max(low - shoulder, 0.01), min(high + shoulder, fs / 2 - 0.01)), fs, rp, rs), 12)
    return dsp.butter(order, (low, high), "band", fs)


def shoulder_bandpass(x: np.ndarray, fs: float, low: float, high: float, shoulder: float = 25.0, rp: float = 1.0, rs: float = 40.0) -> np.ndarray:
    return dsp.sosfiltfilt(shoulder_sos(fs, low, high, shoulder, rp, rs), x)


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles of a few hundred points: those whose circumcircle holds no other, grown from one edge each time."""
    out, n = [], len(points)
    lift = (points**2).sum(1)
    for i, j in itertools.combinations(range(n), 2):
        for k in range(j + 1, n):
            a = np.column_stack([points[[i, j, k]], np.ones(3)])
            det = np.linalg.det(a)
            if abs(det) < 1e-12:
                continue
            c = np.linalg.solve(a, lift[[i, j, k]])  # lift = c . (x, y, 1) on the triangle's plane
            rest = np.ones(n, dtype=bool)
            rest[[i, j, k]] = False
            if (lift[rest] - points[rest] @ c[:2] - c[2] > -1e-9).all():
                out.append((i, j, k))
    return out


def linear_weights(xy: np.ndarray, bad: np.ndarray) -> list[tuple[int, int, float]]:
    """(bad, good, weight): barycentric weights of each bad place in the smallest triangle of good ones about it, else the nearest."""
    good, rows = np.flatnonzero(~bad), []
    for b in np.flatnonzero(bad):
        near = good[np.argsort(((xy[good] - xy[b]) ** 2).sum(1), kind="stable")[:12]]
        best = None
        for t in triangles(xy[near]):
            a = np.vstack([xy[near[list(t)]].T, np.ones(3)])
            w = np.linalg.solve(a, [*xy[b], 1.0])
            if (w >= -1e-9).all() and (best is None or abs(np.linalg.det(a)) < best[0]):
                best = abs(np.linalg.det(a)), near[list(t)], w
        rows += [(b, g, w) for g, w in zip(best[1], best[2], strict=True)] if best else [(b, near[0], 1.0)]
    return rows


def without_line(x: np.ndarray, fs: float, f0: float, nw: float = 2.0, p: float = 0.05) -> tuple[np.ndarray, bool]:
    """x less its line at f0, if Thomson's test finds one there."""
    freq, f, threshold = dsp.ftest(x, fs, nw, p)
    k = int(np.argmin(np.abs(freq - f0)))
    if f[k] <= threshold:
        return x, False
    tapers, _ = dsp.dpss(len(x), nw, int(2 * nw - 1))
    h, t = tapers.sum(1), np.arange(len(x))
    y = ((x - x.mean()) * tapers) @ np.exp(-2j * np.pi * freq[k] * t / fs)
    mu = (h * y).sum() / (h**2).sum()
    return x - 2 * np.real(mu * np.exp(2j * np.pi * freq[k] * t / fs)), True


def log_blobs(x: np.ndarray, sigmas: tuple[float, ...], threshold_rel: float = 0.2) -> list[tuple[int, int, float, float]]:
    """(row, column, sigma, score) of maxima over places and scales of the negative Laplacian of Gaussians."""
    stack = []
    for s in sigmas:
        g = dsp.gaussian_filter(dsp.gaussian_filter(x, s).T, s).T
        p = np.pad(g, 1, mode="symmetric")
        stack.append(-(s**2) * (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g))
    v = np.array(stack)
    p = np.pad(v, 1, constant_values=-np.inf)
    top = np.ones(v.shape, dtype=bool)
    for d in np.ndindex(3, 3, 3):
        if d != (1, 1, 1):
            top &= v >= p[tuple(slice(k, k + n) for k, n in zip(d, v.shape, strict=True))]
    at = np.argwhere(top & (v > threshold_rel * v.max()))
    return [(int(a), int(b), float(sigmas[s]), float(v[s, a, b])) for s, a, b in at]


def kw_spectrum(x: np.ndarray, fs: float, tapers: tuple[float, float] | None = None) -> tuple[np.ndarray, ...]:
    """(f, ky, kx, power) of frames (time, ap, ml): a Hann window in time, or products of tapers of these time-bandwidths."""
    n, a, m = x.shape
    x = x - x.mean(axis=0, keepdims=True)
    if tapers is None:
        own = [np.hanning(n)[:, None, None] * np.ones((1, a, m))]
    else:
        one = lambda size, nw: dsp.dpss(size, nw, max(1, int(2 * nw - 1)))[0]
        own = [u[:, None, None] * v[None, :, None] * w[None, None, :] for u in one(n, tapers[0]) for v in one(a, tapers[1]) for w in one(m, tapers[1])]
    s = np.mean([np.abs(np.fft.fftn(x * w)) ** 2 for w in own], axis=0)
    f = np.fft.fftfreq(n, 1 / fs)
    keep = f > 0
    return f[keep], np.fft.fftfreq(a), np.fft.fftfreq(m), s[keep]


def capon(x: np.ndarray, fs: float, freq: float, slowness: np.ndarray, segments: int = 4) -> list[tuple[float, float, float]]:
    """(sx, sy, power) of minimum-variance beams at one frequency, from segments' cross spectra with a diagonal load.

    Fewer frames than segments make a segment each; without any signal the power is 0.
    """
    n, a, m = x.shape
    segments = min(segments, n)
    size = n // segments
    parts = x[: segments * size].reshape(segments, size, a * m)
    y = np.tensordot(np.exp(-2j * np.pi * freq * np.arange(size) / fs), parts, axes=(0, 1))
    r = y.T @ y.conj() / segments
    total = np.trace(r).real
    if total == 0:
        return [(float(sx), float(sy), 0.0) for sx, sy in itertools.product(slowness, slowness)]
    inverse = np.linalg.inv(r / total + 1e-6 * np.eye(a * m))
    ap, ml = np.divmod(np.arange(a * m), m)
    out = []
    for sx, sy in itertools.product(slowness, slowness):
        steer = np.exp(-2j * np.pi * freq * (sx * ml + sy * ap))
        out.append((float(sx), float(sy), float(total / max((steer.conj() @ inverse @ steer).real, 1e-300))))
    return out


def lucas_kanade(x: np.ndarray, load: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) along ml and ap between consecutive frames, by least squares over 3 x 3 places."""
    mid = (x[1:] + x[:-1]) / 2
    gy, gx = np.gradient(mid, axis=(1, 2))
    gt = x[1:] - x[:-1]

    def around(v: np.ndarray) -> np.ndarray:
        p = np.pad(v, ((0, 0), (1, 1), (1, 1)), mode="edge")
        return sum(p[:, i : i + v.shape[1], j : j + v.shape[2]] for i in range(3) for j in range(3))

    xx, yy, xy, xt, yt = (around(v) for v in (gx * gx, gy * gy, gx * gy, gx * gt, gy * gt))
    det = (xx + load) * (yy + load) - xy * xy
    return (-(yy + load) * xt + xy * yt) / det, (-(xx + load) * yt + xy * xt) / det


def tracked(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """rows (vec_id as frame, ap, ml) in order, with wave: the label of the nearest extremum of the frame before, within the radius."""
    out, last, fresh = [], [], 0
    for _, frame in rows.groupby("vec_id", sort=True):
        now = []
        for ap, ml in zip(frame["ap"], frame["ml"], strict=True):
            near = [(abs(ap - a) + abs(ml - m), w) for a, m, w in last if max(abs(ap - a), abs(ml - m)) <= radius]
            label = min(near)[1] if near else fresh
            fresh += not near
            now.append((ap, ml, label))
        out += [w for _, _, w in now]
        last = now
    return rows.assign(wave=out)


def _at(x: np.ndarray, ap: np.ndarray, ml: np.ndarray) -> np.ndarray:
    """Frames (n, ap, ml) read at real places (n, ap, ml) by bilinear interpolation; places outside take the edge."""
    n, a, m = x.shape
    ap, ml = np.clip(ap, 0, a - 1), np.clip(ml, 0, m - 1)
    i, j = np.minimum(ap.astype(int), max(a - 2, 0)), np.minimum(ml.astype(int), max(m - 2, 0))
    p, q, k = ap - i, ml - j, np.arange(n)[:, None, None]
    below, right = np.minimum(i + 1, a - 1), np.minimum(j + 1, m - 1)
    return (1 - p) * ((1 - q) * x[k, i, j] + q * x[k, i, right]) + p * ((1 - q) * x[k, below, j] + q * x[k, below, right])


def _linearised(first: np.ndarray, second: np.ndarray, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradients (2, n, ap, ml) of the second frames at their displaced places, what they are there less the first frames)."""
    places = np.indices(first.shape[1:], dtype=float)[:, None] + flow
    slope = [_at(g, *places) for g in np.gradient(second, axis=(1, 2))]
    return np.array(slope), _at(second, *places) - first


def flow_tvl1(x: np.ndarray, attachment: float = 15.0, tightness: float = 0.3, warps: int = 5, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) along ap and ml between consecutive frames: absolute brightness error and total variation, by the dual method.

    At each warp the error is linear about the flow so far; a pointwise threshold lowers it, a dual field (one for each component and
    direction) smooths the result. Brightness is scaled to a range of 1.
    """
    x = (x - x.min()) / (np.ptp(x) or 1.0)
    first, second = x[:-1], x[1:]
    flow, dual, step = np.zeros((2, *first.shape)), np.zeros((2, 2, *first.shape)), 0.25
    for _ in range(warps):
        slope, rest = _linearised(first, second, flow)
        size, about = (slope**2).sum(0), flow.copy()
        for _ in range(rounds):
            error = rest + (slope * (flow - about)).sum(0)
            far = attachment * tightness * size
            move = np.where(error < -far, attachment * tightness, np.where(error > far, -attachment * tightness, -error / np.maximum(size, 1e-12)))
            eased = flow + np.where(size > 1e-12, move, 0) * slope
            for c in range(2):
                spread = np.zeros_like(first)
                for axis in (1, 2):
                    inner = np.moveaxis(dual[c, axis - 1], axis, 0)
                    out = np.moveaxis(spread, axis, 0)
                    out[:-1] += inner[:-1]
                    out[1:] -= inner[:-1]
                flow[c] = eased[c] + tightness * spread
                rise = np.array([np.diff(flow[c], axis=axis, append=np.take(flow[c], [-1], axis=axis)) for axis in (1, 2)])
                dual[c] = (dual[c] + step / tightness * rise) / (1 + step / tightness * np.sqrt((rise**2).sum(0)))
    return flow[0], flow[1]


def flow_ilk(x: np.ndarray, radius: int = 2, warps: int = 10, load: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) along ap and ml between consecutive frames: least squares over places within the radius, the second frame warped again each time.

    A warp moves no place by more than one sample, as far as its gradients hold."""
    first, second = x[:-1], x[1:]
    flow, side = np.zeros((2, *first.shape)), 2 * radius + 1

    def around(v: np.ndarray) -> np.ndarray:
        p = np.pad(v, ((0, 0), (radius, radius), (radius, radius)), mode="edge")
        return np.lib.stride_tricks.sliding_window_view(p, (side, side), axis=(1, 2)).sum(axis=(-2, -1))

    for _ in range(warps):
        (gy, gx), rest = _linearised(first, second, flow)
        error = rest - gy * flow[0] - gx * flow[1]
        yy, xx, xy, ye, xe = around(gy * gy) + load, around(gx * gx) + load, around(gx * gy), around(gy * error), around(gx * error)
        det = yy * xx - xy * xy
        moved = np.array([(xy * xe - xx * ye) / det, (xy * ye - yy * xe) / det]) - flow
        flow = flow + moved / np.maximum(np.sqrt((moved**2).sum(0)), 1)
    return flow[0], flow[1]
