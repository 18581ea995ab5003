"""Complexity and outlier kernels in numpy."""

from __future__ import annotations

import itertools

import numpy as np


def hurst(x: np.ndarray) -> float:
    """Exponent of rescaled range over window length."""
    n = len(x)
    sizes = np.unique(np.floor(np.geomspace(8, n // 2, 12)).astype(int)) if n >= 32 else np.array([])
    found = []
    for m in sizes:
        parts = x[: n // m * m].reshape(-1, m)
        walk = np.cumsum(parts - parts.mean(1, keepdims=True), axis=1)
        sd = parts.std(axis=1)
        rs = np.ptp(walk, axis=1)[sd > 0] / sd[sd > 0]
        if len(rs):
            found.append((np.log(m), np.log(rs.mean())))
    return float(np.polyfit(*zip(*found, strict=True), 1)[0]) if len(found) > 1 else np.nan


def dfa(x: np.ndarray) -> float:
    """Detrended fluctuation exponent, lines removed from windows."""
    n = len(x)
    walk, found = np.cumsum(x - np.mean(x)), []
    for m in np.unique(np.floor(np.geomspace(4, n // 4, 12)).astype(int)) if n >= 32 else []:
        parts = walk[: n // m * m].reshape(-1, m)
        t = np.arange(m) - (m - 1) / 2
        rest = parts - parts.mean(1, keepdims=True) - ((parts @ t) / (t @ t))[:, None] * t
        f = np.sqrt((rest**2).mean(axis=1)).mean()
        if f > 0:
            found.append((np.log(m), np.log(f)))
    return float(np.polyfit(*zip(*found, strict=True), 1)[0]) if len(found) > 1 else np.nan


def sample_entropy(x: np.ndarray, order: int = 2, tolerance: float | None = None) -> float:
    """-ln of how often sequences that match for `order` samples match for one more (Chebyshev, 0.2 deviations)."""
    r = 0.2 * np.std(x) if tolerance is None else tolerance
    n = len(x) - order

    def matches(m: int) -> int:
        v = np.lib.stride_tricks.sliding_window_view(x, m)[:n]
        return sum(int((np.abs(v[i + 1 :] - v[i]).max(axis=1) <= r).sum()) for i in range(n - 1))

    a, b = matches(order + 1), matches(order)
    return float(-np.log(a / b)) if a and b else np.inf if b else np.nan


def lempel_ziv(x: np.ndarray, normalize: bool = True) -> float:
    """LZ76 phrases of the series over its median, times log2(n) / n, within [0, 1]."""
    s = "".join("1" if v else "0" for v in x > np.median(x))
    n, i, phrases = len(s), 0, 0
    while i < n:
        k = 1
        while i + k <= n and s[i : i + k] in s[: i + k - 1]:
            k += 1
        phrases, i = phrases + 1, i + k
    return float(np.clip(phrases * np.log2(n) / n, 0, 1)) if normalize and n > 1 else float(phrases)


def knee(y: np.ndarray) -> int:
    """Index of an increasing curve that is furthest below its chord."""
    x = np.linspace(0, 1, len(y))
    span = np.ptp(y) or 1.0
    return int(np.argmax(x - (y - y.min()) / span))


def dbscan_outliers(x: np.ndarray, min_samples: int = 5, eps: float | None = None, block: int = 512) -> np.ndarray:
    """Rows (n, features) in no cluster, after standardising; eps by the knee of the k-nearest distances. NaN rows are not judged.

    Distances are made for a block of rows at a time, so memory is n times the block.
    """
    fine = np.isfinite(x).all(axis=1)
    own = x[fine]
    out = np.zeros(len(x), dtype=bool)
    if len(own) <= min_samples:
        return out
    sd = own.std(axis=0)
    z = (own - own.mean(axis=0)) / np.where(sd > 0, sd, 1)
    starts = range(0, len(z), block)

    def distances(k: int) -> np.ndarray:
        total = np.zeros((len(z[k : k + block]), len(z)))
        for j in range(z.shape[1]):
            total += (z[k : k + block, j, None] - z[None, :, j]) ** 2
        return np.sqrt(total)

    if eps is None:
        kth = np.sort(np.concatenate([np.partition(distances(k), min_samples - 1, axis=1)[:, min_samples - 1] for k in starts]))
        smooth = np.convolve(np.pad(kth, 1, mode="edge"), np.ones(3) / 3, "valid")
        eps = max(float(smooth[knee(smooth)]), 1e-12)
    core = np.concatenate([(distances(k) <= eps).sum(1) >= min_samples for k in starts])
    out[fine] = ~np.concatenate([core[k : k + block] | ((distances(k) <= eps) & core).any(1) for k in starts])
    return out


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost."""
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def fast_ica(x: np.ndarray, n: int, rounds: int = 200, tol: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sources (n, samples), mixing (channels, n)) of x (channels, samples), by symmetric fixed-point iteration with tanh."""
    mean = x.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(x - mean, full_matrices=False)
    n = min(n, int((s > 1e-10 * s[0]).sum()))
    white = (u[:, :n] / s[:n]).T * np.sqrt(x.shape[1])
    z = white @ (x - mean)
    decorrelate = lambda w: (lambda e: e[1] @ np.diag(e[0] ** -0.5) @ e[1].T @ w)(np.linalg.eigh(w @ w.T))
    w = decorrelate(np.random.default_rng(seed).standard_normal((n, n)))
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = decorrelate(g @ z.T / z.shape[1] - np.diag((1 - g**2).mean(1)) @ w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < tol:
            break
    return w @ z, np.linalg.pinv(w @ white)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone piecewise cubic interpolation."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = np.sign(d[1:]) * np.sign(d[:-1]) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))) if len(h) > 1 else ():
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[end] = 0 if np.sign(s) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(s) > 3 * abs(d0) else s
    if len(h) == 1:
        m[:] = d[0]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t**2 * (3 - 2 * t) * y[k + 1] + t**2 * (t - 1) * h[k] * m[k + 1]


def varimax(x: np.ndarray, rounds: int = 100, tol: float = 1e-4, kaiser: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rotated loadings, rotation), pair by pair until all angles are small."""
    scale = np.sqrt((x**2).sum(1, keepdims=True)) if kaiser else np.ones((len(x), 1))
    scale = np.where(scale > 0, scale, 1)
    y, r = x / scale, np.eye(x.shape[1])
    for _ in range(rounds):
        most = 0.0
        for i, j in itertools.combinations(range(x.shape[1]), 2):
            u, v = y[:, i] ** 2 - y[:, j] ** 2, 2 * y[:, i] * y[:, j]
            n = len(y)
            num, den = 2 * (n * (u @ v) - u.sum() * v.sum()), n * (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2)
            angle = np.arctan2(num, den) / 4
            most = max(most, abs(angle))
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            y[:, [i, j]], r[:, [i, j]] = y[:, [i, j]] @ turn, r[:, [i, j]] @ turn
        if most < tol:
            break
    return y * scale, r


def simplicity(y: np.ndarray) -> float:
    """What varimax maximises: the variance of squared loadings, summed over factors."""
    return float(((y**2) ** 2).mean(0).sum() - ((y**2).mean(0) ** 2).sum())


def spread_points(x: np.ndarray, eps: float, seed: int | None = None) -> np.ndarray:
    """Indices of a subset of points more than eps apart: a random start, then each time the nearest that is left."""
    left = np.ones(len(x), dtype=bool)
    at, kept = int(np.random.default_rng(seed).integers(len(x))), []
    while True:
        kept.append(at)
        d = np.linalg.norm(x - x[at], axis=1)
        left &= d > eps
        if not left.any():
            return np.array(kept)
        at = int(np.argmin(np.where(left, d, np.inf)))
