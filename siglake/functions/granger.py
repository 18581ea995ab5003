"""Granger influence by frequency, from cross spectra that are factored into a minimum-phase transfer and its noise."""

from __future__ import annotations

import numpy as np

from siglake.functions import dsp


def factored(s: np.ndarray, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(transfer (freq, 2, 2), noise covariance (2, 2)) of spectra (freq, 2, 2) on the whole circle, by Newton's steps.

    Each step takes the causal part of psi^-1 s psi^-* + 1: positive lags whole, lag zero by its upper triangle.
    """
    n = len(s)
    psi = np.broadcast_to(np.linalg.cholesky(np.fft.ifft(s, axis=0)[0].real).astype(complex), s.shape).copy()
    for _ in range(rounds):
        inner = np.linalg.solve(psi, s)
        g = np.linalg.solve(psi, inner.conj().swapaxes(1, 2)) + np.eye(2)
        lags = np.fft.ifft(g, axis=0)
        zero = lags[0].real / 2
        lags[0] = zero
        lags[n // 2 + 1 :] = 0
        if n % 2 == 0:
            lags[n // 2] /= 2
        turn = zero - np.triu(zero)
        lags[0] += turn.T - turn
        new = psi @ np.fft.fft(lags, axis=0)
        moved = np.abs(new - psi).max() / np.abs(new).max()
        psi = new
        if moved < tol:
            break
    a = np.fft.ifft(psi, axis=0)[0].real
    return psi @ np.linalg.inv(a), a @ a.T


def influence(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x to y, y to x) at each frequency: log of a spectrum over its part that doesn't come from the other's noise."""
    h, noise = factored(s)
    own = h @ noise @ h.conj().swapaxes(1, 2)

    def one(to: int, of: int) -> np.ndarray:
        rest = noise[of, of] - noise[of, to] ** 2 / noise[to, to]
        p = own[:, to, to].real
        return np.log(p / np.maximum(p - rest * np.abs(h[:, to, of]) ** 2, 1e-300))

    return one(1, 0), one(0, 1)


def spectral(x: np.ndarray, y: np.ndarray, fs: float, nw: float = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(freqs, x to y, y to x) of two series, from multitaper cross spectra."""
    n = len(x)
    z = np.stack([x - x.mean(), y - y.mean()])
    tapered = np.fft.fft(z[:, None, :] * dsp.dpss(n, nw, int(2 * nw - 1))[0], axis=-1)
    s = np.einsum("akf,bkf->fab", tapered, tapered.conj()) / tapered.shape[1] / fs
    a, b = influence(s)
    k = n // 2 + 1
    return np.fft.rfftfreq(n, 1 / fs), a[:k], b[:k]
