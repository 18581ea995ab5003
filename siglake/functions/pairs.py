"""Kernels over all pairs of rows of two matrices.

Nothing but numpy is imported here, as in `neighbors`.
"""

from __future__ import annotations

import numpy as np


def unit(x: np.ndarray) -> np.ndarray:
    """Rows less their means, of length 1; NaN without spread."""
    d = x - x.mean(-1, keepdims=True)
    d /= np.sqrt((d * d).sum(-1, keepdims=True))
    d[x.min(-1) == x.max(-1)] = np.nan  # deviations of equal values may be a little more than 0
    return d


def shared(x: np.ndarray, here: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of the row x with each row of y over the samples that both have, and whether there are any."""
    both = here & there
    n = both.sum(-1, keepdims=True)

    def apart(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(both, v - np.where(both, v, 0).sum(-1, keepdims=True) / n, 0)
        return d, np.where(both, v, np.inf).min(-1) == np.where(both, v, -np.inf).max(-1)

    (a, flat_a), (b, flat_b) = apart(x), apart(y)
    r = (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    return np.where(flat_a | flat_b, np.nan, r), n[:, 0] > 0


def correlations(x: np.ndarray, here: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) of Pearson's over the samples that both have, NaN without spread, and whether there are any."""
    with np.errstate(invalid="ignore", divide="ignore"):
        r, known = unit(x) @ unit(y).T, np.ones((len(x), len(y)), dtype=bool)
        for k in np.flatnonzero(~here.all(-1)):
            r[k], known[k] = shared(x[k], here[k], y, there)
        for k in np.flatnonzero(~there.all(-1)):
            r[:, k], known[:, k] = shared(y[k], there[k], x, here)
    return r, known


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL's round."""
    return np.trunc(v * 10.0**digits + np.copysign(0.5, v)) / 10.0**digits
