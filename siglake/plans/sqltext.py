"""SQL texts of signal processing, from which the queries' SQL is put together: what numpy kernels do, by joins and sums.

Coefficients of filters and tapers stand in the SQL as numbers; tests hold their design against known gains and concentrations.
"""

from __future__ import annotations

import numpy as np

from siglake.functions import dsp


def number(v: float) -> str:
    """A double, not a decimal."""
    return f"({float(v):.17e})"


def numbers(values) -> str:
    return "[" + ", ".join(number(v) for v in values) + "]"


def listed(source: str = "sig_64", name: str = "ls", key: str = "vec_id", value: str = "x") -> str:
    return f"{name} AS (SELECT {key}, list({value} ORDER BY i) AS x FROM {source} GROUP BY {key})"


def samples(source: str, name: str, key: str = "vec_id") -> str:
    """Rows (key, i, x) of lists."""
    return f"{name} AS (SELECT {key}, unnest(range(len(x))) AS i, unnest(x) AS x FROM {source})"


def _pass(name: str, source: str, sos: np.ndarray, key: str) -> str:
    """One run of the sections over lists, by recursion over samples, from the states of a constant first sample."""
    zi, state, out, v = dsp.sosfilt_zi(sos), [], [], "x[n + 1]"
    init, outputs = [], []
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        init += [f"{number(zi[s, 0])} * x[1] AS p{s}", f"{number(zi[s, 1])} * x[1] AS q{s}"]
        outputs.append(f"{number(b0)} * {v} + p{s} AS y{s}")
        state += [f"{number(b1)} * {v} - {number(a1)} * y{s} + q{s}", f"{number(b2)} * {v} - {number(a2)} * y{s}"]
        v = f"y{s}"
    out = f"list_append(o, {v})"
    return f"""{name}_r AS (SELECT {key}, x, 0 AS n, []::DOUBLE[] AS o, {', '.join(init)} FROM {source} UNION ALL
    SELECT {key}, x, n + 1, {out}, {', '.join(state)} FROM (SELECT *, {', '.join(outputs)} FROM {name}_r WHERE n < len(x))),
  {name} AS (SELECT {key}, list_reverse(o) AS x FROM {name}_r WHERE n = len(x))"""


def filtered(name: str, source: str, sos: np.ndarray, n: int | None = None, key: str = "vec_id") -> str:
    """Lists of n samples, or of any longer length, filtered forward and back, over odd extensions at both ends."""
    pad = 3 * (2 * len(sos) + 1 - int(min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())))
    pad = pad if n is None else min(pad, n - 1)
    ext = f"{name}_e AS (SELECT {key}, [2 * x[1] - x[{pad} + 1 - j] for j in range({pad})] || x || [2 * x[len(x)] - x[len(x) - 1 - j] for j in range({pad})] AS x FROM {source})"
    return f"{ext}, {_pass(f'{name}_f', f'{name}_e', sos, key)}, {_pass(f'{name}_b', f'{name}_f', sos, key)}, {name} AS (SELECT {key}, x[{pad} + 1:len(x) - {pad}] AS x FROM {name}_b)"


def analytic(source: str, name: str, n: int = 64, key: str = "vec_id") -> str:
    """Real and imaginary part a, b of the analytic signal of rows (key, i, x) of n samples."""
    return f"""{name}_t AS (SELECT {key}, k, CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END * sum(x * cos(2 * pi() * k * i / {n})) / {n} AS re, -CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END * sum(x * sin(2 * pi() * k * i / {n})) / {n} AS im FROM {source}, (SELECT unnest(range({n // 2 + 1})) AS k) GROUP BY {key}, k),
  {name} AS (SELECT {key}, n.i, sum(re * cos(2 * pi() * k * n.i / {n}) - im * sin(2 * pi() * k * n.i / {n})) AS a, sum(re * sin(2 * pi() * k * n.i / {n}) + im * cos(2 * pi() * k * n.i / {n})) AS b FROM {name}_t, (SELECT unnest(range({n})) AS i) n GROUP BY {key}, n.i)"""


def reflected(k: str, n: str | int) -> str:
    """Index k mirrored into 0 to n - 1, the ends repeated."""
    return f"(CASE WHEN {k} < 0 THEN -({k}) - 1 WHEN {k} >= {n} THEN 2 * {n} - 1 - ({k}) ELSE {k} END)"


def gaussian(name: str, sigma: float) -> str:
    """Weights w of offsets j."""
    r = int(4 * sigma + 0.5)
    return f"{name} AS (SELECT j, e / sum(e) OVER () AS w FROM (SELECT j, exp(-0.5::DOUBLE * power(j / {number(sigma)}, 2)) AS e FROM range(-{r}, {r + 1}) r(j)))"


def tapers(name: str, n: int, nw: float) -> str:
    """Tapers (taper, i, w)."""
    own = dsp.dpss(n, nw, max(1, int(2 * nw - 1)))[0]
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT {j} AS taper, unnest(range({n})) AS i, unnest({numbers(t)}) AS w" for j, t in enumerate(own)) + ")"


def multitaper(name: str, source: str, n: int, nw: float, key: str = "vec_id") -> str:
    """Complex spectra (key, taper, k, re, im) of rows (key, i, x) of n samples, each less its line."""
    return f"""{name}_l AS (SELECT {key}, regr_slope(x, i) AS s, regr_intercept(x, i) AS c FROM {source} GROUP BY ALL), {tapers(f'{name}_w', n, nw)},
  {name} AS (SELECT {key}, taper, k, sum((x - s * i - c) * w * cos(2 * pi() * k * i / {n})) AS re, -sum((x - s * i - c) * w * sin(2 * pi() * k * i / {n})) AS im
    FROM {source} JOIN {name}_l USING ({key}) JOIN {name}_w USING (i), (SELECT unnest(range({n // 2 + 1})) AS k) GROUP BY {key}, taper, k)"""


def uniform(seed: int | str, *of: str) -> str:
    """What functions.generators.uniform draws."""
    return f"(('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(of)})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def normal(seed: int, *of: str) -> str:
    return f"sqrt(-2 * ln(1 - {uniform(seed, *of)})) * cos(2 * pi() * {uniform(seed + 1, *of)})"


def _grown(name: str, source: str, rows: int, cols: int) -> str:
    """Grey reconstruction of lists s under lists m, both rows by cols: as many rounds as the longest path may take."""
    near = [[a * cols + b + 1 for a in range(max(r - 1, 0), min(r + 2, rows)) for b in range(max(c - 1, 0), min(c + 2, cols))] for r in range(rows) for c in range(cols)]
    return f"""{name}_r AS (SELECT vec_id, s, m, 0 AS n FROM {source} UNION ALL SELECT vec_id, list_transform({near}, lambda q, k: least(m[k], list_max(list_transform(q, lambda v: s[v])))), m, n + 1 FROM {name}_r WHERE n < {rows * cols}),
  {name} AS (SELECT vec_id, s FROM {name}_r WHERE n = {rows * cols})"""


def hmaxima(name: str, source: str, rows: int, cols: int, quantile: float) -> str:
    """Places (vec_id, k) from 0 of lists x that stand h above their surroundings, h by a quantile."""
    return f"""{name}_h AS (SELECT vec_id, x, CASE WHEN h = 0 THEN 0.1::DOUBLE ELSE h END AS h, list_max(x) - list_min(x) AS span FROM (SELECT vec_id, x, list_aggregate(x, 'quantile_cont', {quantile}) AS h FROM {source})),
  {name}_s AS (SELECT vec_id, [v - h for v in x] AS s, x AS m FROM {name}_h), {_grown(f'{name}_l', f'{name}_s', rows, cols)},
  {name}_u AS (SELECT vec_id, [v - 1e-9 * greatest(1, span) for v in s] AS s, s AS m FROM {name}_l JOIN {name}_h USING (vec_id)), {_grown(f'{name}_t', f'{name}_u', rows, cols)},
  {name} AS (SELECT vec_id, k, x[k + 1] AS x FROM {name}_h JOIN (SELECT vec_id, s AS low FROM {name}_l) USING (vec_id) JOIN (SELECT vec_id, s AS top FROM {name}_t) USING (vec_id), (SELECT unnest(range({rows * cols})) AS k)
    WHERE h <= span AND low[k + 1] - top[k + 1] > 0 AND x[k + 1] - low[k + 1] >= h - 1e-9)"""
