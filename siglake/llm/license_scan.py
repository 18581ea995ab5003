"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are sequences of lower-case words in shingles of `SHINGLE` words. A template belongs to the largest
window size of `SIZES` that it fills. Windows of that size start every quarter of it in texts and templates alike, and each
has `BANDS` band keys, the least values of as many hash functions over its shingles (one row a band).

A text that holds a template to `CONTAINMENT` has a window at most an eighth off one of the template's, hence a Jaccard
similarity j of 0.54 at least, and a band in common with probability 1 - (1 - j)^16 > 0.99999 for each such window. Size 1
has every shingle as its own window, which no copy can miss. What bands retrieve is verified: the share of the
template's shingles in the best stretch of a quarter more than its length, counted exactly. A stretch ends where its share
is reached, so that it takes nothing from a copy that follows. Stretches of one template that overlap give one row, the
best of them and of equals the first.

Null and empty texts hold nothing. A template of fewer words than a shingle is one shingle. Repeated rows each give their
rows; a null doc_id is kept. Empty tables and an empty template list give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches

SHINGLE, CONTAINMENT, BANDS, SEED = 5, 0.8, 16, 42
SIZES = (64, 16, 1)
MATCHES = "doc_id long, license string, containment double, first_word long, n_words long"
# Notices and grants of well-known public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_marks = bytes(32 if not (chr(i).isalnum() or i > 127) else i for i in range(256))
_odd = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)
_place = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII marks and white space part them."""
    return text.lower().encode("utf-8", "replace").translate(_marks).split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """A hash for each shingle, in order; fewer words than a shingle are one."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += (h[k : k + n] + np.uint64(1)) * _place[k]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def band_keys(own: np.ndarray, size: int) -> np.ndarray:
    """Keys (windows x BANDS) of windows of `size` shingles, or of what there is, that start every quarter of it."""
    if size == 1:
        return own[:, None]
    step = size // 4
    starts = np.arange(0, len(own), step)
    out = np.empty((len(starts), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        quarter = np.minimum.reduceat(own * _odd[0, b] + _odd[1, b], starts)
        least = quarter.copy()
        for k in range(1, min(4, len(quarter))):
            np.minimum(least[:-k], quarter[k:], out=least[:-k])
        out[:, b] = least
    return out


class Templates:
    """Templates with their band keys, by window size."""

    def __init__(self, texts: dict[str, str]):
        self.names = [n for n, t in texts.items() if words_of(t)]
        self.own = [np.unique(shingles(words_of(texts[n]))) for n in self.names]
        self.length = [len(words_of(texts[n])) for n in self.names]
        self.sizes: list[tuple[int, list[dict[int, list[int]]], list[np.ndarray]]] = []
        for size in SIZES:
            tables: list[dict[int, list[int]]] = [{} for _ in range(1 if size == 1 else BANDS)]
            for k, n in enumerate(self.names):
                seen = shingles(words_of(texts[n]))
                if size == next((x for x in SIZES if x <= len(seen)), 1):
                    for row in band_keys(seen, size):
                        for table, key in zip(tables, row.tolist(), strict=True):
                            if k not in table.setdefault(key, []):
                                table[key].append(k)
            if tables[0]:
                self.sizes.append((size, tables, [np.array(sorted(t), dtype=np.uint64) for t in tables]))

    def retrieved(self, own: np.ndarray) -> dict[int, list[int]]:
        """template -> first shingles of the windows that share a band with it."""
        found: dict[int, list[int]] = {}
        for size, tables, keys in self.sizes:
            rows = band_keys(own, size)
            for b, (table, sought) in enumerate(zip(tables, keys, strict=True)):
                at = np.minimum(np.searchsorted(sought, rows[:, b]), len(sought) - 1)
                for i in np.flatnonzero(sought[at] == rows[:, b]):
                    for k in table[int(rows[i, b])]:
                        found.setdefault(k, []).append(int(i) * max(1, size // 4))
        return found

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, containment, first word, words) of each verified stretch of a text."""
        own, out = shingles(words_of(text)), []
        for k, starts in sorted(self.retrieved(own).items()):
            template = self.own[k]
            span = max(1, self.length[k] + self.length[k] // 4 - SHINGLE + 1)
            best: list[tuple[float, int, int]] = []
            regions: list[list[int]] = []  # where stretches start; they may end beyond
            for i in sorted(set(starts)):
                lo, hi = max(0, i - span), i + span + max(SIZES)
                if regions and lo <= regions[-1][1]:
                    regions[-1][1] = hi
                else:
                    regions.append([lo, hi])
            for lo, hi in regions:
                region = own[lo : hi + span]
                at = np.flatnonzero(np.isin(region, template))
                ends = np.searchsorted(at, at + span)
                for j in np.flatnonzero((at < hi - lo) & (ends - np.arange(len(at)) >= CONTAINMENT * len(template) - 1e-9)).tolist():
                    p, inside = int(at[j]), at[j : ends[j]]
                    first = np.unique(region[inside], return_index=True)[1]
                    share = len(first) / len(template)
                    if share >= CONTAINMENT:
                        best.append((share, lo + p, int(inside[first.max()]) - p + min(SHINGLE, self.length[k])))
            out += [(self.names[k], *x) for x in self._apart(best)]
        return out

    @staticmethod
    def _apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        """The best of stretches that overlap, in order of place."""
        kept: list[tuple[float, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(x[1] + x[2] <= y[1] or y[1] + y[2] <= x[1] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[1])


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, first_word and n_words of every stretch of docs that holds a template."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in shared.value.matches(text)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, MATCHES)
