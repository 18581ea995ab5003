"""MD5 of many short texts at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
LANES = 8192


def _rounds(words: np.ndarray, length: int) -> np.ndarray:
    """The first 64 bits, as they sort, of the digests of texts of one length, given the words (words, texts) that hold them."""
    a, b, c, d = (np.full(words.shape[1], v, dtype=np.uint32) for v in _START)
    for i, (add, turn, g) in enumerate(zip(_ADD, _TURN, _WORD, strict=True)):
        if i < 16:
            f = c ^ d
            f &= b
            f ^= d
        elif i < 32:
            f = b ^ c
            f &= d
            f ^= c
        elif i < 48:
            f = b ^ c
            f ^= d
        else:
            f = ~d
            f |= b
            f ^= c
        f += a
        f += np.uint32((add + (8 * length if g == 14 else 0)) & 0xFFFFFFFF)
        if g < len(words):
            f += words[g]
        low = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    a, b = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


def md5_order(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """(heads, tails): the first 64 bits of the MD5 of each head followed by each tail, which sort as the digests do."""
    out = np.empty((len(heads), len(tails)), dtype=np.uint64)
    by_length = lambda texts: {n: [k for k, t in enumerate(texts) if len(t) == n] for n in {len(t) for t in texts}}
    for n, hs in by_length(heads).items():
        for m, ts in by_length(tails).items():
            if n + m > 55:  # more than a block
                out[np.ix_(hs, ts)] = [[int.from_bytes(hashlib.md5(heads[h] + tails[t]).digest()[:8], "big") for t in ts] for h in hs]
                continue
            block = np.zeros((len(hs), len(ts), (n + m) // 4 * 4 + 4), dtype=np.uint8)
            block[:, :, :n] = np.frombuffer(b"".join(heads[h] for h in hs), dtype=np.uint8).reshape(len(hs), 1, n)
            block[:, :, n : n + m] = np.frombuffer(b"".join(tails[t] for t in ts), dtype=np.uint8).reshape(1, len(ts), m)
            block[:, :, n + m] = 0x80
            words = np.ascontiguousarray(block.view("<u4").reshape(len(hs) * len(ts), -1).T)
            got = [_rounds(words[:, k : k + LANES], n + m) for k in range(0, words.shape[1], LANES)]
            out[np.ix_(hs, ts)] = np.concatenate(got).reshape(len(hs), len(ts))
    return out
