"""External induced sorting of a shard's suffixes, with the common prefixes of neighbours.

Suffixes are of type S or L, as they are smaller or larger than the next one. The leftmost S suffixes (LMS) are sorted
first: their substrings are sorted by one induction and named, and where names repeat, the reduced string of names is
sorted in turn, by recursion while there are up to `LETTERS` names and by prefix doubling beyond. Another induction then
places all suffixes. An induction runs over a monotone priority queue keyed by first character: taking a bucket's suffixes
in order and putting each one's predecessor into the queue keeps every bucket in order, and as predecessors only go to the
same bucket or later ones, a whole bucket is taken at a time as an array.

The queue carries tuples of a suffix and its common prefix with the one put into the bucket before it. The common prefix of
two suffixes that are put one after the other is one more than that of those that they precede, which is the least of the
values between these two in the order; values are capped at the length that matters. Sorted LMS suffixes get theirs from
hashes, L and S suffixes that meet in a bucket from the runs of their first character.

A queue of more than `IN_MEMORY` entries spills its buckets to a file. The string, its types and the order that comes out
stay in memory, some 30 bytes a character.
"""

from __future__ import annotations

import tempfile

import numpy as np

IN_MEMORY, LETTERS = 8_000_000, 4096
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


ENTRY = np.dtype([("at", np.int32), ("lcp", np.int32)])


class BucketQueue:
    """Entries by bucket, first in first out within one; beyond `most` entries buckets are appended to a file."""

    def __init__(self, buckets: int, most: int | None = None):
        self.parts: list[list] = [[] for _ in range(buckets)]
        self.held, self.most, self.file = 0, IN_MEMORY if most is None else most, None

    def put(self, bucket: int, entries: np.ndarray) -> None:
        self.parts[bucket].append(entries)
        self.held += len(entries)
        if self.held > self.most:
            self._spill()

    def put_all(self, buckets: np.ndarray, entries: np.ndarray) -> None:
        """Entries with their buckets, kept in order within each."""
        if not len(entries):
            return
        order = np.argsort(buckets, kind="stable")
        own, entries = buckets[order], entries[order]
        cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
            self.put(int(own[lo]), entries[lo:hi])

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="suffix-queue-")
        self.file.seek(0, 2)
        for own in self.parts:
            for i, x in enumerate(own):
                if isinstance(x, np.ndarray):
                    own[i] = (self.file.tell(), len(x), x.dtype)
                    x.tofile(self.file)
        self.held = 0

    def take(self, bucket: int) -> np.ndarray:
        """All entries of a bucket, in the order in which they came."""
        own, self.parts[bucket], out = self.parts[bucket], [], []
        for x in own:
            if isinstance(x, np.ndarray):
                self.held -= len(x)
            else:
                at, n, kind = x
                self.file.seek(at)
                x = np.fromfile(self.file, dtype=kind, count=n)
            out.append(x)
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, dtype=ENTRY)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _types(s: np.ndarray) -> np.ndarray:
    """True: type S. The last suffix is L, as nothing follows it but the end, which is smallest."""
    step = np.sign(np.append(s[1:].astype(np.int64), -1) - s.astype(np.int64))
    at = np.where(step != 0, np.arange(len(s)), len(s) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


class _Between:
    """For each bucket the least common prefix met since an entry was put into it."""

    def __init__(self, letters: int, most: int):
        self.least, self.most = np.zeros(letters, dtype=np.int32), np.int32(most)

    def put(self, queue: BucketQueue, to: np.ndarray, entries: np.ndarray, source: np.ndarray, lcp: np.ndarray) -> None:
        """Puts entries whose sources are at `source` among suffixes that follow each other with common prefixes lcp."""
        if len(entries):
            order = np.argsort(to, kind="stable")
            to, entries, source = to[order], entries[order], source[order]
            first = np.append(True, to[1:] != to[:-1])
            table = [lcp]  # least of 1, 2, 4 ... values from each place on
            while (step := 1 << len(table) - 1) < len(lcp):
                table.append(np.minimum(table[-1], np.append(table[-1][step:], np.full(min(step, len(lcp)), self.most, dtype=np.int32))))
            table = np.stack(table)
            lo = np.where(first, 0, np.append(0, source[:-1]) + 1)
            level = np.frexp(source - lo + 1)[1] - 1
            least = np.minimum(table[level, lo], table[level, source + 1 - (1 << level)])
            least[first] = np.minimum(least[first], self.least[to[first]])
            made = np.empty(len(entries), dtype=ENTRY)
            made["at"], made["lcp"] = entries, np.minimum(least + 1, self.most)
            queue.put_all(to, made)
        if len(lcp):
            np.minimum(self.least, lcp.min(), out=self.least)
        if len(entries):
            last = np.append(first[1:], True)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.most)
            self.least[to[last]] = after[source[last] + 1]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int, lcp: np.ndarray | None = None, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with their common prefixes, from the LMS ones in order with theirs.

    Without lcp the LMS suffixes may be in any order: then LMS substrings come out sorted, and no common prefixes.
    """
    n, carried = len(s), lcp is not None
    seeds, queue, larges, smalls = (BucketQueue(letters) for _ in range(4))
    entries = np.zeros(len(lms), dtype=ENTRY)
    entries["at"] = lms
    if carried:
        entries["lcp"] = lcp
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)).astype(np.int32)  # of runs of a character

        def run(at: int) -> int:
            """How often the character follows itself, from this place."""
            return int(ends[np.searchsorted(ends, at)]) + 1 - at

    seeds.put_all(s[lms], entries)
    queue.put(int(s[n - 1]), np.array([(n - 1, 0)], dtype=ENTRY))  # induced by the end itself

    def passed(target: BucketQueue, between: _Between, x: np.ndarray, own: np.ndarray, to_small: bool) -> None:
        """Puts the predecessors of one type."""
        source = np.flatnonzero(x > 0)
        before = x[source] - 1
        kept = small[before] == to_small
        source, before = source[kept], before[kept]
        if carried:
            between.put(target, s[before], before, source, own)
        else:
            made = np.zeros(len(before), dtype=ENTRY)
            made["at"] = before
            target.put_all(s[before], made)

    between = _Between(letters, most)
    for c in range(letters):
        last = -1
        while len(x := queue.take(c)):  # rounds: what a round puts into its own bucket is the next one
            own = x["lcp"].copy()
            if last < 0:
                own[0] = x["lcp"][0] = 0
            larges.put(c, x)
            last = int(x["at"][-1])
            passed(queue, between, x["at"], own, False)
        if len(x := seeds.take(c)):
            own = x["lcp"]
            own[0] = min(run(last), run(int(x["at"][0])), most) if carried and last >= 0 else 0
            passed(queue, between, x["at"], own, False)
    between, parts = _Between(letters, most), []
    for c in range(letters - 1, -1, -1):
        last, descending = -1, []
        while len(x := smalls.take(c)):
            own = x["lcp"].copy()
            if last < 0:
                own[0] = 0
            descending.append(x)
            last = int(x["at"][-1])
            passed(smalls, between, x["at"], own, True)
        large = larges.take(c)
        meet = min(run(last), run(int(large["at"][-1])), most) if carried and last >= 0 and len(large) else 0
        if len(large):
            passed(smalls, between, large["at"][::-1], np.append(np.int32(meet), large["lcp"][:0:-1]), True)
        if descending:
            x = np.concatenate(descending)
            up = np.empty(len(x), dtype=ENTRY)
            up["at"], up["lcp"] = x["at"][::-1], np.append(np.int32(meet), x["lcp"][:0:-1])
            parts.append(up)
        parts.append(large)
    for q in (seeds, queue, larges, smalls):
        q.close()
    out = np.concatenate(parts[::-1]) if parts else np.empty(0, dtype=ENTRY)
    return out["at"], out["lcp"]


def prefix_hashes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which `window_hash` gets the hash of any stretch."""
    sums = np.zeros(len(s) + 1, dtype=np.uint64)
    x = s.astype(np.uint64)
    x += np.uint64(1)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.cumprod(np.full(len(s), _ODD, dtype=np.uint64))
    np.cumsum(x, out=sums[1:])
    return sums, np.cumprod(np.full(len(s), _INVERSE, dtype=np.uint64))


def window_hash(hashes: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    sums, inverse = hashes
    x = (sums[at + length] - sums[at]) * inverse[at]
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1) * np.asarray(length).astype(np.uint64)


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of a reduced string's suffixes, once names repeat little: ranks of twice the length each round."""
    rank, width = names.astype(np.int64), 1
    n = len(rank)
    while True:
        pair = rank * (n + 1)
        pair[: n - width] += rank[width:] + 1
        order = np.argsort(pair)
        own = pair[order]
        new = np.ones(n, dtype=np.int64)
        new[0] = 0
        new[1:] = own[1:] != own[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if rank.max() == n - 1 or width >= n:
            return order


def suffix_array(s: np.ndarray, letters: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Start of each suffix of a non-negative integer string, in order; with most, common prefixes with the one before it, up to that."""
    n = len(s)
    if n < 2:
        return np.arange(n), None if most is None else np.zeros(n, dtype=np.int64)
    letters = int(s.max()) + 1 if letters is None else letters
    if letters > LETTERS:
        order = _doubling(s)
        return order, None if most is None else common_prefix(s, order, most)
    s = s.astype(np.uint16)  # which numpy sorts by radix
    small = _types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        order = _induce(s, small, lms, letters)[0]
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        length = np.zeros(n, dtype=np.int32)
        length[lms] = np.minimum(np.append(lms[1:], n - 1) + 1, n) - lms
        whole = window_hash(prefix_hashes(s), order, length[order])
        new = np.ones(len(order), dtype=np.int64)
        new[0] = 0
        new[1:] = (whole[1:] != whole[:-1]) | (length[order][1:] != length[order][:-1]) | (order[1:] == lms[-1]) | (order[:-1] == lms[-1])
        names = np.cumsum(new)
        if names[-1] + 1 < len(lms):
            name = np.zeros(n, dtype=np.int32)
            name[order] = names
            order = lms[suffix_array(name[lms], int(names[-1]) + 1)[0]]
    else:
        order = lms
    if most is None:
        return _induce(s, small, order, letters)[0], None
    return _induce(s, small, order, letters, common_prefix(s, order, most), most)


def common_prefix(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common-prefix value of each of some suffixes with the one before it, at most `most`, by hashes; the first has 0."""
    hashes, n = prefix_hashes(s), len(s)
    a, b = order[:-1], order[1:]
    low, high = np.zeros(len(b), dtype=np.int64), np.minimum(most, n - np.maximum(a, b))
    at = np.arange(len(b))  # those that are still open
    while len(at):
        middle = (low[at] + high[at] + 1) // 2
        same = window_hash(hashes, a[at], middle) == window_hash(hashes, b[at], middle)
        low[at], high[at] = np.where(same, middle, low[at]), np.where(same, high[at], middle - 1)
        at = at[low[at] < high[at]]
    return np.concatenate([np.zeros(min(1, len(order)), dtype=np.int64), low])
