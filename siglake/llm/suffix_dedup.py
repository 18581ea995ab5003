"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that starts anywhere else as well.

1. Every whole text is scanned once. Each window of LENGTH bytes picks an anchor, the GRAM-byte string in it of least hash
   (the leftmost of equals). The choice depends on the window's bytes alone, so equal windows have equal anchors, at equal
   places in them. Consecutive windows that pick one anchor form its context.
   A task that finds contexts of equal content itself notes them as repeated and passes on one of them, so that what is
   very common isn't gathered anywhere.
2. Contexts are dealt and sorted by (anchor, content), in ranges, so that an anchor of many contexts is shared by tasks. An
   anchor found once has no repeated window. Contexts with equal content are repeated as a whole. What is left are the
   rims of repeated passages: contexts that share an anchor but not their content.
3. Rims are dealt and sorted by anchor. A task takes them in shards of some `SHARD_BYTES`, one after the other, and sorts each
   shard's suffixes by external induced sorting (see suffix_sort). Windows that are neighbours in suffix order with a common prefix of LENGTH are repeated.
   An anchor with more than `GROUP` contexts would not fit a shard. Its windows are parted by where they hold the anchor,
   each context into two at most, and each half is keyed by its core, the bytes that all windows of that half have in
   common: equal windows have equal cores. Halves go through step 2 again, and this recurs until no core has more than
   `GROUP` contexts, or the windows at one place are left, whose core is the window. The number of rows falls with what is
   settled and never exceeds twice that of the level before.
4. Repeated windows are merged into spans, by document, and cut out of its bytes.

Null text: empty. Texts shorter than LENGTH bytes keep all. Repeated rows repeat each other, whatever their doc_id; rows of
one doc_id and text get one result each. A null doc_id is a value like any other. Empty tables give no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches, written
from siglake.llm.suffix_sort import suffix_array

LENGTH, GRAM = 200, 96
#: Windows of a text that are dealt with at once, and the low bits of a hash that hold a place among them.
CHUNK, PLACE = 1 << 20, np.uint64(21)
SHARD_BYTES, GROUP = 1_500_000, 1000
#: Tasks that shards are dealt to; beyond, a task sorts several, one after the other.
MOST_TASKS = 20_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.default_rng(200).integers(1, 1 << 64, 256, dtype=np.uint64)  # a random number for each byte value
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n += n // 2
        for name, factor in (("up", _ODD), ("down", _INVERSE)):
            x = np.full(n, factor, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


class Hashes:
    """Hash of any stretch of a byte string."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, dtype=np.uint8)
        up, self.down = _tables(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=self.sums[1:])

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[at]) * self.down[at])

    def grams(self, length: int) -> np.ndarray:
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def contexts(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, last window) of each context of a text of length bytes or more."""
    parts = []
    for i in range(0, len(raw) - length + 1, CHUNK):
        own = _contexts(raw[i : i + CHUNK + length - 1], length, gram)
        parts.append((*own[:2], own[2] + i, own[3] + i))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _contexts(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    hashes = Hashes(raw)
    grams, wide = hashes.grams(gram), length - gram + 1
    keys = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
    n = len(keys) - wide + 1
    blocks = np.concatenate([keys, np.full(-len(keys) % wide, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[wide - 1 : wide - 1 + n]
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    picked = (np.minimum(ahead, behind) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(picked[1:] != picked[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    place = (picked[first] - first).astype(np.uint64) * np.uint64(_ODD) + (last - first).astype(np.uint64)
    return grams[picked[first]], hashes.of(first, last + length) ^ _mix(place), first, last


ROW = ["anchor", "content", "doc_id", "text_hash", "first", "last"]
KEY = "anchor long, content long, doc_id long, text_hash long, first int, last int"
#: more: a further context of this content, which needs no more than a span; many: the one of them that is passed on.
SCANNED = f"{KEY}, more boolean, many boolean"
#: place: of the anchor in a context, -1 if it has to be looked for; low, high: the places that its windows may have it at.
HALF = "place int, low int, high int, raw binary"


def _combined(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """more and many of a task's own contexts."""
    order = np.lexsort((content, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
    more, many = np.zeros(len(anchor), dtype=bool), np.zeros(len(anchor), dtype=bool)
    more[order[1:]] = same
    many[order[:-1]] = same
    return more, many & ~more


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list) -> pa.RecordBatch:
        anchor, content, first, last = (np.concatenate([p[0][i] for p in parts]) for i in range(4))
        at = np.repeat(np.arange(len(parts)), [len(p[0][0]) for p in parts])
        doc, own = pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.int64())
        cols = [anchor.view(np.int64), content.view(np.int64), None, None, first.astype(np.int32), last.astype(np.int32), *_combined(anchor, content)]
        cols = [pa.array(x) if x is not None else None for x in cols]
        cols[2:4] = [doc.take(pa.array(at)), own.take(pa.array(at))]
        return pa.RecordBatch.from_arrays(cols, [*ROW, "more", "many"])

    for b in batches:
        parts, size = [], 0
        for doc, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) < LENGTH:
                continue
            parts.append((contexts(raw), doc, own))
            size += len(parts[-1][0][0])
            if size > 100_000:
                yield out(parts)
                parts, size = [], 0
        if parts:
            yield out(parts)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, content): which are repeated as a whole, and which stand for a rim's content.

    What is kept between batches is a row or two, however many contexts an anchor has. `many` says of a rim context that
    others have its content. The first and last anchor may go on in another task, so their contexts always are rims.
    """
    held: pa.Table | None = None  # the last row, whose successor isn't known yet
    before = None  # (anchor, content) of the row before it
    opening: pa.Table | None = None  # the first context of the last row's anchor, until a second content shows up

    def found(t: pa.Table, whole: np.ndarray, rim: np.ndarray, many: np.ndarray) -> pa.Table:
        t = t.drop_columns(["more", "many"])
        for name, x in (("whole", whole), ("rim", rim), ("many", many)):
            t = t.append_column(name, pa.array(x))
        return t

    def done(t: pa.Table, after: tuple | None) -> Iterator[pa.RecordBatch]:
        nonlocal before, opening
        anchor, content = t["anchor"].to_numpy(), t["content"].to_numpy()
        n = len(anchor)
        a = np.concatenate([[before[0] if before else 0], anchor, [after[0] if after else 0]])
        c = np.concatenate([[before[1] if before else 0], content, [after[1] if after else 0]])
        same_anchor, same = a[1:] == a[:-1], (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        if not before:
            same_anchor[0] = same[0] = False
        if not after:
            same_anchor[-1] = same[-1] = False
        whole, opens = same[:-1] | same[1:], ~same[:-1]  # opens: first row of its content
        own_many = t["many"].to_numpy()
        whole, many = whole | own_many, same[1:] | own_many
        starts = np.maximum.accumulate(np.where(~same_anchor[:-1], np.arange(n), -1))  # first row of the anchor, -1: before this batch
        later = opens & same_anchor[:-1]  # first row of a further content
        rim = later.copy()
        rim[starts[later & (starts >= 0)]] = True
        rim[0] |= not before
        extra = opening if opening is not None and (later & (starts == -1)).any() else None
        if starts[-1] >= 0:  # the last anchor began here
            k = int(starts[-1])
            opening = None if rim[k] else found(t.slice(k, 1), np.array([False]), np.array([True]), many[k : k + 1])
        elif extra is not None:
            opening = None
        before = (anchor[-1], content[-1])
        if extra is not None:
            yield from extra.to_batches()
        kept = whole | rim
        if kept.any():
            yield from found(t, whole, rim, many).filter(pa.array(kept)).combine_chunks().to_batches()

    for b in batches:
        more = b.column("more")
        t = pa.Table.from_batches([b.filter(more)])
        if t.num_rows:
            no = np.zeros(t.num_rows, dtype=bool)
            yield from found(t, ~no, no, no).combine_chunks().to_batches()
        t = pa.Table.from_batches([b.filter(pc.invert(more))])
        if not t.num_rows:
            continue
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        held = t.slice(t.num_rows - 1)
        if t.num_rows > 1:
            yield from done(t.slice(0, t.num_rows - 1), (held["anchor"][0].as_py(), held["content"][0].as_py()))
    if held is not None:
        yield from done(held, None)
        if opening is not None:
            yield from opening.to_batches()


def _classified(rows: DataFrame, schema: str, name: str) -> DataFrame:
    """Rows with whole, rim and many, dealt by ranges of (anchor, content) and written; the others are gone."""
    dealt = F.when(F.col("more"), F.xxhash64("text_hash", "first")).otherwise(F.col("anchor"))
    rows = rows.repartitionByRange(dealt, "content").sortWithinPartitions("anchor", "content")
    return written(rows.mapInArrow(_classify, f"{schema}, whole boolean, rim boolean, many boolean"), name)


def _spans(found: DataFrame) -> DataFrame:
    return found.where("whole").select("doc_id", "text_hash", F.col("first").alias("start"), (F.col("last") + LENGTH).cast("int").alias("end"))


def repeated_windows(rims: list[bytes], many: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """Of each rim context, which of its windows are repeated, by the suffix order of all of them.

    many: contexts of which there are copies outside. Their windows count for the others.
    """
    text = np.zeros(sum(len(x) + 1 for x in rims), dtype=np.uint16)
    starts, ends, at = [], [], 0
    for x in rims:
        text[at : at + len(x)] = np.frombuffer(x, dtype=np.uint8)
        text[at : at + len(x)] += 1  # 0 parts contexts
        starts.append(at), ends.append(at + len(x) - length + 1)
        at += len(x) + 1
    window = np.zeros(len(text), dtype=bool)
    twice = np.zeros(len(text), dtype=bool)
    for lo, hi, m in zip(starts, ends, many, strict=True):
        window[lo:hi] = True
        twice[lo:hi] = m
    order, prefix = suffix_array(text, 257, length)
    at = np.flatnonzero(window[order])
    order = order[at]
    same = np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1) >= length if len(at) > 1 else np.zeros(0, dtype=bool)
    found = twice.copy()
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return [found[lo:hi] for lo, hi in zip(starts, ends, strict=True)]


def _runs(found: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SPANS = "doc_id long, text_hash long, start int, end int"


def _shard_spans(contexts: list[tuple]) -> pa.RecordBatch:
    """Spans of the repeated windows of contexts (doc_id, text_hash, first, many, raw)."""
    docs, hashes, firsts, many, raw = zip(*contexts, strict=True)
    rows = []
    for doc, own_hash, first, found in zip(docs, hashes, firsts, repeated_windows(list(raw), list(many)), strict=True):
        rows += [(doc, own_hash, first + a, first + b - 1 + LENGTH) for a, b in _runs(found)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "text_hash", "start", "end"])


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of contexts sorted by anchor, a shard at a time: an anchor is never parted, so a task holds SHARD_BYTES and one anchor more."""
    own, size, last = [], 0, None
    for b in batches:
        for anchor, *context in zip(*(b.column(n).to_pylist() for n in ("anchor", "doc_id", "text_hash", "first", "many", "raw")), strict=True):
            if size >= SHARD_BYTES and anchor != last:
                yield _shard_spans(own)
                own, size = [], 0
            own.append(tuple(context))
            size, last = size + len(context[-1]) + 1, anchor
    if own:
        yield _shard_spans(own)


def _digest(raw: bytes, *by: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=b"%d,%d" % by).digest(), "little", signed=True)


def halves(anchor: int, raw: bytes, place: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(core, content, first and last window, place, low, high) of each half of a context's windows, by where they hold the anchor."""
    if place < 0:
        place = int(np.argmax(Hashes(raw).grams(GRAM).view(np.int64) == anchor))
    n, middle = len(raw) - LENGTH + 1, (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        first, last = place - min(b, place), place - max(a, place - n + 1)
        if first <= last:
            core, own = raw[place - a : place - b + LENGTH], raw[first : last + LENGTH]
            yield _digest(core, a, b), _digest(own, place - first, last - first), first, last, place - first, a, b


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context of a crowded anchor as two of fewer windows, keyed by what the windows of each have in common."""
    for b in batches:
        rows = []
        for anchor, doc, own, at, many, place, low, high, raw in zip(*(b.column(n).to_pylist() for n in ("anchor", "doc_id", "text_hash", "first", "many", "place", "low", "high", "raw")), strict=True):
            rows += [(core, content, doc, own, at + i, at + j, p, x, y, raw[i : j + LENGTH], many) for core, content, i, j, p, x, y in halves(anchor, raw, place, low, high)]
        cols = list(zip(*rows, strict=True)) or [()] * 11
        more, many = _combined(np.array(cols[0], dtype=np.int64), np.array(cols[1], dtype=np.int64))
        kinds = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.binary()]
        made = [pa.array(x, k) for x, k in zip(cols[:10], kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*made, pa.array(more), pa.array(many | np.array(cols[10], dtype=bool))], [*ROW, "place", "low", "high", "raw", "more", "many"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, own, text, rims in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text_hash", "text", "rims")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(r["anchor"], doc, own, r["first"], r["many"], -1, 0, LENGTH - GRAM, raw[r["first"] : r["last"] + LENGTH]) for r in rims]
        cols = list(zip(*rows, strict=True)) or [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["anchor", "doc_id", "text_hash", "first", "many", "place", "low", "high", "raw"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text, spans in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "spans")), strict=True):
            raw, kept, at, n = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0
            for start, end in merged([(s["start"], s["end"]) for s in spans or ()]):
                kept.update(raw[at:start])
                at, n = end, n + 1
            kept.update(raw[at:])
            gone = sum(e - s for s, e in merged([(s["start"], s["end"]) for s in spans or ()]))
            rows.append((doc, len(raw), gone, n, kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end: byte spans that cover all repeated strings; docs as from `keyed`."""
    found = _classified(docs.select("doc_id", "text_hash", "text").mapInArrow(_scan, SCANNED), KEY, "suffix-contexts")
    spans = _spans(found)
    rims = found.where("rim").select("anchor", "doc_id", "text_hash", "first", "last", "many")
    size = rims.agg(F.sum(F.col("last") - F.col("first") + LENGTH + 1).alias("bytes")).first()["bytes"]
    if not size:
        return spans
    grouped = rims.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "first", "last", "many")).alias("rims")).hint("shuffle_hash")
    cut = docs.join(grouped, _same(docs, grouped)).select(docs["doc_id"], docs["text_hash"], "text", "rims")
    cut = cut.mapInArrow(_cut_contexts, f"anchor long, doc_id long, text_hash long, first int, many boolean, {HALF}")
    crowded = rims.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor")
    level = 0
    while crowded.take(1):
        cut = written(cut, f"suffix-rims-{level}") if not level else cut
        spans = spans.unionByName(_sorted(cut.join(crowded, "anchor", "left_anti"), size))
        level += 1
        found = _classified(cut.join(crowded, "anchor", "left_semi").mapInArrow(_halved, f"{KEY}, {HALF}, more boolean, many boolean"), f"{KEY}, {HALF}", f"suffix-halves-{level}")
        spans, cut = spans.unionByName(_spans(found)), found.where("rim")
        size = cut.agg(F.coalesce(F.sum(F.length("raw") + 1), F.lit(1)).alias("bytes")).first()["bytes"]
        # Halves of windows at one place are settled, but for a context or two at a task's edge.
        crowded = cut.where("low < high").groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor")
    return spans.unionByName(_sorted(cut, size))


def _sorted(cut: DataFrame, size: int) -> DataFrame:
    """Spans of the windows that are repeated among contexts of size bytes, by sorted shards; a task has several in a large corpus."""
    shards = cut.select("anchor", "doc_id", "text_hash", "first", "many", "raw").repartition(min(-(-size // SHARD_BYTES), MOST_TASKS), "anchor")
    return shards.sortWithinPartitions("anchor").mapInArrow(_sorted_shards, SPANS)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document row."""
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    spans = repeated_spans(docs).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")).hint("shuffle_hash")
    all_ = docs.join(spans, _same(docs, spans), "left").select(docs["doc_id"], "text", "spans")
    return all_.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
