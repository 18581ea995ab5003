"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint bit is set if over half of the XXH64 hashes of a text's 3-word shingles have it. Documents whose
fingerprints differ in at most `RADIUS` bits are linked, and a component is what links reach.

Links come from structured bit masks. Each bit i has a label m(i) of RADIUS + 1 bits; the mask of a non-zero v keeps the
bits with <m(i), v> = 1 (mod 2). Any RADIUS bits leave some non-zero v orthogonal to all their labels, so two fingerprints
within the radius agree on the whole mask of that v: they collide in one of 2^(RADIUS+1) - 1 tables for certain.

Distinct fingerprints alone are hashed, so exact copies cost nothing here. A bucket of up to `BUCKET` fingerprints is
compared in blocks and gives at most one link less than it has members. A larger one is dealt again by the masks of its
own free bits, level by level; at the last level so few bits are free that its size is bounded by construction.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows each give a row; a null doc_id takes part
but names no component. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import checkpointed, small_batches, written

RADIUS, SHINGLE, SEED = 3, 3, 42
TABLES = (1 << (RADIUS + 1)) - 1
BUCKET = 1500
#: Levels of masks: 64, about 32, 16 and 8 free bits.
LEVELS = 3
_ROWS = 50_000
_ALL = (1 << 64) - 1


def masks(bits: int, level: int = 0) -> list[int]:
    """The TABLES masks over the set bits of `bits`; labels rotate with the level, so that levels split differently."""
    at = [i for i in range(64) if bits >> i & 1]
    label = {i: (k * 7 + level) % TABLES + 1 for k, i in enumerate(at)}
    return [sum(1 << i for i in at if (label[i] & v).bit_count() & 1) for v in range(1, TABLES + 1)]


def fingerprint(text: str | None) -> int:
    """64 bits of a whole text; zero without a word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _ROWS):
        ones += np.unpackbits(hashes[i : i + _ROWS].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def linked(own: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to the smallest reached) that join what lies within the radius among distinct unsigned fingerprints."""
    n, root = len(own), np.arange(len(own))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    step = max(1, 2_000_000 // max(1, n))
    for i in range(0, n, step):
        near = np.bitwise_count(own[i : i + step, None] ^ own[None, :]) <= radius
        near &= np.arange(n)[None, :] > np.arange(i, min(n, i + step))[:, None]
        for a, b in zip(*np.nonzero(near), strict=True):
            if (x := top(int(a) + i)) != (y := top(int(b))):
                root[max(x, y)] = min(x, y)
    tops = np.array([top(i) for i in range(n)], dtype=np.int64)
    moved = tops != np.arange(n)
    return own[moved], own[tops[moved]]


def _bucket_links(last: bool):
    """Rows sorted by bucket in; links out, and the rows of buckets that are too large, marked for the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "free"]

        def rows(a: np.ndarray, b: np.ndarray, free: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, free)], names)

        def close(parts: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
            if size > 1:
                a, b = linked(np.unique(np.concatenate(parts)))
                yield rows(a, b, np.zeros(len(a), dtype=np.uint64))

        key, parts, size, over = None, [], 0, False
        for batch in batches:
            fp, free, bucket = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            if not len(fp):
                continue
            kept = fp & ~free
            new = np.flatnonzero((kept[1:] != kept[:-1]) | (free[1:] != free[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(fp)]])
            lone = np.diff(bounds) == 1
            for j, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if (this := (kept[lo], free[lo], bucket[lo])) != key:
                    if not over:
                        yield from close(parts, size)
                    key, parts, size, over = this, [], 0, False
                if lone[j] and 0 < j < len(lone) - 1:
                    key = None  # alone in its bucket
                    continue
                parts.append(fp[lo:hi])
                size += hi - lo
                if size > BUCKET and not last:
                    own = np.concatenate(parts)
                    yield rows(own, own, np.full(len(own), key[1]))
                    parts, over = [], True
        if not over:
            yield from close(parts, size)

    return run


def links(fps: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) among distinct fingerprints fps(fp), enough to join every pair within the radius by a path.

    Level by level: rows (fp, free) are keyed by the masks of the bits that are still free; the bucket is all but those.
    """
    spark = fps.sparkSession
    todo, found = fps.select("fp"), None
    frees = {_ALL}
    for level in range(levels):
        if level == 0:
            lefts = todo.select("fp", F.explode(F.array(*[F.lit(_signed(~m & _ALL)) for m in masks(_ALL)])).alias("left"))
        else:  # 225 or 3375 rows
            table = [(_signed(f), _signed(f & ~m)) for f in frees for m in masks(f, level)]
            lefts = todo.join(F.broadcast(spark.createDataFrame(table, "free long, left long")), "free").select("fp", "left")
        dealt = lefts.select("fp", F.col("left").alias("free"), F.xxhash64("left", F.col("fp").bitwiseAND(F.bitwise_not("left"))).alias("bucket"))
        dealt = dealt.repartition("free", "bucket").sortWithinPartitions("free", "bucket", "fp")
        out = checkpointed(dealt.mapInArrow(_bucket_links(level == levels - 1), "a long, b long, free long"))
        own = out.where("free = 0").select("a", "b")
        found = own if found is None else found.unionByName(own)
        todo = out.where("free != 0").select(F.col("a").alias("fp"), "free")
        if not todo.take(1):
            break
        frees = {f & ~m for f in frees for m in masks(f, level)}
    return found.distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def roots(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components as (a, root): every node of edges (a, b) with the smallest node that it reaches.

    Alternates large-star and small-star steps, each an aggregate and a join, until nothing changes; neighbours are never
    collected. What reaches the driver is one count and checksum a round.
    """
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.where("a != b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select("a", F.col("b").alias("root"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most RADIUS bits."""
    small_batches(docs.sparkSession)
    fps = written(fingerprints(docs), "simhash-fp")
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    to_root = roots(links(distinct.select("fp")))
    named = distinct.join(to_root.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component, the one of smallest doc_id each; all columns stay.

    Rows of null doc_id go unless their component has no other id. Of rows that repeat a doc_id, all with the kept id stay.
    """
    found = simhash_components(docs).where("doc_id <=> component_id").select("doc_id").distinct().hint("shuffle_hash")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
