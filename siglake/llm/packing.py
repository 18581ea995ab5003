"""Best-fit packing with certified bounds.

Documents become token ids with a closing id; those longer than a sequence are cut into full pieces and a rest. Pieces are
dealt into partitions of `PART_ROWS` or so, and each partition packs its own by best-fit decreasing. Dual feasible
functions over the histogram of lengths give a lower bound of its number of sequences: a partition that meets it is
certified. The others put the pieces of all sequences that aren't full into a pool, which is dealt anew, so that they
exchange documents, and packed again, for as long as a round saves sequences.

Null text: empty, one piece of the closing id. Repeated rows and null doc_id: pieces of their own. Equal lengths keep the
order in which they come. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches, written
from siglake.llm.tokens import default_tokenizer_path, encoder

LENGTH, PART_ROWS = 2048, 100_000
#: Low bits of a sequence's id for its place in a partition, then those of partition and round.
PLACE, PART = 23, 24
CLOSING = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, offset long, used long, gap long"


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of each document row."""
    path = tokenizer or default_tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = own.packed(text) + CLOSING
                for k, i in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[i : i + 4 * length]
                    rows.append((doc, k, k * length, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, size: int = LENGTH) -> int:
    """Sequences that any packing needs, by dual feasible functions of the lengths."""
    n = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    best = -(-int(n @ x) // size)
    many, weight = np.cumsum(n[::-1])[::-1], np.cumsum(n * x)
    for a in range(1, size // 2 + 1):  # lengths over size - a count whole, those under a not at all
        whole = int(many[size - a + 1])
        best = max(best, whole + -(-int(weight[size - a] - weight[a - 1]) // size))
    for k in range(1, 17):  # rounding (k + 1) x / size down, unless it is whole
        up = (k + 1) * x
        f = np.where(up % size == 0, x * k, up // size * size)
        best = max(best, -(-int(n @ f) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and tokens in each sequence."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    some, used = 0, []  # bit r: a sequence has room for exactly r
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        if fits := some >> need:
            r = need + (fits & -fits).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, at = size, len(used)
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += need
        if left := r - need:
            room[left].append(at)
            some |= 1 << left
    return bins, offsets, np.array(used, dtype=np.int64)


def _packed(size: int, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [b for b in batches if b.num_rows]
        if not own:
            return
        t = pa.Table.from_batches(own).combine_chunks()
        lengths = t["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, size)
        gap = len(used) - lower_bound(lengths, size)
        part = (round_ << PLACE + PART) + (TaskContext.get().partitionId() << PLACE)
        more = {"bin": bins + part, "offset": offsets, "used": used[bins], "gap": np.full(len(bins), gap)}
        for name, x in more.items():
            t = t.append_column(name, pa.array(x, pa.int64()))
        yield from t.to_batches(max_chunksize=10_000)

    return run


def packed(cut: DataFrame, length: int = LENGTH, part_rows: int = PART_ROWS) -> DataFrame:
    """Pieces with sequence_id, offset, the tokens in their sequence, and gap: 0 where the partition is certified."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def deal(df: DataFrame, round_: int) -> DataFrame:
        parts = max(1, -(-df.count() // part_rows))
        return written(df.select(*names).repartition(parts).mapInArrow(_packed(length, round_), PLACED), f"packing-{round_}")

    done, now = None, deal(cut, 0)
    for round_ in count(1):
        settled = (F.col("gap") == 0) | (F.col("used") == length)
        pool, parts = now.where(~settled), now.select("bin", "gap").distinct()
        state = parts.agg(F.coalesce(F.max("gap"), F.lit(0)).alias("gap"), F.countDistinct(F.shiftright("bin", PLACE)).alias("parts")).first()
        if state["gap"] == 0 or state["parts"] < 2:
            break
        again = deal(pool, round_)
        before, after = (df.select("bin").distinct().count() for df in (pool, again))
        if after >= before:
            break
        kept = now.where(settled)
        done = kept if done is None else done.unionByName(kept)
        now = again
    out = now if done is None else done.unionByName(now)
    return out.select(*names, F.col("bin").alias("sequence_id"), "offset", "used", "gap")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    small_batches(docs.sparkSession)
    return packed(written(pieces(docs, tokenizer, length), "packing-pieces"), length)
