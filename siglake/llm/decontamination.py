"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of at most `PASSAGE` words; a block of about `BLOCK` items, or of `BLOCK_CHARS`
   characters, is dealt with at a time.
2. Document frequencies of the block's words are counted over all documents.
3. A randomised SVD of the passages' TF-IDF matrix, computed by partial products on the executors, gives a latent space.
4. Overlapping windows of every whole document are folded into that space. Passages of cosine `COSINE` or more are
   candidates; neither their number nor that of windows is capped. What the space doesn't carry is found by words: a leak
   holds a known number of a passage's words, so however many of the commonest are left out, a known number of the others
   is in its stretch. Every stretch that holds them is a candidate too, hence no leak is lost to the rank or the cosine.
   Both look at `CHUNK` words at a time, of one long text or several short ones, so memory doesn't grow with a text; chunks of
   a text share more than any stretch needs. A candidate in a chunk that lacks too many of a passage's words is dropped at once.
5. A candidate is a leak if the longest common subsequence with a stretch of the document covers `SAME` of the passage's
   words, or `LIKE` of them and the passage's answer, its last sentence, is there as well (a paraphrase).

Null and empty texts and items give nothing. Ties: a document and item give one row, of the best passage, and of equal ones
the nearest, then the earliest. Repeated rows of a doc_id: one row. Rows of null doc_id are not reported. Empty tables give no rows. Other
columns are not read; the benchmark needs item_id and text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches, written

PASSAGE, STEP, RANK, OVERSAMPLE, SEED = 64, 32, 160, 16, 42
#: Documents are summed up in stretches of HOP words; windows of 2 and 4 of them meet passages up to and over SMALL words.
HOP, SMALL = 16, 24
COSINE, SAME, LIKE, ANSWER = 0.6, 0.8, 0.6, 0.5
#: More than products of 32-bit vectors of length 1 may be off.
ROUNDING = 1e-4
#: Items whose words, vectors and texts are held by a worker at once.
BLOCK, BLOCK_CHARS = 2000, 2_000_000
#: Words of a document that are looked at at once, and those that it shares with the next chunk; both whole stretches.
CHUNK, OVERLAP = 4096, 512
#: Chunks of short texts that are looked at together, at most.
TOGETHER = 64
#: Characters of a text that are made words at once.
PIECE = 1 << 20
#: Passages of fewer words match only word for word.
SHORT = 8
MATCHES = "doc_id long, item_id long, cosine double, lcs double, answer double, at long"
_marks = bytes(32 if not (chr(i).isalnum() or i > 127) else i for i in range(256))
_sentence = re.compile(r"(?<=[.!?:;\n])\s+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII marks and white space part them."""
    return text.lower().encode("utf-8", "replace").translate(_marks).split() if text else []


def chunks_of(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of overlapping chunks that cover a text's words; one chunk if they are few."""
    own, first, at, n = [], 0, 0, len(text or "")
    while at < n:
        to = at + PIECE
        while to < n and (text[to] > "\x7f" or text[to].isalnum()):
            to += 1
        own += words_of(text[at:to])
        at = to
        while len(own) > CHUNK + OVERLAP:
            yield first, own[: CHUNK + OVERLAP]
            own, first = own[CHUNK:], first + CHUNK
    if own:
        yield first, own


def passages_of(text: str | None) -> list[tuple[list[bytes], list[bytes]]]:
    """(words, words of the answer) of each passage of an item."""
    words = words_of(text)
    answer = words_of(([x for x in _sentence.split(text.strip()) if words_of(x)] or [""])[-1]) if text else []
    starts = range(0, max(1, len(words) - STEP), STEP)
    return [(words[i : i + PASSAGE], answer if i == starts[-1] else []) for i in starts if words]


def groups_of(texts: list[str | None]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Chunks of texts as (text, place of the first word, words), together as many words as a chunk holds at most."""
    group, n = [], 0
    for k, text in enumerate(texts):
        for first, words in chunks_of(text):
            if group and (n + len(words) > CHUNK + OVERLAP or len(group) == TOGETHER):
                yield group
                group, n = [], 0
            group.append((k, first, words))
            n += len(words)
    if group:
        yield group


def bits_of(pattern: list[bytes]) -> dict[bytes, int]:
    """A bit for each place of a word in the pattern."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs(pattern: list[bytes], words: list[bytes], bits: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence."""
    at = bits or bits_of(pattern)
    full = open_ = (1 << len(pattern)) - 1
    for w in words:
        if m := open_ & at.get(w, 0):
            open_ = (open_ + m | open_ - m) & full
    return len(pattern) - open_.bit_count()


def stretch_words(n: int) -> int:
    """Words of the stretches that a passage of n words is compared with."""
    return n + n // 4 + 2


def best_stretch(pattern: list[bytes], words: list[bytes], least: int = 0) -> tuple[int, int]:
    """Longest common subsequence with any stretch a little longer than the pattern, and the first stretch that has it; 0, 0 if it is below least.

    A stretch that holds fewer of the pattern's words than that, or no more than the best so far has in common, isn't compared.
    """
    span, step = stretch_words(len(pattern)), max(1, len(pattern) // 8)
    bits = bits_of(pattern)
    upto = [0, *accumulate(w in bits for w in words)]
    best, at = 0, 0
    for i in range(0, max(1, len(words) - span + step), step):
        if upto[min(i + span, len(words))] - upto[i] >= max(least, best + 1) and (n := lcs(pattern, words[i : i + span], bits)) >= max(least, best + 1):
            best, at = n, i
    return best, at


def least_common(n: int, answered: bool) -> int:
    """Least common subsequence with which a passage of n words can be a leak."""
    least = 1.0 if n < SHORT else LIKE if answered else SAME
    return next(k for k in range(n + 1) if k / n >= least)


class Block:
    """Items of one block: words, vectors in the latent space, passages."""

    def __init__(self, items: list[tuple[int, str]]):
        self.passages = [(item, words, answer) for item, text in items for words, answer in passages_of(text)]
        self.counts = [Counter(words) for _, words, _ in self.passages]
        vocabulary = sorted({w for _, words, _ in self.passages for w in words})
        self.words = {w: k + 1 for k, w in enumerate(vocabulary)}  # 0: any other word
        self.idf = np.zeros(len(self.words) + 1, dtype=np.float32)

    def index(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(0)), dtype=np.int32, count=len(words))

    def rows(self) -> list[tuple[list[int], list[float]]]:
        """TF-IDF of each passage, of length 1."""
        out = []
        for _, words, _ in self.passages:
            n = Counter(self.words[w] for w in words)
            x = np.array([c * self.idf[k] for k, c in n.items()])
            out.append((list(n), (x / max(np.linalg.norm(x), 1e-12)).tolist()))
        return out

    def index_words(self) -> None:
        """For each passage its rarer words, and how many of them any leak holds: half of what it must hold in all, or more.

        The commonest words are left out while their number is within the other half, so this is a bound and no estimate.
        """
        self.rare, self.least, self.hops = [], [], []
        self.needed = [least_common(len(words), bool(answer)) for _, words, answer in self.passages]
        for (_, words, _), own, most in zip(self.passages, self.counts, self.needed, strict=True):
            least = most
            kept = []
            for w in sorted(own, key=lambda w: (self.idf[self.words[w]], w)):
                if 2 * (least - own[w]) >= most:
                    least -= own[w]
                else:
                    kept.append((self.words[w], own[w]))
            self.rare.append(tuple(np.array(x, dtype=np.int64) for x in zip(*kept, strict=True)))
            self.least.append(least)
            self.hops.append(-(-(stretch_words(len(words)) + HOP - 1) // HOP))
        self.least, self.hops = np.array(self.least), np.array(self.hops)
        of = np.concatenate([k for k, _ in self.rare])
        order = np.argsort(of, kind="stable")
        self.column = np.repeat(np.arange(len(self.rare)), [len(k) for k, _ in self.rare])[order]
        self.weight = np.concatenate([n for _, n in self.rare])[order]
        self.first = np.searchsorted(of[order], np.arange(len(self.words) + 2))

    def postings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, place in `column` and `weight`) of all passages of which the words are rarer ones."""
        n = self.first[words + 1] - self.first[words]
        return np.repeat(np.arange(len(words)), n), np.repeat(self.first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def possible(self, index: np.ndarray, chunk: np.ndarray, n_chunks: int) -> np.ndarray:
        """Whether a chunk holds enough of a passage's rarer words (chunks x passages); index, chunk: of each known word."""
        size, n = len(self.words) + 1, len(self.least)
        own, words = np.divmod(np.unique(chunk * size + index), size)
        of, at = self.postings(words)
        return np.bincount(own[of] * n + self.column[at], self.weight[at], minlength=n_chunks * n).reshape(n_chunks, n) >= self.least

    def sharing(self, index: np.ndarray, chunk: np.ndarray, hop: np.ndarray, n_hops: np.ndarray, possible: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(chunk, first stretch, passage) of every window that holds enough of the passage's rarer words.

        index, chunk, hop: word, chunk and stretch within the chunk of each known word; n_hops: stretches of each chunk.
        """
        own, passage = np.nonzero(possible)
        if not len(own):
            return
        pair = np.zeros(possible.shape, dtype=np.int64)
        pair[own, passage] = np.arange(len(own))
        size = n_hops[own]
        first = np.cumsum(size) - size
        there = np.flatnonzero(possible.any(axis=1)[chunk])
        of, at = self.postings(index[there])
        of, to = there[of], self.column[at]
        kept = possible[chunk[of], to]
        of, to, weight = of[kept], to[kept], self.weight[at][kept]
        held = np.bincount(first[pair[chunk[of], to]] + hop[of], weight, minlength=size.sum())
        upto = np.concatenate([[0], np.cumsum(held)])
        of = np.repeat(np.arange(len(own)), size)
        i = np.arange(len(of)) - first[of]
        end = first[of] + np.minimum(i + self.hops[passage[of]], size[of])
        k = np.flatnonzero(upto[end] - upto[:-1] >= self.least[passage[of]])
        yield from zip(own[of[k]].tolist(), i[k].tolist(), passage[of[k]].tolist(), strict=True)

    def project(self, basis: np.ndarray) -> None:
        """basis: a row for each word."""
        self.by_word = (basis * self.idf[:, None]).astype(np.float32)
        own = np.array([self.by_word[self.index(words)].sum(axis=0) for _, words, _ in self.passages])
        own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        small = np.array([len(words) <= SMALL for _, words, _ in self.passages])
        self.sizes = [(hops, np.flatnonzero(which), own[which]) for hops, which in ((2, small), (4, ~small)) if which.any()]
        self.vectors = own


def document_frequencies(docs: DataFrame, block: Block) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each word of the block, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shared.value.words, Counter()
        known = frozenset(own)
        for b in batches:
            for text in b.column(0).to_pylist():
                there: set[bytes] = set()
                for _, words in chunks_of(text):
                    there |= known.intersection(words)
                n.update(there)
        yield pa.RecordBatch.from_arrays([pa.array([own[w] for w in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(block.words) + 1, dtype=np.int64)
    for r in counted:
        n[r["word"]] = r["n"]
    return n, docs.count()


def randomised_basis(rows: DataFrame, n_features: int, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """Right singular vectors (features x rank) of sparse rows(at array<int>, x array<double>).

    A random start is multiplied by A'A twice, each time from the partial products of at most 8 tasks; the second product
    also gives the eigenvalues by Rayleigh and Ritz.
    """
    spark = rows.sparkSession
    width = min(rank + OVERSAMPLE, n_features)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_features, width)))[0]
    for _ in range(2):
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            z = np.zeros_like(q)
            for b in batches:
                for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = np.asarray(x, dtype=np.float32)
                    z[at] += own[:, None] * (own @ q[at])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], ["z"])

        z = sum(np.frombuffer(r["z"], dtype=np.float32).reshape(basis.shape).astype(float) for r in rows.mapInArrow(partial, "z binary").collect())
        values, turn = np.linalg.eigh(basis.T @ z)
        last, basis = basis, np.linalg.qr(z)[0]
    order = np.argsort(-values)[:rank]
    return last @ turn[:, order]


def fitted(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> Block:
    spark = docs.sparkSession
    block = Block(items)
    n, total = document_frequencies(docs, block)
    block.idf = np.log((1 + total) / (1 + n)).astype(np.float32) + 0.1
    block.idf[0] = 0
    block.index_words()
    rows = spark.createDataFrame(block.rows(), "at array<int>, x array<double>").repartition(max(1, min(8, len(block.passages) // 500)))
    block.project(randomised_basis(rows, len(block.words) + 1, rank))
    return block


def candidates(parts: np.ndarray, real: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, first stretches) of the windows that are near a passage or nearly so, by size, passage and stretch.

    Rows that aren't real part the chunks: they are zero, and no window begins there. A product of matrices rounds by
    their shapes, which depend on the texts at hand, so `window_cosine` decides what is near.
    """
    windows, hops = parts, 1
    for most, own, vectors in block.sizes:
        while hops < most:
            windows, last = windows.copy(), windows
            windows[:-hops] += last[hops:]
            hops *= 2
        least = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        least = np.where(real, (COSINE - ROUNDING) * np.maximum(least, 1e-6), np.float32(np.inf))
        j, i = np.divmod(np.flatnonzero(vectors @ windows.T >= least), len(parts))
        yield own[j], i


def window_cosine(parts: np.ndarray, i: int, n: int, j: int, block: Block) -> float:
    """The best cosine of passage j with the n windows from i on, whatever other texts are looked at together."""
    hops = 2 if len(block.passages[j][1]) <= SMALL else 4
    near = [parts[k : k + hops].sum(axis=0) for k in range(i, min(i + n, len(parts)))]
    return max(float(x @ block.vectors[j]) / max(float(np.linalg.norm(x)), 1e-6) for x in near)


def leaks_of(text: str | None, block: Block) -> dict[int, tuple[float, float, float, int]]:
    """item -> (lcs, answer, cosine, first word) of a whole text."""
    return leaks_in([text], block)[0]


def leaks_in(texts: list[str | None], block: Block) -> list[dict[int, tuple[float, float, float, int]]]:
    """For each whole text item -> (lcs, answer, cosine, first word)."""
    found: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
    for group in groups_of(texts):
        for g, item, (share, told, cosine, at) in found_in([words for _, _, words in group], block):
            k, first, _ = group[g]
            best = found[k]
            if item not in best or (share, cosine, -at - first) > (best[item][0], best[item][2], -best[item][3]):
                best[item] = (share, told, cosine, at + first)
    return found


def summed(index: np.ndarray, row: np.ndarray, n_rows: int, block: Block) -> np.ndarray:
    """Sums of the words' vectors by row, one word after the other; rows are in order."""
    n = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    n, first = n[order], first[order]
    sums, own = np.zeros((n_rows, block.by_word.shape[1]), dtype=np.float32), np.empty((n_rows, block.by_word.shape[1]), dtype=np.float32)
    for k in range(n[0]):
        m = np.count_nonzero(n > k)
        sums[:m] += np.take(block.by_word, index[first[:m] + k], axis=0, out=own[:m], mode="clip")
    own[order] = sums
    return own


def found_in(chunks: list[list[bytes]], block: Block) -> Iterator[tuple[int, int, tuple[float, float, float, int]]]:
    """(chunk, item, (lcs, answer, cosine, first word)) of every candidate that is a leak.

    The stretches of all chunks are rows of one matrix, in which three rows of zeros, the most a window may reach beyond
    its first stretch, follow each chunk.
    """
    sizes = np.array([len(words) for words in chunks])
    n_hops = -(-sizes // HOP)
    starts, row0 = np.cumsum(sizes) - sizes, np.cumsum(n_hops + 3) - n_hops - 3
    n_rows = int((n_hops + 3).sum())
    index = block.index(list(chain.from_iterable(chunks)))
    known = np.flatnonzero(index)
    index, chunk = index[known].astype(np.int64), np.repeat(np.arange(len(chunks)), sizes)[known]
    hop = (known - starts[chunk]) // HOP
    parts = summed(index, row0[chunk] + hop, n_rows, block)
    chunk_of_row = np.repeat(np.arange(len(chunks)), n_hops + 3)
    real = np.arange(n_rows) - row0[chunk_of_row] < n_hops[chunk_of_row]
    possible = block.possible(index, chunk, len(chunks))

    def enough(g: int, j: int, lo: int, hi: int) -> bool:
        """A common subsequence can't be longer than the words in common."""
        own = block.counts[j]
        return sum(map(own.__getitem__, own.keys() & chunks[g][max(0, lo) : hi])) >= block.needed[j]

    def near() -> Iterator[tuple[int, int, int, int, int, int]]:
        for j, row in candidates(parts, real, block):
            kept = possible[chunk_of_row[row], j]
            j, row = j[kept], row[kept]
            if not len(j):
                continue
            cuts = np.flatnonzero((j[1:] != j[:-1]) | (row[1:] != row[:-1] + 1)) + 1
            of = chunk_of_row[row]
            i = row - row0[of]
            of, j, i = of.tolist(), j.tolist(), i.tolist()
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
                n = len(block.passages[j[lo]][1])
                if enough(of[lo], j[lo], HOP * i[lo] - n, HOP * i[hi - 1] + PASSAGE + n):
                    for k in range(lo, hi):
                        yield of[k], i[k], 1, j[k], HOP * i[k] - n, HOP * i[k] + PASSAGE + n

    shared = ((g, i, int(block.hops[j]), j) for g, i, j in block.sharing(index, chunk, hop, n_hops, possible))
    sharing = ((g, i, n, j, HOP * i, HOP * (i + n)) for g, i, n, j in shared)
    for by_cosine, (g, i, n, j, lo, hi) in chain(zip(repeat(True), near(), strict=False), zip(repeat(False), sharing, strict=False)):
        item, pattern, answer = block.passages[j]
        if not enough(g, j, lo, hi):
            continue
        lo = max(0, lo)
        region = chunks[g][lo:hi]
        common, at = best_stretch(pattern, region, block.needed[j])
        share = common / len(pattern)
        stretch = set(region[at : at + 2 * len(pattern)])
        told = sum(w in stretch for w in answer) / len(answer) if answer else 0.0
        if share < (1.0 if len(pattern) < SHORT else SAME) and (share < LIKE or len(pattern) < SHORT or told < ANSWER):
            continue
        cosine = window_cosine(parts[row0[g] : row0[g] + n_hops[g]], i, n, j, block)
        if cosine >= COSINE or not by_cosine:
            yield g, item, (share, told, cosine, lo + at)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_items: int = BLOCK) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, at (first word): one row for each document and item that leaks into it."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    out = spark.createDataFrame([], MATCHES)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // BLOCK_CHARS))
    for k in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        if not Block(own).passages:
            continue
        shared = spark.sparkContext.broadcast(fitted(docs, own, rank))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = leaks_in(b.column(1).to_pylist(), shared.value)
                rows = [(doc, item, x[2], x[0], x[1], x[3]) for doc, own in zip(b.column(0).to_pylist(), found, strict=True) for item, x in own.items()]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in MATCHES.split(", ")])

        out = out.unionByName(docs.where("doc_id is not null").mapInArrow(search, MATCHES))
    best = F.max_by(F.struct("cosine", "lcs", "answer", "at"), F.struct("lcs", "cosine", -F.col("at"), "answer"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, with all columns; rows of null doc_id can't be told and stay."""
    found = written(leaks(docs, benchmark).select(F.col("doc_id").alias("leaky")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"] == found["leaky"], "left_anti")
